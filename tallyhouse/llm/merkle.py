"""Merkle manifest of a dataset: digests of rows, of their trees, and a proof for every row.

A leaf is the digest of a row's fields. The leaves of a tree (rows of one ``lang``) are ranked by id;
while several nodes remain, every two consecutive ones become their digest (an odd last one alone).
The trees' last nodes, ordered by tree, give the root in the same way.

Every node is a row labelled with the interval [low, high) of leaf ranks that it covers, so no links
between nodes are kept. A leaf's ancestors are the nodes whose interval contains its rank: nodes and
ranks are bucketed by ``rank >> level`` and joined on tree, level and bucket. A node's sibling is what
its parent's interval has besides its own: the difference [parent low, low) or [high, parent high) is
looked up among the nodes of the level; it is empty where a parent has one child.

A leaf is not joined with all of its ancestors, as nodes near the root would meet every leaf. Levels
are taken in bands of ``BAND``: the nodes at the foot of a band are joined with the ancestors in it,
at most ``2 ** BAND`` to a node, and inherit the path of their ancestor at the foot of the next band.

Defined results: nulls are hashed as ``-``; a null id sorts first, rows that repeat an id by their
digest; rows that repeat everything are leaves of their own; texts are hashed whole; other columns are
not read; an empty table has no trees and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import saved
from tallyhouse.operators.ranking import number_rows

#: Levels between the joins of nodes with the paths above them.
BAND = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as it is hashed: its UTF-8 byte count, a colon and itself; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    return digest(*[field(changed.get(name, F.col(name))) for name in FIELDS])


def tree_key(name: Column) -> Column:
    """A tree's key: sorts as the name's bytes, null first, and is never null."""
    return F.coalesce(F.concat(F.lit("="), name.cast("string")), F.lit(""))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``low``: the rank from 0 within ``tree``, by ``order``; a range sort of all rows, counted by partition."""
    placed = saved(number_rows(rows, [F.col("tree"), *order], "_number"), "numbered")
    first = saved(placed.groupBy("tree").agg(F.min("_number").alias("_first")), "first")
    return placed.join(first, "tree").withColumn("low", F.col("_number") - F.col("_first")).drop("_number", "_first")


def height(n: Column) -> Column:
    """Levels above the leaves of a tree of ``n`` leaves: the digits of n - 1 in base two."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def build(leaves: DataFrame) -> DataFrame:
    """Nodes (tree, height, level, low, high, digest) over leaves (tree, low, leaf): a level a round, each written."""
    sizes = saved(leaves.groupBy("tree").agg(height(F.count("*")).alias("height")), "heights")
    level = leaves.join(sizes, "tree").select("tree", "height", F.lit(0).alias("level"), "low", (F.col("low") + 1).alias("high"), F.col("leaf").alias("digest"))
    nodes = level = saved(level, "level")
    top = sizes.agg(F.max("height")).first()[0] or 0
    for k in range(top):
        children = level.filter(F.col("height") > k)
        both = F.sort_array(F.collect_list(F.struct("low", "digest")))["digest"]
        parents = children.groupBy("tree", "height", F.shiftright("low", k + 1).alias("at")).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sha2(F.array_join(both, ""), 256).alias("digest"))
        level = saved(parents.select("tree", "height", F.lit(k + 1).alias("level"), "low", "high", "digest"), "level")
        nodes = nodes.unionByName(level)
    return nodes


def siblings(nodes: DataFrame) -> DataFrame:
    """Nodes below a root with the digest of the sibling (empty without one) and whether it stands before."""
    parents = nodes.select(F.col("tree").alias("ptree"), (F.col("level") - 1).alias("plevel"), F.col("low").alias("plow"), F.col("high").alias("phigh"))
    within = (nodes["tree"] == parents["ptree"]) & (nodes["level"] == parents["plevel"])
    same = F.expr("shiftright(low, level + 1) = shiftright(plow, plevel + 1)")
    placed = nodes.filter("level < height").join(parents, within & same & (F.col("low") >= F.col("plow")) & (F.col("high") <= F.col("phigh")))
    before = F.col("plow") < F.col("low")
    placed = placed.select(*nodes.columns, before.alias("before"), F.when(before, F.col("plow")).otherwise(F.col("high")).alias("from"), F.when(before, F.col("low")).otherwise(F.col("phigh")).alias("to"))
    others = nodes.select(F.col("tree").alias("otree"), F.col("level").alias("olevel"), F.col("low").alias("olow"), F.col("high").alias("ohigh"), F.col("digest").alias("other"))
    found = (placed["tree"] == others["otree"]) & (placed["level"] == others["olevel"]) & (F.col("from") == F.col("olow")) & (F.col("to") == F.col("ohigh"))
    return placed.join(others, found, "left").select(*nodes.columns, "before", F.coalesce("other", F.lit("")).alias("sibling"))


def paths(nodes: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """tree, low and path of every leaf: structs (level, before, sibling) from the leaf to the root, then ``above``.

    ``above`` (tree, path) continues the paths of a tree's root.
    """
    beside = saved(siblings(nodes), "siblings")
    kind = "array<struct<level:int,before:boolean,sibling:string>>"
    roots = nodes.filter("level = height").select("tree", "height", F.col("low").alias("at"))
    if above is None:
        roots = roots.withColumn("path", F.array().cast(kind))
    else:
        roots = roots.join(above, "tree")
    roots = saved(roots, "roots")
    top = roots.agg(F.max("height")).first()[0] or 0
    found: DataFrame | None = None
    for foot in range(top // BAND * BAND, -1, -BAND):
        feet = nodes.filter((F.col("level") == foot) & (F.col("height") > foot)).select("tree", "height", "low")
        steps = feet.withColumn("level", F.explode(F.expr(f"sequence({foot}, least({foot + BAND}, height) - 1)")))
        up = beside.filter(F.col("level").between(foot, foot + BAND - 1)).select(
            F.col("tree").alias("utree"), F.col("level").alias("ulevel"), F.col("low").alias("ulow"), F.col("high").alias("uhigh"), "before", "sibling"
        )
        contains = (F.col("low") >= F.col("ulow")) & (F.col("low") < F.col("uhigh"))
        bucketed = (steps["tree"] == up["utree"]) & (steps["level"] == up["ulevel"]) & F.expr("shiftright(low, level) = shiftright(ulow, ulevel)")
        own = steps.join(up, bucketed & contains).groupBy("tree", "low").agg(F.sort_array(F.collect_list(F.struct("level", "before", "sibling"))).cast(kind).alias("own"))
        own = own.withColumn("at", F.shiftright("low", foot + BAND))
        ends = roots.filter((F.col("height") > foot) & (F.col("height") < foot + BAND)).select(F.col("tree").alias("rtree"), "at", "path")
        if found is not None:
            ends = ends.unionByName(found.select(F.col("tree").alias("rtree"), F.shiftright("low", foot + BAND).alias("at"), "path"))
        joined = own.join(ends, (own["tree"] == ends["rtree"]) & (own["at"] == ends["at"]))
        joined = joined.select("tree", "low", F.concat("own", "path").alias("path"))
        alone = roots.filter(F.col("height") == foot).select("tree", F.col("at").alias("low"), "path")
        found = joined.unionByName(alone)
        if foot:
            found = saved(found, "paths")
    return found


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and the siblings on its path give."""
    step = lambda at, s: F.sha2(F.when(s["before"], F.concat(s["sibling"], at)).otherwise(F.concat(at, s["sibling"])), 256)
    return F.aggregate(path, leaf, step)


def proof(path: Column) -> Column:
    """The digest of the siblings on a path, in order."""
    return F.sha2(F.array_join(F.transform(path, lambda s: s["sibling"]), ""), 256)


def manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, path, proof_sha256, folded_root and verified of every row.

    ``folded_root`` starts from the leaf of the row as it is where ``tampered`` holds: one more in n_chars.
    """
    changed = F.when(tampered & F.col("n_chars").isNotNull(), leaf_digest(n_chars=F.col("n_chars") + 1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree_key(F.col("lang")).alias("tree"), leaf_digest().alias("leaf"), changed.alias("changed"))
    rows = ranked(saved(rows, "leaves"), [F.col("doc_id").asc_nulls_first(), F.col("leaf")])
    nodes = build(rows.select("tree", "low", "leaf"))
    subroots = nodes.filter("level = height").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("digest").alias("leaf"))
    trees = saved(ranked(saved(subroots, "subroots"), [F.col("name")]), "trees")
    top = build(trees.select("tree", "low", "leaf"))
    root = top.filter("level = height").select("digest").first()
    upper = saved(trees.join(paths(top), ["tree", "low"]).select(F.col("name").alias("tree"), "path", F.col("leaf").alias("subroot")), "upper")
    whole = paths(nodes, upper.select("tree", "path"))
    joined = rows.join(whole, ["tree", "low"]).join(upper.select("tree", "subroot"), "tree")
    value = F.lit(root.digest if root else None).cast("string")
    folded = fold(F.coalesce("changed", "leaf"), F.col("path"))
    out = joined.select("doc_id", "leaf", "subroot", value.alias("root"), "path", proof(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
