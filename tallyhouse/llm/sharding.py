"""Balanced label propagation: documents move to their neighbours' shard under capacity quotas.

Documents of equal text are neighbours. Rows start in shards by hash. In each round the rows of a
cluster (a text's documents; texts with many are cut into clusters of a quarter shard) ask for the shard
where most of them are, and a shard admits clusters, in order of a hash, as far as its quota of linked
rows goes; clusters turned away ask again, any shard with room where none of their own has it. Counts by cluster and shard
decide, so no group of copies meets in one task. Rows without neighbours cross no edge wherever they
are, so they make room: at the end each shard keeps its first rows up to its quota, linked rows before
the others, and the rows beyond fill the shards that are short, in order. Counts differ by one at most.

Defined results: null text is empty, with 0 bytes; empty texts are equal; null ids and repeated rows
are rows like any other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import saved, texts, with_rank

SHARDS = 40
OVERHEAD = 16
ROUNDS = 4
#: Rows of a shard that are ordered in one task.
STRETCH_ROWS = 50_000


def by_shard(values: list[int], shard: Column) -> Column:
    """The value of a shard, from a list with one for each."""
    return F.element_at(F.array(*[F.lit(x).cast("long") for x in values]), shard + 1)


def linked_rows(rows: DataFrame, most: int) -> DataFrame:
    """uid, cluster and start shard of the rows whose text others share; clusters of about ``most`` rows."""
    groups = saved(rows.groupBy("text_key").agg(F.count("*").alias("n")).filter("n > 1"), "groups")
    part = F.pmod(F.xxhash64("uid"), F.ceil(F.col("n") / most))
    return rows.join(groups, "text_key").select("uid", F.xxhash64("text_key", part).alias("cluster"), "shard")


def draw(*of: Column | str) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*of), F.lit(1 << 30)) / F.lit(float(1 << 30))


def asked_shards(waiting: DataFrame, room: list[int], number: int) -> DataFrame:
    """cluster, shard and n: the shard that each waiting cluster asks for in a round.

    The one with room that holds most of the cluster, ties by a hash of cluster, shard and round; where
    none of its shards has room, one drawn by the room that shards have left.
    """
    free = by_shard(room, F.col("shard")) > 0
    tie = F.xxhash64("cluster", "shard", F.lit(number))
    best = F.max_by("shard", F.when(free, F.struct("n", tie.alias("tie")))).alias("best")
    found = waiting.groupBy("cluster").agg(best, F.sum("n").alias("n"))
    ends = [sum(room[: k + 1]) for k in range(len(room))]
    at = draw("cluster", F.lit(-1 - number)) * F.lit(float(ends[-1]))
    other = reduce(lambda a, b: a + b, [(at >= F.lit(float(end))).cast("int") for end in ends])
    return found.select("cluster", F.coalesce("best", F.least(other, F.lit(len(room) - 1))).alias("shard"), "n")


def within_room(asked: DataFrame, room: list[int], number: int, stretches: int) -> DataFrame:
    """The clusters that fit into their shard's room, in order of a hash of cluster and round.

    A shard's clusters are cut into ``stretches`` by that hash; rows of earlier stretches are added, so
    that no shard is ordered in one task.
    """
    turned = asked.withColumn("turn", draw("cluster", F.lit(number))).withColumn("stretch", F.floor(F.col("turn") * stretches))
    sums = turned.groupBy("shard", "stretch").agg(F.sum("n").alias("rows"))
    earlier = Window.partitionBy("shard").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("shard", "stretch", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    own = Window.partitionBy("shard", "stretch").orderBy("turn", "cluster").rowsBetween(Window.unboundedPreceding, 0)
    reached = turned.withColumn("reached", F.sum("n").over(own)).join(sums, ["shard", "stretch"])
    return reached.filter(F.col("before") + F.col("reached") <= by_shard(room, F.col("shard"))).select("cluster", "shard", "n")


def propagate(linked: DataFrame, quotas: list[int], rounds: int = ROUNDS) -> DataFrame:
    """The shard of each admitted ``cluster``; those for which no room was found are absent."""
    counts = saved(linked.groupBy("cluster", "shard").agg(F.count("*").alias("n")), "counts")
    room, admitted, waiting = list(quotas), [], counts
    stretches = 1 + sum(quotas) // (len(quotas) * STRETCH_ROWS)
    for number in range(rounds):
        if not any(room):
            break
        taken = saved(within_room(asked_shards(waiting, room, number), room, number, stretches), "admitted")
        for r in taken.groupBy("shard").agg(F.sum("n").alias("n")).collect():
            room[r["shard"]] -= r["n"]
        admitted.append(taken.select("cluster", "shard"))
        waiting = saved(waiting.join(taken.select("cluster"), "cluster", "left_anti"), "waiting")
        if waiting.isEmpty():
            break
    return reduce(DataFrame.union, admitted) if admitted else counts.select("cluster", "shard").limit(0)


def balanced_shards(
    docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; the shards' counts differ by one at most."""
    rows = texts(docs, id_col, text_col)
    rows = rows.select(
        F.monotonically_increasing_id().alias("uid"),
        "doc_id",
        (F.octet_length("text") + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
        F.unhex(F.md5(F.encode("text", "UTF-8"))).alias("text_key"),
    )
    rows = saved(rows.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int")), "rows")
    total = rows.count()
    quotas = [total // shards + (k < total % shards) for k in range(shards)]
    linked = saved(linked_rows(rows, max(1, total // shards // 4)), "linked")
    homes = propagate(linked, quotas, rounds).withColumnRenamed("shard", "home")
    moved = linked.join(homes, "cluster", "left").select("uid", "cluster", F.coalesce("home", "shard").alias("home"))
    placed = rows.select("uid", "shard").join(moved, "uid", "left")
    placed = saved(placed.select("uid", F.coalesce("home", "shard").alias("shard"), "cluster"), "placed")
    held = [0] * shards
    for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect():
        held[r["shard"]] = r["n"]

    stretches = 1 + total // (shards * STRETCH_ROWS)
    alone = F.col("cluster").isNull()
    spread = F.when(alone, stretches + F.pmod(F.xxhash64("uid"), F.lit(stretches))).otherwise(F.pmod(F.col("cluster"), F.lit(stretches)))
    ranked = with_rank(placed, ["shard"], [F.col("cluster"), F.col("uid")], "rank", spread, stretches)
    spare = [max(0, x - y) for x, y in zip(held, quotas, strict=True)]
    short = [max(0, y - x) for x, y in zip(held, quotas, strict=True)]
    before = lambda some: [sum(some[:k]) for k in range(shards)]
    quota = by_shard(quotas, F.col("shard"))
    number = by_shard(before(spare), F.col("shard")) + F.col("rank") - quota
    ranked = ranked.withColumn("number", F.when(F.col("rank") >= quota, number))
    #: Rows beyond their shard's quota, numbered through all shards, go to the shard whose share of gaps holds the number.
    ends = [x + y for x, y in zip(before(short), short, strict=True)]
    to = reduce(lambda a, b: a + b, [(F.col("number") >= F.lit(end)).cast("int") for end in ends])
    ranked = ranked.withColumn("to", F.when(F.col("number").isNotNull(), to))
    slot = by_shard(held, F.col("to")) + F.col("number") - by_shard(before(short), F.col("to"))
    final = ranked.select("uid", F.coalesce("to", "shard").alias("_shard"), F.when(F.col("to").isNull(), F.col("rank")).otherwise(slot).alias("slot"))
    out = rows.join(final, "uid")
    return out.select("doc_id", "size", "text_crc32", F.col("_shard").alias("shard"), F.col("slot").cast("long").alias("slot"))
