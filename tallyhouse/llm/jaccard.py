"""Jaccard join of documents by a blocked sparse product of the document by n-gram incidence matrix.

Rows of the matrix are documents, columns their distinct n-grams as 64-bit hashes. Overlaps of two
documents are an entry of the matrix times its transpose; only entries that can reach the wanted
similarity are computed. A document of n grams needs ``need(n)`` of them in any partner, a pair of n
and m grams ``pair_need(n, m)``. These bounds discard, in this order:

1. Documents: columns are cut into blocks by hash. Each block is told the 32 low bits of its grams and
   answers how many occur once in the corpus; a document with too few grams left has no partner. Two
   grams that are alike in block and bits only keep a document for longer.
2. Columns: grams of the documents left are ordered from rare to frequent. A pair of enough overlap
   shares one of each document's first ``n - need(n) + 1``, so the product needs those columns alone.
3. Pairs: by sizes, and as soon as the overlap counted in the first blocks of columns and the most that the
   rest can add don't reach ``pair_need``.

Documents of one set of grams are one row of the matrix. A column of many documents is first multiplied
with single rows (pivots), and what these links connect isn't multiplied any more: large groups of near
copies take a few products a document. Rows of a column that are still apart after that are multiplied
with each other, in blocks of rows where the column is large, so no component is missed.

Defined results: null or wordless text has no grams and is linked with nothing; fewer words than a gram
has are one gram; null ids are never the smallest unless a component has no other; repeated rows get the
same answer; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import partition_id, saved, shuffle_partitions, texts
from tallyhouse.llm.simhash import Forest, components
from tallyhouse.llm.words import mixed

NGRAM = 3
#: Least similarity in percent.
PERCENT = 90
#: Matrix entries and documents that are sent to the column blocks at a time.
CHUNK, CHUNK_DOCS = 1 << 20, 4096
#: Characters of text for which a column block is added beyond the shuffle partitions.
BLOCK_CHARS = 1 << 26
#: Products with single rows, one for each row, before all pairs left are tested.
PIVOTS = 4
#: Column blocks of a pair's product.
PRODUCT_BLOCKS = 8
#: Rows of a column up to which they are multiplied pair by pair, larger ones in blocks that carry the rows' sets.
SMALL = 64
#: Matrix entries of a column's rows that are multiplied with as many at a time.
BLOCK_ENTRIES = 1 << 20


def gram_set(text: bytes, ngram: int = NGRAM) -> np.ndarray:
    """Ascending distinct hashes of a text's word n-grams, A-Z lowered."""
    words = text.lower().split()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(ngram, len(words))
    if not width:
        return hashes
    grams = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        grams = mixed(grams ^ hashes[k : len(words) - width + 1 + k]) + np.uint64(0x9E3779B97F4A7C15)
    return np.unique(mixed(grams))


def need(n: int | np.ndarray, percent: int = PERCENT) -> int | np.ndarray:
    """Grams that a document of n shares with any partner."""
    return -(-percent * n // 100)


def need_column(n: Column, percent: int) -> Column:
    return F.ceil(n * percent / 100).cast("long")


def pair_need(n: np.ndarray, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Grams that documents of n and m share at least."""
    return -(-percent * (n + m) // (100 + percent))


def _pair_need(n: str, m: str, percent: int) -> Column:
    return F.ceil((F.col(n) + F.col(m)) * percent / (100 + percent)).cast("long")


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    ends, grams = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    return [grams[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


REQUESTS = "block long, chunk long, at long, doc_id long, hash long, cls binary, n long, prints binary, docs binary, counts binary"
ANSWERS = "chunk long, at long, doc_id long, hash long, cls binary, n long, docs binary, counts binary"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _u4(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4")


def _requests(rows: DataFrame, ngram: int, blocks: int) -> DataFrame:
    """A row for each document, and one for each chunk of documents and column block: the grams' low bits."""
    schema = _schema(REQUESTS)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, ids, sets, total = partition_id() << 32, [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            at = range(len(sets))
            yield _batch(schema, [((chunk + k) % blocks, chunk, k, *ids[k], len(sets[k]), None, None, None) for k in at])
            owners = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            grams = np.concatenate(sets)
            block = ((grams >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
            order = np.argsort(block, kind="stable")
            low, owners, block = grams.astype("<u4")[order], owners[order], block[order]
            edges = np.flatnonzero(np.diff(block)) + 1
            out = []
            for low_, own, b in zip(np.split(low, edges), np.split(owners, edges), block[np.r_[0, edges]] if len(block) else [], strict=False):
                docs, counts = np.unique(own, return_counts=True)
                out.append((int(b), chunk, None, None, None, None, None, low_.tobytes(), docs.astype("<u4").tobytes(), counts.astype("<u4").tobytes()))
            yield _batch(schema, out)

        for batch in batches:
            for doc_id, hash_, text in zip(batch.column("doc_id").to_pylist(), batch.column("hash").to_pylist(), batch.column("text"), strict=True):
                grams = gram_set(text.as_buffer().to_pybytes(), ngram)
                ids.append((doc_id, hash_, xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None))
                sets.append(grams)
                total += len(grams)
                if total >= CHUNK or len(sets) >= CHUNK_DOCS:
                    yield from flush()
                    chunk, ids, sets, total = chunk + 1, [], [], 0
        if sets:
            yield from flush()

    return rows.mapInArrow(sent, REQUESTS)


def _answers(requests: DataFrame) -> DataFrame:
    """For each chunk and column block: how many grams of its documents occur once; documents pass through."""
    schema = _schema(ANSWERS)

    def answered(block: list[dict]) -> Iterator[pa.RecordBatch]:
        if not block:
            return
        prints = [_u4(x["prints"]) for x in block]
        joined = np.concatenate(prints)
        order = np.argsort(joined)
        ranked = joined[order]
        other = np.r_[True, ranked[1:] != ranked[:-1], True]
        once = np.zeros(len(joined), np.int64)
        once[order] = other[:-1] & other[1:]
        start, out = 0, []
        for x, own in zip(block, prints, strict=True):
            sizes = _u4(x["counts"]).astype(np.int64)
            counts = np.add.reduceat(once[start : start + len(own)], np.r_[0, np.cumsum(sizes)[:-1]])
            start += len(own)
            some = counts > 0
            out.append((x["chunk"], None, None, None, None, None, _u4(x["docs"])[some].tobytes(), counts[some].astype("<u4").tobytes()))
        yield _batch(schema, out)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            asked = batch.filter(pc.is_valid(batch.column("prints")))
            passed = batch.filter(pc.is_null(batch.column("prints")))
            yield passed.select(schema.names)
            for x in asked.to_pylist():
                if held and held[-1]["block"] != x["block"]:
                    yield from answered(held)
                    held = []
                held.append(x)
        yield from answered(held)

    spark = requests.sparkSession
    return requests.repartition(shuffle_partitions(spark), "block").sortWithinPartitions("block").mapInArrow(rows, ANSWERS)


ROWS = "doc_id long, hash long, cls binary, n long, once long"


def gram_rows(docs: DataFrame, ngram: int = NGRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, hash (of the text), cls (of equal sets; null without words), n (set size) and once (grams that occur once)."""
    rows = texts(docs, id_col, text_col).withColumn("hash", F.xxhash64("text"))
    spark, schema = docs.sparkSession, _schema(ROWS)
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(4 * shuffle_partitions(spark), chars // BLOCK_CHARS)

    def told(chunk: list[dict]) -> pa.RecordBatch:
        own = sorted((x for x in chunk if x["at"] is not None), key=lambda x: x["at"])
        once = np.zeros(len(own), np.int64)
        for x in chunk:
            if x["at"] is None:
                once[_u4(x["docs"])] += _u4(x["counts"])
        return _batch(schema, [(x["doc_id"], x["hash"], x["cls"], x["n"], int(k)) for x, k in zip(own, once, strict=True)])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for x in batch.to_pylist():
                if held and held[-1]["chunk"] != x["chunk"]:
                    yield told(held)
                    held = []
                held.append(x)
        if held:
            yield told(held)

    answers = _answers(_requests(rows, ngram, blocks))
    answers = answers.repartition(shuffle_partitions(spark), "chunk").sortWithinPartitions("chunk")
    return answers.mapInArrow(summed, ROWS)


def gram_sets(docs: DataFrame, chosen: DataFrame, ngram: int = NGRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """cls, n and grams (ascending) of the chosen (doc_id, hash), one row for each set."""
    rows = texts(docs, id_col, text_col).withColumn("hash", F.xxhash64("text"))
    chosen = chosen.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"))
    chosen = chosen.hint("merge")  # they grow with the corpus, so they are never broadcast
    rows = rows.join(chosen, rows["doc_id"].eqNullSafe(chosen["_id"]) & (rows["hash"] == chosen["_hash"]), "left_semi")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [gram_set(x.as_buffer().to_pybytes(), ngram) for x in batch.column("text").slice(at, 256)]
                grams = pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(x) for x in sets])].astype(np.int32), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64()), grams], ["cls", "n", "grams"]
                )

    return rows.select("text").mapInArrow(made, "cls binary, n long, grams array<long>").dropDuplicates(["cls"])


def prefix_columns(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """gram, cls, n and place of the entries that the product needs: each row's rarest grams, without those that no other row has."""
    entries = sets.select("cls", "n", F.explode("grams").alias("gram"))
    shared = saved(entries.groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1"), "columns")
    grams = F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("grams")
    ranked = entries.join(shared, "gram").groupBy("cls", "n").agg(grams).withColumn("once", F.col("n") - F.size("grams"))
    ranked = ranked.withColumn("length", F.col("n") - need_column(F.col("n"), percent) + 1 - F.col("once")).filter("length > 0")
    first = ranked.select("cls", "n", "once", F.posexplode(F.slice("grams", 1, F.col("length").cast("int"))).alias("at", "g"))
    return first.select(F.col("g.gram").alias("gram"), "cls", "n", (F.col("once") + F.col("at")).alias("place"))


def _possible(percent: int) -> Column:
    """Whether entries (cls, n, place) and (cls2, n2, place2) of a column may belong to a linked pair: sizes, and what is left after the shared gram."""
    left = F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2"))
    sizes = F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent
    return (F.col("cls") != F.col("cls2")) & sizes & (left >= _pair_need("n", "n2", percent))


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.select(F.least("cls", "cls2").alias("a"), F.greatest("cls", "cls2").alias("b")).distinct()


def _second(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({x: f"{x}2" for x in ("cls", "n", "place", "root")})


def overlaps(left: list[np.ndarray], right: list[np.ndarray], percent: int = PERCENT, blocks: int = PRODUCT_BLOCKS) -> np.ndarray:
    """Overlap of each pair of ascending sets, summed over column blocks; -1 where the bound was not reached."""
    n, m = (np.array([len(x) for x in side], np.int64) for side in (left, right))
    least, sums, alive = pair_need(n, m, percent), np.zeros(len(n), np.int64), np.ones(len(n), bool)
    rest_n, rest_m = n.copy(), m.copy()
    edges = ((np.arange(1, blocks, dtype=np.uint64) << np.uint64(32)) // np.uint64(blocks)) << np.uint64(32)
    cuts = [[np.r_[0, np.searchsorted(x, edges), len(x)] for x in side] for side in (left, right)]
    for block in range(blocks):
        for k in np.flatnonzero(alive):
            a, b = cuts[0][k], cuts[1][k]
            own, other = left[k][a[block] : a[block + 1]], right[k][b[block] : b[block + 1]]
            if len(own) and len(other):
                at = np.searchsorted(other, own)
                sums[k] += np.count_nonzero(other[np.minimum(at, len(other) - 1)] == own)
            rest_n[k] -= len(own)
            rest_m[k] -= len(other)
        alive &= sums + np.minimum(rest_n, rest_m) >= least
    return np.where(alive, sums, -1)


def linked(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b and overlap of the pairs (a, b) of set classes that are alike enough."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = overlaps(_lists(batch.column("ga")), _lists(batch.column("gb")), percent)
            some = pa.array(found >= 0)
            yield pa.RecordBatch.from_arrays([batch.column(x).filter(some) for x in ("a", "b")] + [pa.array(found[found >= 0])], ["a", "b", "overlap"])

    joined = pairs.join(sets.select(F.col("cls").alias("a"), F.col("grams").alias("ga")), "a")
    joined = joined.join(sets.select(F.col("cls").alias("b"), F.col("grams").alias("gb")), "b")
    return joined.select("a", "b", "ga", "gb").mapInArrow(rows, "a binary, b binary, overlap long")


class Block:
    """A column's block of rows: their sets as a sparse matrix with a list of holders for each gram."""

    def __init__(self, sets: list[np.ndarray]):
        self.rows = len(sets)
        sizes = np.array([len(x) for x in sets])
        self.starts = np.r_[0, np.cumsum(sizes)]
        self.grams, self.local = np.unique(np.concatenate(sets), return_inverse=True)
        self.holders = np.repeat(np.arange(self.rows), sizes)[np.argsort(self.local, kind="stable")]
        self.columns = np.r_[0, np.cumsum(np.bincount(self.local))]

    def holders_of(self, locals_: np.ndarray) -> list[np.ndarray]:
        return [self.holders[self.columns[g] : self.columns[g + 1]] for g in locals_]

    def product(self, locals_: np.ndarray) -> np.ndarray:
        """How many of these grams each row has."""
        return np.bincount(np.concatenate([self.holders[:0], *self.holders_of(locals_)]), minlength=self.rows)


def block_links(rows: list[tuple], percent: int = PERCENT) -> list[tuple]:
    """Links (a, b, overlap) between rows (cls, root, place, side, prefix, grams) of one column that connect something new.

    A pair belongs to the first column that both have in their prefixes. Their overlap is counted over the
    prefixes, where what lies beyond can add ``need(n) - 1`` at most, and then over the other columns for the rows
    that are still possible. Rows of equal ``side`` are told apart from others only where both sides are here.
    """
    cls, root, place, side, prefix, grams = zip(*rows, strict=True)
    block, n = Block(list(grams)), np.array([len(x) for x in grams], np.int64)
    side, forest = np.array(side), Forest()
    _, roots = np.unique(np.array(root, object), return_inverse=True)
    two, out = side.min() != side.max(), []
    for a in range(len(rows)):
        own = np.searchsorted(block.grams, prefix[a])
        other = (np.minimum(n, n[a]) * 100 >= np.maximum(n, n[a]) * percent) & (roots != roots[a])
        other[: a + 1] = False
        if two:
            other &= side != side[a]
        if not other.any():
            continue
        first = np.full(len(rows), -1)
        for k, held in reversed([*enumerate(block.holders_of(own))]):
            first[held] = k
        shared, least = block.product(own), pair_need(n, n[a], percent)
        other &= (first == place[a]) & (shared + need(np.maximum(n, n[a]), percent) - 1 >= least)
        if not other.any():
            continue
        rest = np.setdiff1d(block.local[block.starts[a] : block.starts[a + 1]], own)
        shared += block.product(rest)
        for b in np.flatnonzero(other & (shared >= least)):
            if forest.join(int(roots[a]), int(roots[b])):
                out.append((cls[a], cls[b], int(shared[b])))
    return out


def column_links(entries: DataFrame, rooted: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b, overlap) between all rows of different roots that share a column, by blocks of a column's rows."""
    prefixes = entries.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("place", "gram"))).alias("p"))
    sizes = saved(rooted.groupBy("gram").agg(F.ceil(F.sum("n") / BLOCK_ENTRIES).cast("long").alias("blocks")), "sizes")
    rows = rooted.join(sizes, "gram").withColumn("side", F.pmod(F.xxhash64("cls"), "blocks"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"low": F.least("side", "with"), "high": F.greatest("side", "with")})
    rows = rows.join(prefixes, "cls").join(sets.select("cls", "grams"), "cls")
    within = (F.array_position(F.col("p.gram"), F.col("gram")) - 1).alias("place")
    rows = rows.select("gram", "low", "high", "cls", "root", within, "side", F.col("p.gram").alias("prefix"), "grams")
    schema = _schema("a binary, b binary, overlap long")

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            some = batch.drop_columns(["prefix", "grams"]).to_pydict()
            prefix, grams = _lists(batch.column("prefix")), _lists(batch.column("grams"))
            for k, new in enumerate(zip(some["gram"], some["low"], some["high"], strict=True)):
                if new != key and held:
                    yield _batch(schema, block_links(held, percent))
                    held = []
                key = new
                held.append((*(some[x][k] for x in ("cls", "root", "place", "side")), prefix[k], grams[k]))
        if held:
            yield _batch(schema, block_links(held, percent))

    blocks = rows.repartition(shuffle_partitions(entries.sparkSession), "gram", "low", "high").sortWithinPartitions("gram", "low", "high")
    return blocks.mapInArrow(multiplied, "a binary, b binary, overlap long")


def set_links(sets: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, overlap) that connect all rows of ``sets`` that are alike enough, and the roots (node, root) of their components."""
    entries = saved(prefix_columns(sets, percent), "prefixes")
    found: DataFrame | None = None
    roots: DataFrame | None = None
    for turn in range(PIVOTS + 1):
        if roots is None:
            rooted = entries.withColumn("root", F.col("cls"))
        else:
            rooted = entries.join(roots.withColumnRenamed("root", "_root"), entries["cls"] == roots["node"], "left")
            rooted = rooted.select(*entries.columns, F.coalesce("_root", "cls").alias("root"))
            rooted = saved(rooted, "rooted")
            apart = rooted.groupBy("gram").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most")
            apart = saved(apart.select("gram"), "open")
            if apart.isEmpty():
                break
            rooted = rooted.join(apart, "gram", "left_semi")
        if turn == PIVOTS:
            rows = F.count("*").alias("rows")
            many = saved(rooted.groupBy("gram").agg(rows).filter(F.col("rows") > SMALL).select("gram"), "large")
            few = rooted.join(many, "gram", "left_anti")
            joined = few.join(_second(few), "gram").filter((F.col("root") != F.col("root2")) & _possible(percent))
            alone = linked(saved(_pairs(joined.filter("cls < cls2")), "pairs"), sets, percent)
            large = column_links(entries, rooted.join(many, "gram", "left_semi"), sets, percent)
            new = saved(alone.unionByName(large), "links")
        else:
            first = F.min_by(F.struct("cls", "n", "place", "root"), F.struct(F.xxhash64("cls", F.lit(turn)), "cls")).alias("p")
            other = saved(rooted.groupBy("gram").agg(first).select("gram", "p.*"), "pivots")
            joined = rooted.join(_second(other), "gram").filter((F.col("root") != F.col("root2")) & _possible(percent))
            # a row's columns have several pivots; one of them is tried
            one = F.min_by("cls2", F.struct(F.xxhash64("cls2", F.lit(turn)), "cls2")).alias("cls2")
            pairs = saved(_pairs(joined.groupBy("cls").agg(one)), "pairs")
            new = saved(linked(pairs, sets, percent), "links")
        if not new.isEmpty():
            found = new if found is None else found.unionByName(new)
            roots = saved(components(found.select("a", "b")), "roots")
    if roots is None:
        found, roots = new, sets.select(F.col("cls").alias("node"), F.col("cls").alias("root")).limit(0)
    return found, roots


def jaccard_components(
    docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, hash, n_shingles, root (a set that stands for the component; null without words) and component_id (its smallest id)."""
    rows = saved(gram_rows(docs, ngram, id_col, text_col), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash")).alias("first")
    classes = saved(rows.filter("n > 0").groupBy("cls").agg(first, F.min("doc_id").alias("least"), F.first("n").alias("n"), F.min("once").alias("once")), "classes")
    possible = classes.filter(F.col("n") - F.col("once") >= need_column(F.col("n"), percent))
    sets = saved(gram_sets(docs, possible.select("first.doc_id", "first.hash"), ngram, id_col, text_col), "sets")
    _, roots = set_links(sets, percent)
    rooted = classes.join(roots, classes["cls"] == roots["node"], "left").select("cls", "least", F.coalesce("root", "cls").alias("root"))
    rooted = saved(rooted, "rooted")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = saved(rooted.join(smallest, "root").select("cls", "root", "component_id"), "named")
    wordless = rows.filter("n = 0").select("doc_id", "hash", F.col("n").alias("n_shingles"), F.lit(None).cast("binary").alias("root"), F.col("doc_id").alias("component_id"))
    return rows.filter("n > 0").join(named, "cls").select("doc_id", "hash", F.col("n").alias("n_shingles"), "root", "component_id").unionByName(wordless)
