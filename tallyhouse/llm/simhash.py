"""SimHash near-dedup by the generalised pigeonhole principle.

A fingerprint has a bit set where over half of the shingles' hashes have it. Distinct fingerprints
are linked at ``distance`` or fewer differing bits. For the search the 64 bits are grouped into
partitions: bits whose values go together share one. Partition p gets its own threshold t(p), -1 for
none, with sum(t) = distance - partitions + 1; by the pigeonhole principle a pair within ``distance``
lies within t(p) on some partition. Thresholds come from dynamic programming over candidate counts
estimated by comparing a fixed number of fingerprints with all; the number of partitions is chosen by
the same estimate. The plan only decides the cost: every candidate is verified on all bits, and every
linked pair is a candidate.

Fingerprints that agree on a partition are compared within their group. Groups above ``GROUP`` are
first split again, by the same principle over the bits left, which ends because a group that agrees on
all but eleven bits cannot be larger. Tasks send on the links that join something, no others.

Defined results: null or empty text has fingerprint zero and is linked like any other; null ids are
never the smallest unless a component has no other; repeated rows get the same answer; other columns
are not read; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import saved, shuffle_partitions, texts

BITS = 64
SHINGLE = 3
DISTANCE = 2
SEED = 42
#: Fingerprints that are compared with all others to estimate candidates.
QUERIES = 64
#: Largest group whose fingerprints are compared with each other.
GROUP = 2048
#: Cost of a signature against that of a candidate, for the choice of partitions.
SIGNATURE_COST = 4.0
BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits of one text (UTF-8): A-Z lowered, words joined by a space."""
    words = text.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(x) + 1 for x in words])
    starts = [0, *ends[:-1].tolist()][:n]
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        some = hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8)
        counts += np.add.reduce(np.unpackbits(some, axis=1, bitorder="little"), axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, hash (xxhash64 of the text) and fp (the 64 bits as a signed long) of every row."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_buffer().to_pybytes(), shingle) for x in batch.column("text")]
            values = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), values], ["doc_id", "hash", "fp"])

    rows = texts(docs, id_col, text_col).withColumn("hash", F.xxhash64("text"))
    return rows.mapInArrow(marked, "doc_id long, hash long, fp long")


def _values(batch: pa.RecordBatch, column: str = "fp") -> np.ndarray:
    return batch.column(column).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def bit_correlation(fps: DataFrame) -> np.ndarray:
    """Correlation of the bits over all fingerprints: 64 x 64 sums reach the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, rows = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = np.unpackbits(_values(batch).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            rows += len(bits)
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(both.ravel()), pa.array(np.full(BITS * BITS, rows))], ["i", "j", "n", "rows"])

    sums = fps.mapInArrow(counted, "i long, j long, n double, rows long").groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))
    both, rows = np.zeros((BITS, BITS)), 1
    for r in sums.collect():
        both[r.i, r.j], rows = r.n, max(1, r.rows)
    mean = both.diagonal() / rows
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    return (both / rows - np.outer(mean, mean)) / np.outer(spread, spread)


def group_bits(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """Even partitions of the bits; the next bit goes where it correlates most with those placed."""
    strength = np.abs(correlation) - np.eye(BITS)
    order = np.argsort(-strength.sum(axis=1), kind="stable").tolist()
    sizes = [BITS // parts + (p < BITS % parts) for p in range(parts)]
    groups: list[list[int]] = []
    for size in sizes:
        group = [order.pop(0)]
        while len(group) < size:
            best = max(order, key=lambda b: strength[b, group].sum())
            order.remove(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def candidate_counts(fps: DataFrame, queries: np.ndarray, masks: list[int], distance: int) -> np.ndarray:
    """Fingerprints within t bits of a query on each mask, over all queries; [mask, t]."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((len(masks), distance + 1))
        for batch in batches:
            values = _values(batch)
            for query in queries:
                apart = values ^ query
                for k, mask in enumerate(masks):
                    found[k] += np.bincount(np.minimum(np.bitwise_count(apart & np.uint64(mask)), distance + 1), minlength=distance + 2)[: distance + 1]
        k, t = np.divmod(np.arange(found.size), distance + 1)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(t), pa.array(found.ravel())], ["k", "t", "n"])

    out = np.zeros((len(masks), distance + 1))
    for r in fps.mapInArrow(counted, "k long, t long, n double").groupBy("k", "t").agg(F.sum("n").alias("n")).collect():
        out[r.k, r.t] = r.n
    return out.cumsum(axis=1)


def allocate(costs: np.ndarray, distance: int) -> tuple[float, list[int]]:
    """Thresholds (-1: not probed) of least cost that sum to distance - partitions + 1; costs[p, t + 1]."""
    parts = len(costs)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for p in range(parts):
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t in range(-1, distance + 1):
                option = (cost + costs[p, t + 1], [*chosen, t])
                if total + t not in step or option < step[total + t]:
                    step[total + t] = option
        best = step
    return best[distance - parts + 1]


def signatures(bits: int, threshold: int) -> int:
    return sum(len(list(itertools.combinations(range(bits), k))) for k in range(threshold + 1))


def plan(fps: DataFrame, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """Partitions of the bits and their thresholds."""
    correlation = bit_correlation(fps)
    queries = np.array([r.fp for r in fps.orderBy(F.xxhash64("fp")).limit(QUERIES).collect()], np.int64).view(np.uint64)
    options = [group_bits(correlation, parts) for parts in range(max(2, distance), distance + 3)]
    masks = [mask_of(bits) for option in options for bits in option]
    counts = candidate_counts(fps, queries, masks, distance) / max(1, len(queries))
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for option in options:
        own, counts = counts[: len(option)], counts[len(option) :]
        costs = np.zeros((len(option), distance + 2))
        for p, bits in enumerate(option):
            costs[p, 1:] = [own[p, t] + SIGNATURE_COST * signatures(len(bits), t) for t in range(distance + 1)]
        cost, thresholds = allocate(costs, distance)
        if best is None or cost < best[0]:
            best = (cost, [(bits, t) for bits, t in zip(option, thresholds, strict=True) if t >= 0])
    return best[1]


KEYED = "part int, value long, fp long, probe boolean, rest long"


def _keyed(fps: DataFrame, planned: list[tuple[list[int], int]]) -> DataFrame:
    """A row for each partition and signature; ``probe``: by flipped bits."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _values(batch)
            for part, (bits, threshold) in enumerate(planned):
                mask = mask_of(bits)
                rest = np.full(len(values), np.uint64(~mask & (1 << BITS) - 1)).view(np.int64)
                for k in range(threshold + 1):
                    for flipped in itertools.combinations(bits, k):
                        key = (values & np.uint64(mask)) ^ np.uint64(mask_of(list(flipped)))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(values), part, np.int32)), pa.array(key.view(np.int64)), pa.array(values.view(np.int64)), pa.array(np.full(len(values), k > 0)), pa.array(rest)],
                            ["part", "value", "fp", "probe", "rest"],
                        )

    return fps.select("fp").mapInArrow(rows, KEYED)


def _split(keyed: DataFrame, distance: int) -> DataFrame:
    """Rows of large groups under keys that also hold a share of the bits left."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest, values, old = _values(batch, "rest"), _values(batch), _values(batch, "value")
            parts = batch.column("part").to_numpy(zero_copy_only=False)
            for mask in np.unique(rest):
                own = rest == mask
                bits = [b for b in range(BITS) if int(mask) >> b & 1]
                for p in range(distance + 1):
                    share = np.uint64(mask_of(bits[p :: distance + 1]))
                    key = (old[own] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(p + 1)) ^ (values[own] & share) * np.uint64(0xC2B2AE3D27D4EB4F)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(parts[own]), pa.array(key.view(np.int64)), pa.array(values[own].view(np.int64)), batch.column("probe").filter(pa.array(own)), pa.array(np.full(own.sum(), mask & ~share).view(np.int64))],
                        ["part", "value", "fp", "probe", "rest"],
                    )

    return keyed.mapInArrow(rows, KEYED)


class Forest:
    """Which values are joined already."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(up, up)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _links(keyed: DataFrame, distance: int) -> DataFrame:
    """Links (a < b) within groups of equal key: compared at each offset, groups side by side."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def compared(part: np.ndarray, value: np.ndarray, fp: np.ndarray, probe: np.ndarray) -> pa.RecordBatch:
            new = np.r_[True, (part[1:] != part[:-1]) | (value[1:] != value[:-1])] if len(fp) else np.zeros(0, bool)
            group = np.cumsum(new)
            sizes = np.bincount(group) if len(group) else np.zeros(1, int)
            many = sizes[group] > 1
            group, fp, probe = group[many], fp[many], probe[many]
            forest, out = Forest(), []
            at = np.arange(len(fp))
            for d in range(1, int(sizes.max(initial=0))):
                at = at[at + d < len(fp)]
                at = at[group[at] == group[at + d]]
                near = at[(np.bitwise_count(fp[at].view(np.uint64) ^ fp[at + d].view(np.uint64)) <= distance) & ~(probe[at] & probe[at + d]) & (fp[at] != fp[at + d])]
                out += [(a, b) if a < b else (b, a) for a, b in zip(fp[near].tolist(), fp[near + d].tolist(), strict=True) if forest.join(a, b)]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "value", "fp", "probe")]
            held = [np.concatenate(x) for x in zip(held, columns, strict=True)] if held else columns
            other = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
            if len(other):  # the last group may go on in the next batch
                last = int(other[-1]) + 1
                yield compared(*[x[:last] for x in held])
                held = [x[last:] for x in held]
        if held:
            yield compared(*held)

    return keyed.select("part", "value", "fp", "probe").mapInArrow(rows, "a long, b long")


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links between distinct fingerprints (column fp) that connect all those within ``distance``."""
    keyed = _keyed(fps, plan(fps, distance))
    spark, out = fps.sparkSession, []
    while True:
        keyed = saved(keyed, "signatures")
        large = saved(keyed.groupBy("part", "value").agg(F.count("*").alias("n"), F.max(F.bit_count("rest")).alias("free")).filter(f"n > {GROUP} and free > 11").select("part", "value"), "large")
        some = not large.isEmpty()
        small = keyed.join(large, ["part", "value"], "left_anti") if some else keyed
        small = small.repartition(shuffle_partitions(spark), "part", "value").sortWithinPartitions("part", "value")
        out.append(saved(_links(small, distance).distinct(), "links"))
        if not some:
            break
        keyed = _split(keyed.join(large, ["part", "value"], "left_semi"), distance)
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (its component's smallest node) of all nodes of edges (a, b).

    Alternating large and small stars: each round hangs the larger neighbours of a node, then the
    smaller ones, on its smallest neighbour, until nothing changes. Links of one round are written.
    """
    edges = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = saved(small.filter("u <> v").distinct(), "edges")
        same = new.exceptAll(edges).isEmpty() and edges.exceptAll(new).isEmpty()
        edges = new
        if same:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def near_dedup(
    docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, hash, fp, root (a fingerprint that stands for the component) and component_id (its smallest id)."""
    rows = saved(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = saved(components(links(distinct, distance)), "roots")
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", "hash", "fp", "root", "component_id")
