"""Scores of texts under a Brown class-based bigram model.

A text is its words with A-Z lowered and one end token. Exchange clustering moves every training word to
the class that raises the likelihood of the class bigrams most.

It starts from a coarse clustering of a fixed number of units: the most frequent ``HEAD`` words, and
``FORMS`` groups of all others by the bytes they end with. The most frequent units found a class each;
every round twice as many units take part, until all do. Then each word starts in its unit's class and
is exchanged itself for ``ROUNDS`` rounds. Words lie in buckets by their hash, about ``BUCKET_WORDS`` in each;
a bucket knows which of its words each block has. In a round buckets tell the blocks the classes of their
words, blocks count (word, neighbour class) and send them to the buckets, and these weigh every class for
each of their words against the class bigram counts; alternate halves of the words move. What travels
between a block and a bucket is one row of compressed numbers; block pairs and buckets stay where they are.
Classes are a saved table that grows with the vocabulary; only the class bigram counts reach the driver. A
word that no training row has takes the class of its unit.

    P(word | before) = P(class | class before) * P(word | class)

Transitions are smoothed towards the class frequencies; each class keeps the share of one unknown word
of that class. Counts come from the training rows alone.

The corpus is read once, for blocks of about ``BLOCK_TOKENS`` tokens that hold their own vocabulary and
their texts as numbers in it. Blocks are scored with the counts of their own
words, which reach them from the buckets.

Defined results: null text is empty, which is the end token alone; null ids hash like the text '';
repeated rows are scored alike; without training rows all counts are 0; other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import NO_ID, partition_id, saved, texts

CLASSES = 64
HEAD = 4096
FORMS = 2048
FORM_BYTES = 4
#: Rounds of units that all take part in, before words are exchanged themselves.
STARTING = 1
#: Rounds in which every training word takes part.
ROUNDS = 8
#: Words that are weighed at a time.
WEIGHED = 4096
#: Words of blocks in a bucket, about.
BUCKET_WORDS = 500_000
#: Units whose neighbours share a row.
RANGE = 256
BLOCK_TOKENS = 2_000_000
#: Added to each count of a word, and the weight of class frequencies in transitions.
ADDED = 0.1
PRIOR = 10.0
COUNTED_PAIRS = 3_000_000

PAIRS = "block long, size int, odd binary, a binary, b binary, n binary"
SIDES = "range int, is_after boolean, codes binary, n binary"
ASKED = "bucket int, block long, words binary, n binary"
BUCKETS = "bucket int, words binary, n binary, blocks array<long>, places array<binary>"
ANSWERS = "block long, bucket int, classes binary, n binary"
SEEN = "bucket int, block long, codes binary, n binary"
STATE = "bucket int, classes binary"
BLOCKS = "block long, size int, words binary, ids binary, held_out binary, lengths binary, tokens binary"
WORDS = "word binary, n long"


def batch_of(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def packed(numbers: np.ndarray) -> bytes:
    """Small numbers as compressed bytes, those of equal worth together."""
    width = 4 if not len(numbers) or numbers.max() < 1 << 31 else 8
    planes = numbers.astype(f"<i{width}").view(np.uint8).reshape(-1, width).T.tobytes()
    return bytes([width]) + len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    width, size = data[0], int.from_bytes(data[1:9], "little")
    planes = np.frombuffer(pa.decompress(data[9:], size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(f"<i{width}")[:, 0].astype(np.int64)


def summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and the sum of each one's ``n``."""
    if not len(codes):
        return codes, n
    bits = int(n.max()).bit_length()
    if int(codes.max()).bit_length() + bits < 64:  # one sort of numbers holding both
        both = np.sort((codes << bits) | n)
        codes, n = both >> bits, both & ((1 << bits) - 1)
    else:
        order = np.argsort(codes)
        codes, n = codes[order], n[order]
    firsts = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[firsts], np.add.reduceat(n, firsts)


class Numbers(dict):
    """Numbers of words from 1 in the order of their first look-up."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self) + 1
        return number


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def word_counts(rows: DataFrame) -> DataFrame:
    """Words of the training rows and their counts."""
    cut = saved(blocks(rows), "blocks")
    return counted_words(vocabulary(cut, bucket_count(cut)))


@dataclass
class Units:
    """Words' units: head words first, then forms, then the end and the start of a text."""

    head: dict[bytes, int]
    forms: int = FORMS

    @property
    def end(self) -> int:
        return len(self.head) + self.forms

    @property
    def start(self) -> int:
        return self.end + 1

    def of(self, word: bytes) -> int:
        unit = self.head.get(word)
        if unit is None:
            unit = len(self.head) + int.from_bytes(word[-FORM_BYTES:], "little") * 0x9E3779B1 % (1 << 32) * self.forms // (1 << 32)
        return unit


def blocks(rows: DataFrame, tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Texts as numbers of their block's words; 0 is the end token."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = partition_id() << 24
        words = Numbers()
        ids: list[int] = []
        held: list[bool] = []
        texts_: list[np.ndarray] = []
        size = 0

        def block() -> pa.RecordBatch:
            lengths = np.array([len(x) for x in texts_], np.int64)
            tokens_ = np.concatenate([y for x in texts_ for y in (x, [0])]).astype(np.int32) if texts_ else np.zeros(0, np.int32)
            values = [number, len(words), b"\n".join(words), np.array(ids, np.int64).tobytes(), np.array(held, bool).tobytes(), (lengths + 1).tobytes(), tokens_.tobytes()]
            kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            for doc_id, held_out, value in zip(batch.column("id").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text"), strict=True):
                some = words_of(value.as_buffer().to_pybytes())
                texts_.append(np.fromiter(map(words.__getitem__, some), np.int32, len(some)))
                ids.append(doc_id)
                held.append(held_out)
                size += len(some) + 1
                if size >= tokens:
                    yield block()
                    number += 1
                    words, ids, held, texts_, size = Numbers(), [], [], [], 0
        if ids:
            yield block()

    return rows.select("id", "held_out", "text").mapInArrow(cut, BLOCKS)


@dataclass
class Block:
    words: list[bytes]
    ids: np.ndarray
    held_out: np.ndarray
    lengths: np.ndarray
    tokens: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Block:
        words = bytes(row["words"])
        return cls(
            words.split(b"\n") if words else [],
            np.frombuffer(row["ids"], np.int64),
            np.frombuffer(row["held_out"], bool),
            np.frombuffer(row["lengths"], np.int64),
            np.frombuffer(row["tokens"], np.int32),
        )

    def spread(self, of_words: np.ndarray, end: int) -> np.ndarray:
        """A value for each token, from one for each word and one for the end."""
        return np.concatenate([[end], of_words]).astype(np.int64)[self.tokens]

    def before(self, values: np.ndarray, start: int) -> np.ndarray:
        """The value before each token; ``start`` at the start of a text."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[np.cumsum(self.lengths) - self.lengths] = start
        return out


def unit_sides(cut: DataFrame, units: Units) -> DataFrame:
    """Counts of (unit before, unit) over the training texts, by ranges of either unit.

    ``codes`` are, ascending and as steps, the unit's place in its range * all units + the unit after (or before) it.
    """
    many = units.start + 1

    def rows_of(codes: np.ndarray, counts: np.ndarray, is_after: bool) -> list[tuple]:
        bounds = np.searchsorted(codes, np.arange(0, many + RANGE, RANGE) * many)
        pieces = [(k, codes[lo:hi] - k * RANGE * many, counts[lo:hi]) for k, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)) if lo < hi]
        return [(k, is_after, packed(np.diff(x, prepend=0)), packed(n)) for k, x, n in pieces]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def flushed() -> pa.RecordBatch:
            turned = codes % many * many + codes // many
            order = np.argsort(turned)
            return batch_of(SIDES, rows_of(codes, counts, True) + rows_of(turned[order], counts[order], False))

        for batch in batches:
            for row in batch.to_pylist():
                own = Block.of(row)
                values = own.spread(np.fromiter((units.of(x) for x in own.words), np.int64, len(own.words)), units.end)
                training = ~np.repeat(own.held_out, own.lengths)
                found, times = np.unique((own.before(values, units.start) * many + values)[training], return_counts=True)
                codes, counts = summed(np.concatenate([codes, found]), np.concatenate([counts, times]))
                if len(codes) > COUNTED_PAIRS:
                    yield flushed()
                    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield flushed()

    def merged(found: pa.Table) -> pa.Table:
        rows = found.to_pylist()
        out = []
        for is_after in (True, False):
            some = [r for r in rows if r["is_after"] == is_after]
            if some:
                codes = np.concatenate([np.cumsum(unpacked(r["codes"])) for r in some])
                codes, n = summed(codes, np.concatenate([unpacked(r["n"]) for r in some]))
                out.append((rows[0]["range"], is_after, packed(np.diff(codes, prepend=0)), packed(n)))
        return pa.Table.from_batches([batch_of(SIDES, out)])

    merged_sides = cut.mapInArrow(counted, SIDES).groupBy("range").applyInArrow(merged, SIDES)
    codes = lambda side: F.first(F.when(F.col("is_after") == side, F.struct("codes", "n")), ignorenulls=True)
    return merged_sides.groupBy("range").agg(codes(True).alias("after"), codes(False).alias("before"))


def x_log_x(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def best_classes(after: np.ndarray, before: np.ndarray, own: np.ndarray, pairs: np.ndarray, classes: int) -> np.ndarray:
    """The class of largest likelihood for each unit, its own counts taken out of the class counts.

    after[u, c], before[u, c]: counts of class c after and before unit u; pairs[c, d]: class bigrams.
    """
    out = own.copy()
    for u, mine in enumerate(own.tolist()):
        right, left = after[u], before[u]
        if not right.any() and not left.any():
            continue
        rest = pairs.copy()
        rest[mine] -= right
        rest[:, mine] -= left
        rest = np.maximum(rest, 0)
        ahead, behind = rest[:classes], rest[:, :classes].T
        gain = (x_log_x(ahead + right) - x_log_x(ahead)).sum(axis=1) + (x_log_x(behind + left) - x_log_x(behind)).sum(axis=1)
        both, r, l = rest[:classes, :classes].diagonal(), right[:classes], left[:classes]
        gain += x_log_x(both + r + l) + x_log_x(both) - x_log_x(both + r) - x_log_x(both + l)
        many, fore = ahead.sum(axis=1), behind.sum(axis=1)
        gain -= x_log_x(many + right.sum()) - x_log_x(many) + x_log_x(fore + left.sum()) - x_log_x(fore)
        best = int(gain.argmax())
        out[u] = best if mine >= classes or gain[best] > gain[mine] + 1e-9 else mine
    return out


def exchange(sides: DataFrame, units: Units, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Class of every unit, and the counts of class bigrams [before, class].

    The end is class ``classes``, the start the one after; they stay. Units that take no part yet are
    in a class beyond. ``sides`` are saved ``unit_sides``; a round returns a row for each unit.
    """
    many, outside = units.start + 1, classes + 2
    kinds = outside + 1

    def neighbours(row: dict, of: np.ndarray, kinds: int) -> list[np.ndarray]:
        """Counts of (unit of the range, class) after and before."""
        found = []
        for side in ("after", "before"):
            counts = np.zeros(RANGE * kinds)
            if row[side] is not None:
                unit, other = divmod(np.cumsum(unpacked(row[side]["codes"])), many)
                counts = np.bincount(unit * kinds + of[other], unpacked(row[side]["n"]), minlength=RANGE * kinds)
            found.append(counts.reshape(RANGE, kinds))
        return found

    def told(what):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    one, two, three = what(row)
                    yield pa.RecordBatch.from_arrays([pa.array(one.astype(np.int32)), pa.array(two.astype(np.int32)), pa.array(three.astype(np.int64))], ["one", "two", "n"])

        return sides.mapInArrow(rows, "one int, two int, n long")

    def totals_of(row: dict):
        counts = neighbours(row, np.zeros(many, np.int64), 1)[1][:, 0]
        unit = np.flatnonzero(counts)
        return unit + row["range"] * RANGE, unit, counts[unit]

    totals = np.zeros(many)
    for r in told(totals_of).collect():
        totals[r["one"]] = r["n"]
    rank = np.full(many, np.iinfo(np.int64).max)
    rank[np.argsort(-totals[: units.end], kind="stable")] = np.arange(units.end)
    of = np.full(many, outside)
    of[units.end], of[units.start] = classes, classes + 1
    of[rank < classes] = rank[rank < classes]

    def tallied(of: np.ndarray) -> np.ndarray:
        def cells(row: dict):
            own = of[row["range"] * RANGE :][:RANGE]
            table = np.zeros((kinds, kinds))
            np.add.at(table, own, neighbours(row, of, kinds)[0][: len(own)])
            one, two = np.nonzero(table)
            return one, two, table[one, two]

        out = np.zeros((kinds, kinds))
        for r in told(cells).groupBy("one", "two").agg(F.sum("n").alias("n")).collect():
            out[r["one"], r["two"]] = r["n"]
        return out

    def moved(of: np.ndarray, table: np.ndarray, moves: np.ndarray) -> DataFrame:
        def classes_of(row: dict):
            after, before = neighbours(row, of, kinds)
            unit = np.flatnonzero(moves[row["range"] * RANGE :][:RANGE] & (after.any(axis=1) | before.any(axis=1))[: many - row["range"] * RANGE])
            own = unit + row["range"] * RANGE
            return own, best_classes(after[unit], before[unit], of[own], table, classes), own

        return told(classes_of)

    taking, k = classes, 0
    while k < rounds:
        taking *= 2
        moves = (rank < taking) & ((of == outside) | (rank % 2 == k % 2))
        new = of.copy()
        for r in moved(of, tallied(of), moves).collect():
            new[r["one"]] = r["two"]
        new[(new == outside) & (rank < taking)] = 0  # units that never occur
        k += taking >= units.end
        of = new
    of[of == outside] = 0
    return of, tallied(of)[:outside, :outside]


def bucketed(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of words by bucket, their buckets in that order, and whether a word moves in odd rounds."""
    hashes = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in words), np.uint64, len(words))
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order], (hashes[order] & np.uint64(1)).astype(bool)


def bucket_count(cut: DataFrame) -> int:
    return (cut.agg(F.sum("size")).first()[0] or 0) // BUCKET_WORDS + 1


def asked_words(cut: DataFrame, buckets: int) -> DataFrame:
    """Words of each block by bucket, in the block's order, and their counts in its training texts."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = Block.of(row)
                order, bucket, _ = bucketed(own.words, buckets)
                n = np.bincount(own.tokens[~np.repeat(own.held_out, own.lengths)], minlength=len(own.words) + 1)[1:]
                firsts = np.flatnonzero(np.diff(bucket, prepend=-1))
                pieces = np.split(order, firsts[1:]) if len(firsts) else []
                yield batch_of(ASKED, [(int(bucket[at]), row["block"], b"\n".join([own.words[k] for k in some.tolist()]), packed(n[some])) for at, some in zip(firsts, pieces, strict=True)])

    return cut.mapInArrow(asked, ASKED)


def vocabulary(cut: DataFrame, buckets: int) -> DataFrame:
    """A row for each bucket: its words, their training counts, and for each block the places of its words."""

    def merged(asked: pa.Table) -> pa.Table:
        at: dict[bytes, int] = {}
        places, counts = [], []
        for words, n in zip(asked["words"], asked["n"], strict=True):
            some = words.as_py().split(b"\n")
            places.append(np.fromiter((at.setdefault(x, len(at)) for x in some), np.int64, len(some)))
            counts.append(unpacked(n.as_py()))
        n = np.bincount(np.concatenate(places), np.concatenate(counts)).astype(np.int64)
        row = (asked["bucket"][0].as_py(), b"\n".join(at), packed(n), asked["block"].to_pylist(), [packed(x) for x in places])
        return pa.Table.from_batches([batch_of(BUCKETS, [row])])

    return asked_words(cut, buckets).groupBy("bucket").applyInArrow(merged, BUCKETS)


def block_pairs(cut: DataFrame, buckets: int) -> DataFrame:
    """Counts of (place before, place) over each block's training texts.

    Words' places follow their buckets, from 1; 0 is the end and ``size`` the start of a text. ``a`` holds the
    steps from one place to the next, ``odd`` the words that move in odd rounds.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = Block.of(row)
                size = len(own.words) + 1
                order, _, odd = bucketed(own.words, buckets)
                place = np.zeros(size, np.int64)
                place[order + 1] = np.arange(1, size)
                values = place[own.tokens]
                training = ~np.repeat(own.held_out, own.lengths)
                codes, n = np.unique((own.before(values, size) * (size + 1) + values)[training], return_counts=True)
                numbers = [packed(x) for x in (np.diff(codes // (size + 1), prepend=0), codes % (size + 1), n)]
                yield batch_of(PAIRS, [(row["block"], size, np.packbits(odd).tobytes(), *numbers)])

    return cut.mapInArrow(counted, PAIRS)


def _answers(buckets: pa.Table, state: pa.Table) -> pa.Table:
    """The classes of each block's words in a bucket, and their counts where these are asked for."""
    of = unpacked(state["classes"][0].as_py())
    n = unpacked(buckets["n"][0].as_py()) if "n" in buckets.column_names else None
    rows = []
    for block, data in zip(buckets["blocks"][0].as_py(), buckets["places"][0].as_py(), strict=True):
        at = unpacked(data)
        rows.append((block, buckets["bucket"][0].as_py(), packed(of[at]), None if n is None else packed(n[at])))
    return pa.Table.from_batches([batch_of(ANSWERS, rows)])


def in_places(answers: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a block's words in the order of their places, and the first place of each bucket."""
    order = np.argsort(answers["bucket"].to_numpy(), kind="stable").tolist()
    parts = [unpacked(answers[column][k].as_py()) for k in order]
    return np.concatenate([np.zeros(0, np.int64), *parts]), 1 + np.cumsum([0, *map(len, parts)])


def _seen(classes: int, moving: int | None):
    """Of a block: by bucket the neighbour class counts of words that move, and class bigrams as bucket -1."""
    kinds = classes + 2

    def block(pairs: pa.Table, answers: pa.Table) -> pa.Table:
        size, number = pairs["size"][0].as_py(), pairs["block"][0].as_py()
        a, b, n = (unpacked(pairs[x][0].as_py()) for x in "abn")
        a = np.cumsum(a)
        own, bounds = in_places(answers, "classes")
        of = np.concatenate([[classes], own, [classes + 1]])
        table = np.bincount(of[a] * kinds + of[b], n)
        cells = np.flatnonzero(table)
        rows = [(-1, number, packed(cells), packed(table[cells]))]
        if moving is not None:
            odd = np.unpackbits(np.frombuffer(pairs["odd"][0].as_py(), np.uint8), count=size - 1)
            moves = np.concatenate([[False], odd == moving, [False]])
            right, left = moves[a], moves[b]
            codes = np.concatenate([a[right] * 2 * kinds + of[b[right]], b[left] * 2 * kinds + kinds + of[a[left]]])
            codes, sums = summed(codes, np.concatenate([n[right], n[left]]))
            ends = np.searchsorted(codes, bounds * 2 * kinds)
            for bucket, low, lo, hi in zip(np.sort(answers["bucket"].to_numpy()).tolist(), bounds.tolist(), ends, ends[1:], strict=False):
                if lo < hi:
                    rows.append((bucket, number, packed(np.diff(codes[lo:hi] - low * 2 * kinds, prepend=0)), packed(sums[lo:hi])))
        return pa.Table.from_batches([batch_of(SEEN, rows)])

    return block


def added_logs(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    return x_log_x(x + n) - x_log_x(x)


def added_in_order(rows: np.ndarray, which: np.ndarray, own: np.ndarray, who: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``many`` words the sums of ``rows[which]`` and of ``own`` over its entries, added in their order.

    ``who`` ascends. The words of most entries come first, so that a word's k-th entries are a slice.
    """
    sizes = np.bincount(who, minlength=many)
    order = np.argsort(-sizes, kind="stable")
    starts, ranked = (np.cumsum(sizes) - sizes)[order], sizes[order]
    sums, owns = np.zeros((many, rows.shape[1])), np.zeros(many)
    for k in range(ranked[0] if many else 0):
        some = starts[: np.searchsorted(-ranked, -k)] + k
        sums[: len(some)] += rows[which[some]]
        owns[: len(some)] += own[some]
    out, out_own = np.empty_like(sums), np.empty_like(owns)
    out[order], out_own[order] = sums, owns
    return out, out_own


def best_of_many(
    after: np.ndarray, before: np.ndarray, own: np.ndarray, pairs: np.ndarray, classes: int, cells: list[tuple[np.ndarray, np.ndarray]] | None = None
) -> np.ndarray:
    """``best_classes`` for many words with few neighbour classes each.

    Only their cells (``cells``: word and class, after and before) are weighed; what a cell gives is alike for all
    words of the same count in it, save in the class that a word leaves.
    """
    every = np.arange(len(own))
    gain = np.zeros((len(own), classes))
    after_cells, before_cells = cells or (np.nonzero(after), np.nonzero(before))
    for mine, other, table, (who, cell), (others, met) in ((after, before, pairs.T, after_cells, before_cells), (before, after, pairs, before_cells, after_cells)):
        n = mine[who, cell]
        table = table[:, :classes].astype(float)
        if len(who):
            kinds, which = np.unique(cell * (n.max() + 1) + n, return_inverse=True)
            firsts = np.zeros(len(kinds), np.int64)
            firsts[which] = np.arange(len(which))
            left = added_logs(np.maximum(table[cell, own[who]] - n, 0), n)
            same = np.flatnonzero(cell == own[who])
            rest = np.maximum(table[cell[same]] - other[who[same], :classes], 0)
            left[same] = added_logs(np.maximum(table[cell[same], own[who[same]]] - n[same] - other[who[same], own[who[same]]], 0), n[same])
            rows = np.concatenate([added_logs(table[cell[firsts]], n[firsts][:, None]), added_logs(rest, n[same][:, None])])
            which[same] = len(kinds) + np.arange(len(same))
            sums, owns = added_in_order(rows, which, left, who, len(own))
            sums[every, own] = owns
            gain += sums
        total = mine.sum(axis=1)
        margin = table.sum(axis=0)
        totals, alike = np.unique(total, return_inverse=True)
        fallen = added_logs(margin[None, :], totals[:, None])[alike]
        inner = met < classes
        others, met = others[inner], met[inner]
        fallen[others, met] = added_logs(np.maximum(margin[met] - other[others, met], 0), total[others])
        fallen[every, own] = added_logs(np.maximum(margin[own] - other[every, own] - total, 0), total)
        gain -= fallen
    who, cell = after_cells
    inner = (cell < classes) & (before[who, cell] > 0)
    who, cell = who[inner], cell[inner]
    r, l = after[who, cell], before[who, cell]
    both = np.maximum(pairs[cell, cell] - (cell == own[who]) * (r + l), 0)
    gain[who, cell] += x_log_x(both + r + l) + x_log_x(both) - x_log_x(both + r) - x_log_x(both + l)
    best = gain.argmax(axis=1)
    return np.where(gain[every, best] > gain[every, own] + 1e-9, best, own)


def _moved(pairs: np.ndarray, classes: int):
    """New classes of a bucket's words; its present ones come as block -1."""
    slots = 2 * (classes + 2)

    def bucket(buckets: pa.Table, seen: pa.Table) -> pa.Table:
        places = dict(zip(buckets["blocks"][0].as_py(), buckets["places"][0].as_py(), strict=True))
        codes, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for r in seen.to_pylist():
            if r["block"] < 0:
                of = unpacked(r["codes"])
                continue
            row, slot = divmod(np.cumsum(unpacked(r["codes"])), slots)
            codes.append(unpacked(places[r["block"]])[row] * slots + slot)
            counts.append(unpacked(r["n"]))
        codes, n = summed(np.concatenate(codes), np.concatenate(counts))
        whose, slot = divmod(codes, slots)
        row = np.cumsum(np.diff(whose, prepend=-1) > 0) - 1
        word = whose[np.flatnonzero(np.diff(whose, prepend=-1))]
        for low in range(0, len(word), WEIGHED):
            some = word[low : low + WEIGHED]
            lo, hi = np.searchsorted(row, [low, low + len(some)])
            sides = np.zeros((len(some), slots))
            who, at = row[lo:hi] - low, slot[lo:hi]
            sides[who, at] = n[lo:hi]
            right = at < slots // 2
            cells = [(who[right], at[right]), (who[~right], at[~right] - slots // 2)]
            of[some] = best_of_many(sides[:, : slots // 2], sides[:, slots // 2 :], of[some], pairs, classes, cells)
        return pa.Table.from_batches([batch_of(STATE, [(buckets["bucket"][0].as_py(), packed(of))])])

    return bucket


def class_bigrams(seen: DataFrame, kinds: int) -> np.ndarray:
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(kinds * kinds, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                table[unpacked(row["codes"])] += unpacked(row["n"])
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(table[at])], ["cell", "n"])

    out = np.zeros((kinds, kinds))
    for r in seen.filter("bucket = -1").mapInArrow(cells, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[divmod(r["cell"], kinds)] = r["n"]
    return out


def exchange_words(state: DataFrame, buckets: DataFrame, pairs: DataFrame, classes: int, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """Words' classes (bucket, classes) after so many rounds, and the class bigrams [before, class] they give.

    ``buckets`` and ``pairs`` lie partitioned by bucket and by block, and so don't travel.
    """
    for k in range(rounds + 1):
        answers = buckets.groupBy("bucket").cogroup(state.groupBy("bucket")).applyInArrow(_answers, ANSWERS)
        moving = k % 2 if k < rounds else None
        seen = pairs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_seen(classes, moving), SEEN).persist(StorageLevel.DISK_ONLY)
        table = class_bigrams(seen, classes + 2)
        if k < rounds:
            present = state.select("bucket", F.lit(-1).cast("long").alias("block"), F.col("classes").alias("codes"), F.lit(None).cast("binary").alias("n"))
            given = seen.filter("bucket >= 0").union(present)
            moved = buckets.groupBy("bucket").cogroup(given.groupBy("bucket")).applyInArrow(_moved(table, classes), STATE)
            state = saved(moved, "classes")
        seen.unpersist()
    return state, table


@dataclass
class Model:
    """Logarithms to base 10 of transitions, and what words' shares are made of.

    ``known`` holds (word, n, class) of every training word, ``state`` the classes of the words of
    ``vocabulary`` by bucket; ``classes`` those of the units.
    """

    units: Units
    classes: np.ndarray
    buckets: int
    vocabulary: DataFrame | None
    state: DataFrame | None
    known: DataFrame | None
    transitions: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    tokens: int
    words: int
    end_count: int

    def of_unit(self, word: bytes) -> int:
        return int(self.classes[self.units.of(word)])

    def class_of(self, word: bytes) -> int:
        """For a look at single words; texts get their words' classes from the buckets."""
        own = self.known.filter(F.col("word") == F.lit(bytearray(word))).select("class").first()
        return own["class"] if own else self.of_unit(word)


def unit_classes(buckets: DataFrame, units: Units, classes: np.ndarray) -> DataFrame:
    """The classes of the words' units, by bucket."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = row["words"].split(b"\n")
                yield batch_of(STATE, [(row["bucket"], packed(classes[np.fromiter((units.of(x) for x in words), np.int64, len(words))]))])

    return buckets.select("bucket", "words").mapInArrow(placed, STATE)


def counted_words(buckets: DataFrame) -> DataFrame:
    """The words that training rows have, and their counts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = pa.array(unpacked(row["n"]))
                yield pa.RecordBatch.from_arrays([pa.array(row["words"].split(b"\n"), pa.binary()), n], ["word", "n"]).filter(pc.greater(n, 0))

    return buckets.select("words", "n").mapInArrow(rows, WORDS)


def known_words(buckets: DataFrame, state: DataFrame) -> DataFrame:
    """word, n and class of the words that training rows have."""

    def rows(words: pa.Table, state: pa.Table) -> pa.Table:
        n, of = unpacked(words["n"][0].as_py()), unpacked(state["classes"][0].as_py())
        table = pa.table({"word": pa.array(words["words"][0].as_py().split(b"\n"), pa.binary()), "n": n, "class": of.astype(np.int32)})
        return table.filter(pa.array(n > 0))

    words = buckets.select("bucket", "words", "n")
    return words.groupBy("bucket").cogroup(state.groupBy("bucket")).applyInArrow(rows, f"{WORDS}, class int")


def class_sizes(buckets: DataFrame, state: DataFrame, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each class."""

    def sizes(words: pa.Table, state: pa.Table) -> pa.Table:
        n, of = unpacked(words["n"][0].as_py()), unpacked(state["classes"][0].as_py())
        return pa.table({"class": np.arange(kinds, dtype=np.int32), "n": np.bincount(of, n, minlength=kinds).astype(np.int64), "v": np.bincount(of[n > 0], minlength=kinds).astype(np.int64)})

    tokens, distinct = np.zeros(kinds, np.int64), np.zeros(kinds, np.int64)
    found = buckets.select("bucket", "n").groupBy("bucket").cogroup(state.groupBy("bucket")).applyInArrow(sizes, "class int, n long, v long")
    for r in found.groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        tokens[r["class"]], distinct[r["class"]] = r["n"], r["v"]
    return tokens, distinct


def fit(
    rows: DataFrame, counts: DataFrame, cut: DataFrame, classes: int = CLASSES, head: int = HEAD, rounds: int = ROUNDS, words: DataFrame | None = None
) -> Model:
    most = counts.orderBy(F.desc("n"), "word").limit(head).collect()
    units = Units({bytes(r["word"]): k for k, r in enumerate(most)})
    of, _ = exchange(saved(unit_sides(cut, units), "sides"), units, classes, STARTING)
    buckets = bucket_count(cut)
    words = saved(vocabulary(cut, buckets), "vocabulary") if words is None else words
    pairs = block_pairs(cut, buckets).repartition(max(1, cut.count()), "block").persist(StorageLevel.DISK_ONLY)
    index = words.select("bucket", "blocks", "places").repartition(buckets, "bucket").persist(StorageLevel.DISK_ONLY)
    state, table = exchange_words(saved(unit_classes(words, units, of), "classes"), index, pairs, classes, rounds)
    index.unpersist()
    pairs.unpersist()
    tokens, distinct = class_sizes(words, state, classes + 2)
    ends = rows.filter("not held_out").count()
    tokens[classes], distinct[classes] = ends, int(ends > 0)
    share = (tokens[: classes + 1] + ADDED) / (tokens[: classes + 1].sum() + ADDED * (classes + 1))
    seen = table[:, : classes + 1]
    transitions = np.log10((seen + PRIOR * share) / (seen.sum(axis=1, keepdims=True) + PRIOR))
    return Model(units, of, buckets, words, state, known_words(words, state), transitions, tokens, distinct, int(tokens.sum()), int(distinct.sum()), ends)


SCORES = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scored(model: Model, classes: int):
    model = replace(model, known=None, vocabulary=None, state=None)

    def block(row: pa.Table, answers: pa.Table) -> pa.Table:
        own = Block.of(row.to_pylist()[0])
        order, _, _ = bucketed(own.words, model.buckets)
        n = np.zeros(len(own.words) + 1)
        n[0] = model.end_count
        n[order + 1] = in_places(answers, "n")[0]
        of = np.full(len(own.words) + 1, classes)
        of[order + 1] = in_places(answers, "classes")[0]
        base = np.log10((n + ADDED) / (model.tokens + ADDED * (model.words + 1)))
        share = (n + ADDED) / (model.class_tokens[of] + ADDED * (model.class_words[of] + 1))
        share[0] = 1.0
        value = of[own.tokens]
        score = model.transitions[own.before(value, classes + 1), value] + np.log10(share)[own.tokens]
        firsts = np.cumsum(own.lengths) - own.lengths
        return pa.table(
            {
                "id": own.ids,
                "held_out": own.held_out,
                "n_tokens": own.lengths,
                "n_known": np.add.reduceat((n > 0)[own.tokens].astype(np.int64), firsts),
                "base_score": np.add.reduceat(base[own.tokens], firsts),
                "score": np.add.reduceat(score, firsts),
            }
        )

    return block


def class_scores(
    docs: DataFrame, held_out: Column, classes: int = CLASSES, head: int = HEAD, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Rows for which ``held_out`` (an expression over doc_id) holds are scored but not learned from.
    """
    rows = texts(docs, id_col, text_col).withColumn("held_out", held_out)
    rows = rows.withColumn("id", F.coalesce("doc_id", F.lit(NO_ID)))
    cut = saved(blocks(rows), "blocks")
    words = saved(vocabulary(cut, bucket_count(cut)), "vocabulary")
    model = fit(rows, counted_words(words), cut, classes, head, rounds, words)
    words = model.vocabulary.select("bucket", "n", "blocks", "places")
    answers = words.groupBy("bucket").cogroup(model.state.groupBy("bucket")).applyInArrow(_answers, ANSWERS)
    scores = cut.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scored(model, classes), SCORES)
    return scores.select(
        F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
