"""Alignment of two tokenizers' tokens by merge-path partitioning of their byte ends.

Tokenizers A (byte-level BPE) and B (pieces with byte fallback) spell the same bytes, so their tokens are
two ascending lists of byte ends. Merging the lists tells everything: each distinct end closes one overlap
(link) of an A and a B token, and an end of both closes a group. The documents of a block are merged as one
list of each kind; binary searches on the merge's diagonals cut it into pieces of equal work, whatever the
documents' lengths. A piece is a row with its share of both lists, the token after it in either, and how far
its starts lie apart: enough to work on it alone. Documents that lie in one piece are finished there; of
the others each piece leaves its whole groups and the open ends, which are stitched in order.

Three passes over the pieces: links are counted by pair of ids within a chunk of pieces and added up by
blocks of B ids, which also know the highest count of each B id; every block answers the chunks for the
pairs they asked for; the pieces of a chunk then sum their links' counts. No pass holds more than a
block's pairs, a chunk's pairs or a piece.

Defined results: a text that is null, empty or whose tokens don't spell a space and itself has no tokens, all
numbers zero and no groups; null ids are carried; repeated rows are documents of their own and count as
often; equal counts are all highest; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.bytelevel import ByteLevel, ranks_of
from tallyhouse.llm.common import NO_ID, partition_id, saved, shuffle_partitions, texts

#: Ends of both kinds in a piece, in the documents of a block, and in a chunk.
PIECE, BLOCK, CHUNK = 1 << 16, 1 << 20, 1 << 23
#: Documents that are encoded at a time.
SOME = 128

PIECES = (
    "chunk long, piece long, a binary, b binary, best binary, apart long, next_a long, next_b long,"
    " doc_no array<long>, doc_id array<long>, na array<long>, nb array<long>, opened boolean, left_open boolean"
)
PARTS = (
    "chunk long, doc_no long, piece long, whole boolean, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long,"
    " groups_sha256 string, cut boolean, head_a binary, head_b binary, body binary, tail_a binary, tail_b binary"
)
PAIRS = "block long, chunk long, keys binary, counts binary, best binary"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ") for x in [x.strip()]])


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class Tokenizers:
    """Both tokenizers, from the contents of their files, and the bytes of their tokens."""

    def __init__(self, byte_bpe: bytes, pattern: str, piece_model: bytes):
        import sentencepiece

        kind = json.loads(byte_bpe)
        self.a_bytes = [b""] * (max(kind["model"]["vocab"].values()) + 1)
        for token, k in ranks_of(kind).items():
            self.a_bytes[k] = token
        self.a = ByteLevel(byte_bpe, specials=False, pattern=pattern)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        self.b_bytes = [self._piece(k) for k in range(self.b.get_piece_size())]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        self.kinds = tuple("<u2" if len(own) <= 1 << 16 else "<u4" for own in (self.a_bytes, self.b_bytes))

    def _piece(self, k: int) -> bytes:
        if self.b.is_byte(k):
            return bytes([int(self.b.id_to_piece(k)[3:5], 16)])
        return b"" if self.b.is_control(k) or self.b.is_unknown(k) else self.b.id_to_piece(k).replace("▁", " ").encode()

    def encode(self, some: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """A and B ids of texts; none where they don't spell a space and the text."""
        out = []
        for text, b in zip(some, self.b.encode(some, num_threads=1), strict=True):
            want = b" " + text.encode()
            if text and b"".join([self.b_bytes[x] for x in b]) == want:
                a = self.a.ids(" " + text).astype(np.int64)
                if self.a_sizes[a].sum() == len(want):
                    out.append((a, np.array(b, np.int64)))
                    continue
            out.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
        return out


_LOADED: dict[str, Tokenizers] = {}


def loaded(files: tuple[bytes, str, bytes]) -> Tokenizers:
    """This worker's tokenizers."""
    name = hashlib.sha256(files[0] + files[1].encode() + files[2]).hexdigest()
    if name not in _LOADED:
        _LOADED[name] = Tokenizers(*files)
    return _LOADED[name]


def diagonals(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of either ascending list come among the first ``at`` of their merge, by binary search on each diagonal.

    Equal ends stay together: a diagonal between them moves behind the second.
    """
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (low < high).any():
        open_ = low < high
        middle = (low + high) // 2
        first = np.zeros(len(at), bool)
        first[open_] = a[middle[open_]] <= b[at[open_] - 1 - middle[open_]]
        low = np.where(open_ & first, middle + 1, low)
        high = np.where(open_ & ~first, middle, high)
    i, j = low, at - low
    between = (i > 0) & (j < len(b))
    between[between] = a[i[between] - 1] == b[j[between]]
    return i, j + between


def cut_block(a: list[np.ndarray], b: list[np.ndarray], a_sizes: np.ndarray, b_sizes: np.ndarray, piece: int) -> Iterator[tuple]:
    """Pieces of documents' ids: a, b, apart, next_a, next_b, doc numbers, na, nb, opened, left_open."""
    all_a, all_b = np.concatenate(a), np.concatenate(b)
    ends_a, ends_b = np.cumsum(a_sizes[all_a]), np.cumsum(b_sizes[all_b])
    at = np.arange(piece, len(all_a) + len(all_b), piece)
    i, j = diagonals(ends_a, ends_b, at)
    i, j = np.r_[0, i, len(all_a)], np.r_[0, j, len(all_b)]
    until_a, until_b = (np.cumsum([len(x) for x in own]) for own in (a, b))
    from_a, from_b = np.r_[0, until_a[:-1]], np.r_[0, until_b[:-1]]
    none = (until_a == from_a) & (until_b == from_b)
    stands = np.minimum(np.searchsorted(i[1:] + j[1:], from_a + from_b, side="right"), len(i) - 2)
    for k in range(len(i) - 1):
        # documents that have tokens here; those without any go with the place where they stand
        own_a = np.minimum(until_a, i[k + 1]) - np.maximum(from_a, i[k])
        own_b = np.minimum(until_b, j[k + 1]) - np.maximum(from_b, j[k])
        docs = np.flatnonzero(np.where(none, stands == k, (own_a > 0) | (own_b > 0)))
        na, nb = np.maximum(own_a[docs], 0), np.maximum(own_b[docs], 0)
        full = (na == until_a[docs] - from_a[docs]) & (nb == until_b[docs] - from_b[docs])
        opened = bool(len(docs) and not full[0] and (from_a[docs[0]] < i[k] or from_b[docs[0]] < j[k]))
        left_open = bool(len(docs) and not full[-1] and (until_a[docs[-1]] > i[k + 1] or until_b[docs[-1]] > j[k + 1]))
        apart = (ends_a[i[k] - 1] if i[k] else 0) - (ends_b[j[k] - 1] if j[k] else 0)
        next_a = int(all_a[i[k + 1]]) if i[k + 1] < len(all_a) else -1
        next_b = int(all_b[j[k + 1]]) if j[k + 1] < len(all_b) else -1
        yield all_a[i[k] : i[k + 1]], all_b[j[k] : j[k + 1]], int(apart), next_a, next_b, docs, na, nb, opened, left_open


def merged_links(a: np.ndarray, b: np.ndarray, apart: int, next_a: int, next_b: int, a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Links of a piece: A id, B id and the list's place of the token whose end closes it (A's, then B's); and the common ends' places in both lists."""
    ends_a, ends_b = apart + np.cumsum(a_sizes[a]), np.cumsum(b_sizes[b])
    to_b = np.searchsorted(ends_b, ends_a)
    both = np.flatnonzero((to_b < len(b)) & (np.r_[ends_b, -1][to_b] == ends_a))
    alone = np.ones(len(b), bool)
    alone[to_b[both]] = False
    alone = np.flatnonzero(alone)
    to_a = np.searchsorted(ends_a, ends_b[alone])
    left = np.r_[a, np.r_[a, next_a][to_a]]
    right = np.r_[np.r_[b, next_b][to_b], b[alone]]
    return left, right, alone, both, to_b[both]


def _pack(values: np.ndarray, kind: str) -> bytes:
    return zstandard.ZstdCompressor(3).compress(values.astype(kind).tobytes())


def _unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind).astype(np.int64)


def pieces_of(docs: DataFrame, files: tuple[bytes, str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Equal pieces of the documents' merged ends, in chunks."""
    schema = _schema(PIECES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, chunk, piece, in_chunk, number = loaded(files), partition_id() << 32, 0, 0, 0
        ids, a, b, ends = [], [], [], 0
        kinds = both.kinds

        def flush() -> list[tuple]:
            nonlocal chunk, piece, in_chunk, number
            out = []
            for own_a, own_b, apart, next_a, next_b, at, na, nb, opened, left_open in cut_block(a, b, both.a_sizes, both.b_sizes, PIECE):
                out.append((chunk, piece, _pack(own_a, kinds[0]), _pack(own_b, kinds[1]), None, apart, next_a, next_b, number + at, [ids[k] for k in at], na, nb, opened, left_open))
                piece += 1
            number += len(ids)
            in_chunk += ends
            if in_chunk >= CHUNK:
                chunk, piece, in_chunk, number = chunk + 1, 0, 0, 0
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, SOME):
                some = batch.slice(at, SOME)
                for doc_id, (own_a, own_b) in zip(some.column("doc_id").to_pylist(), both.encode(some.column("text").to_pylist()), strict=True):
                    ids.append(doc_id)
                    a.append(own_a)
                    b.append(own_b)
                    ends += len(own_a) + len(own_b)
                    if ends >= BLOCK:
                        yield _batch(schema, flush())
                        ids, a, b, ends = [], [], [], 0
        if ids:
            yield _batch(schema, flush())

    return texts(docs, id_col, text_col).mapInArrow(cut, PIECES)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 16):
            yield from batch.slice(at, 16).to_pylist()


def _links(row: dict, both: Tokenizers) -> tuple[np.ndarray, ...]:
    a, b = (_unpack(row[x], kind) for x, kind in zip("ab", both.kinds, strict=True))
    return a, b, *merged_links(a, b, row["apart"], row["next_a"], row["next_b"], both.a_sizes, both.b_sizes)


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(keys, return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, place, counts)
    return keys, sums


def chunk_pairs(pieces: DataFrame, files: tuple[bytes, str, bytes], blocks: int) -> DataFrame:
    """How often each pair of ids is linked in a chunk, by block of B ids; a pair's key is A id * B's size + B id."""
    schema = _schema(PAIRS)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = loaded(files)
        width = len(both.b_bytes)

        def told(chunk: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            keys, counts = _added(*(np.concatenate(x) for x in zip(*held, strict=True)))
            block = keys % width % blocks
            order = np.argsort(block, kind="stable")
            edges = np.flatnonzero(np.diff(block[order])) + 1
            parts = [x for x in np.split(order, edges) if len(x)]
            return _batch(schema, [(int(block[x[0]]), chunk, _pack(keys[x], "<u8"), _pack(counts[x], "<u4"), None) for x in parts])

        chunk, held, size = None, [], 0
        for row in _rows(batches):
            if row["chunk"] != chunk and held:
                yield told(chunk, held)
                held, size = [], 0
            chunk = row["chunk"]
            left, right, *_ = _links(row, both)[2:]
            held.append(np.unique(left * width + right, return_counts=True))
            size += len(held[-1][0])
            if size > 1 << 21:
                held = [_added(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                size = len(held[0][0])
        if held:
            yield told(chunk, held)

    return pieces.select("chunk", "a", "b", "apart", "next_a", "next_b").mapInArrow(counted, PAIRS)


def pair_totals(asked: DataFrame, width: int) -> DataFrame:
    """A row a block: its pairs' counts in all chunks, and which are the highest of their B id."""
    schema = _schema(PAIRS)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(block: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            keys, counts = _added(*(np.concatenate(x) for x in zip(*held, strict=True)))
            highest = np.zeros(width, np.int64)
            np.maximum.at(highest, keys % width, counts)
            best = counts == highest[keys % width]
            return _batch(schema, [(block, -1, _pack(keys, "<u8"), _pack(counts, "<u8"), _pack(best, "u1"))])

        block, held, size = None, [], 0
        for row in _rows(batches):
            if row["block"] != block and held:
                yield told(block, held)
                held, size = [], 0
            block = row["block"]
            held.append((_unpack(row["keys"], "<u8"), _unpack(row["counts"], "<u4")))
            size += len(held[-1][0])
            if size > max(1 << 21, 2 * len(held[0][0])):
                held = [_added(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                size = len(held[0][0])
        if held:
            yield told(block, held)

    n = shuffle_partitions(asked.sparkSession)
    return asked.repartition(n, "block").sortWithinPartitions("block").mapInArrow(summed, PAIRS)


def answers(asked: DataFrame, totals: DataFrame) -> DataFrame:
    """What each chunk asked for, as rows of the schema of pieces: keys, counts and which are best."""
    schema = _schema(PIECES)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = counts = best = None
        for row in _rows(batches):
            own = _unpack(row["keys"], "<u8")
            if row["chunk"] < 0:
                keys, counts, best = own, _unpack(row["counts"], "<u8"), _unpack(row["best"], "u1")
            else:
                at = np.searchsorted(keys, own)
                yield _batch(schema, [(row["chunk"], -1, row["keys"], _pack(counts[at], "<u8"), _pack(best[at], "u1"), *[None] * 9)])

    n = shuffle_partitions(asked.sparkSession)
    rows = asked.select("block", "chunk", "keys", F.lit(None).cast("binary").alias("counts"), "best").unionByName(totals)
    return rows.repartition(n, "block").sortWithinPartitions("block", "chunk").mapInArrow(told, PIECES)


def spelled(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, names: tuple[list[bytes], list[bytes]]) -> tuple[bytes, np.ndarray]:
    """The text ``a1,a2|b1;a3|b2,b3;`` of tokens up to the last cut, and the ends of its groups in it."""
    a, b = a[: cut_a[-1] + 1] if len(cut_a) else a[:0], b[: cut_b[-1] + 1] if len(cut_b) else b[:0]
    group_a, group_b = np.searchsorted(cut_a, np.arange(len(a))), np.searchsorted(cut_b, np.arange(len(b)))
    place_a = np.arange(len(a)) + np.r_[0, cut_b + 1][group_a]
    place_b = np.arange(len(b)) + (cut_a + 1)[group_b]
    # names of A with a comma, with a bar; of B with a comma, with a semicolon
    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[cut_a] = last_b[cut_b] = 1
    words, sizes = names
    order = np.zeros(len(a) + len(b), np.int64)
    order[place_a], order[place_b] = 4 * a + last_a, 4 * b + 2 + last_b
    ends = np.cumsum(sizes[order])
    return b"".join([words[x] for x in order.tolist()]), ends[place_b[cut_b]] if len(cut_b) else ends


def names_of(size: int) -> tuple[list[bytes], np.ndarray]:
    words = [b"%d%s" % (k, end) for k in range(size) for end in (b",", b"|", b",", b";")]
    return words, np.array([len(x) for x in words])


def _listed(ids: np.ndarray) -> bytes:
    return b"".join([b"%d," % x for x in ids.tolist()])


def document_parts(pieces: DataFrame, answered: DataFrame, files: tuple[bytes, str, bytes]) -> DataFrame:
    """What each piece has of its documents: numbers, and groups as far as they are closed."""
    schema = _schema(PARTS)

    def parts(row: dict, both: Tokenizers, known: tuple[np.ndarray, ...], names: tuple) -> pa.RecordBatch:
        a, b, left, right, alone, cut_a, cut_b = _links(row, both)
        na, nb = np.array(row["na"], np.int64), np.array(row["nb"], np.int64)
        own_a, own_b = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
        owner = np.r_[own_a, own_b[alone]]
        keys, counts, best = known
        at = np.searchsorted(keys, left * len(both.b_bytes) + right)
        sums = [np.bincount(owner, minlength=len(na)).astype(np.int64)]
        for values in (best, counts):
            total = np.zeros(len(na), np.int64)
            np.add.at(total, owner, values[at])
            sums.append(total)
        links, n_best, count_sum = sums
        groups = np.bincount(own_a[cut_a], minlength=len(na))
        text, ends = spelled(a, b, cut_a, cut_b, names)
        until = np.r_[0, ends][np.cumsum(groups)]
        out, start, first_cut, a_at, b_at = [], 0, 0, 0, 0
        for k in range(len(na)):
            opened, left_open = row["opened"] and k == 0, row["left_open"] and k == len(na) - 1
            numbers = (row["doc_id"][k], int(na[k]), int(nb[k]), int(groups[k]), int(links[k]), int(n_best[k]), int(count_sum[k]))
            own = text[start : until[k]]
            if not opened and not left_open:
                digest = hashlib.sha256(own[:-1]).hexdigest() if own else ""
                out.append((row["chunk"], row["doc_no"][k], row["piece"], True, *numbers, digest, *[None] * 6))
            else:
                cuts_a, cuts_b = cut_a[first_cut : first_cut + groups[k]], cut_b[first_cut : first_cut + groups[k]]
                cut = len(cuts_a) > 0
                head_a, head_b = (a[a_at : cuts_a[0] + 1], b[b_at : cuts_b[0] + 1]) if cut else (a[a_at : a_at + na[k]], b[b_at : b_at + nb[k]])
                body = text[ends[first_cut] : until[k]] if cut else b""
                tail_a = a[cuts_a[-1] + 1 : a_at + na[k]] if cut else a[:0]
                tail_b = b[cuts_b[-1] + 1 : b_at + nb[k]] if cut else b[:0]
                out.append((row["chunk"], row["doc_no"][k], row["piece"], False, *numbers, None, cut, *map(_listed, (head_a, head_b)), body, *map(_listed, (tail_a, tail_b))))
            start, first_cut = until[k], first_cut + groups[k]
            a_at, b_at = a_at + na[k], b_at + nb[k]
        return _batch(schema, out)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = loaded(files)
        names = names_of(max(len(both.a_bytes), len(both.b_bytes)))
        chunk, held, known = None, [], None
        for row in _rows(batches):
            if row["chunk"] != chunk:
                chunk, held, known = row["chunk"], [], None
            if row["piece"] < 0:
                held.append((_unpack(row["a"], "<u8"), _unpack(row["b"], "<u8"), _unpack(row["best"], "u1")))
                continue
            if known is None:
                keys, counts, best = [np.concatenate(x) for x in zip(*held, strict=True)] if held else [np.zeros(0, np.int64)] * 3
                order = np.argsort(keys)
                known, held = (keys[order], counts[order], best[order]), []
            yield parts(row, both, known, names)

    n = shuffle_partitions(pieces.sparkSession)
    rows = pieces.unionByName(answered)
    return rows.repartition(n, "chunk").sortWithinPartitions("chunk", "piece").mapInArrow(summed, PARTS)


def stitch(parts: pd.DataFrame) -> tuple[int, str]:
    """Groups and their digest of a document's parts, in order."""
    parts, open_a, open_b, text, n = parts.sort_values("piece"), b"", b"", hashlib.sha256(), 0
    ended = b""
    for x in parts.itertuples():
        open_a, open_b = open_a + x.head_a, open_b + x.head_b
        if x.cut:
            done = open_a[:-1] + b"|" + open_b[:-1] + b";" + x.body
            text.update(ended + done[:-1])
            ended, n = b";", n + x.n_groups
            open_a, open_b = x.tail_a, x.tail_b
    return n, text.hexdigest()


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(docs: DataFrame, files: tuple[bytes, str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    ``files``: the contents of A's tokenizers file, its pattern of pre-tokens and the contents of B's model.
    """
    spark = docs.sparkSession
    pieces = saved(pieces_of(docs, files, id_col, text_col), "pieces")
    width = len(Tokenizers(*files).b_bytes)
    asked = saved(chunk_pairs(pieces, files, 4 * shuffle_partitions(spark)), "pairs")
    answered = answers(asked, saved(pair_totals(asked, width), "totals"))
    parts = saved(document_parts(pieces, answered, files), "parts")
    columns = [x.split()[0] for x in ALIGNED.split(", ")]

    def stitched(some: pd.DataFrame) -> pd.DataFrame:
        n, digest = stitch(some)
        sums = [int(some[x].sum()) for x in ("n_a", "n_b")], [int(some[x].sum()) for x in ("n_links", "n_best", "count_sum")]
        return pd.DataFrame([(some["doc_id"].iloc[0], *sums[0], n, *sums[1], digest)], columns=columns)

    cut = parts.filter("not whole").withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    rest = cut.groupBy("chunk", "doc_no").applyInPandas(stitched, ALIGNED).withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
    return parts.filter("whole").select(columns).unionByName(rest)
