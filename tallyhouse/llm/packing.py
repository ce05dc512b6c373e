"""Harmonic packing of token documents into sequences of fixed capacity.

Lengths fall into reciprocal-capacity classes: the pieces of class j are cut to exactly
``capacity // j`` tokens, so j of them fill a sequence and nothing but the count decides where a piece
goes. What is left of a document after a cut is classed again, until at most ``capacity // CLASSES``
tokens remain, which stay whole and are classed by their exact length. Each worker fills sequences of
its own pieces as it reads; only the pieces of a sequence it could not fill travel: they are numbered
within their class across workers and fill further sequences. The last sequence of each class, fewer
than ten thousand small pieces in all whatever the input, is packed first-fit by falling length.

Token ids are those of a tokenizers file, whose contents travel with the job; every text is encoded whole.

Defined results: null or empty text is the end token alone; null ids are carried; repeated rows are
documents of their own; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.bytelevel import ByteLevel
from tallyhouse.llm.common import NO_ID, partition_id, saved, texts

CAPACITY = 2048
#: Classes whose pieces are cut to size; shorter ends stay whole.
CLASSES = 32
END = 1

PIECES = "part long, size int, number long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, sequence_id long, offset long"
#: Numbers of sequences: of worker p from (p + 1) << WORKER, of class s filled across workers from s << CLASS.
WORKER, CLASS = 38, 26


def cuts(tokens: int, capacity: int = CAPACITY, classes: int = CLASSES) -> list[int]:
    """Lengths of a document's pieces, in order."""
    out = [capacity] * (tokens // capacity)
    left = tokens % capacity
    while left > capacity // classes:
        size = capacity // -(-capacity // left)
        out.append(size)
        left -= size
    return [*out, left] if left else out


_ENCODERS: dict[str, ByteLevel] = {}


def encoder(content: bytes) -> ByteLevel:
    """This worker's encoder of a tokenizers file."""
    name = hashlib.sha256(content).hexdigest()
    if name not in _ENCODERS:
        _ENCODERS[name] = ByteLevel(content, specials=True)
    return _ENCODERS[name]


def _pieces(docs: DataFrame, tokenizer: bytes, capacity: int, end: int, with_ids: bool) -> DataFrame:
    """Every piece; those in sequences that one worker filled have their place."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, full = partition_id(), 0
        coder, last = encoder(tokenizer), np.array([end], "<u4").tobytes()
        waiting: dict[int, list[tuple]] = defaultdict(list)

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.field(x.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in PIECES.split(", ")]
            columns = list(zip(*pieces, strict=True)) or [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, kinds, strict=True)], schema=pa.schema(kinds))

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some, out = batch.slice(at, 256), []
                for doc_id, text in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist(), strict=True):
                    ids = coder.ids(text).tobytes() + last
                    tokens, start = len(ids) // 4, 0
                    for size in cuts(tokens, capacity):
                        own = ids[4 * start : 4 * (start + size)]
                        held = waiting[size]
                        held.append((doc_id, start, size, zlib.crc32(own), tokens, own if with_ids else None))
                        start += size
                        if len(held) == capacity // size:
                            number = (part + 1 << WORKER) + full
                            out += [(part, size, None, *x, number, k * size) for k, x in enumerate(held)]
                            held.clear()
                            full += 1
                yield rows(out)
        yield rows([(part, size, k, *x, None, None) for size, held in waiting.items() for k, x in enumerate(held)])

    return texts(docs).mapInArrow(packed, PIECES)


def first_fit(pieces: pd.DataFrame, capacity: int = CAPACITY) -> pd.DataFrame:
    """Sequence and offset of pieces, the longest first, each into the first sequence with room."""
    pieces = pieces.sort_values(["length", "doc_id", "start", "part", "number"], ascending=[False, True, True, True, True], kind="stable")
    used: list[int] = []
    places = []
    for length in pieces["length"]:
        k = next((k for k, x in enumerate(used) if x + length <= capacity), len(used))
        if k == len(used):
            used.append(0)
        places.append((k, used[k]))
        used[k] += length
    return pieces.assign(sequence_id=[x[0] for x in places], offset=[x[1] for x in places])


def harmonic_pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end: int = END,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, ids, sequence_id, offset.

    ``tokenizer``: path of a tokenizers file, read by the driver. ``ids`` (little-endian unsigned 32-bit) is null unless ``with_ids``. Gapless offsets; sequences
    hold at most ``capacity`` tokens.
    """
    pieces = saved(_pieces(texts(docs, id_col, text_col), Path(tokenizer).read_bytes(), capacity, end, with_ids), "pieces")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "sequence_id", "offset"]
    done = pieces.filter("sequence_id is not null").select(columns)
    loose = pieces.filter("sequence_id is null").drop("sequence_id", "offset")
    counts = loose.groupBy("size", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "size",
        "part",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy("size")).alias("all"),
    )
    per = (F.lit(capacity) / F.col("size")).cast("long")
    loose = loose.join(counts, ["size", "part"]).withColumn("rank", F.col("before") + F.col("number"))
    last = F.col("rank") >= F.col("all") - F.col("all") % per
    across = loose.filter(~last).withColumns(
        {
            "sequence_id": F.col("size").cast("long") * F.lit(1 << CLASS) + F.expr("rank div cast(%d / size as long)" % capacity),
            "offset": (F.col("rank") % per) * F.col("size"),
        }
    )
    kept = "part long, number long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
    rest = loose.filter(last).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    rest = rest.select([x.split()[0] for x in kept.split(", ")]).groupBy()
    rest = rest.applyInPandas(lambda x: first_fit(x, capacity), f"{kept}, sequence_id long, offset long")
    rest = rest.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
    return done.unionByName(across.select(columns)).unionByName(rest.select(columns))
