"""Exact dedup over a cuckoo-filter index of live digests.

The digest space is cut into shards. A shard is one row: a cuckoo filter of 16-bit marks in buckets
of four slots, and beside every mark the number of the stored entry, so that a hit is verified
against the full digest kept in that bucket. A shard that overflows doubles its buckets and places
its stored digests anew. ``insert``, ``delete`` and ``probe`` work on all shards in parallel.

Copies are folded before they travel: each input partition sends one ticket for each of its texts,
so a text held by a third of all rows reaches its shard as one row per partition, and the answer goes
back to the rows by (digest, partition).

Defined results: null text counts as empty; null id is below every id; rows that repeat id and text
are told apart by their position in the input and one of them stays; other columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import NO_ID, partition_id, saved, shuffle_partitions, texts

SLOTS = 4
MAX_KICKS = 200
FIRST_BUCKETS = 64
#: Digests that a shard is planned for.
SHARD_DIGESTS = 1 << 15

ROWS = "doc_id long, digest binary, part int, seq long"
TICKETS = "shard int, digest binary, part int, doc_id long, seq long, copies long"
INDEX = "shard int, buckets int, marks binary, entries binary, digests binary, ids binary, parts binary, seqs binary, copies binary"
FOUND = "digest binary, part int, keep_id long, keep_part int, keep_seq long, group_size long"


class CuckooShard:
    """Cuckoo filter with the stored entry beside every mark."""

    def __init__(self, buckets: int = FIRST_BUCKETS):
        self.stored: dict[int, list] = {}
        self.next_entry = 0
        self._empty(buckets)

    def _empty(self, buckets: int) -> None:
        self.buckets = buckets
        self.marks = [0] * (buckets * SLOTS)
        self.entries = [-1] * (buckets * SLOTS)

    def _homes(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:10], "little") & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x9E3779B1 & (self.buckets - 1))

    def _slot(self, digest: bytes) -> int:
        """The slot that holds the digest, -1 if none: marks that agree are checked against the content."""
        mark, first, second = self._homes(digest)
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.marks[slot] == mark and self.stored[self.entries[slot]][0] == digest:
                    return slot
        return -1

    def find(self, digest: bytes) -> list | None:
        slot = self._slot(digest)
        return None if slot < 0 else self.stored[self.entries[slot]]

    def insert(self, digest: bytes, doc_id: int, part: int, seq: int, copies: int) -> None:
        """A live digest takes the larger (id, position) and adds the copies; a new one gets a slot."""
        held = self.find(digest)
        if held is not None:
            held[1:4] = max(held[1:4], [doc_id, part, seq])
            held[4] += copies
            return
        entry, self.next_entry = self.next_entry, self.next_entry + 1
        self.stored[entry] = [digest, doc_id, part, seq, copies]
        if not self._place(digest, entry):
            self._resize()

    def delete(self, digest: bytes) -> bool:
        slot = self._slot(digest)
        if slot < 0:
            return False
        del self.stored[self.entries[slot]]
        self.marks[slot], self.entries[slot] = 0, -1
        return True

    def _place(self, digest: bytes, entry: int) -> bool:
        mark, first, second = self._homes(digest)
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.marks[slot]:
                    self.marks[slot], self.entries[slot] = mark, entry
                    return True
        bucket = second
        for kick in range(MAX_KICKS):
            slot = bucket * SLOTS + (kick * 7 + mark) % SLOTS
            self.marks[slot], mark = mark, self.marks[slot]
            self.entries[slot], entry = entry, self.entries[slot]
            bucket = self._other(bucket, mark)
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.marks[slot]:
                    self.marks[slot], self.entries[slot] = mark, entry
                    return True
        return False

    def _resize(self) -> None:
        """Twice the buckets, until every stored digest has a slot."""
        while True:
            self._empty(self.buckets * 2)
            if all(self._place(held[0], entry) for entry, held in self.stored.items()):
                return

    def to_row(self, shard: int) -> dict:
        order = {entry: k for k, entry in enumerate(self.stored)}
        held = list(self.stored.values())
        pack = lambda k: np.array([x[k] for x in held], np.int64).tobytes()
        return {
            "shard": shard,
            "buckets": self.buckets,
            "marks": np.array(self.marks, np.uint16).tobytes(),
            "entries": np.array([order.get(x, -1) for x in self.entries], np.int32).tobytes(),
            "digests": b"".join(x[0] for x in held),
            "ids": pack(1),
            "parts": pack(2),
            "seqs": pack(3),
            "copies": pack(4),
        }

    @classmethod
    def from_row(cls, row) -> CuckooShard:
        shard = cls(int(row.buckets))
        shard.marks = np.frombuffer(row.marks, np.uint16).tolist()
        shard.entries = np.frombuffer(row.entries, np.int32).tolist()
        columns = [np.frombuffer(x, np.int64).tolist() for x in (row.ids, row.parts, row.seqs, row.copies)]
        for k, values in enumerate(zip(*columns, strict=True)):
            shard.stored[k] = [bytes(row.digests[32 * k : 32 * k + 32]), *values]
        shard.next_entry = len(shard.stored)
        return shard


@dataclass
class CuckooIndex:
    """Rows of shards (``INDEX``) and their number."""

    rows: DataFrame
    shards: int


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, SHA-256 of the text with A-Z lowered, and position (partition, number) of every row."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = partition_id(), 0
        for batch in batches:
            found = [hashlib.sha256(x.as_buffer().to_pybytes().lower()).digest() for x in batch.column("text")]
            n = len(found)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(found, pa.binary()),
                    pa.array(np.full(n, part, np.int32)),
                    pa.array(np.arange(seq, seq + n, dtype=np.int64)),
                ],
                ["doc_id", "digest", "part", "seq"],
            )
            seq += n

    return texts(docs, id_col, text_col).mapInArrow(digested, ROWS)


def shard_of(shards: int):
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard")


def tickets(rows: DataFrame, shards: int) -> DataFrame:
    """One row for each text and input partition: its largest (id, number) and its copies."""
    last = F.max(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "seq")).alias("last")
    folded = rows.groupBy("digest", "part").agg(last, F.count("*").alias("copies"))
    return folded.select(
        shard_of(shards), "digest", "part", F.col("last.id").alias("doc_id"), F.col("last.seq").alias("seq"), "copies"
    )


def empty_index(rows: DataFrame) -> CuckooIndex:
    """An index without digests, cut for as many texts as ``rows`` may hold."""
    spark = rows.sparkSession
    shards = max(4 * shuffle_partitions(spark), -(-rows.count() // SHARD_DIGESTS))
    return CuckooIndex(spark.createDataFrame([], INDEX), shards)


def _loaded(row: pd.DataFrame) -> CuckooShard:
    return CuckooShard.from_row(next(row.itertuples())) if len(row) else CuckooShard()


def insert(index: CuckooIndex, batch: DataFrame) -> CuckooIndex:
    """The index with a batch of tickets inserted."""

    def into(row: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        shard = _loaded(row)
        for x in new.itertuples():
            shard.insert(x.digest, x.doc_id, x.part, x.seq, x.copies)
        number = (new if len(new) else row)["shard"].iloc[0]
        return pd.DataFrame([shard.to_row(int(number))])

    both = index.rows.groupBy("shard").cogroup(batch.groupBy("shard"))
    return CuckooIndex(saved(both.applyInPandas(into, INDEX), "cuckoo"), index.shards)


def delete(index: CuckooIndex, digests: DataFrame) -> CuckooIndex:
    """The index without the given ``digest`` values; those not live are passed over."""

    def out_of(row: pd.DataFrame, gone: pd.DataFrame) -> pd.DataFrame:
        if not len(row):
            return pd.DataFrame(columns=[x.split()[0] for x in INDEX.split(", ")])
        shard = _loaded(row)
        for digest in gone["digest"]:
            shard.delete(digest)
        return pd.DataFrame([shard.to_row(int(row["shard"].iloc[0]))])

    gone = digests.select("digest").distinct().select("digest", shard_of(index.shards))
    both = index.rows.groupBy("shard").cogroup(gone.groupBy("shard"))
    return CuckooIndex(saved(both.applyInPandas(out_of, INDEX), "cuckoo"), index.shards)


def probe(index: CuckooIndex, batch: DataFrame) -> DataFrame:
    """For every ticket whose digest is live: the row that stays and the number of copies."""

    def look(row: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        shard = _loaded(row)
        found = []
        for x in asked.itertuples():
            held = shard.find(x.digest)
            if held is not None:
                found.append((x.digest, x.part, *held[1:]))
        names = [x.split()[0] for x in FOUND.split(", ")]
        return pd.DataFrame(found, columns=names)

    return index.rows.groupBy("shard").cogroup(batch.groupBy("shard")).applyInPandas(look, FOUND)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with the row that stays of its text.

    doc_id, keep_id, group_size, kept, text_sha256, part, seq (position in the input).
    """
    rows = saved(digest_rows(docs, id_col, text_col), "digests")
    index = empty_index(rows)
    batch = saved(tickets(rows, index.shards), "tickets")
    found = probe(insert(index, batch), batch)
    joined = rows.join(found, ["digest", "part"])
    return joined.select(
        "doc_id",
        F.nullif("keep_id", F.lit(NO_ID)).alias("keep_id"),
        "group_size",
        ((F.col("part") == F.col("keep_part")) & (F.col("seq") == F.col("keep_seq"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "part",
        "seq",
    )
