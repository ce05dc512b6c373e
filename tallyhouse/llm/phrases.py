"""Removal of passages that recur, located by sharded automata of repeated phrases.

A window is ``WINDOW`` consecutive words of a document; words covered by a window that also starts
anywhere else go. Equal windows hold the same phrases of ``PHRASE`` words, and of those the one with the
least hash, so three steps find them all:

1. every document sends the least phrase of each of its windows, as a hash, once for each place; phrases
   met twice or more can belong to a recurring window;
2. documents with such phrases send the windows these stand for; windows met twice or more are the
   confirmed recurring passages. Copies within a batch are folded before they travel;
3. documents are dealt to shards. A shard gets the confirmed windows and the phrases of its documents,
   compiles the phrases into an Aho-Corasick automaton and streams its documents through it: every
   occurrence of a phrase is located, and the windows around it that are confirmed cover their words.

A shard's automaton grows with the shard's documents, not with the corpus; a phrase of a third of all
documents is one row for each shard. Words and phrases are compared by 64-bit hashes; windows by two
that are independent, 128 bits, as those of the whole corpus meet each other.

Defined results: null text has no words; texts shorter than a window lose nothing; null ids are rows
like any other; rows that repeat id and text count as two documents, get the same answer and so lose
what a window of theirs covers; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import NO_ID, saved, shuffle_partitions, texts
from tallyhouse.llm.words import gram_hashes, mixed, window_minima, word_hashes, word_spans

WINDOW = 35
PHRASE = 8
#: Windows are confirmed by a second hash, of words mixed with this.
CHECK = np.uint64(0xA0761D6478BD642F)
#: Documents that a shard is planned for.
SHARD_DOCS = 1000

SEEDS = "id long, hash long, n_words long, sha256 string, seeds array<long>"


def joined(text: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b" ".join([text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])


def least_phrases(words: np.ndarray, window: int, phrase: int) -> np.ndarray:
    """For every window the hash of its least phrase."""
    if len(words) < window:
        return np.zeros(0, np.uint64)
    return window_minima(gram_hashes(words, phrase), window - phrase + 1)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _seeds(rows: DataFrame, window: int, phrase: int) -> DataFrame:
    """For every document its words and the places of its windows' least phrases."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shas, seeds = [], [], []
            for value in batch.column("text"):
                text = value.as_buffer().to_pybytes()
                starts, ends = word_spans(text)
                counts.append(len(starts))
                shas.append(hashlib.sha256(joined(text, starts, ends)).hexdigest())
                words = word_hashes(text, starts, ends)
                grams = gram_hashes(words, phrase)
                seeds.append(_signed(grams[np.isin(grams, least_phrases(words, window, phrase))]))
            offsets = pa.array(np.cumsum([0, *map(len, seeds)]), pa.int32())
            values = pa.array(np.concatenate(seeds) if seeds else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("hash"), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.ListArray.from_arrays(offsets, values)],
                ["id", "hash", "n_words", "sha256", "seeds"],
            )

    return rows.mapInArrow(found, SEEDS)


def _windows(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """Windows whose least phrase recurs, by shard; ``twice``: more than once in the batch."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_shard: dict[int, list[np.ndarray]] = {}
            for shard, value, seeds in zip(batch.column("shard").to_pylist(), batch.column("text"), batch.column("seeds"), strict=True):
                text = value.as_buffer().to_pybytes()
                words = word_hashes(text, *word_spans(text))
                own = np.isin(_signed(least_phrases(words, window, phrase)), seeds.values.to_numpy())
                by_shard.setdefault(shard, []).append((gram_hashes(words, window)[own], gram_hashes(mixed(words ^ CHECK), window)[own]))
            for shard, some in by_shard.items():
                values, checks = (np.concatenate(x) for x in zip(*some, strict=True))
                order = np.lexsort((checks, values))
                values, checks = values[order], checks[order]
                first = np.flatnonzero(np.r_[True, (values[1:] != values[:-1]) | (checks[1:] != checks[:-1])][: len(values)])
                times = np.diff(np.r_[first, len(values)])
                columns = [pa.array(_signed(values[first])), pa.array(_signed(checks[first])), pa.array(np.full(len(first), shard, np.int32)), pa.array(times > 1)]
                yield pa.RecordBatch.from_arrays(columns, ["window", "check", "shard", "twice"])

    return docs.select("shard", "text", "seeds").mapInArrow(found, "window long, check long, shard int, twice boolean")


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in ``known``, which is sorted."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


class Automaton:
    """Phrases of words, found in texts whose words are joined by single spaces."""

    def __init__(self, phrases: set[str]):
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for x in phrases:
            self.automaton.add_word(f" {x} ")
        self.automaton.make_automaton()
        self.some = bool(phrases)

    def ends(self, text: str) -> list[int]:
        """Where occurrences end in `` text `` (with a space on either side)."""
        return [at for at, _ in self.automaton.iter(f" {text} ")] if self.some else []


def covered(text: bytes, automaton: Automaton, confirmed: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and whether a confirmed window covers them."""
    starts, ends = word_spans(text)
    n, count = len(starts), len(starts) - window + 1
    if count < 1:
        return starts, ends, np.zeros(n, bool)
    plain = joined(text, starts, ends).decode()
    lasts = np.cumsum([len(x) + 1 for x in plain.split(" ")])  # where the space after each word is
    hits = np.searchsorted(lasts, automaton.ends(plain)) - phrase + 1
    near = np.zeros(count + 1, np.int64)
    np.add.at(near, np.clip(hits + phrase - window, 0, count), 1)
    np.add.at(near, np.minimum(hits + 1, count), -1)
    at = np.flatnonzero(np.cumsum(near)[:count] > 0)
    words = gram_hashes(word_hashes(text, starts, ends), window)[at]
    found = at[among(_signed(words), confirmed)]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, found, 1)
    np.add.at(cover, found + window, -1)
    return starts, ends, np.cumsum(cover)[:n] > 0


def _removed(window: int, phrase: int):
    def shard(docs: pd.DataFrame, dictionary: pd.DataFrame) -> pd.DataFrame:
        confirmed = np.unique(dictionary["window"].to_numpy(np.int64))
        data = [x.encode() for x in docs["text"]]
        phrases: set[str] = set()
        if len(confirmed):  # the phrases that stand for this shard's confirmed windows
            for text in data:
                starts, ends = word_spans(text)
                words = word_hashes(text, starts, ends)
                own = among(_signed(gram_hashes(words, window)), confirmed)
                least = least_phrases(words, window, phrase)[own]
                for at in np.flatnonzero(np.isin(gram_hashes(words, phrase), least)).tolist() if len(least) else ():
                    phrases.add(joined(text, starts[at : at + phrase], ends[at : at + phrase]).decode())
        automaton, out = Automaton(phrases), []
        for doc_id, mark, text in zip(docs["id"], docs["hash"], data, strict=True):
            starts, ends, gone = covered(text, automaton, confirmed, window, phrase)
            kept = joined(text, starts[~gone], ends[~gone])
            spans = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0])).tolist()
            out.append((doc_id, mark, int(gone.sum()), hashlib.sha256(kept).hexdigest(), spans))
        return pd.DataFrame(out, columns=["id", "hash", "n_removed", "kept_sha256", "spans"])

    return shard


def recurring_passages(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and spans (word bounds of removed runs, start and end in turn)."""
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col)
    rows = rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("hash"), "text")
    seeds = saved(_seeds(rows, window, phrase), "seeds")
    places = seeds.select("id", "hash", F.explode("seeds").alias("seed"))
    # saved, so that the join below has plain inputs and Spark can split a phrase of many documents
    recurring = saved(places.groupBy("seed").agg(F.count("*").alias("n")).filter("n > 1").select("seed"), "recurring")
    lists = places.join(recurring, "seed", "left_semi").groupBy("id", "hash").agg(F.collect_set("seed").alias("seeds"))
    shards = max(4 * shuffle_partitions(spark), -(-seeds.count() // SHARD_DOCS))
    shard = F.pmod(F.xxhash64("id", "hash"), F.lit(shards)).cast("int")
    candidates = saved(rows.join(lists, ["id", "hash"]).withColumn("shard", shard), "candidates")
    windows = _windows(candidates, window, phrase)
    own = Window.partitionBy("window", "check")
    times = (F.count("*").over(own) > 1) | F.max("twice").over(own)
    dictionary = windows.withColumn("recurs", times).filter("recurs").select("shard", "window").distinct()
    removed = candidates.select("id", "hash", "text", "shard").groupBy("shard").cogroup(dictionary.groupBy("shard")).applyInPandas(
        _removed(window, phrase), "id long, hash long, n_removed long, kept_sha256 string, spans array<int>"
    )
    removed = removed.dropDuplicates(["id", "hash"])
    out = seeds.join(removed, ["id", "hash"], "left")
    return out.select(
        F.nullif("id", F.lit(NO_ID)).alias("doc_id"),
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"),
        F.coalesce("spans", F.array().cast("array<int>")).alias("spans"),
    )
