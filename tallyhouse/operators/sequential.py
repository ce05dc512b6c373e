"""Accepting withdrawals in order, where each answer depends on earlier ones.

A key has an opening level. Its events arrive in order with a signed delta; an
event is accepted when the level stays at 0 or above, otherwise it is refused
and changes nothing. A running sum cannot express this, because a refused
event must not count for later ones.

Where opening and running sum never fall below 0, every event of the key is
accepted and the sums are the answer: most keys need no more than a window.
The other keys are cut into chunks that are folded side by side from guessed
opening levels. Every chunk also reports the range of opening levels for which
its decisions, and so its net change, stay the same. Walking over these short
reports shows which guesses were wrong; only those chunks are folded again. The
walk repeats until every chunk was folded from its true level, so the answer is
exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.operators.running import running_totals
from tallyhouse.sources.sinks import shared_root

# Events in one chunk of a key.
CHUNK_EVENTS = 100_000

_NO_LIMIT = np.iinfo(np.int64).max
_NO_FLOOR = np.iinfo(np.int64).min


def accept_in_order(
    events: DataFrame,
    openings: DataFrame,
    key: str,
    order: Sequence[str],
    delta: str,
    bucket: str,
    chunk_events: int = CHUNK_EVENTS,
) -> DataFrame:
    """Events with ``accepted`` and ``level_after``.

    ``order`` must be total inside a key and ``bucket`` a column that rises
    with it. ``openings`` holds ``key`` and ``opening`` (bigint) for every key;
    events of other keys are dropped. A null opening is 0. ``delta`` is bigint.
    """
    shared_root(events.sparkSession)
    sums = {"_pos": F.lit(1).cast("bigint"), "_sum": F.col(delta)}
    placed = running_totals(events, [key], F.col(bucket), [F.col(c) for c in order], sums)
    placed = placed.withColumn("chunk", F.floor((F.col("_pos") - 1) / chunk_events)).checkpoint()
    # Openings join the chunks, never the events of a large key.
    openings = openings.select(key, F.coalesce("opening", F.lit(0)).alias("opening"))
    lowest = F.min(F.col("opening") + F.col("_low")).over(Window.partitionBy(key))
    chunks = (
        placed.groupBy(key, "chunk")
        .agg(F.sum(delta).alias("net"), F.min("_sum").alias("_low"))
        .join(openings, key)
        .withColumn("_tight", lowest < 0)
    )
    after = (F.col("opening") + F.col("_sum")).alias("level_after")
    easy = placed.join(chunks.filter("not _tight").select(key, "chunk", "opening"), [key, "chunk"])
    easy = easy.select(*events.columns, F.lit(True).alias("accepted"), after)
    tight = chunks.filter("_tight").select(key, "chunk", "opening", "net")
    return easy.unionByName(_fold_chunks(placed, tight, key, delta).select(*easy.columns))


def replay(
    deltas: np.ndarray,
    level: int,
    opening: int | None = None,
    low: int = _NO_FLOOR,
    high: int = _NO_LIMIT,
) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Fold events of one chunk: answers, levels, and the range of opening levels
    (lowest included, highest excluded) for which all answers are the same. A
    later part of a chunk goes on from the last level, the opening and the range."""
    accepted = np.empty(len(deltas), dtype=bool)
    levels = np.empty(len(deltas), dtype=np.int64)
    opening = level if opening is None else opening
    for i, delta in enumerate(deltas.tolist()):
        spare = level + delta
        if spare >= 0:
            accepted[i], level = True, spare
            low = max(low, opening - spare)
        else:
            accepted[i] = False
            high = min(high, opening - spare)
        levels[i] = level
    return accepted, levels, low, high


def accept_short(
    events: DataFrame, openings: DataFrame, key: str, order: Sequence[str], delta: str
) -> DataFrame:
    """``accept_in_order`` for keys with one opening and no more events than a chunk has: one shuffle, in which the
    openings come as rows before the events of their key, and one pass over sorted partitions that keeps a
    level. Keys and ``delta`` are bigint."""
    names = events.columns
    answered = T.StructType(
        [*events.schema.fields, T.StructField("accepted", T.BooleanType()), T.StructField("level_after", T.LongType())]
    )

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = level = None
        for batch in batches:
            keys, opens = batch.column(key).to_pandas(), batch.column("_opening").is_valid().to_numpy(False)
            deltas, starts = (batch.column(c).fill_null(0).to_numpy() for c in (delta, "_opening"))
            accepted, levels = np.empty(len(keys), bool), np.empty(len(keys), np.int64)
            for run in _runs(keys) if len(keys) else ():
                first, now = run.start, keys.iat[run.start]
                if now != at:
                    at, level = now, None
                if opens[first]:
                    level, first = int(starts[first]), first + 1
                if level is None:  # a key without opening
                    opens[run] = True
                elif first < run.stop:
                    accepted[first : run.stop], levels[first : run.stop], _, _ = replay(deltas[first : run.stop], level)
                    level = int(levels[run.stop - 1])
            columns = [*(batch.column(c) for c in names), pa.array(accepted), pa.array(levels)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "accepted", "level_after"]).filter(pa.array(~opens))

    opened = openings.select(key, F.coalesce("opening", F.lit(0)).cast("bigint").alias("_opening"))
    return (
        events.unionByName(opened, allowMissingColumns=True)
        .filter(F.col(key).isNotNull())
        .repartition(key)
        .sortWithinPartitions(key, F.col("_opening").isNull(), *order)
        .mapInArrow(answers, answered)
    )


def _runs(values: pd.Series) -> Iterator[slice]:
    """Stretches of equal neighbours."""
    edges = np.flatnonzero((values != values.shift()).to_numpy()[1:]) + 1
    bounds = [0, *edges.tolist(), len(values)]
    return (slice(i, j) for i, j in zip(bounds, bounds[1:], strict=False))


def _fold_chunks(placed: DataFrame, chunks: DataFrame, key: str, delta: str) -> DataFrame:
    """Events of the given chunks with their answers; ``chunks`` has all those of a key.

    Python reads sorted partitions batch by batch and keeps one chunk's state."""
    key_type = placed.schema[key].dataType.simpleString()
    unit = F.struct(key, "chunk")

    def answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = level = opening = low = high = None
        for batch in batches:
            deltas, starts = batch["delta"].to_numpy(), batch["start"].to_numpy()
            accepted, levels = np.empty(len(batch), bool), np.empty(len(batch), np.int64)
            lows, highs = np.empty(len(batch), np.int64), np.empty(len(batch), np.int64)
            for run in _runs(batch["unit"]) if len(batch) else ():
                if batch["unit"].iloc[run.start] != at:
                    at = batch["unit"].iloc[run.start]
                    level = opening = int(starts[run.start])
                    low, high = _NO_FLOOR, _NO_LIMIT
                accepted[run], levels[run], low, high = replay(
                    deltas[run], level, opening, low, high
                )
                level = int(levels[run.stop - 1])
                lows[run], highs[run] = low, high
            yield batch[[key, "chunk", "_pos", "start"]].assign(
                accepted=accepted, level_after=levels, low=lows, high=highs
            )

    def fold(starts: DataFrame) -> DataFrame:
        return (
            placed.select(key, "chunk", "_pos", F.col(delta).alias("delta"))
            .join(starts.select(key, "chunk", "start"), [key, "chunk"])
            .withColumn("unit", F.to_json(unit))
            .repartition(key, "chunk")
            .sortWithinPartitions(key, "chunk", "_pos")
            .mapInPandas(
                answers,
                f"{key} {key_type}, chunk bigint, _pos bigint, start bigint, accepted boolean,"
                " level_after bigint, low bigint, high bigint",
            )
        )

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Opening level of every chunk, as far as the reports tell. ``known`` is
        off for a chunk whose report does not cover its level."""
        at = level = None
        for batch in batches:
            starts, known = [], []
            columns = (batch[c] for c in ("unit", "opening", "low", "high", "net"))
            for of, opening, low, high, net in zip(*columns, strict=True):
                if of != at:
                    at, level = of, int(opening)
                starts.append(level)
                known.append(bool(low <= level < high))
                level += int(net)
                if not known[-1]:
                    level = max(level, 0)
            yield batch.drop(columns="unit").assign(
                start=np.array(starts, np.int64), known=np.array(known, bool)
            )

    def walked(reports: DataFrame) -> DataFrame:
        rows = reports.select(key, "chunk", "opening", "low", "high", "net")
        return (
            rows.withColumn("unit", F.to_json(F.struct(key)))
            .repartition(key)
            .sortWithinPartitions(key, "chunk")
            .mapInPandas(
                walk,
                f"{key} {key_type}, chunk bigint, opening bigint, low bigint, high bigint,"
                " net bigint, start bigint, known boolean",
            )
            .checkpoint()
        )

    # First guess: nothing was refused before the chunk.
    zero = F.lit(0).cast("bigint")
    state = walked(chunks.withColumns({"low": zero, "high": zero}))
    while True:
        wrong = state.filter(~F.col("known"))
        if wrong.isEmpty():
            break
        redone = (
            fold(wrong)
            .groupBy(key, "chunk")
            .agg(
                F.max("low").alias("low"),
                F.min("high").alias("high"),
                (F.max_by("level_after", "_pos") - F.first("start")).alias("net"),
            )
            .join(wrong.select(key, "chunk", "opening"), [key, "chunk"])
        )
        kept = state.filter("known").select(key, "chunk", "opening", "low", "high", "net")
        state = walked(kept.unionByName(redone))
    done = fold(state).select(key, "_pos", "accepted", "level_after")
    return placed.join(done, [key, "_pos"])
