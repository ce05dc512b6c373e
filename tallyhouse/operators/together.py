"""Withdrawals from several keys at once, taken whole or not at all.

Keys (products) lie in blocks, each a row of packed arrays in the order of its events; the units of
withdrawal (sales) lie in blocks of their own. In a round every block of keys folds those whose lines another key's
answer added or removed, and tells the blocks of units only the lines whose answer changed; these tell the keys
which lines of others that adds or removes. So events are sorted and packed once, and rows travel only for changed
answers. Keys of very many events lie in no block: ``answer_long`` answers them as rows in the same rounds.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.operators.sequential import replay
from tallyhouse.sources.sinks import written

#: Events in a block, and from how many on a key is folded alone and not side by side with the others.
BLOCK_EVENTS = 250_000
SIDE_BY_SIDE = 2_000

_NO_TIME = np.iinfo(np.int64).min
_PACKED = pa.schema(
    [("block", pa.int32()), *((c, pa.binary()) for c in ("products", "starts", "opening", "moved", "units", "sale", "at", "kind"))]
)
_LINES = pa.schema([("units", pa.int32()), ("sale_id", pa.int64()), ("at", pa.int64()), ("line", pa.int64())])
_UNITS = pa.schema([("units", pa.int32()), ("lines", pa.binary()), ("unit", pa.binary())])
_ANSWERS = pa.schema(
    [("block", pa.int32()), ("absent", pa.binary()), ("refused", pa.binary()), ("units", pa.int32()), ("line", pa.int64())]
)
_TOLD = pa.schema([("units", pa.int32()), ("refused", pa.binary()), ("block", pa.int32()), ("line", pa.int64())])
_KINDS = {pa.int32(): "int", pa.int64(): "bigint", pa.binary(): "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{field.name} {_KINDS[field.type]}" for field in schema)


def _numbers(table: pa.Table, column: str) -> np.ndarray:
    """Values of a column that are not null."""
    return table.column(column).drop_null().to_numpy()


def _array(table: pa.Table, column: str, kind: str) -> np.ndarray:
    """The packed array of a block's only row."""
    return np.frombuffer(table.column(column)[0].as_py(), kind)


def _flags(table: pa.Table, column: str, n: int) -> np.ndarray | None:
    """Flags of a block's state, if ``table`` has a row of it."""
    kept = table.column(column).drop_null()
    if not len(kept):
        return None
    return np.unpackbits(np.frombuffer(kept[0].as_py(), np.uint8), count=n).astype(bool)


def _rows(schema: pa.Schema, **columns: object) -> pa.Table:
    """Rows of ``schema``; columns left out are null."""
    n = len(next(iter(columns.values())))
    return pa.table(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema
    )


def _packed(events: pa.Table, openings: pa.Table) -> pa.Table:
    """One row with the sorted events of a block."""
    if not events.num_rows:
        return _PACKED.empty_table()
    order = [(c, "ascending") for c in ("product_id", "at", "kind", "sale_id", "moved")]
    events = events.take(pc.sort_indices(events, sort_keys=order, null_placement="at_start"))
    products = _numbers(events, "product_id")
    firsts = np.flatnonzero(np.append(True, products[1:] != products[:-1]))
    starts = np.append(firsts, len(products)).astype(np.int32)
    known, levels = _numbers(openings, "product_id"), openings.column("opening").to_numpy()
    opening, rank = np.zeros(len(firsts), np.int64), np.argsort(known)
    if len(known):
        at = np.minimum(np.searchsorted(known[rank], products[firsts]), len(known) - 1)
        opening = np.where(known[rank][at] == products[firsts], levels[rank][at], 0).astype(np.int64)
    packed = {
        "products": products[firsts], "starts": starts, "opening": opening, "moved": _numbers(events, "moved"),
        "units": events.column("units").fill_null(-1).to_numpy(), "sale": events.column("sale_id").fill_null(0).to_numpy(),
        "at": events.column("at").cast(pa.int64()).fill_null(_NO_TIME).to_numpy(),
        "kind": events.column("kind").to_numpy().astype(np.int8),
    }
    block = events.column("block")[0].as_py()
    return _rows(_PACKED, block=[block], **{c: [values.tobytes()] for c, values in packed.items()})


def _lines_of(block: pa.Table) -> pa.Table:
    """The lines of a block's events, named by block and place."""
    units = _array(block, "units", "i4")
    at = np.flatnonzero(units >= 0)
    line = (np.int64(block.column("block")[0].as_py()) << 32) + at
    sale, when = (_array(block, c, "i8")[at] for c in ("sale", "at"))
    return _rows(_LINES, units=units[at], sale_id=sale, at=when, line=line)


def _units_of(lines: pa.Table) -> pa.Table:
    """One row with the lines of a block of units, by line, and the number of each line's unit."""
    sale, at, line = (_numbers(lines, c) for c in ("sale_id", "at", "line"))
    order = np.lexsort((at, sale))
    sale, at = sale[order], at[order]
    unit = np.empty(len(order), np.int32)
    unit[order] = np.cumsum(np.append(False, (sale[1:] != sale[:-1]) | (at[1:] != at[:-1])))
    rank = np.argsort(line)
    packed = {"lines": [line[rank].tobytes()], "unit": [unit[rank].tobytes()]}
    return _rows(_UNITS, units=lines.column("units")[:1].to_pylist(), **packed)


def _fits(moved: np.ndarray, delta: np.ndarray, starts: np.ndarray, ends: np.ndarray, level: np.ndarray, fits: np.ndarray) -> None:
    """Fill ``fits`` for the events of the keys between ``starts`` and ``ends``: whether the level before
    them is enough. Short keys take a step each at the same time."""
    sizes = ends - starts
    for k in np.flatnonzero(sizes > SIDE_BY_SIDE):
        run = slice(starts[k], ends[k])
        accepted, after, _, _ = replay(delta[run], int(level[k]))
        fits[run] = after - np.where(accepted, delta[run], 0) + moved[run] >= 0
    few = np.flatnonzero(sizes <= SIDE_BY_SIDE)
    few = few[np.argsort(-sizes[few], kind="stable")]
    starts, sizes, level = starts[few], sizes[few], level[few].copy()
    left = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), "left")
    for step, n in enumerate(left.tolist()):
        at = starts[:n] + step
        now = level[:n]
        fits[at] = now + moved[at] >= 0
        after = now + delta[at]
        np.copyto(now, after, where=after >= 0)


def _answers(block: pa.Table, news: pa.Table) -> pa.Table:
    """The state of a block after the lines that ``news`` adds or removes, and the lines whose answer changed."""
    if not block.num_rows:
        return _ANSWERS.empty_table()
    number = block.column("block")[0].as_py()
    starts, opening = _array(block, "starts", "i4").astype(np.int64), _array(block, "opening", "i8")
    moved, units = _array(block, "moved", "i8"), _array(block, "units", "i4")
    absent, before = (_flags(news, c, len(moved)) for c in ("absent", "refused"))
    if absent is None:  # the first round
        absent, before = np.zeros(len(moved), bool), np.zeros(len(moved), bool)
        keys = np.arange(len(opening))
    else:
        turned = _numbers(news, "line") & 0xFFFFFFFF
        absent[turned] ^= True
        keys = np.unique(np.searchsorted(starts, turned, "right") - 1)
    fits = ~before
    _fits(moved, np.where(absent, 0, moved), starts[keys], starts[keys + 1], opening[keys], fits)
    refused = ~fits & (units >= 0)
    changed = np.flatnonzero(refused != before)
    state = {"absent": [np.packbits(absent).tobytes()], "refused": [np.packbits(refused).tobytes()]}
    told = _rows(_ANSWERS, units=units[changed], line=(np.int64(number) << 32) + changed)
    return pa.concat_tables([_rows(_ANSWERS, block=[number], **state), told])


def _told(block: pa.Table, news: pa.Table) -> pa.Table:
    """The state of a block of units after the changed answers of ``news``, and the lines that another line's answer
    adds to or removes from their key."""
    if not block.num_rows:
        return _TOLD.empty_table()
    lines, unit = _array(block, "lines", "i8"), _array(block, "unit", "i4")
    before = _flags(news, "refused", len(lines))
    before = np.zeros(len(lines), bool) if before is None else before
    refused = before.copy()
    refused[np.searchsorted(lines, _numbers(news, "line"))] ^= True
    was, now = (np.bincount(unit, flags)[unit] - flags > 0 for flags in (before, refused))
    turned = lines[was != now]
    state = _rows(_TOLD, units=block.column("units")[:1].to_pylist(), refused=[np.packbits(refused).tobytes()])
    keys = np.where(turned < 0, -1, turned >> 32).astype(np.int32)
    return pa.concat_tables([state, _rows(_TOLD, block=keys, line=turned)])


def _unpacked(zoned: bool, schema: T.StructType) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Events of a block as rows again, with the ``delta`` they have where absent lines move nothing."""
    time = pa.timestamp("us", "UTC" if zoned else None)

    def rows(block: pa.Table, state: pa.Table) -> pa.Table:
        starts, moved, at, kind = (_array(block, c, k) for c, k in (("starts", "i4"), ("moved", "i8"), ("at", "i8"), ("kind", "i1")))
        absent = _flags(state, "absent", len(moved))
        columns = {
            "product_id": pa.array(np.repeat(_array(block, "products", "i8"), np.diff(starts))),
            "at": pa.array(at, mask=at == _NO_TIME).cast(time),
            "kind": pa.array(kind.astype(np.int32)),
            "sale_id": pa.array(_array(block, "sale", "i8"), mask=kind == 0),
            "moved": pa.array(moved),
            "delta": pa.array(np.where(absent, 0, moved)),
        }
        return pa.table([columns[c] for c in schema.names], schema.names)

    return rows


def together(
    short: DataFrame,
    long: DataFrame | None,
    opening: DataFrame,
    answer_long: Callable[[DataFrame], DataFrame],
    block_events: int = BLOCK_EVENTS,
) -> tuple[DataFrame, DataFrame | None]:
    """``short`` and ``long`` with ``delta``: ``moved``, or 0 where another key refused the unit of the line.

    Both hold ``product_id``, ``at``, ``kind``, ``sale_id`` and ``moved`` once for each unit (sale id and time) and
    product; ``opening`` has a row for each product at most. ``answer_long`` adds ``fits`` to events with ``delta``."""
    blocks = max(1, -(-short.count() // block_events))
    units = F.when(F.col("kind") == 1, F.pmod(F.xxhash64("sale_id"), F.lit(blocks))).cast("int").alias("units")
    block = F.pmod(F.xxhash64("product_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block")
    names = ["product_id", "at", "kind", "sale_id", "moved"]
    events, levels = short.select(block, units, *names), opening.select(block, "product_id", "opening")
    packed = written(events.groupBy("block").cogroup(levels.groupBy("block")).applyInArrow(_packed, _ddl(_PACKED)))
    lines = packed.select("block", "units", "sale", "at").groupBy("block").applyInArrow(_lines_of, _ddl(_LINES))
    zoned = dict(short.dtypes)["at"] == "timestamp"
    asked = absent_long = refused_long = None
    if long is not None:
        # A line in no block has a negative name.
        asked = written(long.select(*long.columns, units, (-1 - F.monotonically_increasing_id()).alias("line")))
        zero = "timestamp_ntz'1970-01-01 00:00:00'"
        micros = F.unix_micros("at") if zoned else F.expr(f"timestampdiff(MICROSECOND, {zero}, at)")
        own = asked.filter("kind = 1").select("units", "sale_id", F.coalesce(micros, F.lit(_NO_TIME)).alias("at"), "line")
        lines = lines.unionByName(own)
        absent_long, refused_long = (asked.select("line").limit(0) for _ in range(2))
    of_units = written(lines.groupBy("units").applyInArrow(_units_of, _ddl(_UNITS)))
    folded = packed.select("block", "starts", "opening", "moved", "units")
    spark = short.sparkSession
    news, told = spark.createDataFrame([], _ddl(_ANSWERS)), spark.createDataFrame([], _ddl(_TOLD))
    ask_long = long is not None

    def turned(lines: DataFrame, others: DataFrame) -> DataFrame:
        """Lines that are in one of both."""
        return lines.unionByName(others).groupBy("line").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("line")

    while True:
        both = folded.groupBy("block").cogroup(news.groupBy("block"))
        state = written(both.applyInArrow(_answers, _ddl(_ANSWERS)))
        changed = state.filter("line is not null").select("units", "line")
        state = state.filter("absent is not null")
        if ask_long:
            answered = answer_long(_with_delta(asked, absent_long))
            refused = written(answered.filter("kind = 1 and not fits").select("line"))
            of = asked.select("units", "line").join(turned(refused, refused_long), "line")
            changed, refused_long = changed.unionByName(of.select("units", "line")), refused
        if changed.isEmpty():
            break
        heard = told.filter("refused is not null").unionByName(changed, allowMissingColumns=True)
        told = written(of_units.groupBy("units").cogroup(heard.groupBy("units")).applyInArrow(_told, _ddl(_TOLD)))
        lines = told.filter("line is not null").select("block", "line")
        if lines.isEmpty():
            break
        news = state.unionByName(lines.filter("block >= 0"), allowMissingColumns=True)
        if long is not None:
            of_long = lines.filter("block < 0").select("line")
            ask_long = not of_long.isEmpty()
            absent_long = written(turned(of_long, absent_long)) if ask_long else absent_long
    schema = T.StructType([*short.select(*names).schema.fields, T.StructField("delta", T.LongType())])
    rows = packed.groupBy("block").cogroup(state.select("block", "absent").groupBy("block"))
    return (
        rows.applyInArrow(_unpacked(zoned, schema), schema),
        None if asked is None else _with_delta(asked, absent_long).drop("units", "line"),
    )


def _with_delta(events: DataFrame, absent: DataFrame) -> DataFrame:
    gone = events.join(absent.withColumn("_absent", F.lit(True)), "line", "left")
    return gone.withColumn("delta", F.when(F.col("_absent"), F.lit(0).cast("bigint")).otherwise(F.col("moved"))).drop("_absent")
