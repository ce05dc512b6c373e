"""Sales replayed against the stock there was: which of them would have been refused, and what that frees.

A sale is taken whole or not at all: if one of its products has too little stock, none of its lines
counts, and what the other products keep may let later sales pass. So a sale's answer depends on several
products at once, and a product's level on answers given for others.

Products that never run short, even if every sale is taken, refuse nothing and need no more than running
totals. For the others rounds are played (``together``): each product answers its own lines exactly and in order,
counting a sale as absent where another product refused it in the round before.
An answer rests on earlier events alone; every round settles at least the earliest event that was still
wrong, and a round that repeats the refusals of the one before is the sequential answer. It is played once
more for the levels (``accept_short``, or ``accept_in_order`` for products of very many events).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators.running import by_hour_or_sale, running_total
from tallyhouse.operators.sequential import CHUNK_EVENTS, accept_in_order, accept_short
from tallyhouse.operators.together import BLOCK_EVENTS, together
from tallyhouse.sources.sinks import shared_root, written

ORDER = ["at", "kind", "sale_id", "moved"]
PLAYED = ["product_id", "at", "kind", "sale_id", "moved", "before", "fits", "kept"]


@dataclass(frozen=True)
class Replayed:
    """``sales``: id and accepted. ``rejects``: the lines that had too little. ``stock``: what is left."""

    sales: DataFrame
    rejects: DataFrame
    stock: DataFrame


def replay_sales(
    stock_entries: DataFrame,
    sale_items: DataFrame,
    sales: DataFrame,
    openings: DataFrame | None = None,
    **sizes: int,
) -> Replayed:
    """Play entries and sales in order of time, entries first at equal times, then by sale id.

    ``openings``: ``product_id`` and ``opening``; without it every product starts at 0. A negative entry is
    a removal and refused where it exceeds the stock. Undated events come first. Lines of one
    product in a sale count together; lines without a sale, product or positive quantity are left out. Sales of one
    id and time are one sale. Of several openings of a product the least is played.
    """
    shared_root(sales.sparkSession)
    received = stock_entries.filter("product_id is not null and quantity is not null").select(
        "product_id",
        F.col("entry_date").alias("at"),
        F.lit(0).alias("kind"),
        F.lit(None).cast("bigint").alias("sale_id"),
        F.col("quantity").cast("bigint").alias("moved"),
    )
    dated = sales.select(F.col("id").alias("sale_id"), F.col("sale_date").alias("at"))
    lines = sale_items.filter("quantity > 0 and product_id is not null").select("sale_id", "product_id", "quantity")
    sold = (  # merged by sale, so that a sale's lines are where they are counted together
        lines.join(dated.hint("merge"), "sale_id")
        .groupBy("sale_id", "product_id", "at")
        .agg((-F.sum("quantity")).cast("bigint").alias("moved"))
        .select("product_id", "at", F.lit(1).alias("kind"), "sale_id", "moved")
    )
    events = written(received.unionByName(sold))
    if openings is None:
        openings = events.select("product_id").distinct().withColumn("opening", F.lit(0).cast("bigint"))
    openings = openings.select("product_id", F.col("opening").cast("bigint").alias("opening")).checkpoint()
    totals, tight = _tight(events, openings)
    played = written(_play(events, tight, sizes))
    rejects = played.filter("kind = 1 and not fits").select(
        "sale_id", "product_id", "at", (-F.col("moved")).alias("quantity"), F.col("before").alias("available")
    )
    refused = written(rejects.select(F.col("sale_id").alias("id"), F.col("at").alias("_at")).distinct())
    # Other products keep all but their lines of refused sales.
    free = written(totals.join(tight, "product_id", "left_anti").select("product_id", "total"))
    lines = events.filter("kind = 1").join(free, "product_id", "left_semi")
    back = lines.join(refused, (F.col("sale_id") == F.col("id")) & F.col("at").eqNullSafe(F.col("_at")), "left_semi")
    kept = played.select("product_id", F.col("kept").alias("moved")).unionByName(free.withColumnRenamed("total", "moved"))
    kept = kept.unionByName(back.select("product_id", (-F.col("moved")).alias("moved")))
    left = kept.groupBy("product_id").agg(F.sum("moved").alias("_moved"))
    known = openings.unionByName(
        totals.select("product_id", F.lit(0).cast("bigint").alias("opening")).join(openings, "product_id", "left_anti")
    )
    stock = known.join(left, "product_id", "left").select(
        "product_id", (F.coalesce("opening", F.lit(0)) + F.coalesce("_moved", F.lit(0))).alias("stock")
    )
    asked = sales.select(F.col("id").alias("_id"), F.col("sale_date").alias("_date"))
    same = (F.col("_id") == F.col("id")) & F.col("_date").eqNullSafe(F.col("_at"))
    answers = asked.join(refused, same, "left").select(F.col("_id").alias("id"), F.col("id").isNull().alias("accepted"))
    return Replayed(answers, rejects, stock)


def _tight(events: DataFrame, openings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Products with their ``total`` if every sale is taken, and those that run short then, with ``opening`` and ``events``."""
    sums = events.groupBy("product_id").agg(
        F.sum("moved").alias("total"), F.sum(F.least("moved", F.lit(0))).alias("_out"), F.count(F.lit(1)).alias("events")
    )
    least = openings.groupBy("product_id").agg(F.min("opening").alias("opening"))
    totals = written(sums.join(least, "product_id", "left").fillna(0, "opening"))
    # A total below 0 is a level below 0; without one, the order of the events tells.
    open_ = totals.filter("opening + total >= 0 and opening + _out < 0").select("product_id")
    asked = events.join(written(open_), "product_id", "left_semi")
    stretch = by_hour_or_sale("at", "kind", "sale_id")
    levels = running_total(asked, ["product_id"], stretch, [F.col(c) for c in ORDER], F.col("moved"), "sum")
    lows = levels.groupBy("product_id").agg(F.min("sum").alias("_low"))
    found = totals.join(lows, "product_id", "left").filter("opening + coalesce(least(_low, total), total) < 0")
    return totals, written(found.select("product_id", "opening", "events"))


def _play(events: DataFrame, tight: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Events of the tight products with ``fits``, the level ``before`` them and what of them is ``kept``, where sales
    go whole or not at all. Products of more events than a chunk has are answered in chunks."""
    most = sizes.get("chunk_events", CHUNK_EVENTS)
    many = tight.filter(F.col("events") > most)
    short, long = events.join(tight.filter(F.col("events") <= most), "product_id", "left_semi"), None
    if not many.isEmpty():
        stretch = by_hour_or_sale("at", "kind", "sale_id").alias("stretch")
        long = events.join(many, "product_id", "left_semi").select("*", stretch)

    def answer_long(seen: DataFrame) -> DataFrame:
        answered = accept_in_order(seen, many.select("product_id", "opening"), "product_id", ORDER, "delta", "stretch", most)
        return _answered(answered)

    few = tight.filter(F.col("events") <= most).select("product_id", "opening")
    short, long = together(written(short), long, few, answer_long, sizes.get("block_events", BLOCK_EVENTS))
    played = _answered(accept_short(short, few, "product_id", ORDER, "delta")).select(*PLAYED)
    return played if long is None else played.unionByName(answer_long(long).select(*PLAYED))


def _answered(settled: DataFrame) -> DataFrame:
    kept = F.when(F.col("accepted"), F.col("delta")).otherwise(0)
    settled = settled.withColumn("before", F.col("level_after") - kept).withColumn("kept", kept)
    return settled.withColumn("fits", F.col("before") + F.col("moved") >= 0)
