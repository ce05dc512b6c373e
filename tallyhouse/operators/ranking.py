"""Top rows per group and numbering of whole results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.sources.sinks import shared_root


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str
) -> DataFrame:
    """First ``n`` rows of each key. Spark trims every key to ``n`` rows before
    the shuffle, so a key with most of the rows still moves few of them."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, place).filter(F.col(name) <= n)


def number_rows(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Consecutive numbers from 1 in the given total order.

    The rows are range-sorted and checkpointed, each sorted partition is
    counted, and the position inside the partition is added to the count of
    all earlier ones. The table of counts has one row for each partition.
    """
    shared_root(df.sparkSession)
    placed = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.join(offsets, "_part")
        .withColumn(name, F.col("_before") + inside + 1)
        .drop("_at", "_part", "_before")
    )
