"""Running totals that stay parallel inside one large group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Undated sales of one stretch.
UNDATED = 4096


def by_hour(ts: str) -> Column:
    """Stretches of an hour; rows without a time come first, as they sort."""
    hour = F.unix_date(F.col(ts).cast("date")).cast("bigint") * 24 + F.hour(ts)
    return F.coalesce(hour, F.lit(-(1 << 40)))


def by_hour_or_sale(at: str, kind: str, sale_id: str) -> Column:
    """Stretches of the order (at, kind, sale id): hours, and ranges of ids where there is no time."""
    undated = F.when(F.col(kind) == 0, F.lit(-(1 << 62))).otherwise(F.expr(f"{sale_id} div {UNDATED}") - (1 << 61))
    return F.when(F.col(at).isNull(), undated).otherwise(by_hour(at))


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    value: Column,
    name: str,
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over this and all earlier rows of the key."""
    return running_totals(df, keys, bucket, order, {name: value})


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    values: Mapping[str, Column],
) -> DataFrame:
    """Add a running sum for each entry of ``values``.

    ``bucket`` cuts each key into consecutive stretches of the order (an hour,
    a range of ids). Stretches are totalled with map-side combine, the totals are
    accumulated per key, and rows are only ordered inside their own stretch: no
    task sees a whole key.
    """
    # In a struct, so that rows of a null bucket meet their own total and come first.
    df = df.withColumn("_bucket", F.struct(bucket.alias("at")))
    totals = df.groupBy(*keys, "_bucket").agg(
        *[F.sum(value).alias(f"_sum_{name}") for name, value in values.items()]
    )
    earlier = (
        Window.partitionBy(*keys)
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *keys,
        "_bucket",
        *[
            F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0)).alias(f"_before_{name}")
            for name in values
        ],
    )
    inside = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # A sort-merge join leaves the rows where the window below needs them, and
    # the offsets, one for each stretch, are never broadcast.
    return (
        df.join(offsets.hint("merge"), [*keys, "_bucket"])
        .withColumns(
            {n: F.col(f"_before_{n}") + F.sum(v).over(inside) for n, v in values.items()}
        )
        .drop("_bucket", *[f"_before_{name}" for name in values])
    )


def running_last(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    values: Mapping[str, Column],
) -> DataFrame:
    """Add the last value that is not null of each entry of ``values`` among the earlier rows of the key.

    Stretches as in ``running_totals``: each tells its own last value, and rows are
    only ordered inside their stretch.
    """
    df = df.withColumn("_bucket", F.struct(bucket.alias("at")))
    at = F.struct(*order)
    ends = df.groupBy(*keys, "_bucket").agg(
        *[F.max_by(v, F.when(v.isNotNull(), at)).alias(f"_end_{n}") for n, v in values.items()]
    )
    earlier = (
        Window.partitionBy(*keys)
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = ends.select(
        *keys,
        "_bucket",
        *[F.last(f"_end_{n}", ignorenulls=True).over(earlier).alias(f"_before_{n}") for n in values],
    )
    inside = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    found = {
        n: F.coalesce(F.last(v, ignorenulls=True).over(inside), F.col(f"_before_{n}"))
        for n, v in values.items()
    }
    return (
        df.join(carried.hint("merge"), [*keys, "_bucket"])
        .withColumns(found)
        .drop("_bucket", *[f"_before_{n}" for n in values])
    )


def running_count(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], name: str
) -> DataFrame:
    """1-based position of each row inside its key."""
    return running_total(df, keys, bucket, order, F.lit(1).cast("bigint"), name)
