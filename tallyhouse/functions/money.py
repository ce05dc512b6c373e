"""Money and ratio helpers.

Money is ``decimal(18,2)`` at rest and is summed as decimal, so a total never
depends on the order in which partitions arrive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
TOTAL = "decimal(38,2)"


def money(value: Column) -> Column:
    return value.cast(MONEY)


def total(value: Column) -> Column:
    """Sum that is 0 rather than null over no rows."""
    return F.coalesce(F.sum(value), F.lit(0)).cast(TOTAL)


def cents(value: Column) -> Column:
    """Money as a whole number of cents."""
    return (money(value) * 100).cast("bigint")


def from_cents(value: Column) -> Column:
    return (value.cast("decimal(18,0)") * F.lit("0.01").cast("decimal(2,2)")).cast(MONEY)


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as double, 0 when the whole is 0 or missing."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    return ratio(part, whole) * 100


def percent_label(part: Column, whole: Column) -> Column:
    """Percentage shown with one decimal, halves to even."""
    return F.bround(percent(part, whole), 1)
