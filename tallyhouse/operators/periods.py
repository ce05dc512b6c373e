"""Date filters as plain ranges on the timestamp, so they reach the scan."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT_DAYS = 30


def moment(value: datetime | date) -> Column:
    """A naive timestamp literal."""
    if not isinstance(value, datetime):
        value = datetime(value.year, value.month, value.day)
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def default_period(as_of: date, start: date | None, end: date | None) -> tuple[date, date]:
    return start or as_of - timedelta(days=REPORT_DAYS), end or as_of


def in_period(ts: str, start: date, end: date, inclusive_end: bool = True) -> Column:
    """From midnight of ``start`` to midnight after ``end``. That last instant
    belongs to the period unless ``inclusive_end`` is off."""
    last = moment(end + timedelta(days=1))
    upper = F.col(ts) <= last if inclusive_end else F.col(ts) < last
    return (F.col(ts) >= moment(start)) & upper


def on_day(ts: str, day: date) -> Column:
    return in_period(ts, day, day, inclusive_end=False)


def since_monday(ts: str, as_of: date) -> Column:
    return F.col(ts) >= moment(as_of - timedelta(days=as_of.weekday()))


def since_month_start(ts: str, as_of: date) -> Column:
    return F.col(ts) >= moment(as_of.replace(day=1))


def last_30_days(ts: str, now: datetime) -> Column:
    """Rolling window up to now, counted in time rather than whole days."""
    return F.col(ts) >= moment(now - timedelta(days=30))


def day_spine(spark: SparkSession, first: date, last: date, name: str) -> DataFrame:
    """One row for each day of a short closed range."""
    days = (last - first).days + 1
    spine = spark.range(days, numPartitions=1)
    return spine.select(F.date_add(F.lit(first), F.col("id").cast("int")).alias(name))
