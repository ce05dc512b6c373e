"""Balances kept beside the stored tables and advanced from version to version.

A balance is a sum, so that of a later version is that of an earlier one plus the rows that came and
less the rows that went. Both are read from the folders in which the versions differ; the months that
neither touched are not opened. Sums of integers and decimals make the result equal to that of
the whole history, in any order and over any number of versions.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.money import TOTAL
from tallyhouse.plans import ledger, sales
from tallyhouse.sources import versions

#: Balances by their key, with the types they are kept in.
KINDS = {
    "products": ("product_id bigint", "received bigint, entries bigint, sold bigint, lines bigint"),
    "debtors": ("debtor_id bigint", "paid decimal(38,2), payments bigint"),
}


def _whole(value: Column) -> Column:
    return value.cast("bigint")


def product_moves(stock_entries: DataFrame, sale_items: DataFrame) -> DataFrame:
    """Movements as summands of a product's balance; rows carry their ``sign``."""
    moved, rows = _whole(F.col("quantity")) * F.col("sign"), _whole(F.col("sign"))
    received = stock_entries.select("product_id", moved.alias("received"), rows.alias("entries"))
    sold = sale_items.select("product_id", moved.alias("sold"), rows.alias("lines"))
    return received.unionByName(sold, allowMissingColumns=True)


def debtor_moves(payments: DataFrame) -> DataFrame:
    return payments.select(
        "debtor_id", (F.col("amount") * F.col("sign")).alias("paid"), _whole(F.col("sign")).alias("payments")
    )


def _moves(spark: SparkSession, root: str, kind: str, old: int, new: int) -> DataFrame:
    def rows(name: str) -> DataFrame:
        return versions.changed_rows(spark, root, name, old, new)

    if kind == "products":
        return product_moves(rows("stock_entries"), rows("sale_items"))
    return debtor_moves(rows("payments"))


def _ddl(kind: str) -> str:
    return ", ".join(KINDS[kind])


def _folded(moves: DataFrame, kind: str) -> DataFrame:
    key, sums = KINDS[kind]
    totals = [
        F.coalesce(F.sum(name), F.lit(0)).cast(type_).alias(name)
        for name, type_ in (column.split(" ") for column in sums.split(", "))
    ]
    return moves.groupBy(key.split(" ")[0]).agg(*totals)


def saved(spark: SparkSession, root: str, kind: str) -> list[int]:
    """Versions whose balances were written to the end."""
    paths = versions.paths(spark, f"{root}/balances/{kind}/*/_SUCCESS")
    return sorted(int(path.split("/")[-2]) for path in paths)


def balances(spark: SparkSession, root: str, kind: str, number: int | None = None) -> DataFrame:
    """Balances at a version (the newest where none is named), from the nearest earlier saved ones
    and what has changed since; from the whole history where none was saved."""
    number = versions.latest(spark, root) if number is None else number
    base = max((n for n in saved(spark, root, kind) if n <= number), default=0)
    start = (
        spark.read.schema(_ddl(kind)).parquet(f"{root}/balances/{kind}/{base}")
        if base
        else spark.createDataFrame([], _ddl(kind))
    )
    if base == number:
        return start
    return _folded(start.unionByName(_moves(spark, root, kind, base, number)), kind)


def save_balances(spark: SparkSession, root: str, number: int | None = None) -> int:
    """Write the balances of a version, advanced from those saved before."""
    number = versions.latest(spark, root) if number is None else number
    for kind in KINDS:
        if number not in saved(spark, root, kind):
            path = f"{root}/balances/{kind}/{number}"
            balances(spark, root, kind, number).write.mode("overwrite").parquet(path)
    return number


def stock_drift(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """``ledger.stock_drift`` of a version, without its line history."""
    number = versions.latest(spark, root) if number is None else number
    # A product whose rows have all been taken off has no ledger.
    moved = balances(spark, root, "products", number).filter("entries > 0 or lines > 0")
    ledgered = moved.select("product_id", (F.col("received") - F.col("sold")).alias("ledger_stock"))
    return ledger.drift_of(versions.load_version(spark, root, number).products, ledgered)


def debt_balance(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """``ledger.debt_balance`` of a version, without its payment history."""
    number = versions.latest(spark, root) if number is None else number
    paid = balances(spark, root, "debtors", number).filter("payments > 0").select(
        F.col("debtor_id").alias("id"), F.col("paid").cast(TOTAL).alias("recorded_payments")
    )
    return ledger.recorded(versions.load_version(spark, root, number).debtors, paid)


def products_report(
    spark: SparkSession,
    root: str,
    as_of: date,
    start: date | None = None,
    end: date | None = None,
    number: int | None = None,
) -> DataFrame:
    """``sales.products_report`` of a version; whether a product was ever sold comes from its balance."""
    number = versions.latest(spark, root) if number is None else number
    ever = balances(spark, root, "products", number).filter("lines > 0").select("product_id")
    return sales.products_report(versions.load_version(spark, root, number), as_of, start, end, ever)
