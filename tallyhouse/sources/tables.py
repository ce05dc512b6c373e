"""Retail tables at rest: Parquet, facts partitioned by month."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators.hot_keys import left_by_merge
from tallyhouse.sources import schemas


class RetailTables:
    """The eight retail tables by attribute. A table may be given as a function
    without arguments; it is then opened on first use, so a report only pays
    for the tables it reads."""

    NAMES = (
        "categories",
        "users",
        "products",
        "sales",
        "sale_items",
        "debtors",
        "payments",
        "stock_entries",
    )

    categories: DataFrame
    users: DataFrame
    products: DataFrame
    sales: DataFrame
    sale_items: DataFrame
    debtors: DataFrame
    payments: DataFrame
    stock_entries: DataFrame

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]) -> None:
        if set(tables) != set(self.NAMES):
            raise TypeError(f"expected the tables {', '.join(self.NAMES)}")
        self._given = tables

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.NAMES:
            raise AttributeError(name)
        table = self._given[name]
        opened = table if isinstance(table, DataFrame) else table()
        setattr(self, name, opened)
        return opened

    def replace(self, **tables: DataFrame | Callable[[], DataFrame]) -> RetailTables:
        return RetailTables(**{**self._given, **tables})


# Facts and the timestamp that decides their month folder. Sale lines carry no
# date of their own and take the month of their sale.
MONTH_OF = {
    "sales": "sale_date",
    "stock_entries": "entry_date",
    "payments": "payment_date",
}


def load_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table. ``month`` is among its columns only where it is stored by month."""
    columns, path = schemas.TABLES[name], f"{root}/{name}"
    flat = spark.read.schema(schemas.ddl(columns)).parquet(path)
    if "month" not in flat.columns:
        return flat
    return spark.read.schema(schemas.ddl({**columns, "month": "string"})).parquet(path)


def load_tables(spark: SparkSession, root: str) -> RetailTables:
    return RetailTables(**{n: partial(load_table, spark, root, n) for n in RetailTables.NAMES})


#: Month of undated rows, and of lines whose sale is not there.
UNKNOWN = "unknown"


def conform(df: DataFrame, name: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Declared columns in declared order and type; absent ones become null."""
    have = set(df.columns)
    wanted = [
        (F.col(column) if column in have else F.lit(None)).cast(kind).alias(column)
        for column, kind in schemas.TABLES[name].items()
    ]
    return df.select(*wanted, *extra)


def month_of(ts: str) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM"), F.lit(UNKNOWN)).alias("month")


def with_months(tables: RetailTables) -> dict[str, DataFrame]:
    """All tables as they are stored, facts with their ``month``. Sale lines take the month of their sale."""
    out = {n: conform(getattr(tables, n), n) for n in ("categories", "users", "products", "debtors")}
    for name, ts in MONTH_OF.items():
        out[name] = conform(getattr(tables, name).withColumn("month", month_of(ts)), name, ("month",))
    months = tables.sales.select(F.col("id").alias("sale_id"), month_of("sale_date"))
    # A line without its sale is kept, under the month of undated sales.
    items = left_by_merge(tables.sale_items.drop("month"), months, "sale_id").fillna(UNKNOWN, "month")
    return {**out, "sale_items": conform(items, "sale_items", ("month",))}


def write_tables(tables: RetailTables, root: str) -> None:
    """Write all tables. ``sales`` and ``sale_items`` share month folders, so a
    report over a period prunes both sides of their join.

    Rows are gathered by month, and adaptive execution splits large months by
    their size: a month that holds most of the data still writes in parallel.
    """
    for name, df in with_months(tables).items():
        if "month" in df.columns:
            df.hint("rebalance", "month").write.mode("overwrite").partitionBy("month").parquet(f"{root}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{root}/{name}")
