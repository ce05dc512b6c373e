"""Joining and folding sale lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.money import TOTAL
from tallyhouse.sources.tables import UNKNOWN


def of_sales(items: DataFrame, sales: DataFrame, *columns: str) -> DataFrame:
    """Lines of the given sales, with the named sale columns. Where both tables
    are stored by month, the month takes part in the join and prunes folders."""
    keys = ["sale_id"]
    if "month" in items.columns and "month" in sales.columns:
        keys.append("month")
    extra = [k for k in keys if k != "sale_id"]
    return items.join(sales.select(F.col("id").alias("sale_id"), *extra, *columns), keys)


def without_sale(items: DataFrame, sales: DataFrame) -> DataFrame:
    """Lines whose sale is not there. Where lines are stored by month, these lie with the undated ones."""
    if "month" in items.columns and "month" in sales.columns:
        items, sales = (df.filter(F.col("month") == UNKNOWN) for df in (items, sales))
    return items.join(sales.select(F.col("id").alias("sale_id")), "sale_id", "left_anti")


def revenue() -> Column:
    return F.col("quantity") * F.col("price_at_sale")


def per_product(lines: DataFrame, *also: str) -> DataFrame:
    """Lines, units and revenue by product (and ``also``). Folding before the product join
    keeps a best seller from landing on one task."""
    return lines.groupBy("product_id", *also).agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum("quantity").alias("units"),
        F.sum(revenue()).cast(TOTAL).alias("revenue"),
    )


def with_products(folded: DataFrame, products: DataFrame, *columns: str) -> DataFrame:
    """Attach product columns to rows already folded by product."""
    return folded.join(products.select(F.col("id").alias("product_id"), *columns), "product_id")


def gross_profit() -> Column:
    """Revenue less units at the current buying price; discounts are ignored."""
    return (F.col("revenue") - F.col("units") * F.col("buying_price")).cast(TOTAL)


def side_by_side(*rows: DataFrame) -> DataFrame:
    """One-row frames with different columns as a single row."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
