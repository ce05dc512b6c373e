"""Stock levels, days of cover, dead stock and product history."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import pricing, stock, text
from tallyhouse.operators import lines as L
from tallyhouse.operators.periods import last_30_days
from tallyhouse.operators.ranking import top_per_group
from tallyhouse.sources.tables import RetailTables

HISTORY_ROWS = 10


def _recent_lines(t: RetailTables, now: datetime) -> DataFrame:
    return L.of_sales(t.sale_items, t.sales.filter(last_30_days("sale_date", now)))


def daily_sales(t: RetailTables, now: datetime) -> DataFrame:
    """Average units a day over the last 30 days, for products that sold."""
    return (
        _recent_lines(t, now)
        .groupBy("product_id")
        .agg((F.sum("quantity") / F.lit(30.0)).alias("avg_daily_sales"))
    )


def _with_cover(t: RetailTables, shelf: DataFrame, now: datetime) -> DataFrame:
    """Category, status and days of cover for the given products."""
    kinds = t.categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    info = stock.stock_status_info(F.col("current_stock"), F.col("reorder_level"))
    days = stock.days_remaining(F.col("current_stock"), F.col("avg_daily_sales"))
    return (
        shelf.withColumnRenamed("id", "product_id")
        .join(kinds, "category_id")
        .join(daily_sales(t, now), "product_id", "left")
        .withColumn("info", info)
        .withColumn("days_remaining", days)
    )


def stock_list(
    t: RetailTables, now: datetime, category_id: int | None = None, search: str = ""
) -> DataFrame:
    """Active products by name, optionally of one category or matching a term."""
    shelf = t.products.filter("is_active")
    if category_id:
        shelf = shelf.filter(F.col("category_id") == category_id)
    if search:
        shelf = shelf.filter(text.contains(F.col("name"), search))
    return (
        _with_cover(t, shelf, now)
        .select(
            "product_id",
            "name",
            "category",
            "current_stock",
            "reorder_level",
            F.col("info.status").alias("status"),
            F.col("info.color").alias("color"),
            F.col("info.text").alias("status_text"),
            "days_remaining",
            stock.days_band(F.col("days_remaining")).alias("days_band"),
            "buying_price",
            "selling_price",
        )
        .orderBy("name", "product_id")
    )


def low_stock(t: RetailTables, now: datetime) -> DataFrame:
    """Active products at or below their reorder level, emptiest first."""
    levels = F.col("current_stock"), F.col("reorder_level"), F.col("is_active")
    return (
        _with_cover(t, t.products.filter(stock.is_low(*levels)), now)
        .select(
            "product_id",
            "name",
            "category",
            "current_stock",
            "reorder_level",
            F.col("info.status").alias("status"),
            "days_remaining",
            stock.suggested_restock(F.col("reorder_level")).alias("suggested_restock"),
        )
        .orderBy("current_stock", "product_id")
    )


def low_stock_counts(products: DataFrame) -> DataFrame:
    """Critical (0 and below) and other low products, and both together."""
    levels = F.col("current_stock"), F.col("reorder_level"), F.col("is_active")
    low = stock.is_low(*levels)
    critical = low & stock.is_critical_listing(F.col("current_stock"))
    return products.agg(
        F.count_if(critical).alias("critical_count"),
        F.count_if(low & ~critical).alias("low_count"),
        F.count_if(low).alias("low_stock_count"),
    )


def dead_stock(t: RetailTables, now: datetime) -> DataFrame:
    """Sellable products without a sale in the last 30 days."""
    shelf = t.products.filter(stock.is_sellable(F.col("current_stock"), F.col("is_active")))
    sold = _recent_lines(t, now).select("product_id").distinct()
    kinds = t.categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return (
        shelf.withColumnRenamed("id", "product_id")
        .join(sold, "product_id", "left_anti")
        .join(kinds, "category_id")
        .select(
            "product_id",
            "name",
            "category",
            "current_stock",
            stock.value_at_risk(F.col("current_stock"), F.col("buying_price")).alias(
                "value_at_risk"
            ),
            F.lit(30).alias("days_unsold"),
        )
    )


def recent_movements(t: RetailTables, n: int = HISTORY_ROWS) -> DataFrame:
    """Latest stock entries of every product, newest first."""
    newest = [F.desc("entry_date"), *_ties(t.stock_entries, "quantity", "supplier", "user_id")]
    staff = t.users.select(F.col("id").alias("user_id"), "username")
    return (
        top_per_group(t.stock_entries, ["product_id"], newest, n, "position")
        .join(staff, "user_id", "left")
        .select(
            "product_id",
            "position",
            "entry_date",
            "quantity",
            text.signed_label(F.col("quantity")).alias("quantity_label"),
            F.coalesce(F.nullif("supplier", F.lit("")), F.lit("—")).alias("supplier"),
            "username",
        )
    )


def recent_product_sales(t: RetailTables, n: int = HISTORY_ROWS) -> DataFrame:
    """Latest sale lines of every product, newest first."""
    lines = L.of_sales(t.sale_items, t.sales, "sale_date", "receipt_number")
    newest = [F.desc("sale_date"), F.desc("sale_id"), *_ties(lines, "quantity", "price_at_sale")]
    return top_per_group(lines, ["product_id"], newest, n, "position").select(
        "product_id",
        "position",
        "sale_date",
        "receipt_number",
        "quantity",
        "price_at_sale",
        "total",
    )


def _ties(df: DataFrame, *columns: str) -> list:
    """Sort keys that settle equal times: the row id where there is one."""
    return [F.desc("id")] if "id" in df.columns else [F.desc(c) for c in columns]


def product_details(t: RetailTables, now: datetime) -> DataFrame:
    """Head of the detail page of every product."""
    buying, selling = F.col("buying_price"), F.col("selling_price")
    return (
        _with_cover(t, t.products, now)
        .withColumn("margin_pct", pricing.margin_pct(buying, selling))
        .select(
            "product_id",
            "name",
            "category",
            "current_stock",
            "reorder_level",
            F.col("info.status").alias("status"),
            "days_remaining",
            stock.days_band(F.col("days_remaining"), 7, 14, inclusive=False).alias("days_band"),
            pricing.unit_profit(buying, selling).alias("profit_per_unit"),
            "margin_pct",
            pricing.margin_band(F.col("margin_pct")).alias("margin_band"),
        )
    )


def product_history(t: RetailTables, n: int = HISTORY_ROWS) -> DataFrame:
    """Latest movements and latest sales of every product in one listing."""
    moved = recent_movements(t, n).select(
        F.lit("movement").alias("kind"),
        "product_id",
        "position",
        F.col("entry_date").alias("at"),
        "quantity",
        F.col("supplier").alias("reference"),
    )
    sold = recent_product_sales(t, n).select(
        F.lit("sale").alias("kind"),
        "product_id",
        "position",
        F.col("sale_date").alias("at"),
        "quantity",
        F.col("receipt_number").alias("reference"),
    )
    return moved.unionByName(sold)
