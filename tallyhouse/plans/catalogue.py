"""Product and category lookups, and receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import pricing, stock, text
from tallyhouse.operators import lines as L
from tallyhouse.operators.hot_keys import even_join
from tallyhouse.sources.tables import RetailTables

CATALOGUE_ROWS = 50
SUGGESTION_ROWS = 10
LINE_ORDER = ("product_id", "quantity", "price_at_sale")


def categories_overview(t: RetailTables) -> DataFrame:
    """Products of every category, inactive ones and empty categories included."""
    counts = t.products.groupBy(F.col("category_id").alias("id")).agg(
        F.count(F.lit(1)).alias("product_count")
    )
    return (
        t.categories.join(counts, "id", "left")
        .select(
            "id",
            "name",
            F.coalesce("product_count", F.lit(0)).alias("product_count"),
            F.substring("name", 1, 1).alias("initial"),
        )
        .orderBy("name")
    )


def category_list(categories: DataFrame) -> DataFrame:
    return categories.select("id", "name", "description").orderBy("name")


def pos_catalogue(
    t: RetailTables,
    category_id: int | None = None,
    search: str = "",
    limit: int | None = CATALOGUE_ROWS,
) -> DataFrame:
    """Sellable products for the sales screen, which shows the first 50."""
    shelf = t.products.filter(stock.is_sellable(F.col("current_stock"), F.col("is_active")))
    if category_id:
        shelf = shelf.filter(F.col("category_id") == category_id)
    if search:
        shelf = shelf.filter(text.contains(F.col("name"), search))
    if limit is not None:
        shelf = shelf.orderBy("id").limit(limit)
    kinds = t.categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return shelf.join(kinds, "category_id").select(
        "id",
        "name",
        F.col("selling_price").alias("price"),
        F.col("current_stock").alias("stock"),
        "category",
    )


def product_search(products: DataFrame, term: str, limit: int = SUGGESTION_ROWS) -> DataFrame:
    """Suggestions for a search term; terms under two characters find nothing."""
    found = text.contains(F.col("name"), term) if len(term) >= 2 else F.lit(False)
    return (
        products.filter(found)
        .orderBy("id")
        .limit(limit)
        .select("id", "name", "buying_price", "selling_price", "category_id", "current_stock")
    )


def product_margins(products: DataFrame) -> DataFrame:
    buying, selling = F.col("buying_price"), F.col("selling_price")
    return products.select(
        "id",
        "name",
        selling.alias("price"),
        F.col("current_stock").alias("stock"),
        buying,
        pricing.unit_profit(buying, selling).alias("profit"),
    )


def by_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``df`` whose key occurs in ``ids``: one lookup for many keys."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def restock_lookup(t: RetailTables) -> DataFrame:
    """Products with the supplier of their latest intake; manual adjustments
    are no intake. Ties at one instant go to the last id or supplier name."""
    entries = t.stock_entries.filter(
        (F.col("quantity") > 0)
        & (F.col("supplier") != "MANUAL_ADJUSTMENT")
        & (F.col("supplier") != "")
    )
    tie = "id" if "id" in entries.columns else "supplier"
    latest = entries.groupBy(F.col("product_id").alias("id")).agg(
        F.max_by("supplier", F.struct("entry_date", tie)).alias("supplier")
    )
    return t.products.join(latest, "id", "left").select(
        "id", "name", "buying_price", "selling_price", "category_id", "supplier"
    )


def receipts(t: RetailTables) -> DataFrame:
    """One header row for each given sale, with or without lines."""
    staff = t.users.select(F.col("id").alias("user_id"), F.col("username").alias("cashier"))
    return t.sales.join(staff, "user_id", "left").select(
        "id",
        "receipt_number",
        text.stamp_label(F.col("sale_date")).alias("date"),
        F.col("total_amount").alias("subtotal"),
        "discount",
        F.col("final_amount").alias("total"),
        F.col("amount_paid").alias("paid"),
        "balance",
        F.upper("payment_method").alias("payment_method"),
        "customer_name",
        "cashier",
    )


def printed_receipts(t: RetailTables) -> DataFrame:
    """The given sales as they are printed: a row for each line, with the header of its sale, and one row
    without line for a sale without lines. Nothing is nested, so a receipt may have any number of lines."""
    names = t.products.select(F.col("id").alias("product_id"), F.col("name").alias("product"))
    lines = t.sale_items.select(F.col("sale_id").alias("id"), *LINE_ORDER, F.col("total").alias("line_total"))
    return receipts(t).join(lines.join(names, "product_id", "left"), "id", "left")


def receipt_lines(t: RetailTables, even: bool = False) -> DataFrame:
    """The printed lines of the given sales, one row each: nothing is nested, so a
    receipt may have any number of lines. On paper they stand by ``LINE_ORDER``.
    ``even`` salts the products that hold most lines."""
    names = t.products.select(F.col("id").alias("product_id"), F.col("name").alias("product"))
    lines = L.of_sales(t.sale_items, t.sales, "receipt_number")
    named = (
        even_join(lines, names, "product_id", "sale_id", "left")
        if even
        else lines.join(names, "product_id", "left")
    )
    return named.select("sale_id", "receipt_number", *LINE_ORDER, "product", "total")
