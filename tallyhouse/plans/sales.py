"""Sales reports: dashboard, period reports, daily closing and export."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions import pricing, stock, text
from tallyhouse.functions.money import TOTAL, percent, percent_label, ratio, total
from tallyhouse.operators import lines as L
from tallyhouse.operators.hot_keys import even_join
from tallyhouse.operators.periods import (
    day_spine,
    default_period,
    in_period,
    on_day,
    since_monday,
    since_month_start,
)
from tallyhouse.operators.ranking import number_rows
from tallyhouse.plans.receivables import debt_summary
from tallyhouse.sources.tables import RetailTables

METHODS = ("cash", "mpesa", "credit")


def by_method() -> list[Column]:
    """One total for each payment method, all in the same pass."""
    return [
        total(F.when(F.col("payment_method") == m, F.col("final_amount"))).alias(f"{m}_total")
        for m in METHODS
    ]


def sales_totals(sales: DataFrame) -> DataFrame:
    return sales.agg(
        total(F.col("final_amount")).alias("total_sales"),
        F.count(F.lit(1)).alias("transaction_count"),
        *by_method(),
    )


def _line_totals(t: RetailTables, sales: DataFrame) -> DataFrame:
    """Profit, line count and best seller of the given sales, as one row."""
    folded = L.per_product(L.of_sales(t.sale_items, sales))
    known = L.with_products(folded, t.products, "name", "buying_price")
    place = F.struct("units", -F.col("product_id"))
    return known.agg(
        F.coalesce(F.sum(L.gross_profit()), F.lit(0)).cast(TOTAL).alias("total_profit"),
        F.coalesce(F.sum("lines"), F.lit(0)).alias("lines_sold"),
        F.coalesce(F.max_by("name", place), F.lit("None")).alias("best_product"),
        F.coalesce(F.max("units"), F.lit(0)).alias("best_product_quantity"),
    )


def dashboard_kpis(t: RetailTables, as_of: date) -> DataFrame:
    today = t.sales.filter(on_day("sale_date", as_of))
    levels = F.col("current_stock"), F.col("is_active")
    shelves = t.products.agg(
        F.count_if(stock.is_low(levels[0], F.col("reorder_level"), levels[1])).alias(
            "low_stock_count"
        ),
        F.count_if(stock.is_critical_dashboard(*levels)).alias("critical_count"),
    )
    debts = debt_summary(t.debtors, as_of).select("total_debt", "overdue_count")
    profit = _line_totals(t, today).select("total_profit")
    return L.side_by_side(sales_totals(today), profit, shelves, debts)


def top_products_week(t: RetailTables, as_of: date, n: int = 5) -> DataFrame:
    week = t.sales.filter(since_monday("sale_date", as_of))
    folded = L.per_product(L.of_sales(t.sale_items, week))
    top = (
        L.with_products(folded, t.products, "name")
        .orderBy(F.desc("units"), "product_id")
        .limit(n)
    )
    rank = F.row_number().over(Window.orderBy(F.desc("units"), "product_id"))
    return top.select(
        rank.cast("bigint").alias("rank"), "name", F.col("units").alias("total_quantity")
    )


def recent_sales(sales: DataFrame, n: int = 5) -> DataFrame:
    return sales.orderBy(F.desc("sale_date"), F.desc("id")).limit(n)


def sales_trend(sales: DataFrame, as_of: date, days: int = 7) -> DataFrame:
    """Daily totals of the last days, oldest first, with 0 for empty days."""
    first = as_of.fromordinal(as_of.toordinal() - days + 1)
    daily = (
        sales.filter(in_period("sale_date", first, as_of, inclusive_end=False))
        .groupBy(F.col("sale_date").cast("date").alias("date"))
        .agg(F.sum("final_amount").alias("sales"))
    )
    return (
        day_spine(sales.sparkSession, first, as_of, "date")
        .join(daily, "date", "left")
        .select("date", F.coalesce("sales", F.lit(0)).cast(TOTAL).alias("sales"))
        .orderBy("date")
    )


def _per_category(t: RetailTables, sales: DataFrame) -> DataFrame:
    folded = L.per_product(L.of_sales(t.sale_items, sales))
    return _fold_categories(L.with_products(folded, t.products, "category_id"))


def _fold_categories(sold: DataFrame, *also: str) -> DataFrame:
    return sold.groupBy("category_id", *also).agg(
        F.sum("lines").alias("transaction_count"),
        F.sum("units").alias("items_sold"),
        F.sum("revenue").cast(TOTAL).alias("revenue"),
    )


def _category_names(t: RetailTables) -> DataFrame:
    return t.categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))


def category_sales_month(t: RetailTables, as_of: date) -> DataFrame:
    month = t.sales.filter(since_month_start("sale_date", as_of))
    return (
        _per_category(t, month)
        .join(_category_names(t), "category_id")
        .select("category", F.col("revenue").alias("total"))
    )


def daily_summary(t: RetailTables, as_of: date) -> DataFrame:
    today = t.sales.filter(on_day("sale_date", as_of))
    totals = sales_totals(today).select("total_sales", "transaction_count")
    return L.side_by_side(totals, _line_totals(t, today).drop("lines_sold"))


def _period(
    t: RetailTables, as_of: date, start: date | None, end: date | None
) -> tuple[date, date, DataFrame]:
    start, end = default_period(as_of, start, end)
    return start, end, t.sales.filter(in_period("sale_date", start, end))


def sales_report(
    t: RetailTables, as_of: date, start: date | None = None, end: date | None = None
) -> DataFrame:
    """Sales of the period, newest first, with their number of lines."""
    _, _, sales = _period(t, as_of, start, end)
    counts = (
        L.of_sales(t.sale_items, sales)
        .groupBy("sale_id")
        .agg(F.count(F.lit(1)).alias("item_count"))
        .withColumnRenamed("sale_id", "id")
    )
    cashiers = t.users.select(F.col("id").alias("user_id"), "username")
    return (
        sales.join(counts, "id", "left")
        .join(cashiers, "user_id", "left")
        .select(
            "id",
            "sale_date",
            "receipt_number",
            F.coalesce("item_count", F.lit(0)).alias("item_count"),
            "final_amount",
            "payment_method",
            text.walk_in(F.col("customer_name")).alias("customer"),
            F.coalesce("username", F.lit("—")).alias("username"),
        )
        .orderBy(F.desc("sale_date"), F.desc("id"))
    )


def sales_report_summary(
    t: RetailTables, as_of: date, start: date | None = None, end: date | None = None
) -> DataFrame:
    _, _, sales = _period(t, as_of, start, end)
    row = L.side_by_side(sales_totals(sales), _line_totals(t, sales).select("total_profit"))
    return _with_mix(row).withColumn(
        "average_sale", ratio(F.col("total_sales"), F.col("transaction_count"))
    )


def _with_mix(row: DataFrame) -> DataFrame:
    """Share of each payment method in the three together."""
    grand = F.col("cash_total") + F.col("mpesa_total") + F.col("credit_total")
    shares = {f"{m}_pct": percent_label(F.col(f"{m}_total"), grand) for m in METHODS}
    return row.withColumns(shares)


def products_report(
    t: RetailTables,
    as_of: date,
    start: date | None = None,
    end: date | None = None,
    ever: DataFrame | None = None,
) -> DataFrame:
    """Performance of products sold in the period and of products never sold.

    A product sold only outside the period is left out. Lines of undated sales and lines whose sale
    is not there count in every period; the latter lie under one month where lines are
    stored by month, and else take an anti join of all lines. Beyond these, lines are matched
    to the period's sales alone; the whole line history is read for nothing but the
    distinct product ids, and not for these where ``ever`` has them.
    """
    start, end = default_period(as_of, start, end)
    kept = t.sales.filter(in_period("sale_date", start, end) | F.col("sale_date").isNull())
    counted = "product_id", "quantity", "price_at_sale"
    matched = L.of_sales(t.sale_items, kept).select(*counted)
    sold = L.per_product(matched.unionByName(L.without_sale(t.sale_items, t.sales).select(*counted))).drop("lines")
    ever = t.sale_items.select("product_id").distinct() if ever is None else ever
    ever = ever.withColumn("_ever", F.lit(True))
    shelf = t.products.withColumnRenamed("id", "product_id").join(
        _category_names(t), "category_id"
    )
    listed = (
        shelf.join(sold, "product_id", "left")
        .join(ever, "product_id", "left")
        .filter(F.col("units").isNotNull() | F.col("_ever").isNull())
        .drop("_ever")
    )
    ranked = number_rows(listed, [F.desc_nulls_last("units"), F.col("product_id")], "rank")
    most = ranked.agg(F.max(F.coalesce("units", F.lit(0))).alias("most")).scalar()
    buying, selling, units = F.col("buying_price"), F.col("selling_price"), F.col("units")
    return ranked.select(
        "rank",
        "product_id",
        "name",
        "category",
        units.alias("total_sold"),
        F.col("revenue").alias("total_revenue"),
        "current_stock",
        buying,
        selling,
        pricing.unit_profit(buying, selling).alias("profit_per_unit"),
        pricing.total_profit(buying, selling, units).cast(TOTAL).alias("total_profit"),
        percent(F.coalesce(units, F.lit(0)), most).alias("bar_pct"),
        stock.stock_dot(F.col("current_stock")).alias("stock_dot"),
        medal(F.col("rank")).alias("medal"),
    )


def medal(rank: Column) -> Column:
    return F.when(rank == 1, "gold").when(rank == 2, "silver").when(rank == 3, "bronze")


def products_report_totals(report: DataFrame) -> DataFrame:
    return report.agg(
        F.coalesce(F.sum("total_sold"), F.lit(0)).alias("total_units"),
        total(F.col("total_revenue")).alias("total_revenue"),
        F.count(F.lit(1)).alias("total_products"),
    )


def categories_report(
    t: RetailTables, as_of: date, start: date | None = None, end: date | None = None
) -> DataFrame:
    """``transaction_count`` counts lines, as its label hides; ``sale_count``
    counts the distinct sales behind them."""
    _, _, sales = _period(t, as_of, start, end)
    lines = L.per_product(L.of_sales(t.sale_items, sales), "sale_id")
    per_sale = _fold_categories(L.with_products(lines, t.products, "category_id"), "sale_id")
    folded = per_sale.groupBy("category_id").agg(
        F.count(F.lit(1)).alias("sale_count"),
        *[F.sum(c).alias(c) for c in ("transaction_count", "items_sold")],
        F.sum("revenue").cast(TOTAL).alias("revenue"),
    )
    whole = folded.agg(F.sum("revenue").alias("whole")).scalar()
    return (
        folded.join(_category_names(t), "category_id")
        .select(
            "category",
            "transaction_count",
            "sale_count",
            "items_sold",
            "revenue",
            percent(F.col("revenue"), whole).alias("share_pct"),
        )
    )


def categories_report_totals(report: DataFrame) -> DataFrame:
    return report.agg(
        F.coalesce(F.sum("transaction_count"), F.lit(0)).alias("transaction_count"),
        F.coalesce(F.sum("items_sold"), F.lit(0)).alias("items_sold"),
        total(F.col("revenue")).alias("revenue"),
        F.count(F.lit(1)).alias("category_count"),
    )


def users_report(
    t: RetailTables, as_of: date, start: date | None = None, end: date | None = None
) -> DataFrame:
    """Sales by staff member; staff without sales in the period are left out."""
    _, _, sales = _period(t, as_of, start, end)
    folded = sales.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("sales_count"),
        F.sum("final_amount").cast(TOTAL).alias("total_sales"),
    )
    whole = folded.agg(F.sum("total_sales").alias("whole")).scalar()
    staff = t.users.select(F.col("id").alias("user_id"), "username", "full_name")
    ranked = number_rows(
        folded.join(staff, "user_id"),
        [F.desc("total_sales"), F.col("user_id")],
        "rank",
    )
    return ranked.select(
        "rank",
        "username",
        "full_name",
        "sales_count",
        "total_sales",
        ratio(F.col("total_sales"), F.col("sales_count")).alias("avg_sale"),
        percent(F.col("total_sales"), whole).alias("share_pct"),
        medal(F.col("rank")).alias("medal"),
        text.initial(F.col("username")).alias("initial"),
    )


def users_report_totals(report: DataFrame) -> DataFrame:
    return report.agg(
        total(F.col("total_sales")).alias("grand_total"),
        F.coalesce(F.sum("sales_count"), F.lit(0)).alias("grand_count"),
        F.count(F.lit(1)).alias("user_count"),
    )


def daily_closing(t: RetailTables, day: date) -> DataFrame:
    sales = t.sales.filter(on_day("sale_date", day))
    row = L.side_by_side(sales_totals(sales), _line_totals(t, sales))
    made = F.col("total_sales")
    margin = F.when(made > 0, percent(F.col("total_profit"), made)).otherwise(F.lit(0.0))
    return _with_mix(row).select(
        F.lit(day).alias("closing_date"),
        "*",
        ratio(made, F.col("transaction_count")).alias("average_sale"),
        margin.alias("margin_pct"),
    )


def sales_by_method(sales: DataFrame) -> DataFrame:
    return sales.groupBy("payment_method").agg(
        F.count(F.lit(1)).alias("transactions"),
        total(F.col("final_amount")).alias("amount"),
    )


def export_sales(
    t: RetailTables,
    as_of: date,
    start: date | None = None,
    end: date | None = None,
    even: bool = False,
) -> DataFrame:
    """Flat sale lines of the period, newest sale first. ``even`` salts the products that hold most lines."""
    _, _, sales = _period(t, as_of, start, end)
    lines = L.of_sales(
        t.sale_items,
        sales,
        "sale_date",
        "receipt_number",
        "payment_method",
        "customer_name",
        "user_id",
    )
    names = t.products.select(F.col("id").alias("product_id"), F.col("name").alias("product"))
    named = (
        even_join(lines, names, "product_id", "sale_id") if even else lines.join(names, "product_id")
    )
    staff = t.users.select(F.col("id").alias("user_id"), "username")
    return (
        named.join(staff, "user_id")
        .orderBy(F.desc("sale_date"), F.desc("sale_id"), "product_id", "quantity", "price_at_sale")
        .select(
            text.stamp_label(F.col("sale_date")).alias("Date"),
            F.col("receipt_number").alias("Receipt #"),
            F.col("product").alias("Product"),
            F.col("quantity").alias("Quantity"),
            F.col("price_at_sale").alias("Price"),
            F.col("total").alias("Total"),
            F.upper("payment_method").alias("Payment Method"),
            text.walk_in(F.col("customer_name")).alias("Customer"),
            F.col("username").alias("Cashier"),
        )
    )


def export_summary(
    t: RetailTables, as_of: date, start: date | None = None, end: date | None = None
) -> DataFrame:
    """The Summary sheet: four metrics as text."""
    start, end, sales = _period(t, as_of, start, end)
    row = sales_totals(sales)
    average = ratio(F.col("total_sales"), F.col("transaction_count"))
    return row.select(
        text.format_currency(F.col("total_sales")).alias("Total Sales"),
        F.col("transaction_count").cast("string").alias("Total Transactions"),
        text.format_currency(average).alias("Average Sale"),
        F.lit(f"{start.isoformat()} to {end.isoformat()}").alias("Report Period"),
    ).unpivot(
        [],
        ["Total Sales", "Total Transactions", "Average Sale", "Report Period"],
        "Metric",
        "Value",
    )
