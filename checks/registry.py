"""One entry for each report and operator, run over the whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import derive
from tallyhouse.functions import debt, pricing, stock, text, validation
from tallyhouse.plans import balances, catalogue, categories, intake, inventory, ledger, receivables, replay, sales
from tallyhouse.sources import folder, mapped, sinks, versions
from tallyhouse.sources import intake as files
from tallyhouse.sources.mapped import AS_OF, NOW
from tallyhouse.sources.tables import RetailTables
from tallyhouse.sources.workbooks import parse_workbooks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def present(df: DataFrame) -> DataFrame:
    """Plain column types for comparison: double, bigint, text, boolean."""
    plain = []
    for field in df.schema.fields:
        kind, name = field.dataType, f"`{field.name}`"
        if isinstance(kind, (T.DecimalType, T.FloatType)):
            column = f"cast({name} as double)"
        elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            column = f"cast({name} as bigint)"
        elif isinstance(kind, T.DateType):
            column = f"cast({name} as string)"
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            column = f"date_format({name}, 'yyyy-MM-dd HH:mm:ss')"
        else:
            column = name
        plain.append(f"{column} as {name}")
    return df.selectExpr(*plain)


def query(build: Query) -> Query:
    QUERIES[build.__name__] = lambda spark, sf: present(build(spark, sf))
    return build


def _tables(spark: SparkSession, sf: str) -> RetailTables:
    return mapped.mapped_tables(spark, sf)


def _named(spark: SparkSession, sf: str) -> RetailTables:
    """The tables with customer names on credit sales."""
    return _tables(spark, sf).replace(sales=lambda: mapped.named_sales(spark, sf))


def _versions(spark: SparkSession, sf: str) -> str:
    """A store whose first version has the tables, with balances, and the second the late batch."""
    root = sinks.scratch_path(spark, "shop")
    balances.save_balances(spark, root, versions.publish(_named(spark, sf), root))
    versions.publish_changes(spark, root, **derive.late_batch(spark, sf))
    return root


# --- dashboard and sales reports ------------------------------------------


@query
def dashboard_kpis(spark, sf):
    return sales.dashboard_kpis(_tables(spark, sf), AS_OF)


@query
def top_products_week(spark, sf):
    return sales.top_products_week(_tables(spark, sf), AS_OF)


@query
def recent_sales(spark, sf):
    return sales.recent_sales(mapped.sales(spark, sf)).select(
        "id", "receipt_number", "final_amount", "payment_method", "sale_date"
    )


@query
def sales_trend_7d(spark, sf):
    return sales.sales_trend(mapped.sales(spark, sf), AS_OF)


@query
def category_sales_month(spark, sf):
    return sales.category_sales_month(_tables(spark, sf), AS_OF)


@query
def daily_summary(spark, sf):
    return sales.daily_summary(_tables(spark, sf), AS_OF)


@query
def sales_report(spark, sf):
    return sales.sales_report(_named(spark, sf), AS_OF)


@query
def sales_report_summary(spark, sf):
    return sales.sales_report_summary(_tables(spark, sf), AS_OF)


@query
def products_report(spark, sf):
    return sales.products_report(_tables(spark, sf), AS_OF)


@query
def products_report_totals(spark, sf):
    return sales.products_report_totals(sales.products_report(_tables(spark, sf), AS_OF))


@query
def categories_report(spark, sf):
    return sales.categories_report(_tables(spark, sf), AS_OF)


@query
def categories_report_totals(spark, sf):
    return sales.categories_report_totals(sales.categories_report(_tables(spark, sf), AS_OF))


@query
def users_report(spark, sf):
    return sales.users_report(_tables(spark, sf), AS_OF)


@query
def users_report_totals(spark, sf):
    return sales.users_report_totals(sales.users_report(_tables(spark, sf), AS_OF))


@query
def daily_closing(spark, sf):
    return sales.daily_closing(_tables(spark, sf), AS_OF)


@query
def sales_by_method(spark, sf):
    return sales.sales_by_method(mapped.sales(spark, sf))


@query
def export_sales(spark, sf):
    return sales.export_sales(_named(spark, sf), AS_OF)


@query
def export_summary(spark, sf):
    return sales.export_summary(_tables(spark, sf), AS_OF)


# --- inventory -------------------------------------------------------------


@query
def stock_list(spark, sf):
    return inventory.stock_list(_tables(spark, sf), NOW)


@query
def stock_list_search(spark, sf):
    return inventory.stock_list(_tables(spark, sf), NOW, category_id=2, search="RED%#")


@query
def low_stock(spark, sf):
    return inventory.low_stock(_tables(spark, sf), NOW)


@query
def low_stock_counts(spark, sf):
    return inventory.low_stock_counts(mapped.products(spark, sf))


@query
def dead_stock(spark, sf):
    return inventory.dead_stock(_tables(spark, sf), NOW)


@query
def product_details(spark, sf):
    return inventory.product_details(_tables(spark, sf), NOW)


@query
def product_history(spark, sf):
    return inventory.product_history(_tables(spark, sf))


@query
def recent_movements(spark, sf):
    return inventory.recent_movements(_tables(spark, sf))


@query
def recent_product_sales(spark, sf):
    return inventory.recent_product_sales(_tables(spark, sf))


# --- receivables -----------------------------------------------------------


@query
def debtors_list(spark, sf):
    return receivables.debtors_list(mapped.debtors(spark, sf), AS_OF)


@query
def debtors_overdue(spark, sf):
    return receivables.debtors_list(mapped.debtors(spark, sf), AS_OF, "overdue")


@query
def debtors_due_soon(spark, sf):
    return receivables.debtors_list(mapped.debtors(spark, sf), AS_OF, "due_soon")


@query
def debtors_pending(spark, sf):
    return receivables.debtors_list(mapped.debtors(spark, sf), AS_OF, "pending")


@query
def debtors_search(spark, sf):
    return receivables.debtors_list(mapped.debtors(spark, sf), AS_OF, search="CUSTOMER#%7")


@query
def debt_summary(spark, sf):
    return receivables.debt_summary(mapped.debtors(spark, sf), AS_OF)


@query
def debtor_profile(spark, sf):
    return receivables.debtor_profile(_tables(spark, sf), AS_OF)


@query
def debtor_lines(spark, sf):
    return receivables.debtor_lines(_tables(spark, sf))


@query
def debtor_payments(spark, sf):
    return receivables.debtor_payments(_tables(spark, sf))


@query
def debtor_statement(spark, sf):
    return receivables.debtor_statement(_tables(spark, sf))


# --- catalogue -------------------------------------------------------------


@query
def categories_overview(spark, sf):
    return catalogue.categories_overview(_tables(spark, sf))


@query
def category_list(spark, sf):
    return catalogue.category_list(mapped.categories(spark, sf))


@query
def pos_catalogue(spark, sf):
    return catalogue.pos_catalogue(_tables(spark, sf))


@query
def product_search(spark, sf):
    return catalogue.product_search(mapped.products(spark, sf), "RING")


@query
def lookup_many(spark, sf):
    wanted = mapped.star(spark, sf, "events").select(F.col("user_id").alias("id"))
    return catalogue.by_ids(mapped.products(spark, sf), wanted)


@query
def product_margin_projection(spark, sf):
    return catalogue.product_margins(mapped.products(spark, sf))


@query
def restock_lookup(spark, sf):
    return catalogue.restock_lookup(_tables(spark, sf))


@query
def receipts(spark, sf):
    return catalogue.printed_receipts(_named(spark, sf))


@query
def receipt_lines(spark, sf):
    return catalogue.receipt_lines(_tables(spark, sf))


# --- sources and sinks -----------------------------------------------------


@query
def source_table_counts(spark, sf):
    t = _tables(spark, sf)
    counts = [
        getattr(t, name).agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
        for name in RetailTables.NAMES
    ]
    return reduce(DataFrame.unionByName, counts)


def _csv_list(spark, sf):
    path = sinks.scratch_path(spark, "stock-list")
    sinks.write_csv(derive.product_list(spark, sf), path)
    return path


@query
def stock_csv_parse(spark, sf):
    return files.read_stock_csv(spark, _csv_list(spark, sf))


@query
def import_preview(spark, sf):
    shown = files.preview(files.read_csv_text(spark, _csv_list(spark, sf)))
    return shown.rows.select(
        "row_count",
        F.lit(", ".join(shown.columns)).alias("columns"),
        shown.head.agg(F.count(F.lit(1)).alias("n")).scalar().alias("head_rows"),
    )


@query
def stock_workbook_parse(spark, sf):
    return parse_workbooks(derive.workbooks(spark, sf)).drop("line")


@query
def intake_json_explode(spark, sf):
    return files.explode_intake_json(derive.intake_json(spark, sf), "batch")


@query
def sink_csv_roundtrip(spark, sf):
    path = sinks.scratch_path(spark, "export")
    t = _named(spark, sf)
    lines = sales.export_sales(t, AS_OF)
    sinks.write_export(lines, sales.export_summary(t, AS_OF), path)
    back = spark.read.option("header", True).option("escape", '"').csv(f"{path}/lines")
    summary = spark.read.option("header", True).option("escape", '"').csv(f"{path}/summary")
    return back.select(
        *[F.col(f"`{c}`").alias(c) for c in ("Date", "Receipt #", "Product", "Quantity", "Price")],
        F.col("Total"),
        F.col("Payment Method"),
        F.col("Customer"),
        F.col("Cashier"),
        summary.filter(F.col("Metric") == "Total Transactions")
        .select("Value")
        .scalar()
        .alias("summary_transactions"),
    )


@query
def sink_json_roundtrip(spark, sf):
    path = sinks.scratch_path(spark, "catalogue")
    shelf = catalogue.pos_catalogue(_tables(spark, sf), limit=None)
    sinks.write_json(shelf, path)
    return spark.read.schema(shelf.schema).json(path)


@query
def sink_json_answers(spark, sf):
    return sinks.as_json(catalogue.categories_overview(_tables(spark, sf)))


# --- scalar functions ------------------------------------------------------


@query
def scalar_stock_bands(spark, sf):
    level, reorder, active = F.col("current_stock"), F.col("reorder_level"), F.col("is_active")
    info = stock.stock_status_info(level, reorder)
    return mapped.products(spark, sf).select(
        "id",
        info["status"].alias("status"),
        info["color"].alias("color"),
        info["text"].alias("text"),
        stock.suggested_restock(reorder).alias("suggested_restock"),
        stock.stock_dot(level).alias("dot"),
        stock.stock_dot(level, reorder).alias("dot_reorder"),
        stock.is_sellable(level, active).alias("sellable"),
        stock.is_low(level, reorder, active).alias("low"),
        stock.is_critical_dashboard(level, active).alias("critical"),
    )


@query
def scalar_days_remaining(spark, sf):
    t = _tables(spark, sf)
    daily = inventory.daily_sales(t, NOW).withColumnRenamed("product_id", "id")
    days = stock.days_remaining(F.col("current_stock"), F.col("avg_daily_sales"))
    return t.products.join(daily, "id", "left").select(
        "id",
        days.alias("days"),
        stock.days_band(days).alias("list_band"),
        stock.days_band(days, 7, 14, inclusive=False).alias("detail_band"),
    )


@query
def scalar_debt_bands(spark, sf):
    balance, due = F.col("balance"), F.col("due_date")
    return mapped.debtors(spark, sf).select(
        "id",
        debt.debt_status(balance, due, AS_OF).alias("status"),
        debt.aging_bucket(F.col("created_at"), AS_OF).alias("age"),
        F.coalesce(debt.is_overdue(balance, due, AS_OF), F.lit(False)).alias("overdue"),
    )


@query
def scalar_pricing(spark, sf):
    lines = mapped.sale_items(spark, sf)
    p = mapped.products(spark, sf).select(F.col("id").alias("product_id"), "buying_price")
    buying, price = F.col("buying_price"), F.col("price_at_sale")
    pct = pricing.margin_pct(buying, price)
    return lines.join(p, "product_id").select(
        "sale_id",
        "product_id",
        "quantity",
        pricing.unit_profit(buying, price).alias("unit_profit"),
        pricing.total_profit(buying, price, F.col("quantity")).alias("total_profit"),
        F.round(pct, 4).alias("margin_pct"),
        pricing.margin_band(pct).alias("band"),
        pricing.below_cost(buying, price).alias("below_cost"),
        pricing.below_cost_warning(buying, price).alias("warning"),
    )


@query
def scalar_discount(spark, sf):
    h = derive.checkout_headers(spark, sf).join(
        mapped.sales(spark, sf).select(F.col("id").alias("sale_id"), "total_amount"), "sale_id"
    )
    subtotal = F.col("total_amount").cast("decimal(38,2)")
    off = pricing.discount_amount(subtotal, F.col("discount_type"), F.col("discount_value"))
    method, paid = F.col("payment_method"), F.col("amount_paid")
    final = pricing.final_amount(subtotal, off)
    return h.select(
        "sale_id",
        off.alias("discount"),
        final.alias("final"),
        pricing.final_amount(subtotal, off, clamp=True).alias("clamped"),
        pricing.credit_balance(method, final, paid).alias("balance"),
        pricing.payment_acceptable(method, final, paid).alias("acceptable"),
    )


@query
def scalar_repayment(spark, sf):
    return mapped.debtors(spark, sf).select(
        "id", pricing.repayment_pct(F.col("amount_paid"), F.col("total_owed")).alias("paid_pct")
    )


@query
def scalar_text(spark, sf):
    return mapped.stock_entries(spark, sf).join(
        mapped.products(spark, sf).select(F.col("id").alias("product_id"), "name", "selling_price"),
        "product_id",
    ).select(
        "product_id",
        text.sanitize_text(F.concat("name", F.lit(" é-_!?"))).alias("clean"),
        text.signed_label(F.col("quantity")).alias("signed"),
        text.initial(F.col("name")).alias("initial"),
        text.walk_in(F.nullif("supplier", F.lit("MANUAL_ADJUSTMENT"))).alias("who"),
        text.format_currency(F.col("selling_price") * 1000).alias("amount"),
        F.upper("supplier").alias("upper_name"),
    )


@query
def scalar_dates(spark, sf):
    ts = F.col("ts")
    raw = F.when(F.col("event_type") == "error", F.lit("not a date")).otherwise(
        F.date_format("ts", "yyyy-MM-dd")
    )
    return mapped.star(spark, sf, "events").select(
        "event_id",
        text.receipt_number(ts).alias("receipt_number"),
        text.parse_date(raw, AS_OF).alias("parsed"),
        text.stamp_label(ts).alias("stamp"),
        text.day_label(ts).alias("day"),
        text.time_label(ts).alias("time"),
    )


@query
def scalar_validation(spark, sf):
    rows = derive.intake_text(spark, sf)
    errors = validation.stock_entry_errors(
        F.when(F.col("seq") % 4 == 0, F.substring("name", 1, 1)).otherwise(F.col("name")),
        F.col("quantity"),
        F.when(F.col("seq") % 5 == 0, F.concat(F.lit("-"), "buying_price")).otherwise(
            F.col("buying_price")
        ),
        F.when(F.col("seq") % 6 == 0, F.lit("n/a")).otherwise(F.col("selling_price")),
    )
    return rows.select(
        "seq", (F.size(errors) == 0).alias("valid"), F.concat_ws("; ", errors).alias("errors")
    )


# --- ledger ----------------------------------------------------------------


def _imported(spark, sf):
    return intake.import_intake(
        mapped.products(spark, sf), mapped.categories(spark, sf), derive.intake_rows(spark, sf)
    )


@query
def intake_rejects(spark, sf):
    return intake.screen_intake(derive.intake_rows(spark, sf)).rejects


@query
def ledger_intake_rejects(spark, sf):
    rejects = intake.screen_intake(derive.intake_rows(spark, sf)).rejects
    return rejects.groupBy("reason", "category").agg(F.count(F.lit(1)).alias("row_count"))


@query
def ledger_category_merge(spark, sf):
    rows = intake.screen_intake(derive.intake_rows(spark, sf)).accepted
    return intake.merge_categories(mapped.categories(spark, sf), rows).select("id", "name")


@query
def ledger_intake_merge(spark, sf):
    return _imported(spark, sf).products


@query
def ledger_intake_entries(spark, sf):
    return _imported(spark, sf).entries


@query
def ledger_folder_import(spark, sf):
    """The intake from files of a folder to the products they leave."""
    path = sinks.scratch_path(spark, "intake-folder")
    derive.intake_folder(spark, sf, path)
    read = folder.read_stock_folder(spark, path)
    return intake.import_intake(mapped.products(spark, sf), mapped.categories(spark, sf), read.rows).products


@query
def ledger_price_sales(spark, sf):
    return ledger.price_sales(
        derive.checkout_headers(spark, sf), derive.checkout_lines(spark, sf)
    ).select(
        "sale_id", "line_count", "subtotal", "discount", "final_amount", "balance", "accepted"
    )


@query
def ledger_price_lines(spark, sf):
    return ledger.price_lines(derive.checkout_lines(spark, sf)).select(
        "sale_id", "product_id", "quantity", "price_at_sale", "total"
    )


@query
def ledger_oversell(spark, sf):
    t = _tables(spark, sf)
    return ledger.oversell_audit(t.stock_entries, t.sale_items, t.sales)


@query
def ledger_extract_debtors(spark, sf):
    return ledger.extract_debtors(mapped.named_sales(spark, sf))


@query
def ledger_duplicate_receipts(spark, sf):
    stamped = mapped.sales(spark, sf).withColumn(
        "receipt_number", text.receipt_number(F.col("sale_date"))
    )
    return ledger.duplicate_receipts(stamped)


@query
def ledger_stock_balance(spark, sf):
    t = _tables(spark, sf)
    return ledger.stock_balance(t.stock_entries, t.sale_items)


@query
def ledger_stock_drift(spark, sf):
    t = _tables(spark, sf)
    return ledger.stock_drift(t.products, t.stock_entries, t.sale_items)


@query
def ledger_debt_balance(spark, sf):
    return ledger.debt_balance(mapped.debtors(spark, sf), mapped.payments(spark, sf)).select(
        "id", "total_owed", "amount_paid", "balance", "recorded_payments"
    )


def _written_off(spark, sf):
    owing = mapped.debtors(spark, sf)
    undated = owing.filter(F.col("due_date").isNull()).select(
        "id", F.lit("no date").alias("reason"), F.col("id").alias("seq")
    )
    return ledger.write_off(owing, undated, at=NOW, user_id=1)


@query
def ledger_write_off(spark, sf):
    return _written_off(spark, sf).debtors.select("id", "amount_paid", "balance", "status")


@query
def ledger_write_off_payments(spark, sf):
    return _written_off(spark, sf).payments


@query
def ledger_write_off_rejects(spark, sf):
    """Every event asks for its user's debt."""
    asked = derive.late_payments(spark, sf).select(
        F.col("debtor_id").alias("id"), F.lit("asked").alias("reason"), F.col("id").alias("seq")
    )
    return ledger.write_off(mapped.debtors(spark, sf), asked).rejects


@query
def ledger_debt_drift(spark, sf):
    done = _written_off(spark, sf)
    paid = mapped.payments(spark, sf).unionByName(done.payments, allowMissingColumns=True)
    return ledger.debt_drift(done.debtors, paid, mapped.sales(spark, sf))


@query
def ledger_adjustments(spark, sf):
    log = ledger.adjustment_log(
        mapped.products(spark, sf), derive.adjustments(spark, sf), "seq", "slot"
    )
    return log.select("seq", "product_id", "accepted", "level_after", "reject_reason")


@query
def ledger_adjusted_products(spark, sf):
    done = ledger.apply_adjustments(
        mapped.products(spark, sf), derive.adjustments(spark, sf), "seq", "slot"
    )
    return done.products.select("id", "current_stock")


@query
def ledger_payments(spark, sf):
    log = ledger.payment_log(
        mapped.debtors(spark, sf),
        derive.late_payments(spark, sf),
        ["payment_date", "id"],
        "paid_on",
    )
    return log.select("id", "debtor_id", "accepted", "balance_after", "reject_reason")


@query
def ledger_hot_key_payments(spark, sf):
    """All events as payments to two debtors, keys cut into many chunks."""
    two = derive.late_payments(spark, sf).withColumn("debtor_id", F.pmod("debtor_id", F.lit(2)))
    owing = spark.range(2).select(
        "id", (F.col("id") * 1_000_000 + 250_000).cast("decimal(18,2)").alias("balance")
    )
    log = ledger.payment_log(owing, two, ["payment_date", "id"], "paid_on", chunk_events=512)
    return log.select("id", "debtor_id", "accepted", "balance_after", "reject_reason")


@query
def ledger_paid_debtors(spark, sf):
    done = ledger.apply_payments(
        mapped.debtors(spark, sf),
        mapped.sales(spark, sf),
        derive.late_payments(spark, sf),
        ["payment_date", "id"],
        "paid_on",
    )
    sale = done.sales.select(
        F.col("id").alias("sale_id"),
        F.col("amount_paid").alias("sale_paid"),
        F.col("balance").alias("sale_balance"),
    )
    return done.debtors.join(sale, "sale_id").select(
        "id", "amount_paid", "balance", "status", "sale_paid", "sale_balance"
    )


@query
def ledger_product_changes(spark, sf):
    return ledger.apply_product_changes(
        mapped.products(spark, sf), derive.product_changes(spark, sf)
    ).select("id", "reorder_level", "is_active")


@query
def ledger_product_change_rejects(spark, sf):
    return ledger.rejected_product_changes(
        mapped.products(spark, sf), derive.product_changes(spark, sf)
    )


def _category_changes(spark, sf):
    shelf = derive.shelf_categories(spark, sf)
    checked = categories.check_category_changes(
        shelf, mapped.products(spark, sf), derive.category_changes(spark, sf)
    )
    return shelf, checked


@query
def ledger_category_changes(spark, sf):
    return _category_changes(spark, sf)[1]


@query
def ledger_changed_categories(spark, sf):
    return categories.apply_category_changes(*_category_changes(spark, sf)).select("id", "name")


@query
def ledger_replayed_stock(spark, sf):
    """What is left of every product if sales without stock had been refused."""
    t = _tables(spark, sf)
    opening = t.products.select(F.col("id").alias("product_id"), F.col("current_stock").alias("opening"))
    return replay.replay_sales(t.stock_entries, t.sale_items, t.sales, opening).stock


# --- versions of the stored tables and balances advanced with them ----------


@query
def stored_version_months(spark, sf):
    """Sales and their lines by the months of the version that a batch of changes made."""
    t = versions.load_version(spark, _versions(spark, sf))
    made = t.sales.groupBy("month").agg(
        F.count(F.lit(1)).alias("sales_count"), F.sum("final_amount").alias("total_sales")
    )
    sold = t.sale_items.groupBy("month").agg(
        F.count(F.lit(1)).alias("line_count"), F.sum("quantity").alias("units")
    )
    return made.join(sold, "month", "full")


@query
def stored_products_report(spark, sf):
    return balances.products_report(spark, _versions(spark, sf), AS_OF)


@query
def ledger_advanced_stock_drift(spark, sf):
    return balances.stock_drift(spark, _versions(spark, sf))


@query
def ledger_advanced_debt_balance(spark, sf):
    return balances.debt_balance(spark, _versions(spark, sf)).select(
        "id", "total_owed", "amount_paid", "balance", "recorded_payments"
    )


# --- a product on half of all lines -----------------------------------------


def _best_seller(spark, sf):
    return _named(spark, sf).replace(sale_items=lambda: derive.best_seller_lines(spark, sf))


@query
def export_sales_even(spark, sf):
    return sales.export_sales(_best_seller(spark, sf), AS_OF, even=True)


@query
def receipt_lines_even(spark, sf):
    return catalogue.receipt_lines(_best_seller(spark, sf), even=True)
