"""Expected values of the golden shop (FIXTURES.md §3)."""

from datetime import date, datetime
from decimal import Decimal

from conftest import NOON, TODAY, d, frame, rows
from pyspark.sql import functions as F

from tallyhouse.plans import catalogue, inventory, ledger, receivables, sales


def test_daily_summary(shop):
    assert rows(sales.daily_summary(shop, TODAY)) == [(34850, 3, 10125, "Cola", 5)]


def test_day_without_sales(shop):
    assert rows(sales.daily_summary(shop, date(2020, 1, 1))) == [(0, 0, 0, "None", 0)]
    closing = sales.daily_closing(shop, date(2020, 1, 1)).first()
    assert (closing.average_sale, closing.margin_pct, closing.cash_pct) == (0, 0, 0)


def test_dashboard(shop):
    got = sales.dashboard_kpis(shop, TODAY).first()
    assert (got.cash_total, got.mpesa_total, got.credit_total) == (350, 34500, 0)
    assert (got.low_stock_count, got.critical_count) == (2, 1)
    assert (got.total_debt, got.overdue_count) == (2000, 0)


def test_trend_is_zero_filled(shop):
    got = rows(sales.sales_trend(shop.sales, TODAY))
    assert [v for _, v in got] == [0, 0, 0, 0, 0, 2400, 34850]
    assert (got[0][0], got[-1][0]) == (date(2024, 3, 7), TODAY)


def test_sales_report_includes_midnight_of_the_next_day(shop):
    got = rows(sales.sales_report(shop, TODAY), "id", "item_count", "customer")
    assert got == [
        (4, 1, "Walk-in"), (6, 2, "Walk-in"), (2, 1, "Walk-in"), (1, 1, "Walk-in"), (3, 1, "Ann"),
    ]


def test_sales_report_summary(shop):
    got = sales.sales_report_summary(shop, TODAY).first()
    assert (got.total_sales, got.transaction_count, got.total_profit) == (37320, 5, 11550)
    assert got.average_sale == 7464
    assert (got.cash_total, got.mpesa_total, got.credit_total) == (420, 34500, 2400)
    assert (got.cash_pct, got.mpesa_pct, got.credit_pct) == (1.1, 92.4, 6.4)


def test_products_report_leaves_out_products_sold_only_outside(shop):
    report = sales.products_report(shop, TODAY)
    got = rows(report.orderBy("rank"), "name", "total_sold", "total_revenue", "bar_pct", "medal")
    assert got == [
        ("Cola", 6, 420, 100.0, "gold"),
        ("Curtain", 2, 2400, 2 / 6 * 100, "silver"),
        ("TV", 1, 35000, 1 / 6 * 100, "bronze"),
        ("Pepsi", None, None, 0, None),
        ("Kettle", None, None, 0, None),
        ("Radio", None, None, 0, None),
    ]
    assert rows(sales.products_report_totals(report)) == [(9, 37820, 6)]


def test_products_report_keeps_lines_of_undated_sales(shop, spark):
    undated = shop.sales.withColumn(
        "sale_date", F.when(F.col("id") != 5, F.col("sale_date"))
    )
    got = rows(sales.products_report(shop.replace(sales=undated), TODAY), "name", "total_sold")
    assert ("Shirt", 1) in got


def test_products_report_keeps_lines_without_a_sale(shop):
    lost = shop.replace(sales=shop.sales.filter("id != 5"))
    got = rows(sales.products_report(lost, TODAY), "name", "total_sold", "total_revenue")
    assert ("Shirt", 1, 500) in got


def test_categories_report_counts_lines(shop):
    report = sales.categories_report(shop, TODAY)
    got = rows(report, "category", "transaction_count", "sale_count", "items_sold", "revenue")
    assert sorted(got) == [
        ("Curtains", 1, 1, 2, 2400), ("Drinks", 4, 3, 6, 420), ("Electronics", 1, 1, 1, 35000),
    ]
    shares = [r.share_pct for r in report.collect()]
    assert abs(sum(shares) - 100) < 1e-9
    assert rows(sales.categories_report_totals(report)) == [(6, 9, 37820, 3)]


def test_users_report(shop):
    report = sales.users_report(shop, TODAY)
    got = rows(report.orderBy("rank"), "username", "sales_count", "total_sales", "avg_sale")
    assert got == [("user2", 1, 34500, 34500), ("user1", 4, 2820, 705)]
    assert rows(sales.users_report_totals(report)) == [(37320, 5, 2)]


def test_week_and_month(shop):
    assert rows(sales.top_products_week(shop, TODAY)) == [
        (1, "Cola", 6), (2, "Curtain", 2), (3, "TV", 1),
    ]
    assert sorted(rows(sales.category_sales_month(shop, TODAY))) == [
        ("Curtains", 2400), ("Drinks", 420), ("Electronics", 35000),
    ]


def test_export(shop):
    got = [r.asDict() for r in sales.export_sales(shop, TODAY).collect()]
    assert len(got) == 6 and got[0]["Date"] == "2024-03-14 00:00:00"
    six = [r for r in got if r["Receipt #"] == "R6"]
    assert len(six) == 2
    assert {(r["Customer"], r["Payment Method"], r["Cashier"]) for r in six} == {
        ("Walk-in", "CASH", "user1")
    }
    assert rows(sales.export_summary(shop, TODAY)) == [
        ("Total Sales", "KSh 37,320.00"),
        ("Total Transactions", "5"),
        ("Average Sale", "KSh 7,464.00"),
        ("Report Period", "2024-02-12 to 2024-03-13"),
    ]


def test_stock_list(shop):
    got = rows(inventory.stock_list(shop, NOON), "name", "status", "days_remaining")
    assert got == [
        ("Cola", "healthy", 250), ("Curtain", "low", 150), ("Kettle", "low", 999),
        ("Pepsi", "out_of_stock", 0), ("Shirt", "healthy", 999), ("TV", "critical", 150),
    ]
    assert rows(inventory.stock_list(shop, NOON, category_id=4, search="PEP"), "name") == [
        ("Pepsi",)
    ]


def test_low_stock(shop):
    got = rows(inventory.low_stock(shop, NOON), "name", "suggested_restock")
    assert got == [("Pepsi", 10), ("TV", 10)]
    assert rows(inventory.low_stock_counts(shop.products)) == [(1, 1, 2)]


def test_dead_stock(shop):
    got = rows(inventory.dead_stock(shop, NOON), "name", "value_at_risk", "days_unsold")
    assert sorted(got) == [("Kettle", 7200, 30), ("Shirt", 3300, 30)]


def test_history_is_newest_first(shop):
    got = rows(inventory.recent_movements(shop, 2).orderBy("product_id", "position"))
    assert [(r[0], r[1], r[3], r[4]) for r in got] == [
        (1, 1, -1, "-1"), (1, 2, 5, "+5"), (3, 1, 6, "+6"),
    ]
    sold = rows(inventory.recent_product_sales(shop).filter("product_id = 1"), "receipt_number")
    assert sorted(sold) == [("R1",), ("R4",), ("R6",), ("R6",)]


def test_debtors(shop):
    for status in ("", "due_soon", "pending"):
        got = rows(
            receivables.debtors_list(shop.debtors, TODAY, status, "ANN"),
            "balance",
            "debt_status",
            "aging_category",
        )
        assert got == [(2000, "due_soon", "0-3 days")]
    assert receivables.debtors_list(shop.debtors, TODAY, "overdue").isEmpty()
    assert rows(receivables.debtors_list(shop.debtors, TODAY, search="07"), "id") == [(1,)]
    assert rows(receivables.debt_summary(shop.debtors, TODAY)) == [(2000, 1, 0)]


def test_debtor_profile(shop):
    got = receivables.debtor_profile(shop, TODAY).first()
    assert (got.paid_pct, got.receipt_number, got.line_count, got.payment_count) == (
        16.7, "R3", 1, 0,
    )
    assert rows(receivables.debtor_lines(shop), "product", "quantity") == [("Curtain", 2)]


def test_catalogue(shop):
    assert rows(catalogue.categories_overview(shop), "name", "product_count") == [
        ("Clothes", 1), ("Curtains", 1), ("Drinks", 2), ("Electronics", 3),
    ]
    assert sorted(rows(catalogue.pos_catalogue(shop), "name")) == [
        ("Cola",), ("Curtain",), ("Kettle",), ("Shirt",), ("TV",),
    ]
    assert rows(catalogue.product_search(shop.products, "t"), "name") == []
    assert rows(catalogue.product_search(shop.products, "T_"), "name") != []
    supplier = dict(rows(catalogue.restock_lookup(shop), "name", "supplier"))
    assert (supplier["Cola"], supplier["TV"], supplier["Pepsi"]) == ("Bulk", "Tele Ltd", None)


def test_receipts_have_one_header_and_flat_lines(shop):
    assert rows(catalogue.receipts(shop).groupBy().count()) == [(6,)]
    lines = catalogue.receipt_lines(shop)
    assert lines.count() == 7
    assert rows(lines.filter("sale_id = 6"), "product") == [("Cola",), ("Cola",)]
    empty = shop.replace(sale_items=shop.sale_items.filter("sale_id != 6"))
    assert catalogue.receipts(empty).filter("id = 6").count() == 1


def _payments(spark, amounts):
    return spark.createDataFrame(
        [
            (i, 1, Decimal(a), datetime(2024, 3, 13, 12, i), date(2024, 3, 13))
            for i, a in enumerate(amounts)
        ],
        "id bigint, debtor_id bigint, amount decimal(18,2), payment_date timestamp_ntz, day date",
    )


def test_payments_in_order(shop, spark):
    given = _payments(spark, [500, 1600, 1500, 0])
    done = ledger.apply_payments(
        shop.debtors, shop.sales, given, ["payment_date", "id"], "day"
    )
    log = {r.id: r for r in done.log.collect()}
    assert [log[i].accepted for i in range(4)] == [True, False, True, False]
    assert log[1].reject_reason == "exceeds balance"
    assert log[3].reject_reason == "amount not positive"
    got = rows(done.debtors, "amount_paid", "balance", "status")
    assert got == [(2400, 0, "paid")]
    sale = done.sales.filter("id = 3").first()
    assert (sale.amount_paid, sale.balance) == (2400, 0)
    assert done.sales.count() == 6


def test_payments_and_write_offs_are_dated(shop, spark):
    given, order = _payments(spark, [500, 1600, 700, 0]), ["payment_date", "id"]
    moments = dict(rows(given, "id", "payment_date"))
    renamed = given.withColumnRenamed("payment_date", "made")
    done = ledger.apply_payments(shop.debtors, shop.sales, renamed, ["made", "id"], "day", paid_at="made")
    assert rows(done.debtors, "updated_at", "balance") == [(moments[2], 800)]
    assert sorted(rows(done.payments, "id", "amount", "payment_date")) == [
        (0, 500, moments[0]), (2, 700, moments[2]),
    ]
    refused = ledger.apply_payments(
        done.debtors, shop.sales, given.filter("id = 1"), order, "day", paid_at="payment_date"
    )
    assert rows(refused.debtors, "updated_at") == [(moments[2],)] and refused.payments.isEmpty()
    asked = spark.createDataFrame([(1, "gone", 1)], "id bigint, reason string, seq int")
    closed = ledger.write_off(done.debtors, asked, at=NOON)
    assert rows(closed.debtors, "updated_at", "status") == [(NOON, "written_off")]


def test_write_off_leaves_the_sale_behind(shop, spark):
    asked = spark.createDataFrame(
        [(1, "moved", 2), (1, "gone", 1), (99, "gone", 3), (None, "gone", 4)],
        "id bigint, reason string, seq int",
    )
    done = ledger.write_off(shop.debtors, asked)
    assert sorted(rows(done.rejects, "seq", "reject_reason")) == [
        (2, "already paid"), (3, "unknown debtor"), (4, "unknown debtor"),
    ]
    assert rows(done.payments, "debtor_id", "amount", "payment_method", "notes") == [
        (1, 2000, "write_off", "WRITE OFF - Reason: gone")
    ]
    assert rows(done.debtors, "amount_paid", "balance", "status") == [(2400, 0, "written_off")]
    paid = shop.payments.unionByName(done.payments, allowMissingColumns=True)
    assert rows(ledger.debt_drift(done.debtors, paid, shop.sales)) == [(1, 0, 0, 2000)]
    again = ledger.write_off(done.debtors, asked)
    assert again.payments.isEmpty() and again.rejects.count() == 4


def test_stock_drift_and_balance(shop):
    balance = dict(rows(ledger.stock_balance(shop.stock_entries, shop.sale_items)))
    assert balance == {1: 53, 3: 5, 4: -2, 5: -1}
    drift = {r.product_id: r.drift for r in
             ledger.stock_drift(shop.products, shop.stock_entries, shop.sale_items).collect()}
    assert drift == {1: -3, 4: 12, 5: 12, 6: 8, 7: 4}


def test_oversell_audit(shop):
    got = ledger.oversell_audit(shop.stock_entries, shop.sale_items, shop.sales)
    assert sorted(rows(got, "product_id", "sale_id", "quantity", "available")) == [
        (4, 3, 2, 0), (5, 5, 1, 0),
    ]


def test_extract_debtors_and_duplicate_receipts(shop):
    assert rows(ledger.extract_debtors(shop.sales), "sale_id", "balance", "status") == [
        (3, 2000, "pending")
    ]
    twice = shop.sales.unionByName(shop.sales.filter("id = 2"))
    assert rows(ledger.duplicate_receipts(twice)) == [("R2", 2, 2)]
    assert ledger.duplicate_receipts(shop.sales).isEmpty()


def test_statement_ends_at_the_stored_balance(spark, shop):
    debtor = frame(spark, "debtors", "id sale_id customer_name total_owed amount_paid balance", [(1, 3, "Ann", d(2400), d(900), d(1500))])
    paid = frame(spark, "payments", "id debtor_id amount payment_method payment_date user_id", [(1, 1, d(500), "cash", datetime(2024, 3, 13, 9), 1)])
    (row,) = receivables.debtor_statement(shop.replace(debtors=debtor, payments=paid)).collect()
    assert (row.paid_to_date, row.left_to_pay) == (d(500), d(1500))
