"""Versions of the stored tables and the balances advanced with them."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from conftest import TODAY, d, frame, rows

from tallyhouse.plans import balances, ledger, sales
from tallyhouse.sources import versions

SALES = "id receipt_number final_amount payment_method sale_date user_id"
ITEMS = "sale_id product_id quantity price_at_sale"
ENTRIES = "id product_id quantity entry_date"
PAYMENTS = "id debtor_id amount payment_date"


def files(root):
    return {p: p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}


def lines_of(t):
    return sorted(rows(t.sale_items, "sale_id", "product_id", "quantity", "month"), key=str)


def sale(spark, *made):
    return frame(spark, "sales", SALES, [(i, f"R{i}", d(9), "cash", at, 1) for i, at in made])


@pytest.fixture
def root(spark, shop, tmp_path):
    home = str(tmp_path / "shop")
    assert versions.publish(shop, home) == 1
    return home


def test_a_version_reads_back_whole(spark, shop, root):
    t = versions.load_version(spark, root)
    for name in t.NAMES:
        back = getattr(t, name).drop("month")
        assert back.count() == getattr(shop, name).count()
    assert rows(sales.daily_summary(t, TODAY)) == [(34850, 3, 10125, "Cola", 5)]


def test_lines_move_with_the_month_of_their_sale(spark, shop, root):
    before, old = files(root), versions.load_version(spark, root)
    held = lines_of(old)
    assert versions.publish_changes(spark, root, sales=sale(spark, (3, datetime(2024, 2, 2)))) == 2
    new = versions.load_version(spark, root)
    assert (3, 4, 2, "2024-02") in lines_of(new) and len(lines_of(new)) == 7
    assert rows(new.sales.filter("month = '2024-02'"), "id") == [(3,)]
    assert lines_of(old) == held == lines_of(versions.load_version(spark, root, 1))
    after = files(root)
    assert all(after[path] == stamp for path, stamp in before.items())
    gone = versions.manifest(spark, root, 1) - versions.manifest(spark, root, 2)
    assert {(table, month) for table, month, _ in gone} == {("sales", "2024-03"), ("sale_items", "2024-03")}


def test_new_sales_rewrite_no_month(spark, shop, root):
    first = versions.manifest(spark, root, 1)
    lines = frame(spark, "sale_items", ITEMS, [(9, 1, 4, d(70)), (9, 2, 1, d(65))])
    versions.publish_changes(
        spark, root, sales=sale(spark, (9, datetime(2024, 3, 5))), sale_items=lines
    )
    assert first < versions.manifest(spark, root, 2)
    t = versions.load_version(spark, root)
    assert t.sales.filter("month = '2024-03'").count() == 6
    assert (9, 1, 4, "2024-03") in lines_of(t) and len(lines_of(t)) == 9


def test_lines_wait_for_their_sale_and_are_replaced_whole(spark, shop, root):
    lines = frame(spark, "sale_items", ITEMS, [(8, 2, 6, d(65)), (6, 5, 1, d(500)), (None, 3, 1, d(1))])
    versions.publish_changes(spark, root, sale_items=lines)
    t = versions.load_version(spark, root)
    waiting = [row for row in lines_of(t) if row[3] == "unknown"]
    assert waiting == [(8, 2, 6, "unknown"), (None, 3, 1, "unknown")]
    assert [row for row in lines_of(t) if row[0] == 6] == [(6, 5, 1, "2024-03")]
    got = dict(rows(sales.products_report(t, TODAY), "name", "total_sold"))
    assert got["Pepsi"] == 6 and got["Shirt"] == 1
    versions.publish_changes(spark, root, sales=sale(spark, (8, None), (1, None)))
    versions.publish_changes(spark, root, sales=sale(spark, (8, datetime(2023, 5, 5))))
    t = versions.load_version(spark, root)
    assert (8, 2, 6, "2023-05") in lines_of(t) and (1, 1, 3, "unknown") in lines_of(t)
    assert rows(t.sales.filter("month = 'unknown'"), "id") == [(1,)]


def test_of_two_batches_on_one_version_the_second_fails(spark, shop, root):
    dear = shop.products.withColumn("selling_price", shop.products.selling_price + 1)
    versions.publish_changes(spark, root, base=1, products=dear)
    with pytest.raises(versions.VersionTaken):
        versions.publish_changes(spark, root, base=1, sales=sale(spark, (1, datetime(2020, 1, 1))))
    assert versions.numbers(spark, root) == [1, 2]
    t = versions.load_version(spark, root)
    assert t.sales.filter("sale_date < '2021-01-01'").count() == 0
    assert rows(t.products.filter("id = 1"), "selling_price") == [(71,)]


def test_a_batch_that_fails_leaves_the_version_as_it_was(spark, shop, root):
    broken = shop.payments.selectExpr("*", "raise_error('no')").limit(0)
    with pytest.raises(TypeError):
        versions.publish_changes(spark, root, nothing=broken)
    wrong = shop.stock_entries.withColumn("quantity", shop.stock_entries.supplier)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        versions.publish_changes(spark, root, sales=sale(spark, (1, datetime(2020, 1, 1))), stock_entries=wrong)
    assert versions.numbers(spark, root) == [1]
    assert rows(versions.load_version(spark, root).sales.filter("id = 1"), "sale_date") == [
        (datetime(2024, 3, 13, 9),)
    ]


def test_empty_tables_and_empty_batches(spark, shop, tmp_path):
    home = str(tmp_path / "empty")
    versions.publish(shop.replace(**{n: getattr(shop, n).limit(0) for n in shop.NAMES}), home)
    versions.publish_changes(spark, home, sales=shop.sales.limit(0))
    balances.save_balances(spark, home)
    assert versions.load_version(spark, home).sale_items.count() == 0
    assert balances.stock_drift(spark, home).count() == 0
    assert balances.balances(spark, home, "debtors").count() == 0


def moved(row):
    return tuple(None if value is None else str(value) for value in row)


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(moved, a.collect()), key=str) == sorted(map(moved, b.collect()), key=str)


def test_balances_advance_to_those_of_the_whole_history(spark, shop, root):
    rng = random.Random(5)
    balances.save_balances(spark, root)

    def day():
        return rng.choice([None, datetime(2024, 1, 1) + timedelta(days=rng.randrange(90))])

    for step in range(3):
        picked = rng.sample(range(1, 12), 4)
        lines = [(rng.choice([*picked, 15]), rng.randrange(1, 9), rng.randrange(1, 5), d(10)) for _ in range(6)]
        versions.publish_changes(
            spark,
            root,
            sales=sale(spark, *((i, day()) for i in picked)),
            sale_items=frame(spark, "sale_items", ITEMS, lines),
            stock_entries=frame(spark, "stock_entries", ENTRIES, [(90 + step, rng.randrange(1, 9), 7, day())]),
            payments=frame(spark, "payments", PAYMENTS, [(step, 1, d("2.50"), day()), (9 + step, None, d(1), day())]),
        )
        t = versions.load_version(spark, root)
        same(balances.stock_drift(spark, root), ledger.stock_drift(t.products, t.stock_entries, t.sale_items))
        same(balances.debt_balance(spark, root), ledger.debt_balance(t.debtors, t.payments))
        same(balances.products_report(spark, root, TODAY), sales.products_report(t, TODAY))
        if step == 1:
            balances.save_balances(spark, root)
    assert balances.saved(spark, root, "products") == [1, 3]
    same(balances.stock_drift(spark, root, 2), ledger.stock_drift(
        *(getattr(versions.load_version(spark, root, 2), n) for n in ("products", "stock_entries", "sale_items"))
    ))


def test_advanced_balances_read_no_untouched_month(spark, shop, root):
    balances.save_balances(spark, root)
    late = frame(spark, "sale_items", ITEMS, [(5, 1, 1, d(70))])
    versions.publish_changes(spark, root, sale_items=late)
    read = balances.stock_drift(spark, root).inputFiles()
    assert read and not any("month=2024-03" in path for path in read)
    assert any("month=2024-01" in path for path in read)
    assert not any("stock_entries" in path for path in read)


def test_what_a_batch_names_is_never_broadcast(spark, root, monkeypatch):
    plans, write = [], versions._write

    def seen(df, *at):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *at)

    monkeypatch.setattr(versions, "_write", seen)
    lines = frame(spark, "sale_items", ITEMS, [(2, 3, 1, d(5)), (None, 4, 1, d(5))])
    versions.publish_changes(spark, root, sales=sale(spark, (3, datetime(2024, 2, 2))), sale_items=lines)
    assert len(plans) == 2 and not [plan for plan in plans if "Broadcast" in plan]
    kept = lines_of(versions.load_version(spark, root))
    assert (2, 3, 1, "2024-03") in kept and (None, 4, 1, "unknown") in kept
    # lines without sale are read again on their own and stay
    versions.publish_changes(spark, root, sale_items=frame(spark, "sale_items", ITEMS, [(77, 1, 1, d(5))]))
    versions.publish_changes(spark, root, sale_items=frame(spark, "sale_items", ITEMS, [(77, 2, 1, d(5))]))
    assert sorted(kept + [(77, 2, 1, "unknown")], key=str) == lines_of(versions.load_version(spark, root))
