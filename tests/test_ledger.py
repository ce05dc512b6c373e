from decimal import Decimal

import pytest
from conftest import rows

from tallyhouse.plans import ledger


def test_price_sales(spark):
    headers = spark.createDataFrame(
        [
            (1, "cash", Decimal(90), "percentage", Decimal(10)),
            (2, "cash", Decimal(10), "fixed", Decimal(5)),
            (3, "credit", Decimal(10), "none", Decimal(0)),
            (4, "cash", Decimal(10), "none", Decimal(0)),
        ],
        "sale_id bigint, payment_method string, amount_paid decimal(18,2), discount_type string,"
        " discount_value decimal(18,2)",
    )
    lines = spark.createDataFrame(
        [
            (1, 2, Decimal(50), None),
            (2, 1, Decimal(50), Decimal(20)),
            (3, 3, Decimal(10), Decimal(0)),
        ],
        "sale_id bigint, quantity int, selling_price decimal(18,2), price_override decimal(18,2)",
    )
    got = rows(
        ledger.price_sales(headers, lines).orderBy("sale_id"),
        "subtotal", "discount", "final_amount", "balance", "accepted",
    )
    assert got == [
        (100, 10, 90, 0, True), (20, 5, 15, 0, False), (30, 0, 30, 20, True), (0, 0, 0, 0, False),
    ]
    assert rows(ledger.price_lines(lines), "price_at_sale", "total") == [
        (50, 100), (20, 20), (10, 30),
    ]


@pytest.mark.parametrize("sizes", [{}, {"chunk_events": 2}])
def test_adjustments(spark, shop, sizes):
    asked = spark.createDataFrame(
        [
            (1, 1, "remove", 51, "lost"),
            (2, 1, "remove", 50, "damaged"),
            (3, 1, "remove", 1, "lost"),
            (4, 1, "add", 3, None),
            (5, 1, "remove", 2, "lost"),
            (6, 2, "add", 0, "none"),
            (7, 99, "add", 5, "unknown product"),
        ],
        "seq bigint, product_id bigint, adjustment_type string, quantity int, reason string",
    )
    done = ledger.apply_adjustments(shop.products, asked, "seq", "seq", **sizes)
    assert sorted(rows(done.entries, "seq", "quantity", "notes", "buying_price")) == [
        (2, -50, "REMOVED: 50 items. Reason: damaged", 45),
        (4, 3, "ADDED: 3 items. Reason: ", 45),
        (5, -2, "REMOVED: 2 items. Reason: lost", 45),
    ]
    assert sorted(rows(done.rejects, "seq", "reject_reason")) == [
        (1, "exceeds stock"), (3, "exceeds stock"), (6, "quantity not positive"),
        (7, "unknown product"),
    ]
    stock = dict(rows(done.products, "id", "current_stock"))
    assert (stock[1], stock[2], len(stock)) == (1, 0, 7)


def test_product_changes(spark, shop):
    changes = spark.createDataFrame(
        [
            (1, 1, "reorder", 9), (2, 1, "reorder", -1), (3, 2, "reorder", 7),
            (4, 2, "reorder", 8), (5, 3, "deactivate", None), (6, 99, "reorder", 4),
            (7, None, "reorder", 4), (8, 1, "paint", 4), (9, 1, None, 4), (10, 1, "reorder", None),
        ],
        "seq bigint, product_id bigint, action string, reorder_level int",
    )
    got = {r.id: r for r in ledger.apply_product_changes(shop.products, changes).collect()}
    assert [got[i].reorder_level for i in (1, 2, 3)] == [9, 8, 5]
    assert [got[i].is_active for i in (1, 3, 7)] == [True, False, False]
    refused = ledger.rejected_product_changes(shop.products, changes)
    assert sorted(rows(refused, "seq", "reject_reason")) == [
        (2, "negative reorder level"), (6, "unknown product"), (7, "unknown product"),
        (8, "unknown action"), (9, "unknown action"), (10, "reorder level missing"),
    ]
    assert ledger.check_product_changes(shop.products, changes).count() == 10
