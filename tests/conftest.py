import sys
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tallyhouse.sources import schemas  # noqa: E402
from tallyhouse.sources.tables import RetailTables  # noqa: E402

TODAY = date(2024, 3, 13)
NOON = datetime(2024, 3, 13, 12)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tallyhouse-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def frame(spark, table, columns, rows):
    """A small table with the declared types of ``table``."""
    kinds = schemas.TABLES[table]
    return spark.createDataFrame(rows, ", ".join(f"{c} {kinds[c]}" for c in columns.split()))


def d(value):
    return Decimal(str(value))


@pytest.fixture(scope="session")
def shop(spark):
    """The golden shop of FIXTURES.md §3."""
    categories = frame(
        spark,
        "categories",
        "id name description",
        [(1, "Electronics", None), (2, "Curtains", None), (3, "Clothes", None), (4, "Drinks", None)],
    )
    users = frame(
        spark,
        "users",
        "id username full_name is_active",
        [(i, f"user{i}", f"User {i}", True) for i in (1, 2, 3)],
    )
    products = frame(
        spark,
        "products",
        "id name category_id current_stock reorder_level buying_price selling_price is_active",
        [
            (1, "Cola", 4, 50, 5, d(45), d(70), True),
            (2, "Pepsi", 4, 0, 5, d(42), d(65), True),
            (3, "TV", 1, 5, 5, d(25000), d(35000), True),
            (4, "Curtain", 2, 10, 5, d(500), d(1200), True),
            (5, "Shirt", 3, 11, 5, d(300), d(500), True),
            (6, "Kettle", 1, 8, 5, d(900), d(850), True),
            (7, "Radio", 1, 4, 5, d(100), d(150), False),
        ],
    )

    def sale(i, at, method, total, discount, paid, customer, user):
        final = total - discount
        owed = final - paid if method == "credit" else 0
        return (
            i, f"R{i}", d(total), d(discount), d(final), method, d(paid), d(owed),
            customer, None, at, user,
        )

    sales = frame(
        spark,
        "sales",
        "id receipt_number total_amount discount final_amount payment_method amount_paid balance"
        " customer_name customer_phone sale_date user_id",
        [
            sale(1, datetime(2024, 3, 13, 9), "cash", 210, 0, 210, None, 1),
            sale(2, datetime(2024, 3, 13, 10), "mpesa", 35000, 500, 34500, None, 2),
            sale(3, datetime(2024, 3, 12, 12), "credit", 2400, 0, 400, "Ann", 1),
            sale(4, datetime(2024, 3, 14), "cash", 70, 0, 70, None, 1),
            sale(5, datetime(2024, 1, 5, 10), "cash", 500, 0, 500, None, 2),
            sale(6, datetime(2024, 3, 13, 11), "cash", 140, 0, 140, "", 1),
        ],
    )
    lines = [
        (1, 1, 1, 3, 70), (2, 2, 3, 1, 35000), (3, 3, 4, 2, 1200), (4, 4, 1, 1, 70),
        (5, 5, 5, 1, 500), (6, 6, 1, 1, 70), (7, 6, 1, 1, 70),
    ]
    sale_items = frame(
        spark,
        "sale_items",
        "id sale_id product_id quantity price_at_sale total",
        [(i, s, p, q, d(x), d(q * x)) for i, s, p, q, x in lines],
    )
    debtors = frame(
        spark,
        "debtors",
        "id sale_id customer_name customer_phone total_owed amount_paid balance due_date status"
        " created_at",
        [
            (1, 3, "Ann", "0700", d(2400), d(400), d(2000), date(2024, 3, 16), "pending",
             datetime(2024, 3, 12, 12)),
        ],
    )
    payments = frame(
        spark, "payments", "id debtor_id amount payment_method notes payment_date user_id", []
    )
    stock_entries = frame(
        spark,
        "stock_entries",
        "id product_id quantity supplier notes entry_date user_id",
        [
            (1, 1, 55, "Acme", None, datetime(2024, 1, 1), 1),
            (2, 1, -1, "MANUAL_ADJUSTMENT", "REMOVED", datetime(2024, 3, 1), 1),
            (3, 3, 6, "Tele Ltd", None, datetime(2024, 1, 2), 2),
            (4, 1, 5, "Bulk", None, datetime(2024, 2, 1), 2),
        ],
    )
    return RetailTables(
        categories=categories,
        users=users,
        products=products,
        sales=sales,
        sale_items=sale_items,
        debtors=debtors,
        payments=payments,
        stock_entries=stock_entries,
    )


def rows(df, *columns):
    """Rows as tuples, decimals as float."""
    picked = df.select(*columns) if columns else df
    return [
        tuple(float(v) if isinstance(v, Decimal) else v for v in row) for row in picked.collect()
    ]
