from datetime import datetime
from decimal import Decimal

from checks.registry import QUERIES
from tallyhouse.sources import mapped

AT = datetime(2001, 7, 30, 9)
STAR = {
    "nation": [(0, "KENYA"), (1, "PERU")],
    "customer": [(1, "Ann"), (25, "Ben")],
    "part": [(5, "soap", "B", "home", 10.0), (6, "rope", "B", "home", 20.0)],
    "orders": [(1, 1, "P", 41.0, AT), (2, 25, "F", 7.5, AT), (3, 1, "O", 9.0, AT)],
    "lineitem": [
        (1, 5, 1, 3.0, 30.0, "N", "O", AT), (1, 6, 1, 1.0, 11.0, "N", "O", AT),
        (2, 9, 1, 1.0, 7.5, "N", "O", AT), (8, 5, 1, 1.0, 10.0, "N", "O", AT),
    ],
}


def test_receipts_have_all_lines_of_their_sales(spark, tmp_path):
    """Products may be missing, sales may have no lines, and lines of other sales stay out."""
    for name, rows in STAR.items():
        spark.createDataFrame(rows, mapped._STAR[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    got = QUERIES["receipts"](spark, str(tmp_path))
    columns = "id customer_name cashier total product_id product quantity price_at_sale line_total".split()
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == [
        (1, "Ann", "PERU", Decimal(41), 5, "soap #5", 3, Decimal(10), Decimal(30)),
        (1, "Ann", "PERU", Decimal(41), 6, "rope #6", 1, Decimal(11), Decimal(11)),
        (2, None, "KENYA", Decimal("7.5"), 9, None, 1, Decimal("7.5"), Decimal("7.5")),
        (3, None, "PERU", Decimal(9), None, None, None, None, None),
    ]
