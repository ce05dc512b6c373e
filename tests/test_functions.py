from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions import debt, money, pricing, stock, text, validation

TODAY = date(2024, 3, 13)


def values(spark, column, schema, data):
    return [r[0] for r in spark.createDataFrame(data, schema).select(column).collect()]


def test_stock_status_boundaries(spark):
    got = values(
        spark,
        stock.stock_status(F.col("s"), F.col("r")),
        "s int, r int",
        [(-1, 5), (0, 5), (1, 5), (5, 5), (6, 5), (10, 5), (11, 5)],
    )
    assert got == [
        "out_of_stock", "out_of_stock", "critical", "critical", "low", "low", "healthy",
    ]


def test_stock_status_info_text(spark):
    info = stock.stock_status_info(F.col("s"), F.lit(5))
    got = values(spark, info, "s int", [(0,), (5,), (10,), (11,)])
    assert [tuple(i) for i in got] == [
        ("out_of_stock", "danger", "Out of Stock"),
        ("critical", "danger", "Critical"),
        ("low", "warning", "Low"),
        ("healthy", "success", "Healthy"),
    ]


def test_days_remaining(spark):
    got = values(
        spark,
        stock.days_remaining(F.col("s"), F.col("a")),
        "s int, a double",
        [(0, 1.0), (10, 0.0), (10, None), (10, 3.0), (1, 30.0)],
    )
    assert got == [0, 999, 999, 3, 0]


def test_days_band_inclusive_and_exclusive(spark):
    data = [(3,), (4,), (7,), (8,), (14,)]
    listing = values(spark, stock.days_band(F.col("n")), "n int", data)
    detail = values(spark, stock.days_band(F.col("n"), 7, 14, inclusive=False), "n int", data)
    assert listing == ["red", "amber", "amber", "green", "green"]
    assert detail == ["red", "red", "amber", "amber", "green"]


def test_critical_has_two_meanings(spark):
    levels = [(-1,), (0,), (1,)]
    page = values(spark, stock.is_critical_listing(F.col("s")), "s int", levels)
    dash = values(spark, stock.is_critical_dashboard(F.col("s"), F.lit(True)), "s int", levels)
    assert page == [True, True, False]
    assert dash == [False, True, False]


@pytest.mark.parametrize(
    "balance, due, want",
    [
        (0, date(2024, 1, 1), "paid"),
        (5, date(2024, 3, 12), "overdue"),
        (5, date(2024, 3, 13), "due_soon"),
        (5, date(2024, 3, 16), "due_soon"),
        (5, date(2024, 3, 17), "pending"),
        (5, None, "pending"),
    ],
)
def test_debt_status(spark, balance, due, want):
    column = debt.debt_status(F.col("b"), F.col("d"), TODAY)
    assert values(spark, column, "b int, d date", [(balance, due)]) == [want]


def test_aging_bucket(spark):
    starts = ((3, 10), (3, 9), (2, 28), (2, 27))
    days = [(datetime(2024, month, day),) for month, day in starts]
    got = values(spark, debt.aging_bucket(F.col("t"), TODAY), "t timestamp_ntz", days)
    assert got == ["0-3 days", "4-14 days", "4-14 days", "15+ days"]


def test_status_filters_differ_from_status(spark):
    df = spark.createDataFrame(
        [(1, date(2024, 3, 12)), (2, date(2024, 3, 14)), (3, date(2024, 4, 1)), (4, None)],
        "id int, due date",
    )

    def ids(option):
        keep = debt.matches_status(option, F.lit(10), F.col("due"), TODAY)
        return sorted(r.id for r in df.filter(keep).collect())

    assert ids("") == [1, 2, 3, 4]
    assert ids("overdue") == [1]
    assert ids("due_soon") == [2]
    assert ids("pending") == [2, 3]


def test_discount_and_payment(spark):
    got = (
        spark.createDataFrame(
            [(k, Decimal(v)) for k, v in (("percentage", 10), ("fixed", 300), ("none", 5), (None, 5))],
            "kind string, v decimal(18,2)",
        )
        .select(
            pricing.discount_amount(F.lit(Decimal("250.00")), F.col("kind"), F.col("v")).alias("o")
        )
        .select(
            "o",
            pricing.final_amount(F.lit(Decimal("250.00")), F.col("o")).alias("f"),
            pricing.final_amount(F.lit(Decimal("250.00")), F.col("o"), clamp=True).alias("c"),
        )
        .collect()
    )
    assert [tuple(map(float, r)) for r in got] == [
        (25, 225, 225), (300, -50, 0), (0, 250, 250), (0, 250, 250),
    ]


def test_payment_acceptable_and_balance(spark):
    df = spark.createDataFrame([("cash", 5), ("cash", 10), ("credit", 5)], "m string, p int")
    ten = F.lit(10)
    got = df.select(
        pricing.payment_acceptable(F.col("m"), ten, F.col("p")),
        pricing.credit_balance(F.col("m"), ten, F.col("p")).cast("int"),
    ).collect()
    assert [tuple(r) for r in got] == [(False, 0), (True, 0), (True, 5)]


def test_effective_price(spark):
    column = pricing.effective_price(F.col("o"), F.col("s"))
    data = [(None, Decimal(7)), (Decimal(0), Decimal(7)), (Decimal(5), Decimal(7))]
    got = values(spark, column, "o decimal(18,2), s decimal(18,2)", data)
    assert list(map(float, got)) == [7, 7, 5]


def test_margin(spark):
    pct = pricing.margin_pct(F.col("b"), F.col("s"))
    df = spark.createDataFrame([(900, 850), (90, 100), (10, 100), (10, 0)], "b int, s int")
    got = df.select(F.round(pct, 2), pricing.margin_band(pct)).collect()
    assert [tuple(r) for r in got] == [
        (-5.88, "loss"), (10.0, "thin"), (90.0, "good"), (0.0, "thin"),
    ]


def test_below_cost_warning(spark):
    column = pricing.below_cost_warning(F.col("b"), F.col("s"))
    got = values(spark, column, "b int, s int", [(1200, 1000), (1, 2)])
    assert got == [
        "Selling price (KSh 1,000.00) is below buying price (KSh 1,200.00)!"
        " This will result in loss.",
        None,
    ]


def test_repayment_rounds_half_to_even(spark):
    column = pricing.repayment_pct(F.col("p"), F.col("o"))
    assert values(spark, column, "p int, o int", [(1, 800), (3, 800), (1, 0)]) == [0.1, 0.4, None]


def test_text_helpers(spark):
    df = spark.createDataFrame(
        [(datetime(2024, 3, 13, 9, 5, 7), "été, -x_!", "", -3)],
        "t timestamp_ntz, s string, c string, q int",
    )
    got = df.select(
        text.receipt_number(F.col("t")),
        text.sanitize_text(F.col("s")),
        text.walk_in(F.col("c")),
        text.signed_label(F.col("q")),
        text.format_currency(F.lit(1234.5)),
        text.day_label(F.col("t")),
        text.initial(F.col("s")),
    ).first()
    assert tuple(got) == (
        "INV-20240313-090507", "été -x_", "Walk-in", "-3", "KSh 1,234.50", "13 Mar 2024", "É",
    )


def test_parse_date_falls_back(spark):
    column = text.parse_date(F.col("s"), TODAY)
    got = values(spark, column, "s string", [("2024-01-02",), ("2/1/24",), (None,)])
    assert got == [date(2024, 1, 2), TODAY, TODAY]


def test_validation_messages(spark):
    column = validation.stock_entry_errors(*map(F.col, ("n", "q", "b", "s")))
    got = values(
        spark,
        column,
        "n string, q string, b string, s string",
        [("Cola", "3", "1.5", "2"), (" x ", "0", "-1", "abc"), (None, "12.7", None, "-0.5")],
    )
    assert got[0] == []
    assert got[1] == [
        "Product name must be at least 2 characters",
        "Quantity must be greater than 0",
        "Buying price cannot be negative",
        "Selling price must be a valid number",
    ]
    assert got[2] == [
        "Product name must be at least 2 characters",
        "Quantity must be a valid number",
        "Buying price must be a valid number",
        "Selling price cannot be negative",
    ]


def test_white_space_of_any_kind_goes(spark):
    df = spark.createDataFrame([("\t Cola \r\n",), (" a b\u00a0",), ("\x1cx",)], "t string")
    assert [r[0] for r in df.select(text.strip(F.col("t"))).collect()] == ["Cola", "a b", "x"]


def test_dates_without_leading_zeros(spark):
    df = spark.createDataFrame([("2024-3-5",), ("2024-03-05",), ("soon",)], "t string")
    got = [r[0] for r in df.select(text.parse_date(F.col("t"), date(2020, 1, 1))).collect()]
    assert got == [date(2024, 3, 5), date(2024, 3, 5), date(2020, 1, 1)]


def test_search_with_a_backslash(spark):
    df = spark.createDataFrame([("a\\b",), ("ab",)], "t string")
    assert [r[0] for r in df.filter(text.contains(F.col("t"), "a\\b")).collect()] == ["a\\b"]
    assert df.filter(text.contains(F.col("t"), "a\\")).count() == 1


def test_cents_of_large_decimals(spark):
    df = spark.sql("select cast('9007199254740993.17' as decimal(18,2)) m")
    assert df.select(money.cents(F.col("m"))).first()[0] == 900719925474099317
