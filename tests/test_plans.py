"""The plans Spark makes for the reports."""

from datetime import date

import pytest
from conftest import NOON, TODAY
from pyspark.sql import functions as F

from checks.registry import QUERIES
from tallyhouse.operators.hot_keys import even_join
from tallyhouse.plans import inventory, sales
from tallyhouse.sources import mapped

SMALL = "/root/testdata/sf0.001"
REPORTS = (
    "dashboard_kpis daily_summary daily_closing sales_report products_report categories_report"
    " users_report export_sales stock_list low_stock dead_stock product_history debtors_list"
    " debtor_profile debtor_statement receipts ledger_oversell ledger_stock_drift"
).split()


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", REPORTS)
def test_reports_stay_in_the_jvm_and_free_of_cross_joins(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "Python" not in text and "InPandas" not in text
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_day_filter_and_columns_reach_the_scan(spark):
    t = mapped.mapped_tables(spark, SMALL)
    text = plan(sales.daily_summary(t, date(2001, 7, 31)))
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThan(o_orderdate" in text
    assert "l_shipdate" not in text.split("== Optimized")[1].split("ReadSchema", 1)[1]


def test_anti_join_for_dead_stock(spark, shop):
    assert "LeftAnti" in plan(inventory.dead_stock(shop, NOON))


def test_fold_by_product_comes_before_the_product_join(spark, shop):
    text = plan(sales.daily_summary(shop, TODAY)).split("== Physical Plan ==")[1]
    lines = text.splitlines()
    joined = next(i for i, row in enumerate(lines) if "Join [product_id" in row)
    assert any("partial_sum" in row for row in lines[joined:])


def _shares(df):
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def test_a_product_on_half_of_the_lines_spreads_over_the_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        key = F.when(F.col("id") % 2 == 0, 7).otherwise(F.xxhash64("id") % 5000).cast("bigint")
        lines = spark.range(200_000).select(F.col("id").alias("sale_id"), key.alias("product_id"))
        names = lines.distinct().select("product_id").distinct().withColumn("name", F.col("product_id") * 2)
        even, plain = even_join(lines, names, "product_id", "sale_id"), lines.join(names, "product_id")
        shares = _shares(even)
        assert sum(shares) == 200_000 and shares[-1] <= 2 * shares[len(shares) // 2]
        assert _shares(plain)[-1] > 4 * _shares(plain)[4]
        assert even.filter("name <> product_id * 2").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_even_join_equals_the_plain_join(spark):
    rows = [(i, 1 if i % 3 else None) for i in range(90)] + [(i, i) for i in range(2, 9)] * 2
    lines = spark.createDataFrame(rows, "sale_id bigint, product_id bigint")
    names = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "product_id bigint, name string")
    for how in ("inner", "left"):
        for some in (lines, lines.limit(0), lines.filter("product_id is null")):
            got = even_join(some, names, "product_id", "sale_id", how).select("sale_id", "product_id", "name")
            want = some.join(names, "product_id", how).select("sale_id", "product_id", "name")
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    with pytest.raises(ValueError):
        even_join(lines, names, "product_id", "sale_id", "full")
