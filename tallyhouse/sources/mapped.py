"""Retail tables derived from an order/line-item star schema (FIXTURES.md §2).

Amounts go through whole cents, so every engine derives the same decimals.
"""

from __future__ import annotations

from datetime import date, datetime
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tallyhouse.operators.hot_keys import left_by_merge
from tallyhouse.sources.tables import RetailTables

AS_OF = date(2001, 7, 31)
NOW = datetime(2001, 7, 31)

_STAR = {
    "nation": "n_nationkey int, n_name string",
    "customer": "c_custkey bigint, c_name string",
    "supplier": "s_suppkey bigint, s_name string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double,"
    " l_extendedprice double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
}


def star(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_STAR[name]).parquet(f"{sf_dir}/{name}.parquet")


def cents_of(amount: str) -> str:
    return f"cast(rint({amount} * 100) as bigint)"


def amount_of(cents: str) -> str:
    """Whole cents as money."""
    return f"cast(cast({cents} as decimal(18,0)) * 0.01BD as decimal(18,2))"


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One row for each category: the window orders names, not products.
    kinds = star(spark, sf_dir, "part").selectExpr("p_type as name").distinct()
    return kinds.selectExpr(
        "cast(row_number() over (order by name) as bigint) as id",
        "name",
        "cast(null as string) as description",
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star(spark, sf_dir, "nation").selectExpr(
        "cast(n_nationkey as bigint) as id",
        "n_name as username",
        "n_name as full_name",
        "true as is_active",
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = categories(spark, sf_dir).selectExpr("id as category_id", "name as p_type")
    price = cents_of("p_retailprice")
    return (
        star(spark, sf_dir, "part")
        .join(kinds, "p_type")
        .selectExpr(
            "p_partkey as id",
            "concat(p_name, ' #', p_partkey) as name",
            "category_id",
            "cast(p_partkey * 7 % 41 as int) as current_stock",
            "cast(p_partkey % 6 + 5 as int) as reorder_level",
            f"{amount_of(f'({price} * 4 div 5)')} as buying_price",
            f"{amount_of(price)} as selling_price",
            "p_partkey % 20 != 0 as is_active",
        )
    )


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    final = cents_of("o_totalprice")
    paid = f"if(o_orderstatus = 'P', {final} * (o_orderkey % 5) div 4, {final})"
    return star(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as id",
        "concat('INV-', date_format(o_orderdate, 'yyyyMMdd'), '-', o_orderkey) as receipt_number",
        f"{amount_of(final)} as total_amount",
        "cast(0 as decimal(18,2)) as discount",
        f"{amount_of(final)} as final_amount",
        "case o_orderstatus when 'F' then 'cash' when 'O' then 'mpesa' when 'P' then 'credit' end"
        " as payment_method",
        f"{amount_of(paid)} as amount_paid",
        f"{amount_of(f'({final} - {paid})')} as balance",
        "if(o_orderstatus = 'P', o_custkey, null) as customer_id",
        "cast(null as string) as customer_phone",
        "o_orderdate as sale_date",
        "o_custkey % 25 as user_id",
    )


def named_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales with the customer's name on credit sales. Kept apart from
    ``sales`` so reports that show no name do not pay for the join, and sales
    without customer, most of them, do not take part in it."""
    names = star(spark, sf_dir, "customer").selectExpr(
        "c_custkey as customer_id", "c_name as customer_name"
    )
    return left_by_merge(sales(spark, sf_dir), names, "customer_id")


def sale_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = f"({cents_of('l_extendedprice')} div cast(l_quantity as int))"
    return star(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as sale_id",
        "l_partkey as product_id",
        "cast(l_quantity as int) as quantity",
        f"{amount_of(price)} as price_at_sale",
        f"{amount_of(f'({price} * cast(l_quantity as int))')} as total",
    )


OWING = "payment_method = 'credit' and balance > 0"


def debtors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        named_sales(spark, sf_dir)
        .filter(OWING)
        .selectExpr(
            "id",
            "id as sale_id",
            "customer_name",
            "customer_phone",
            "final_amount as total_owed",
            "amount_paid",
            "balance",
            "if(id % 10 = 0, null, date_add(cast(sale_date as date), cast(id % 30 + 3 as int)))"
            " as due_date",
            "'pending' as status",
            "sale_date as created_at",
        )
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        sales(spark, sf_dir)
        .filter(OWING)
        .selectExpr("id", "sale_date", "balance", "explode(array(1, 2, 3)) as k")
        .filter("k <= id % 4")
        .selectExpr(
            "id * 10 + k as id",
            "id as debtor_id",
            f"{amount_of('(' + cents_of('cast(balance as double)') + ' div 5)')} as amount",
            "if(k = 1, 'cash', 'mpesa') as payment_method",
            "cast(null as string) as notes",
            "cast(date_add(cast(sale_date as date), k * 7) as timestamp_ntz) as payment_date",
            "id % 25 as user_id",
        )
    )


def stock_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = star(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "l_suppkey")
    return (
        star(spark, sf_dir, "lineitem")
        .filter("l_linestatus = 'F'")
        .join(names, "l_suppkey")
        .selectExpr(
            "l_partkey as product_id",
            "cast(if(l_returnflag = 'R', -l_quantity, l_quantity) as int) as quantity",
            "if(l_returnflag = 'R', 'MANUAL_ADJUSTMENT', s_name) as supplier",
            "cast(null as string) as notes",
            "l_shipdate as entry_date",
            "l_suppkey % 25 as user_id",
        )
    )


def mapped_tables(spark: SparkSession, sf_dir: str) -> RetailTables:
    builders = (categories, users, products, sales, sale_items, debtors, payments, stock_entries)
    return RetailTables(**{build.__name__: partial(build, spark, sf_dir) for build in builders})
