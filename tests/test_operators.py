"""Operators on skewed inputs, against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators.hot_keys import left_by_merge
from tallyhouse.operators.ranking import number_rows, top_per_group
from tallyhouse.operators.running import running_count, running_total
from tallyhouse.operators.sequential import accept_in_order, replay
from tallyhouse.sources import mapped
from tallyhouse.sources.tables import load_tables, write_tables


def skewed(n, seed):
    """Events of which key 0 holds a good third."""
    rng = random.Random(seed)
    return [
        (i, 0 if rng.random() < 0.4 else rng.randrange(1, 30), rng.randrange(-60, 40))
        for i in range(n)
    ]


def test_running_total_of_a_hot_key(spark):
    events = skewed(3000, 1)
    df = spark.createDataFrame(events, "seq int, key int, v int").repartition(8)
    got = running_total(
        df, ["key"], F.floor(F.col("seq") / 50), [F.col("seq")], F.col("v"), "run"
    )
    level, want = defaultdict(int), {}
    for seq, key, v in events:
        level[key] += v
        want[seq] = level[key]
    assert {r.seq: r.run for r in got.collect()} == want


def test_running_count(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(100)], "seq int, key int")
    got = running_count(df, ["key"], F.floor(F.col("seq") / 7), [F.col("seq")], "n")
    assert all(r.n == r.seq // 2 + 1 for r in got.collect())


def test_number_rows(spark):
    rng = random.Random(2)
    data = [(i, None if rng.random() < 0.3 else rng.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(data, "id int, v int").repartition(6)
    order = [F.desc_nulls_last("v"), F.col("id")]
    got = number_rows(df, order, "rank")
    ranked = sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert {r.id: r["rank"] for r in got.collect()} == {
        row[0]: i + 1 for i, row in enumerate(ranked)
    }


def test_top_per_group_trims_before_the_shuffle(spark):
    df = spark.createDataFrame(skewed(2000, 3), "seq int, key int, v int")
    got = top_per_group(df, ["key"], [F.desc("v"), F.col("seq")], 3, "place")
    by_key = defaultdict(list)
    for seq, key, v in skewed(2000, 3):
        by_key[key].append((-v, seq))
    want = {(k, i + 1, s) for k, vs in by_key.items() for i, (_, s) in enumerate(sorted(vs)[:3])}
    assert {(r.key, r.place, r.seq) for r in got.collect()} == want
    plan = got._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "Partial" in plan


def brute(events, openings):
    level, out = dict(openings), {}
    for seq, key, delta in sorted(events):
        accepted = level[key] + delta >= 0
        level[key] += delta if accepted else 0
        out[seq] = (accepted, level[key])
    return out


@pytest.mark.parametrize("chunk", [7, 64, 10_000])
@pytest.mark.parametrize("signs", ["both", "withdrawals"])
def test_accept_in_order_matches_brute_force(spark, chunk, signs):
    events = skewed(600, 4)
    if signs == "withdrawals":
        events = [(s, k, -abs(v) - 1) for s, k, v in events]
    opening = 5 if signs == "both" else 4000
    openings = {k: opening + k for k in range(30)}
    df = spark.createDataFrame(events, "seq bigint, key bigint, delta bigint").withColumn(
        "slot", F.expr("seq div 60")
    )
    starts = spark.createDataFrame(list(openings.items()), "key bigint, opening bigint")
    got = accept_in_order(
        df.repartition(5), starts, "key", ["slot", "seq"], "delta", "slot",
        chunk_events=chunk,
    )
    assert got.columns == ["seq", "key", "delta", "slot", "accepted", "level_after"]
    assert {r.seq: (r.accepted, r.level_after) for r in got.collect()} == brute(events, openings)


def test_replay_reports_where_its_answers_hold():
    import numpy as np

    rng = random.Random(5)
    deltas = np.array([rng.randrange(-9, 7) for _ in range(40)])
    accepted, levels, low, high = replay(deltas, 6)
    for start in range(0, 60):
        same = (replay(deltas, start)[0] == accepted).all()
        assert same == (low <= start < high)
    assert levels[-1] == 6 + deltas[accepted].sum()


def test_write_and_load_by_month(spark, shop, tmp_path):
    root = str(tmp_path / "shop")
    write_tables(shop, root)
    again = load_tables(spark, root)
    assert again.sales.count() == 6 and again.sale_items.count() == 7
    assert {r.month for r in again.sale_items.select("month").distinct().collect()} == {
        "2024-01", "2024-03",
    }
    march = again.sales.filter("month = '2024-03'")
    assert march.count() == 5


def test_reports_over_stored_tables_prune_months(spark, shop, tmp_path):
    from conftest import TODAY, rows

    from tallyhouse.plans import sales

    root = str(tmp_path / "shop")
    write_tables(shop, root)
    stored = load_tables(spark, root)
    assert rows(sales.daily_summary(stored, TODAY)) == [(34850, 3, 10125, "Cola", 5)]
    assert sorted(rows(sales.categories_report(stored, TODAY), "category", "revenue")) == [
        ("Curtains", 2400), ("Drinks", 420), ("Electronics", 35000),
    ]
    lines = sales.L.of_sales(stored.sale_items, stored.sales.filter("sale_date > '2024-03-01'"))
    assert "dynamicpruning" in lines._jdf.queryExecution().toString().lower()


def test_hours_rise_with_time_and_missing_times_come_first(spark):
    from datetime import datetime

    from tallyhouse.operators.running import by_hour

    times = [None, datetime(1969, 12, 31, 23), datetime(1970, 1, 1), datetime(2024, 3, 13, 1, 59)]
    df = spark.createDataFrame(list(enumerate(times)), "i int, t timestamp_ntz")
    got = [r.h for r in df.select("i", by_hour("t").alias("h")).orderBy("i").collect()]
    assert got == sorted(got) and got[1:3] == [-1, 0]


def test_null_stretches_are_kept(spark):
    rows = [("k", None if i % 2 else i, i, 1) for i in range(10)]
    df = spark.createDataFrame(rows, "key string, bucket int, at int, delta bigint")
    got = running_total(df, ["key"], F.col("bucket"), [F.col("at")], F.col("delta"), "total")
    assert sorted(r.total for r in got.collect()) == list(range(1, 11))


@pytest.mark.parametrize("chunk", [1000, 4])
def test_ordered_acceptance_answers_events_without_a_bucket(spark, chunk):
    rows = [("k", i, None if i < 10 else i, -1) for i in range(20)]
    events = spark.createDataFrame(rows, "key string, at int, bucket int, delta bigint")
    openings = spark.createDataFrame([("k", 15)], "key string, opening bigint")
    got = accept_in_order(events, openings, "key", ["at"], "delta", "bucket", chunk).collect()
    assert len(got) == 20 and sorted(r["at"] for r in got if r.accepted) == list(range(15))


def test_keys_that_never_run_short_are_accepted_whole(spark):
    rows = [("easy", i, -1) for i in range(9)] + [("tight", i, -1) for i in range(9)]
    events = spark.createDataFrame(rows, "key string, at int, delta bigint")
    openings = spark.createDataFrame(
        [("easy", 9), ("tight", 4), ("idle", 1)], "key string, opening bigint"
    )
    got = accept_in_order(events, openings, "key", ["at"], "delta", "at", 4).collect()
    assert len(got) == len(rows)
    assert {(r.at, r.accepted, r.level_after) for r in got if r.key == "easy"} == {
        (i, True, 8 - i) for i in range(9)
    }
    assert {(r.at, r.accepted, r.level_after) for r in got if r.key == "tight"} == {
        (i, i < 4, max(3 - i, 0)) for i in range(9)
    }


def test_a_level_below_zero_refuses_until_it_is_made_good(spark):
    deltas = [-1, 2, -1, 4, -2, -1, 1]
    events = [(i, "k", d) for i, d in enumerate(deltas)]
    df = spark.createDataFrame(events, "seq int, key string, delta bigint")
    openings = spark.createDataFrame([("k", -3)], "key string, opening bigint")
    got = accept_in_order(df, openings, "key", ["seq"], "delta", "seq", 2).collect()
    assert {r.seq: (r.accepted, r.level_after) for r in got} == brute(events, {"k": -3})


def test_rows_without_key_pass_by_the_join(spark):
    rows = spark.createDataFrame([(i, i % 5 if i % 10 == 0 else None) for i in range(200)], "id int, key int")
    listed = spark.createDataFrame([(0, "a"), (0, "b"), (7, "c"), (None, "d")], "key int, name string")
    got = left_by_merge(rows.repartition(4), listed, "key")
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(listed, "key", "left").select(got.columns).collect()))


def test_sales_without_customer_are_not_joined(spark, tmp_path):
    orders = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz"
    made = [(i, i % 3, "P" if i % 10 == 0 else "F", 10.0, None) for i in range(100)]
    spark.createDataFrame(made, orders).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(0, "A"), (1, "B")], "c_custkey bigint, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    named = mapped.named_sales(spark, str(tmp_path))
    plan = named._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan
    names = {r.id: r.customer_name for r in named.collect()}
    assert names == {i: {0: "A", 1: "B"}.get(i % 3) if i % 10 == 0 else None for i in range(100)}
