import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import queries, temporal

DAY = date(2024, 1, 1)


def brute(captures, entries):
    out = []
    for page_id, url, day in captures:
        host, segment = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = rest.split("/")[0].split("?")[0].split("#")[0].split("@")[-1].split(":")[0].lower()
            parts = rest.split("#")[0].split("?")[0].split("/")
            segment = parts[1] if len(parts) > 1 else ""
        labels = host.split(".")
        keys = {".".join(labels[k:]) for k in range(max(1, len(labels) - 1))} if host else set()
        keys |= {f"{host}/{segment}"} if host and segment else set()
        active = set()
        for key in keys if day else ():
            latest = {}
            for k, category, action, on in entries:
                if k == key and None not in (category, action, on) and on <= day:
                    latest[category] = max(latest.get(category, (date.min, "")), (on, action))
            active |= {(key, c) for c, (_, action) in latest.items() if action == "add"}
        out.append((page_id, host, len(active), ",".join(sorted({c for _, c in active})), bool(active)))
    return sorted(out, key=repr)


def run(spark, captures, entries):
    c = spark.createDataFrame(captures, "page_id long, url string, fetched_on date").withColumns({"key": F.lit("x"), "epoch": F.lit("y"), "category": F.lit("z")})
    e = spark.createDataFrame(entries, "key string, category string, action string, listed_on date")
    return sorted(((r.page_id, r.host, r.n_active, r.categories, r.blocked) for r in temporal.temporal_filter(c, e).collect()), key=repr)


def test_captures_against_entries_of_their_day(spark):
    rng = random.Random(8)
    hosts = ["a.example.com", "b.example.com", "example.com", "x.y.example.org", "HOT.example.net", "localhost"]
    urls = [f"https://{h}{p}" for h in hosts for p in ("", "/", "/en/1", "/en?x=1", "/de#a", ":80/en")]
    captures = [(k, rng.choice(urls), DAY + timedelta(rng.randrange(400))) for k in range(400)]
    captures += [(500 + k, "http://hot.example.net/en", DAY + timedelta(k % 3)) for k in range(200)]
    captures += [(900, None, DAY), (901, "no url", DAY), (902, "http://a.example.com/en", None), (None, "http://u@a.example.com/en", DAY), (903, "", DAY)]
    keys = ["a.example.com", "example.com", "example.org", "hot.example.net", "hot.example.net/en", "com", "b.example.com/en", "localhost"]
    entries = [(rng.choice(keys), rng.choice("pq"), rng.choice(["add", "remove"]), DAY + timedelta(rng.randrange(380))) for _ in range(120)]
    entries += [(None, "p", "add", DAY), ("example.com", None, "add", DAY), ("example.com", "p", "add", None)]
    assert run(spark, captures, entries) == brute(captures, entries)


@pytest.mark.parametrize("captures, entries", [([], [("a.b", "p", "add", DAY)]), ([(1, "http://a.b/c", DAY)], []), ([], [])])
def test_empty_tables(spark, captures, entries):
    assert run(spark, captures, entries) == brute(captures, entries)


@pytest.mark.parametrize("names", [("host", "n_active", "categories", "blocked"), ("Host", "segment", "_segment", "day"), ("valid_from", "valid_to", "c0", "listed_on")])
def test_clashing_columns(spark, names):
    captures = [(1, "http://a.b/c", DAY), (2, None, DAY), (3, "http://x.y", None)]
    c = spark.createDataFrame(captures, "page_id long, url string, fetched_on date").withColumns({x: F.lit(f"own {x}") for x in names})
    e = spark.createDataFrame([("a.b", "p", "add", DAY)], "key string, category string, action string, listed_on date")
    got = temporal.temporal_filter(c, e)
    results = ["host", "n_active", "categories", "blocked"]
    kept = [x for x in names if x.lower() not in results]
    assert got.columns == ["page_id", "url", "fetched_on", *kept, *results]
    rows = {r.page_id: r for r in got.collect()}
    assert {k: (r.host, r.n_active, r.categories, r.blocked) for k, r in rows.items()} == {1: ("a.b", 1, "p", True), 2: ("", 0, "", False), 3: ("x.y", 0, "", False)}
    assert all(r[x] == f"own {x}" for r in rows.values() for x in kept)


def test_no_python_on_the_executors(spark):
    plan = queries.op6_temporal_list_join(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
