import random

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators.running import running_last
from tallyhouse.plans import categories as plan

CHANGES = "seq bigint, action string, id bigint, name string, description string"


def replay(stored, used, changes):
    """The reasons by seq, and the categories left, asking one request after another."""
    live, reasons, added = dict(stored), {}, []
    for seq, action, i, name, _ in sorted(changes):
        wanted, reason = (name or "").strip(), None
        names = [n for k, n in live.items() if action == "add" or k != i] + added
        if action in ("rename", "delete") and i not in live:
            reason = "unknown category"
        elif action in ("add", "rename") and not wanted:
            reason = "name is required"
        elif action in ("add", "rename") and wanted in names:
            reason = "name already exists"
        elif action == "delete" and i in used:
            reason = "category has products"
        elif action == "delete":
            del live[i]
        elif action == "rename":
            live[i] = wanted
        elif action == "add":
            added.append(wanted)
        else:
            reason = "unknown action"
        reasons[seq] = reason
    top = max(stored, default=0)
    return reasons, live | {top + 1 + k: n for k, n in enumerate(added)}


def tables(spark, stored, used):
    categories = spark.createDataFrame([(k, n, None) for k, n in stored.items()], "id bigint, name string, description string")
    return categories, spark.createDataFrame([(k,) for k in used], "category_id bigint")


def answered(spark, stored, used, changes):
    categories, products = tables(spark, stored, used)
    batch = spark.createDataFrame(changes, CHANGES).repartition(3)
    checked = plan.check_category_changes(categories, products, batch)
    reasons = {r.seq: r.reject_reason for r in checked.collect()}
    return reasons, {r.id: r.name for r in plan.apply_category_changes(categories, checked).collect()}


def test_requests_hang_on_earlier_ones(spark):
    stored = {1: "A", 2: "B", 3: "Used", 4: "D"}
    changes = [
        (1, "rename", 1, "C", None), (2, "add", None, " A ", None), (3, "rename", 1, "A", None),
        (4, "delete", 2, None, None), (5, "rename", 2, "X", None), (6, "add", None, "B", None), (7, "add", None, "B", None),
        (8, "delete", 3, None, None), (9, "rename", 3, " ", None), (10, "add", None, None, None), (11, "delete", 77, None, None),
        (12, "rename", 4, "D", None), (13, "burn", 4, "D", None), (14, None, 4, "E", None),
    ]
    want = replay(stored, {3}, changes)
    assert want[0] == {
        1: None, 2: None, 3: "name already exists", 4: None, 5: "unknown category", 6: None, 7: "name already exists",
        8: "category has products", 9: "name is required", 10: "name is required", 11: "unknown category", 12: None,
        13: "unknown action", 14: "unknown action",
    }
    assert answered(spark, stored, {3}, changes) == want


@pytest.mark.parametrize("seed", range(4))
def test_random_batches_as_one_by_one(spark, seed):
    rng = random.Random(seed)
    stored = {k: f"n{k}" for k in range(1, 8)}
    names = [f"n{k}" for k in range(1, 13)] + ["", None, " n2 "]
    changes = [
        (10 * k, action, None if action == "add" else rng.randrange(1, 10), None if action == "delete" else rng.choice(names), None)
        for k, action in enumerate(rng.choices(["add", "rename", "delete"], [3, 6, 1], k=60))
    ]
    used = {1, 2, 3}
    assert answered(spark, stored, used, changes) == replay(stored, used, changes)


def test_long_chain_of_answers(spark):
    """Each rename needs the name that the one before it let go."""
    stored = {k: f"n{k}" for k in range(1, 7)}
    changes = [(k, "rename", 7 - k, f"n{8 - k}", None) for k in range(1, 7)]
    want = replay(stored, set(), changes)
    assert set(want[0].values()) == {None}
    assert answered(spark, stored, set(), changes) == want


def test_one_name_wanted_by_most(spark):
    changes = [(k, "add", None, "Hot", None) for k in range(500)] + [(k, "rename", 1 + k % 3, "Hot", None) for k in range(500, 700)]
    stored = {1: "a", 2: "b", 3: "c"}
    assert answered(spark, stored, set(), changes) == replay(stored, set(), changes)


def test_descriptions(spark):
    categories, products = tables(spark, {1: "A", 2: "B"}, set())
    changes = spark.createDataFrame([(1, "rename", 1, "A", " new "), (2, "add", None, "C", None)], CHANGES)
    checked = plan.check_category_changes(categories, products, changes)
    got = {r.name: r.description for r in plan.apply_category_changes(categories, checked).collect()}
    assert got == {"A": "new", "B": None, "C": ""}
    kept = plan.apply_category_changes(categories, checked.drop("description")).collect()
    assert {r.name: r.description for r in kept} == {"A": None, "B": None, "C": None}


def test_empty_batch(spark):
    categories, products = tables(spark, {1: "A"}, {1})
    checked = plan.check_category_changes(categories, products, spark.createDataFrame([], CHANGES))
    assert checked.count() == 0
    assert plan.apply_category_changes(categories, checked).count() == 1


def test_last_values_over_stretches(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice("ab"), rng.choice([None, k])) for k in range(200)]
    df = spark.createDataFrame(rows, "at bigint, key string, v bigint").repartition(4)
    got = running_last(df, ["key"], F.expr("at div 7"), [F.col("at")], {"last": F.col("v")}).collect()
    for r in got:
        earlier = [v for at, key, v in rows if key == r.key and at < r.at and v is not None]
        assert r["last"] == (earlier[-1] if earlier else None)
