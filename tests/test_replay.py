import random
from datetime import datetime, timedelta

import pytest

from tallyhouse.plans import replay as plan

ENTRIES = "product_id bigint, quantity int, entry_date timestamp"
LINES = "id bigint, sale_id bigint, product_id bigint, quantity int"
SALES = "id bigint, sale_date timestamp"
START = datetime(2024, 1, 1)


def one_by_one(entries, lines, sales, opening):
    """Accepted by sale, the lines that had too little, and the stock left."""
    stock, taken, rejects, wanted = dict(opening), {}, [], {}
    for _, sale, product, n in lines:
        if product is not None and n > 0:
            own = wanted.setdefault(sale, {})
            own[product] = own.get(product, 0) + n
    when = lambda at: (at is not None, at or START)
    events = [(when(at), 0, 0, n, p) for p, n, at in entries] + [(when(at), 1, i, 0, None) for i, at in sales]
    for _, kind, sale, n, product in sorted(events, key=lambda e: e[:4]):
        if kind == 0:
            if stock.setdefault(product, 0) + n >= 0:
                stock[product] += n
            continue
        own = wanted.get(sale, {})
        short = {p: stock.setdefault(p, 0) for p, n in own.items() if stock.get(p, 0) < n}
        rejects += [(sale, p, own[p], left) for p, left in short.items()]
        taken[sale] = not short
        if not short:
            for p, n in own.items():
                stock[p] -= n
    return taken, sorted(rejects), stock


def played(spark, entries, lines, sales, opening, **sizes):
    openings = spark.createDataFrame([*opening.items()], "product_id bigint, opening int") if opening else None
    got = plan.replay_sales(
        spark.createDataFrame(entries, ENTRIES), spark.createDataFrame(lines, LINES).repartition(3), spark.createDataFrame(sales, SALES), openings, **sizes
    )
    rejects = sorted((r.sale_id, r.product_id, r.quantity, r.available) for r in got.rejects.collect())
    return {r.id: r.accepted for r in got.sales.collect()}, rejects, {r.product_id: r.stock for r in got.stock.collect()}


def test_a_refused_sale_frees_its_other_products(spark):
    at = lambda h: START + timedelta(hours=h)
    entries = [(1, 5, at(0)), (2, 3, at(0)), (3, 9, None)]
    sales = [(1, at(1)), (2, at(2)), (3, at(3)), (4, None), (5, at(5)), (6, at(6))]
    lines = [
        (1, 1, 1, 4), (2, 1, 2, 4),  # too little of 2: 1 keeps its five
        (3, 2, 1, 2), (4, 2, 1, 2), (5, 2, 3, 1),
        (6, 3, 1, 2),  # one left
        (7, 4, 3, 9),  # undated sales follow the undated entries
        (8, 5, 3, 1), (9, 5, 4, 1), (10, 5, None, 7), (11, 77, 1, 1), (12, 6, 1, 0),
    ]
    want = one_by_one(entries, lines, sales, {})
    assert want[0] == {4: True, 1: False, 2: False, 3: True, 5: False, 6: True}
    got = played(spark, entries, lines, sales, {})
    assert got[:2] == want[:2]
    assert {p: n for p, n in got[2].items() if n} == {p: n for p, n in want[2].items() if n}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_shops_as_one_by_one(spark, seed):
    rng = random.Random(seed)
    products = range(1, 7)
    hour = lambda: None if rng.random() < 0.1 else START + timedelta(hours=rng.randrange(40), minutes=rng.randrange(3))
    entries = [(rng.choice(products), rng.choice([-3, 4, 8]), hour()) for _ in range(40)]
    sales = [(k, hour()) for k in range(90)]
    lines = [(k, rng.randrange(90), rng.choice(products), rng.randrange(1, 5)) for k in range(200)]
    opening = {p: rng.randrange(12) for p in products}
    got = played(spark, entries, lines, sales, opening, chunk_events=16)
    assert got == one_by_one(entries, lines, sales, opening)


def test_no_sales(spark):
    assert played(spark, [(1, 4, START)], [], [], {1: 2}) == ({}, [], {1: 6})


def test_only_products_of_many_events_are_cut(spark, monkeypatch):
    """Product 1 has more events than a chunk, 2 and 3 are answered in one pass."""
    asked, chunks = [], plan.accept_in_order

    def seen(events, *rest, **sizes):
        asked.append({r.product_id for r in events.select("product_id").distinct().collect()})
        return chunks(events, *rest, **sizes)

    monkeypatch.setattr(plan, "accept_in_order", seen)
    rng = random.Random(5)
    moment = lambda: START + timedelta(microseconds=rng.randrange(10**6))
    entries = [(p, rng.choice([-2, 3]), moment()) for p in (1, 2, 3) for _ in range(4)]
    sales = [(k, moment()) for k in range(40)]
    lines = [(k, k % 40, 1 if k < 30 else rng.choice([2, 3]), rng.randrange(1, 3)) for k in range(50)]
    opening = {1: 4, 2: 1, 3: 2}
    assert played(spark, entries, lines, sales, opening, chunk_events=20) == one_by_one(entries, lines, sales, opening)
    assert asked and set.union(*asked) == {1}
    asked.clear()
    assert played(spark, entries, lines, sales, opening) == one_by_one(entries, lines, sales, opening)
    assert not asked
