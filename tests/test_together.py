import random
from datetime import timedelta

import numpy as np
from test_replay import START, one_by_one, played

from tallyhouse.operators import together
from tallyhouse.plans import replay as plan


def test_rounds_pass_on_answers_and_not_events(spark, monkeypatch):
    """However many rounds there are and however many blocks, the events are answered as rows once."""
    asked, short = [], plan.accept_short
    monkeypatch.setattr(plan, "accept_short", lambda *args: asked.append(args) or short(*args))
    rng = random.Random(3)
    sales = [(k, START + timedelta(minutes=k // 2)) for k in range(60)]
    lines = [(k, rng.randrange(60), rng.randrange(9), rng.randrange(1, 4)) for k in range(150)]
    entries = [(rng.randrange(9), rng.choice([-2, 2, 3]), START + timedelta(minutes=rng.randrange(30))) for _ in range(30)]
    opening = {p: rng.randrange(8) for p in range(9)}
    assert played(spark, entries, lines, sales, opening, block_events=40) == one_by_one(entries, lines, sales, opening)
    assert len(asked) == 1


def test_rows_of_one_sale_count_together(spark):
    """A sale that is there twice takes its lines twice, whole or not at all, and the rounds end."""
    later = START + timedelta(hours=1)
    sales = [(1, START), (1, START), (2, later), (2, later)]
    lines = [(1, 1, 1, 2), (2, 1, 2, 1), (3, 2, 1, 1), (4, 2, 2, 1)]
    got = played(spark, [], lines, sales, {1: 5, 2: 9})
    assert got == ({1: True, 2: False}, [(2, 1, 2, 1)], {1: 1, 2: 7})


def test_long_and_short_keys_fold_as_one_by_one(monkeypatch):
    monkeypatch.setattr(together, "SIDE_BY_SIDE", 20)
    rng = np.random.default_rng(4)
    sizes = np.array([1, 30, 7, 0, 20, 55])
    starts = np.append(0, np.cumsum(sizes))
    moved = rng.integers(-5, 5, starts[-1])
    delta, opening = np.where(rng.random(len(moved)) < 0.3, 0, moved), rng.integers(0, 6, len(sizes))
    want = []
    for a, b, level in zip(starts, starts[1:], opening.tolist(), strict=False):
        for k in range(a, b):
            want.append(level + moved[k] >= 0)
            level = level + delta[k] if level + delta[k] >= 0 else level
    fits = np.zeros(len(moved), bool)
    together._fits(moved, delta, starts[:-1], starts[1:], opening, fits)
    assert fits.tolist() == want
