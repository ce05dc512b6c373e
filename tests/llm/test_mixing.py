import random
import re

import pandas as pd
import pytest

from tallyhouse.llm import mixing
from tests.llm.shared import ODD, clashing, frame


def brute_targets(sizes, weights=mixing.WEIGHTS):
    names = sorted((x for x in sizes if x is not None), key=lambda x: x.encode()) + [x for x in sizes if x is None]
    weight = {x: weights[k % len(weights)] for k, x in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [x for x in names if x not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[x] for x in free) if free else 0
        over = [x for x in free if level * weight[x] > 3 * sizes[x]]
        if not over:
            return {x: fixed.get(x, level * weight[x]) for x in names}
        fixed |= {x: 3 * sizes[x] for x in over}


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute(rows):
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + words(text)
    return sizes, brute_targets(sizes)


def test_odd_rows(spark):
    got = mixing.mix(clashing(frame(spark, ODD)).repartition(2)).collect()
    sizes, targets = brute(ODD)
    assert sorted((r.doc_id, r.size) for r in got if r.doc_id is not None) == sorted((r[0], words(r[1])) for r in ODD if r[0] is not None)
    assert len(got) == len(ODD)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3


def test_sources_come_near_their_targets(spark):
    rng = random.Random(1)
    rows = [(k, "w " * int(rng.paretovariate(1.1) * 5), "en", rng.choice("aaaaabcdefgh")) for k in range(4000)]
    df = frame(spark, rows)
    got = mixing.mix(df.repartition(5)).toPandas()
    _, targets = brute(rows)
    taken = got.groupby("source")["taken"].sum()
    for source, target in targets.items():
        assert taken[source] == pytest.approx(target, rel=0.01)
    rates = got[got.source == "a"].sort_values("size")["rate"]
    assert rates.is_monotonic_increasing or rates.is_monotonic_decreasing
    again = mixing.mix(df.repartition(5)).toPandas()
    key = ["doc_id"]
    pd.testing.assert_frame_equal(got.sort_values(key)[["doc_id", "taken"]].reset_index(drop=True), again.sort_values(key)[["doc_id", "taken"]].reset_index(drop=True))


def test_targets_with_several_stops(spark):
    sizes = {"a": 10, "b": 1000, "c": 3, "d": 5, "e": 7000, None: 1}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes)) and sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_empty_table(spark):
    assert mixing.mix(frame(spark, [])).count() == 0


def test_same_mix_for_any_partitions(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(["w"] * rng.randrange(1, 300)), "en", rng.choice("ab")) for k in range(6000)]
    docs = frame(spark, rows)
    mixes = [sorted((r.doc_id, r.taken) for r in mixing.mix(docs.repartition(n)).collect()) for n in (1, 4, 7)]
    assert mixes[0] == mixes[1] == mixes[2]
