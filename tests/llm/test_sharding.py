import zlib
from collections import Counter, defaultdict

import pytest

from tallyhouse.llm import sharding
from tests.llm.shared import ODD, clashing, frame


def check(rows, got, shards):
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(
        ((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows), key=repr
    )
    counts = Counter(r.shard for r in got)
    assert set(counts) <= set(range(shards)) and max(counts.values()) - min([counts[k] for k in range(shards)]) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_odd_rows(spark):
    got = sharding.balanced_shards(clashing(frame(spark, ODD)).repartition(3), shards=4).collect()
    check(ODD, got, 4)


@pytest.mark.parametrize("stretch", [50_000, 7])
def test_groups_stay_together(spark, monkeypatch, stretch):
    monkeypatch.setattr(sharding, "STRETCH_ROWS", stretch)
    rows = [(k, f"t{k}" if k % 5 else f"group {k // 40}", "en", "a") for k in range(2000)]
    got = sharding.balanced_shards(frame(spark, rows).repartition(4), shards=8).collect()
    check(rows, got, 8)
    text = {r[0]: r[1] for r in rows}
    groups = defaultdict(set)
    for r in got:
        groups[text[r.doc_id]].add(r.shard)
    several = [x for t, x in groups.items() if t.startswith("group")]
    assert len(several) == 50 and sum(len(x) > 1 for x in several) <= 2


def test_a_third_of_all_rows_alike(spark):
    rows = [(k, "hot" if k % 3 == 0 else f"t{k // 4}", "en", "a") for k in range(3000)]
    got = sharding.balanced_shards(frame(spark, rows).repartition(4), shards=10).collect()
    check(rows, got, 10)
    text = {r[0]: r[1] for r in rows}
    hot = Counter(r.shard for r in got if text[r.doc_id] == "hot")
    groups = defaultdict(set)
    for r in got:
        groups[text[r.doc_id]].add(r.shard)
    cut = sum(len(x) > 1 for t, x in groups.items() if t != "hot")
    assert sum(hot.values()) == 1000 and cut < 0.3 * len(groups)


@pytest.mark.parametrize("copies, stretch", [(2, 50_000), (3, 40)])
def test_groups_that_fit_are_not_cut(spark, monkeypatch, copies, stretch):
    monkeypatch.setattr(sharding, "STRETCH_ROWS", stretch)
    rows = [(k, f"t{k // copies}", "en", "a") for k in range(4000 * copies)]
    got = sharding.balanced_shards(frame(spark, rows).repartition(4)).collect()
    check(rows, got, sharding.SHARDS)
    groups = defaultdict(set)
    for r in got:
        groups[r.doc_id // copies].add(r.shard)
    assert sum(len(x) > 1 for x in groups.values()) < 0.02 * len(groups)


def test_shards_admit_what_their_room_holds(spark):
    clusters = [(c, c % 3, 1 + c % 4) for c in range(90)]
    room = [40, 0, 1000]
    asked = spark.createDataFrame(clusters, "cluster long, shard int, n long")
    for stretches in (1, 5):
        got = {r.cluster: r for r in sharding.within_room(asked, room, 2, stretches).collect()}
        held = Counter()
        for r in got.values():
            held[r.shard] += r.n
        assert 36 < held[0] <= 40 and held[1] == 0 and sum(c in got for c, s, _ in clusters if s == 2) == 30
    waiting = spark.createDataFrame([(1, 0, 5), (1, 2, 3), (2, 1, 9), (3, 0, 2), (3, 2, 7)], "cluster long, shard int, n long")
    wanted = {r.cluster: (r.shard, r.n) for r in sharding.asked_shards(waiting, room, 0).collect()}
    assert wanted[1] == (0, 8) and wanted[3] == (2, 9) and wanted[2][0] in (0, 2)


def test_fewer_rows_than_shards_and_none(spark):
    rows = [(1, "a", "en", "a"), (2, "a", "en", "a"), (3, "b", "en", "a")]
    check(rows, sharding.balanced_shards(frame(spark, rows)).collect(), 40)
    assert sharding.balanced_shards(frame(spark, [])).count() == 0


def test_no_python_on_the_executors(spark):
    plan = sharding.balanced_shards(frame(spark, ODD), shards=3)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
