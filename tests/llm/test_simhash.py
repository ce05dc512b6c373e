import random

import numpy as np
import pytest
import xxhash

from tallyhouse.llm import simhash
from tests.llm.shared import ODD, clashing, frame


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_components(marks, distance=2):
    """marks: (doc_id, fingerprint); the smallest id reachable for each fingerprint."""
    values = sorted({x for _, x in marks})
    up = {x: x for x in values}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    arr = np.array(values, np.uint64)
    for i, x in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= distance):
            a, b = root(x), root(values[j])
            up[max(a, b)] = min(a, b)
    least = {}
    for doc_id, x in marks:
        r = root(x)
        least[r] = min([y for y in (least.get(r), doc_id) if y is not None], default=None)
    return {x: least[root(x)] for x in values}


def test_odd_rows(spark):
    got = simhash.near_dedup(clashing(frame(spark, ODD)).repartition(3)).collect()
    marks = [(r[0], brute_fingerprint(r[1])) for r in ODD]
    of = brute_components(marks)
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got), key=repr) == sorted(((i, x, of[x]) for i, x in marks), key=repr)


@pytest.fixture(scope="module")
def values():
    """Random fingerprints, chains, and a dense ball around one."""
    rng = random.Random(9)
    out = [rng.getrandbits(64) for _ in range(1500)]
    for _ in range(60):
        x = rng.choice(out)
        for _ in range(rng.randrange(1, 12)):
            x ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            out.append(x)
    ball = rng.getrandbits(64)
    out += [ball ^ 1 << a ^ 1 << b for a in range(64) for b in range(a, 40)]
    out += [out[5]] * 300
    return out


def test_components_as_by_brute_force(spark, values, monkeypatch):
    marks = list(enumerate(values))
    fps = spark.createDataFrame([(k, k, x - (1 << 64) if x >> 63 else x) for k, x in marks], "doc_id long, hash long, fp long").repartition(4)
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: fps)
    of = brute_components(marks)
    want = [(k, of[x]) for k, x in marks]
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_dedup(fps).collect()) == want
    monkeypatch.setattr(simhash, "GROUP", 40)  # large groups are split
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_dedup(fps).collect()) == want


@pytest.mark.parametrize("thresholds", [[(0, 0, 0)], [(1, 0)], [(2, -1)], [(0, -1, 0, 0)]])
def test_any_allocation_finds_all_links(spark, values, monkeypatch, thresholds):
    (chosen,) = thresholds
    bits = np.array_split(np.random.default_rng(1).permutation(64), len(chosen))
    planned = [(sorted(b.tolist()), t) for b, t in zip(bits, chosen, strict=True) if t >= 0]
    if chosen == (0, -1, 0, 0):  # one fewer than the principle asks for: widen it to a legal one
        planned = [(sorted(np.concatenate(bits[:2]).tolist()), 0), *planned[1:]]
    monkeypatch.setattr(simhash, "plan", lambda *a: planned)
    some = values[:1800]
    fps = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in sorted(set(some))], "fp long")
    links = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.links(fps).collect()]
    assert all(bin(a ^ b).count("1") <= 2 for a, b in links)
    roots = {r.node: r.root for r in simhash.components(simhash.links(fps)).collect()}
    of = brute_components(list(enumerate(some)))
    joined = {}
    for x in set(some):
        joined.setdefault(roots.get(x - (1 << 64) if x >> 63 else x, x - (1 << 64) if x >> 63 else x), set()).add(of[x])
    assert all(len(x) == 1 for x in joined.values()) and len(joined) == len(set(of.values()))


def test_thresholds_cost_least():
    costs = np.array([[0, 5, 50, 99], [0, 1, 9, 99], [0, 7, 8, 99]], float)
    best = min((sum(costs[p, t + 1] for p, t in enumerate(c)), list(c)) for c in np.ndindex(4, 4, 4) for c in [tuple(x - 1 for x in c)] if sum(c) == 0)
    assert simhash.allocate(costs, 2)[0] == best[0]


def test_empty_table(spark):
    assert simhash.near_dedup(frame(spark, [])).count() == 0
