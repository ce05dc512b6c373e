import random

import numpy as np
import pytest

from tallyhouse.llm import jaccard
from tests.llm.shared import ODD, clashing, frame


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def brute(rows, percent=90):
    """doc_id, set size and smallest id of the component of every row."""
    sets = [brute_set(r[1]) for r in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(r[0], least.get(root(i), r[0]))
    return sorted(((r[0], len(sets[i]), least.get(root(i))) for i, r in enumerate(rows)), key=repr)


def of(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def rows_of(texts):
    return [(k, x, "en", "a") for k, x in enumerate(texts)]


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"x{rng.getrandbits(40)}"
    return words


@pytest.fixture(scope="module")
def corpus():
    """Random texts, near copies about the threshold, chains, a passage in a third of all, short texts and orders of few words."""
    rng = random.Random(4)
    word = lambda: f"w{min(int(rng.paretovariate(0.6)), 5000)}"
    passage = [f"p{k}" for k in range(60)]
    texts = []
    for k in range(260):
        words = [word() for _ in range(rng.choice([9, 30, 120, 300]))]
        texts.append(" ".join(words + (passage if k % 3 == 0 else [])))
        for _ in range(rng.randrange(4)):
            texts.append(" ".join(edited(rng, texts[-1].split(" "), rng.randrange(1, 6))))
    base = [word() for _ in range(200)]
    texts += [" ".join(edited(rng, base, rng.randrange(1, 4))) for _ in range(150)]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(1, 40))) for _ in range(150)]
    texts += [" ".join(passage[: rng.randrange(40, 60)]) for _ in range(40)]
    texts += [texts[0]] * 30 + [texts[1].upper()] * 5 + ["  ".join(texts[2].split(" "))]
    return rows_of(texts)


def test_components_as_by_brute_force(spark, corpus):
    docs = frame(spark, corpus).repartition(5)
    assert of(jaccard.jaccard_components(docs)) == brute(corpus)


def test_any_chunks_and_pivots(spark, corpus, monkeypatch):
    for name, value in (("SMALL", 4), ("BLOCK_ENTRIES", 900), ("CHUNK", 2000), ("CHUNK_DOCS", 50), ("BLOCK_CHARS", 1000), ("PIVOTS", 0), ("PRODUCT_BLOCKS", 3)):
        monkeypatch.setattr(jaccard, name, value)
    assert of(jaccard.jaccard_components(frame(spark, corpus).repartition(3))) == brute(corpus)


def test_other_thresholds(spark, corpus):
    some = corpus[::3]
    for percent in (50, 80, 100):
        assert of(jaccard.jaccard_components(frame(spark, some), percent=percent)) == brute(some, percent)


def test_odd_rows(spark):
    got = jaccard.jaccard_components(clashing(frame(spark, ODD)).withColumnsRenamed({"n": "cls"}).selectExpr("*", "'x' as grams", "'x' as hash", "'x' as root", "'x' as once").repartition(3))
    assert got.columns == ["doc_id", "hash", "n_shingles", "root", "component_id"]
    assert of(got) == brute(ODD)


def test_very_long_text(spark):
    rng = random.Random(5)
    words = [f"v{rng.randrange(300_000)}" for _ in range(400_000)]
    rows = rows_of([" ".join(words), " ".join(words[:-9]), "v1 v2 v3 v4"])
    assert len(rows[0][1]) > 2_500_000
    assert of(jaccard.jaccard_components(frame(spark, rows))) == brute(rows)


def test_empty_table(spark):
    assert jaccard.jaccard_components(frame(spark, [])).count() == 0
    assert of(jaccard.jaccard_components(frame(spark, rows_of(["", " \n"])))) == [(0, 0, 0), (1, 0, 1)]


def test_overlaps_stop_below_the_bound():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 60), np.uint64) * np.uint64(2))
        b = np.unique(np.r_[rng.choice(a, rng.integers(1, len(a) + 1)), rng.integers(0, 1 << 63, rng.integers(0, 9), np.uint64)])
        (found,) = jaccard.overlaps([a], [b], 80)
        both = len(np.intersect1d(a, b))
        assert found == (both if 100 * both >= 80 * len(np.union1d(a, b)) else -1)


def test_documents_without_partner_are_left_out_early(spark, corpus):
    rows = jaccard.gram_rows(frame(spark, corpus)).collect()
    sets = {r[0]: brute_set(r[1]) for r in corpus}
    counts = {}
    for s in sets.values():
        for g in s:
            counts[g] = counts.get(g, 0) + 1
    assert {r.doc_id: (r.n, r.once) for r in rows} == {k: (len(s), sum(counts[g] == 1 for g in s)) for k, s in sets.items()}
