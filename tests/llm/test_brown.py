import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import brown
from tallyhouse.llm.bytecnn import remainder
from tests.llm.shared import ODD, clashing, frame


def scores(df, **how):
    return brown.class_scores(df, remainder(F.col("doc_id"), 10) == 0, **how).collect()


def brute_base(rows, held):
    low = lambda t: [*(t or "").encode().lower().split(), None]
    counts = Counter(w for r in rows if not held[r[0]] for w in low(r[1]))
    n, v = sum(counts.values()), len(counts)
    return {
        (r[0], r[1]): (len(low(r[1])), sum(counts[w] > 0 for w in low(r[1])), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in low(r[1])))
        for r in rows
    }


def compare(rows, got):
    held = {r.doc_id: r.held_out for r in got}
    want = sorted(brute_base(rows, held).values())
    assert sorted({(r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got}) == sorted({(*x[:3], round(x[3], 6)) for x in want})


def test_odd_rows(spark):
    got = scores(clashing(frame(spark, ODD)).repartition(2), classes=4, head=8, rounds=2)
    assert len(got) == len(ODD) and all(math.isfinite(r.score) and r.score < 0 for r in got)
    compare(ODD, got)


def test_classes_beat_the_unigram_on_held_out_texts(spark):
    rng = random.Random(5)
    tongues = [[f"{c}{k}" for k in range(200)] for c in "abc"]
    rows = [(k, " ".join(rng.choices(rng.choice(tongues), k=60)), "en", "a") for k in range(600)]
    got = scores(frame(spark, rows).repartition(3), classes=8, head=500, rounds=8)
    compare(rows, got)
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > 0.93 * sum(r.base_score for r in held)


def test_probabilities_of_the_next_token_sum_to_one(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices("a b c d e f g".split(), k=20)), "en", "a") for k in range(1, 60)]
    rows += [(1000 + k, f"{x}", "en", "a") for k, x in enumerate(["a"])]
    df = brown.texts(frame(spark, rows)).withColumn("held_out", F.lit(False)).withColumn("id", F.col("doc_id"))
    counts, cut = brown.saved(brown.word_counts(df), "c"), brown.saved(brown.blocks(df), "b")
    model = brown.fit(df, counts, cut, classes=3, head=4, rounds=2)
    known = {bytes(r.word): r.n for r in counts.collect()}
    for before in range(5):
        total = 0.0
        for k in range(3):
            share = [(n + 0.1) / (model.class_tokens[k] + 0.1 * (model.class_words[k] + 1)) for w, n in known.items() if model.class_of(w) == k]
            total += 10 ** model.transitions[before, k] * (sum(share) + 0.1 / (model.class_tokens[k] + 0.1 * (model.class_words[k] + 1)))
        assert total + 10 ** model.transitions[before, 3] == pytest.approx(1)


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(0)
    kinds, classes = 5, 3
    of = np.array([0, 1, 2, 0, 1, 2])
    pairs = rng.integers(0, 30, (6, 6)).astype(float)
    tally = lambda of: np.array([[pairs[np.ix_(of == a, of == b)].sum() for b in range(kinds)] for a in range(kinds)])
    likelihood = lambda t: brown.x_log_x(t).sum() - brown.x_log_x(t.sum(axis=0)).sum() - brown.x_log_x(t.sum(axis=1)).sum()
    for u in range(6):
        others = np.arange(6) != u
        after = np.array([[pairs[u, others & (of == c)].sum() for c in range(kinds)]])
        before = np.array([[pairs[others & (of == c), u].sum() for c in range(kinds)]])
        without = pairs.copy()
        without[u, u] = 0
        saved, pairs = pairs, without
        new = brown.best_classes(after, before, of[[u]], tally(of), classes)
        moved = [likelihood(tally(np.where(np.arange(6) == u, c, of))) for c in range(classes)]
        assert moved[new[0]] == pytest.approx(max(moved))
        pairs = saved


def test_empty_table_and_no_training_rows(spark):
    assert scores(frame(spark, []), classes=2, head=2, rounds=1) == []
    rows = brown.class_scores(frame(spark, [(1, "a b", "en", "a")]), F.lit(True), classes=2, head=2, rounds=1).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows] == [(3, 0, 0, 0.0)]


def test_every_training_word_is_exchanged_itself(spark):
    """Words outside the head that end alike, and so share a unit, come to the classes of their tongues."""
    rng = random.Random(3)
    tongues = [[f"{c}{k}same" for k in range(40)] for c in "ab"]
    rows = [(k, " ".join(rng.choices(tongues[k % 2], k=40)), "en", "a") for k in range(1, 200)]
    df = brown.texts(frame(spark, rows)).withColumn("held_out", F.lit(False)).withColumn("id", F.col("doc_id"))
    counts, cut = brown.saved(brown.word_counts(df), "c"), brown.saved(brown.blocks(df, 500), "b")
    model = brown.fit(df, counts, cut, classes=2, head=2, rounds=8)
    assert len({model.of_unit(x.encode()) for x in tongues[0][20:] + tongues[1][20:]}) < 3
    known = {bytes(r["word"]).decode(): r["class"] for r in model.known.collect()}
    assert set(known) == {x for r in rows for x in r[1].split()}
    found = [Counter(known[x] for x in t if x in known) for t in tongues]
    assert all(max(x.values()) == x.total() for x in found) and set(found[0]) != set(found[1])


def test_many_words_are_weighed_like_single_ones():
    rng = np.random.default_rng(4)
    classes = 5
    after, before = (rng.integers(0, 4, (60, classes + 2)) * (rng.random((60, classes + 2)) < 0.3) for _ in range(2))
    after[:, classes + 1], before[:, classes], own = 0, 0, rng.integers(0, classes, 60)
    pairs = rng.integers(300, 900, (classes + 2, classes + 2)).astype(float)
    one = brown.best_classes(after.astype(float), before.astype(float), own, pairs, classes)
    assert brown.best_of_many(after.astype(float), before.astype(float), own, pairs, classes).tolist() == one.tolist()


def test_words_travel_as_a_row_for_each_block_and_bucket(spark):
    rows = [(k, " ".join(f"w{(k * j) % 37}" for j in range(40)), "en", "a") for k in range(1, 60)]
    df = brown.texts(frame(spark, rows)).withColumn("held_out", F.col("doc_id") == 7).withColumn("id", F.col("doc_id"))
    cut = brown.saved(brown.blocks(df.coalesce(1), 500), "b")
    many, asked = cut.count(), brown.asked_words(cut, 3).collect()
    assert many > 3 and len({(r.block, r.bucket) for r in asked}) == len(asked) <= 3 * many
    want = Counter(w for r in rows if r[0] != 7 for w in r[1].encode().split())
    for bucket in brown.vocabulary(cut, 3).collect():
        words, n = bytes(bucket.words).split(b"\n"), brown.unpacked(bytes(bucket.n)).tolist()
        assert n == [want[w] for w in words]
        sent = {r.block: bytes(r.words).split(b"\n") for r in asked if r.bucket == bucket.bucket}
        assert {b: [words[k] for k in brown.unpacked(bytes(p))] for b, p in zip(bucket.blocks, bucket.places, strict=True)} == sent


def test_packed_numbers_may_exceed_32_bits():
    for numbers in ([], [3, 0, 7], [2**31, 1, 2**40], [2**31 - 1, -5]):
        assert brown.unpacked(brown.packed(np.array(numbers, np.int64))).tolist() == numbers
