import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import bytecnn
from tests.llm.shared import ODD, clashing, frame

TONGUES = {"aa": ["the", "tion", "ing", "and"], "bb": ["ñe", "ción", "que", "los"], "cc": ["über", "sch", "und", "keit"]}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = []
    for k in range(900):
        lang = rng.choice(list(TONGUES))
        out.append((k, " ".join("".join(rng.choices(TONGUES[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(2, 200))), lang, "a"))
    return out


def test_held_out_accuracy(spark, rows):
    df = frame(spark, rows)
    held = bytecnn.remainder(F.col("doc_id"), 4) == 2
    got = bytecnn.identify(df, bytecnn.fit(df, ~held)).collect()
    truth = {r[0]: r[2] for r in rows}
    held_out = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held_out) > 150 and sum(truth[r.doc_id] == r.lang_pred for r in held_out) / len(held_out) > 0.98
    again = bytecnn.identify(df, bytecnn.fit(df.repartition(3), ~held)).collect()
    assert {(r.doc_id, r.lang_pred) for r in again} == {(r.doc_id, r.lang_pred) for r in got}


def test_odd_rows(spark, rows):
    df = clashing(frame(spark, [*rows[:300], *[(None if r[0] is None else 5000 + r[0], *r[1:]) for r in ODD]]))
    net = bytecnn.fit(df, F.lit(True))
    got = [r for r in bytecnn.identify(df, net).collect() if r.doc_id is None or r.doc_id >= 5000]
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {5003, 5004, 5010, None} and {r.lang_pred for r in got} <= {"und", *net.labels}
    assert sum(r.doc_id is None for r in got if r.lang_pred == "und") == 1


def test_nothing_to_learn(spark):
    df = frame(spark, [(1, "abc", None, "a"), (2, "abc", "", "a")])
    assert bytecnn.fit(df, F.lit(True)) is None
    assert {r.lang_pred for r in bytecnn.identify(df, None).collect()} == {"und"}
    assert bytecnn.identify(frame(spark, []), None).count() == 0


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    net = bytecnn.Network.fresh(["x", "y", "z"], rng)
    windows, answers = rng.integers(0, 256, (5, bytecnn.WINDOW)), np.array([0, 1, 2, 1, 0])

    def loss():
        hidden = []
        for w, f, b in zip(bytecnn.WIDTHS, net.filters, net.biases, strict=True):
            e = net.embedding[windows]
            hidden.append((np.concatenate([e[:, k : bytecnn.WINDOW - w + 1 + k] for k in range(w)], axis=2) @ f + b).max(axis=1))
        p = bytecnn.softmax(np.maximum(np.concatenate(hidden, axis=1), 0) @ net.out + net.out_bias)
        return -np.log(p[np.arange(5), answers]).mean()

    for weights, found in zip(net.weights(), bytecnn.gradients(net, windows, answers), strict=True):
        for at in rng.choice(weights.size, 12):
            old = weights.flat[at]
            weights.flat[at] = old + 1e-6
            up = loss()
            weights.flat[at] = old - 1e-6
            down = loss()
            weights.flat[at] = old
            assert (up - down) / 2e-6 == pytest.approx(found.flat[at], abs=1e-5)


def test_tables_and_windows_give_the_same_as_the_filters():
    rng = np.random.default_rng(3)
    net = bytecnn.Network.fresh(["x", "y"], rng)
    some = lambda n: rng.integers(1, 256, n).astype(np.uint8).tobytes()
    texts = [b"", b"a", some(256), some(257), some(3000)]
    filled = [bytecnn.cut_windows(x) for x in texts]
    windows = bytecnn.stacked(b"".join(x for x, _ in filled), [n for _, n in filled])
    assert [n for _, n in filled] == [1, 1, 1, 2, 12]
    assert bytes(windows[5:][:, : bytecnn.STRIDE].reshape(-1)).startswith(texts[4][: 11 * bytecnn.STRIDE])
    want = []
    for w, f, b in zip(bytecnn.WIDTHS, net.filters, net.biases, strict=True):
        e = net.embedding[windows]
        want.append((np.concatenate([e[:, k : bytecnn.WINDOW - w + 1 + k] for k in range(w)], axis=2) @ f + b).max(axis=1))
    want = bytecnn.softmax(np.maximum(np.concatenate(want, axis=1), 0) @ net.out + net.out_bias)
    assert bytecnn.Tables(net).probabilities(windows) == pytest.approx(want, abs=1e-4)
