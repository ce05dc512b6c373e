import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyhouse.llm import phrases, words
from tests.llm.shared import ODD, clashing, frame


def brute(rows, window=35):
    split = [re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text, *_ in rows]
    starts = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (doc_id, *_), w in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if starts[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df, **how):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in phrases.recurring_passages(df, **how).collect()), key=repr)


def test_odd_rows(spark):
    rows = [*ODD, (20, "ñ é " * 40, "es", "a"), (21, " ".join(f"w{k}" for k in range(60)), "en", "a"), (21, " ".join(f"w{k}" for k in range(60)), "en", "a")]
    assert result(clashing(frame(spark, rows)).repartition(3)) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_passages(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(30)] + ["ä", "ça", "x\x1cy"]
    some = lambda n: rng.choices(vocabulary, k=n)
    passages = [some(n) for n in (34, 35, 36, 60, 120, 400)]
    rows = []
    for k in range(150):
        w = some(rng.randrange(0, 120))
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, len(p))
            w += p[a : a + rng.randrange(20, 130)] + some(rng.randrange(0, 5))
        sep = rng.choice([" ", "  ", "\n", " \t"])
        rows.append((k, sep.join(w), "en", "a"))
    rows += [(200 + k, " ".join(passages[5]), "en", "a") for k in range(40)]
    assert result(frame(spark, rows).repartition(4)) == brute(rows)


def test_short_windows_within_one_document(spark):
    rows = [(1, "a b c d a b c e a b", "en", "a"), (2, "c e a b x", "en", "a")]
    assert result(frame(spark, rows), window=3, phrase=2) == brute(rows, 3)


def test_words_on_which_polynomials_collide(spark):
    """Thue-Morse words: equal polynomial hashes modulo 2 ** 64 for every odd base."""
    def word(n, flip):
        return "".join("ab"[(bin(k).count("1") + flip) % 2] for k in range(n))

    rows = []
    for k, n in enumerate((32, 64, 512, 1024, 2048, 4096)):
        rest = [f"r{k}w{j}" for j in range(34)]
        rows += [(2 * k, " ".join([word(n, 0), *rest]), "en", "a"), (2 * k + 1, " ".join([word(n, 1), *rest]), "en", "a")]
    assert {r[2] for r in brute(rows)} == {0}
    assert result(frame(spark, rows)) == brute(rows)


def test_empty_table(spark):
    assert phrases.recurring_passages(frame(spark, [])).count() == 0


def test_hashes_depend_on_the_words_alone():
    a, b = b" one  two\nthree ", b"x one two three"
    ha = words.word_hashes(a, *words.word_spans(a))
    hb = words.word_hashes(b, *words.word_spans(b))
    assert (ha == hb[1:]).all() and len(set(hb.tolist())) == 4
    assert words.gram_hashes(ha, 2).tolist() == words.gram_hashes(hb, 2)[1:].tolist()
    values = np.random.default_rng(0).integers(0, 99, 50).astype(np.uint64)
    for width in (1, 2, 5, 28):
        assert words.window_minima(values, width).tolist() == [values[i : i + width].min() for i in range(51 - width)]
