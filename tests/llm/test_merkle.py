import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import merkle
from tests.llm.shared import ODD, clashing, frame


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf_of(doc_id, source, lang, n_chars, text):
    return h(*map(field, (doc_id, source, lang, n_chars, text)))


def tree(leaves):
    """The root, and the siblings of every leaf as (stands before, digest)."""
    level, at, paths = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for k, i in enumerate(at):
            paths[k].append((i % 2 == 1, level[i - 1] if i % 2 else level[i + 1] if i + 1 < len(level) else ""))
        level, at = [h(*level[i : i + 2]) for i in range(0, len(level), 2)], [i // 2 for i in at]
    return level[0], paths


def brute(rows):
    """rows: (doc_id, text, lang, source); what op12 returns for each, sorted."""
    full = [(i, s, la, None if t is None else len(t), t) for i, t, la, s in rows]
    langs = sorted({r[2] for r in full}, key=lambda x: (x is not None, (x or "").encode()))
    own = {la: sorted((r for r in full if r[2] == la), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r))) for la in langs}
    trees = {la: tree([leaf_of(*r) for r in own[la]]) for la in langs}
    root, upper = tree([trees[la][0] for la in langs])
    out = []
    for la, top in zip(langs, upper, strict=True):
        for r, path in zip(own[la], trees[la][1], strict=True):
            tampered = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            at = leaf_of(*r[:3], r[3] + 1, r[4]) if tampered else leaf_of(*r)
            for before, digest in path + top:
                at = h(digest, at) if before else h(at, digest)
            out.append((r[0], leaf_of(*r), trees[la][0], root, h(*[d for _, d in path + top]), at, at == root))
            assert at != root or not tampered
    return sorted(out, key=repr)


def of(df):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in merkle.manifest(df, tampered).select(columns).collect()), key=repr)


def test_odd_rows(spark):
    docs = clashing(frame(spark, ODD)).selectExpr("*", "'x' as tree", "'x' as leaf", "'x' as low", "'x' as height", "'x' as path", "'x' as root")
    assert of(docs.repartition(3)) == brute(ODD)


@pytest.mark.parametrize("band", [1, 3, 8])
def test_any_band_and_sizes(spark, monkeypatch, band):
    """Trees of one, two, three, a power of two and more leaves; many trees."""
    monkeypatch.setattr(merkle, "BAND", band)
    rng = random.Random(band)
    rows = [(rng.randrange(10**9), f"text {k} é", f"l{k % 3}" if k > 40 else f"é{k % 17}", rng.choice("ab")) for k in range(330)]
    rows += [(7, "x", "two", "a"), (-7, None, "two", None), *[(k, "", "four", "a") for k in range(8)], (1, "t" * 3_000_000, "one", "b")]
    assert of(frame(spark, rows).repartition(4)) == brute(rows)


def test_nodes_cover_their_leaves(spark):
    rows = [(k, str(k), "en" if k % 5 else "de", "a") for k in range(100)]
    leaves = merkle.ranked(frame(spark, rows).select("doc_id", merkle.tree_key(F.col("lang")).alias("tree"), merkle.leaf_digest().alias("leaf")), [F.col("doc_id")])
    nodes = merkle.build(leaves.select("tree", "low", "leaf")).collect()
    for key, n in (("=en", 80), ("=de", 20)):
        for level in range(merkle_height := (n - 1).bit_length() + 1):
            own = sorted((r.low, r.high) for r in nodes if r.tree == key and r.level == level)
            assert own == [(a, min(a + (1 << level), n)) for a in range(0, n, 1 << level)]
        assert max(r.level for r in nodes if r.tree == key) == merkle_height - 1


def test_one_leaf_and_empty_table(spark):
    assert of(frame(spark, [(3, "a", None, "s")])) == brute([(3, "a", None, "s")])
    assert of(frame(spark, [])) == []
