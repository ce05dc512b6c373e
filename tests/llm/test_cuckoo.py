import hashlib
from collections import defaultdict

import pytest

from tallyhouse.llm import cuckoo
from tallyhouse.llm.common import lower_ascii, saved
from tests.llm.shared import ODD, clashing, frame


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        groups[hashlib.sha256(low.encode()).hexdigest()].append(doc_id)
    out = []
    for digest, ids in groups.items():
        keep = max((x for x in ids if x is not None), default=None)
        out += [(x, keep, len(ids), digest) for x in ids]
    return sorted(out, key=repr)


def test_odd_rows_as_by_brute_force(spark):
    got = cuckoo.exact_dedup(clashing(frame(spark, ODD)).repartition(3)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(ODD)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)


def test_many_copies_over_many_partitions(spark):
    rows = [(k, "hot" if k % 3 == 0 else f"t{k % 50}", "en", "a") for k in range(3000)]
    got = cuckoo.exact_dedup(frame(spark, rows).repartition(7)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(rows)


def test_empty_table(spark):
    assert cuckoo.exact_dedup(frame(spark, [])).count() == 0


def test_shard_inserts_deletes_and_resizes():
    shard = cuckoo.CuckooShard(2)
    digests = [hashlib.sha256(str(k).encode()).digest() for k in range(5000)]
    for k, x in enumerate(digests):
        shard.insert(x, k, 0, 0, 1)
    assert shard.buckets >= 1250 and all(shard.find(x)[1] == k for k, x in enumerate(digests))
    assert all(shard.delete(x) for x in digests[::2]) and not shard.delete(digests[0])
    assert [shard.find(x) is not None for x in digests[:4]] == [False, True, False, True]
    import pandas as pd

    row = pd.DataFrame([shard.to_row(3)])
    again = cuckoo.CuckooShard.from_row(next(row.itertuples()))
    assert again.find(digests[1]) == shard.find(digests[1]) and again.find(digests[0]) is None
    again.insert(digests[0], 9, 0, 0, 2)
    assert again.find(digests[0])[4] == 2


def test_hit_with_equal_mark_is_verified():
    shard = cuckoo.CuckooShard(64)
    one, other = b"a" * 32, b"a" * 31 + b"b"
    shard.insert(one, 1, 0, 0, 1)
    assert shard.find(other) is None
    shard.insert(other, 2, 0, 0, 1)
    assert shard.find(one)[1] == 1 and shard.find(other)[1] == 2


@pytest.mark.parametrize("batches", [2])
def test_index_over_batches(spark, batches):
    rows = saved(cuckoo.digest_rows(frame(spark, [(k, f"t{k % 40}", "en", "a") for k in range(100)])), "rows")
    index = cuckoo.empty_index(rows)
    for k in range(batches):
        index = cuckoo.insert(index, cuckoo.tickets(rows.filter(f"doc_id % {batches} = {k}"), index.shards))
    asked = cuckoo.tickets(rows, index.shards)
    found = cuckoo.probe(index, asked).select("digest", "keep_id", "group_size").distinct().collect()
    assert len(found) == 40 and {r.keep_id for r in found} == set(range(60, 100)) and sum(r.group_size for r in found) == 100
    gone = rows.filter("doc_id < 10").select("digest")
    assert cuckoo.probe(cuckoo.delete(index, gone), asked).select("digest").distinct().count() == 30


def test_lowering_is_ascii_only(spark):
    assert frame(spark, [(1, "ÀBz", "en", "a")]).select(lower_ascii("text")).first()[0] == "Àbz"
