import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyhouse.llm import packing
from tallyhouse.llm.bytelevel import ByteLevel
from tests.llm.shared import ODD, clashing, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, got):
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    texts = {}
    for doc_id, text, *_ in rows:
        texts.setdefault(doc_id, []).append(text)
    for doc_id, some in texts.items():
        pieces = sorted(by_doc[doc_id], key=lambda r: r.start)
        if len(some) == 1:
            ids = plain(some[0])
            at = 0
            for r in pieces:
                own = ids[r.start : r.start + r.length]
                assert r.start == at and len(own) == r.length and r.doc_tokens == len(ids)
                assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
                at += r.length
            assert at == len(ids)
    for some in by_seq.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY
    return len(by_seq)


def test_odd_rows(spark):
    got = packing.harmonic_pack(clashing(frame(spark, ODD)).repartition(2), PATH).collect()
    check(ODD, got)
    assert sum(r.length for r in got) == sum(len(plain(x[1])) for x in ODD)


def test_little_padding(spark):
    rng = random.Random(3)
    words = ["of", "the", "tion", "erth", "Anblewh,", "ouêau", "\n", "x1"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 1500))), "en", "a") for k in range(300)]
    got = packing.harmonic_pack(frame(spark, rows).repartition(4), PATH).collect()
    sequences = check(rows, got)
    assert sum(r.length for r in got) / (sequences * packing.CAPACITY) > 0.97


def test_ids_are_those_of_the_tokenizers_library():
    texts = ["", " a", "a  b", "a \n b", "x\n\ny z ", "it's  <|endoftext|> ok", "tab\t x", "  a   b", "1 2 don't\r\n", "a\x1c b", "ſ'S ٣ ½ é\u0301 \u3000 日本 \U0001f469\u200d\U0001f4bb"]
    rng = random.Random(5)
    texts += ["".join(rng.choices("abé1 \t\n'.,sß\u00a0\u2028漢\U0001f600", k=rng.randrange(60))) for _ in range(2000)]
    coder = packing.encoder(Path(PATH).read_bytes())
    whole = Tokenizer.from_file(PATH)
    assert [coder.ids(x).tolist() for x in texts] == [whole.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("text", ["a" * 2_000_000, "b" + " " * 1_000_000 + "c", "\n" * 1_000_000 + "x", "word, " * 400_000])
def test_texts_of_megabytes(text):
    """tiktoken alone fails on the runs of white space."""
    whole = Tokenizer.from_file(PATH)
    for specials in (True, False):
        assert ByteLevel(Path(PATH).read_bytes(), specials).ids(text).tolist() == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 700, 1024, 1500, 2047, 2048, 2049, 10000])
def test_cuts_fill_classes(n):
    sizes = packing.cuts(n)
    assert sum(sizes) == n and all(x > 0 for x in sizes)
    assert all(x < packing.CAPACITY // packing.CLASSES + 1 or x == packing.CAPACITY // (packing.CAPACITY // x) for x in sizes)


def test_ids_are_kept_on_request(spark):
    rows = [(1, "a b c", "en", "a")]
    (piece,) = packing.harmonic_pack(frame(spark, rows), PATH, with_ids=True).collect()
    assert np.frombuffer(piece.ids, "<u4").tolist() == plain("a b c")


def test_empty_table(spark):
    assert packing.harmonic_pack(frame(spark, []), PATH).count() == 0
