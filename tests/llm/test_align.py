import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallyhouse.llm import align, queries
from tests.llm.shared import ODD, clashing, frame


@pytest.fixture(scope="module")
def files():
    return queries.alignment_files()


@pytest.fixture(scope="module")
def encoded():
    """Ids and bytes of a text's tokens by the tokenizers' own libraries."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    printing = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [x for x in range(256) if x not in printing]
    letters = {chr(x): x for x in printing} | {chr(256 + k): x for k, x in enumerate(others)}

    def one(text):
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in a.id_to_token(x)) for x in ids_a]
        names = [b.id_to_piece(x) for x in ids_b]
        bytes_b = [bytes([int(x[3:5], 16)]) if x.startswith("<0x") and len(x) == 6 else x.replace("▁", " ").encode() for x in names]
        want = (" " + text).encode()
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            return [], [], [], []
        return ids_a, bytes_a, ids_b, bytes_b

    return one


def brute(rows, one):
    docs, counts = [], Counter()
    for r in rows:
        ids_a, bytes_a, ids_b, bytes_b = one(r[1] or "")
        ends_a, ends_b = np.cumsum([0, *map(len, bytes_a)]), np.cumsum([0, *map(len, bytes_b)])
        links, j = [], 0
        for i in range(len(ids_a)):
            while j < len(ids_b) and ends_b[j + 1] <= ends_a[i]:
                j += 1
            k = j
            while k < len(ids_b) and ends_b[k] < ends_a[i + 1]:
                links.append((ids_a[i], ids_b[k]))
                k += 1
        cuts = sorted({*ends_a[1:].tolist()} & {*ends_b[1:].tolist()})
        groups, low = [], 0
        for high in cuts:
            own = [",".join(str(ids[k]) for k in range(len(ids)) if low < ends[k + 1] <= high) for ids, ends in ((ids_a, ends_a), (ids_b, ends_b))] if len(ids_a) < 3000 else None
            if own is None:
                own = [",".join(map(str, ids[np.searchsorted(ends[1:], low, "right") : np.searchsorted(ends[1:], high, "right")])) for ids, ends in ((ids_a, ends_a), (ids_b, ends_b))]
            groups.append("|".join(own))
            low = high
        counts.update(links)
        docs.append((r[0], len(ids_a), len(ids_b), links, groups))
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(n, highest.get(b, 0))
    out = []
    for doc_id, n_a, n_b, links, groups in docs:
        best = sum(counts[x] == highest[x[1]] for x in links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc_id, n_a, n_b, len(groups), len(links), best, sum(counts[x] for x in links), digest))
    return sorted(out, key=repr)


def of(df):
    return sorted((tuple(r) for r in df.select(*[x.split()[0] for x in align.ALIGNED.split(", ")]).collect()), key=repr)


def texts_of(rng, n):
    alphabets = ["abcdefgh", "éèàü", "日本語の", "😀🏽", " ", "\n\t", "0123456789", ".,;:'!", "<|endoftext|>", "▁", "ﬁ²", " 　", "don't we'll"]
    return ["".join("".join(rng.choices(rng.choice(alphabets), k=rng.randrange(1, 9))) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


def test_odd_rows(spark, files, encoded):
    docs = clashing(frame(spark, ODD)).selectExpr("*", "'x' as chunk", "'x' as piece", "'x' as whole", "'x' as a", "'x' as na")
    assert of(align.align(docs.repartition(3), files)) == brute(ODD, encoded)


@pytest.mark.parametrize("piece", [5, 64, 1 << 16])
def test_any_pieces(spark, files, encoded, monkeypatch, piece):
    monkeypatch.setattr(align, "PIECE", piece)
    monkeypatch.setattr(align, "BLOCK", 700)
    monkeypatch.setattr(align, "CHUNK", 2000)
    rng = random.Random(piece)
    rows = [(k, x, "en", "a") for k, x in enumerate(["", None, *texts_of(rng, 60), "", "<|endoftext|> <s> </s> <unk> <0x41>", "a  b\x00c", "x" * 900])]
    rows += [(1000 + k, None if rng.random() < 0.3 else "the cat sat on the mat " * rng.randrange(1, 30) + "end", "en", "a") for k in range(40)]
    assert of(align.align(frame(spark, rows).repartition(2), files)) == brute(rows, encoded)


def test_documents(spark, files, encoded):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert of(queries.op13_token_alignment(spark, "/root/testdata/sf0.001")) == brute(rows, encoded)


def test_very_long_text(spark, files, encoded):
    rng = random.Random(3)
    rows = [(1, "".join(rng.choice("abc é,.") for _ in range(1_500_000)), "en", "a"), (2, " " * 200_000, "en", "a"), (3, "z" * 300_000, "en", "a")]
    got = of(align.align(frame(spark, rows), files))
    assert [x[:3] for x in got] == [x[:3] for x in brute(rows, encoded)]
    assert got == brute(rows, encoded)


def test_empty_table(spark, files):
    assert align.align(frame(spark, []), files).count() == 0


def test_same_ids_as_the_tokenizers(files, encoded):
    both = align.Tokenizers(*files)
    some = texts_of(random.Random(8), 3000)
    for text, (a, b) in zip(some, both.encode(some), strict=True):
        want = encoded(text)
        assert (a.tolist(), b.tolist()) == (want[0], want[2]), text


def test_diagonals_cut_the_merge_evenly():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a, b = (np.unique(rng.integers(1, 60, rng.integers(0, 40))) for _ in "ab")
        at = np.arange(3, len(a) + len(b), 3)
        i, j = align.diagonals(a, b, at)
        merged = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
        for d, x, y in zip(at, i, j, strict=True):
            d += d < len(merged) and merged[d][0] == merged[d - 1][0]
            assert (x, y) == (sum(k == 0 for _, k in merged[:d]), sum(k == 1 for _, k in merged[:d]))
