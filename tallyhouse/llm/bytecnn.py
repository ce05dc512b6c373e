"""Language identification with a byte convolutional network.

Bytes of a fixed-length window are embedded, convolved with filters of several widths, rectified,
max-pooled over the window and classified by softmax. Training is plain numpy on the driver, on a
bounded sample: every language among the labels, about ``PER_LANGUAGE`` labelled rows of each and
``WINDOWS_OF_ROW`` windows of a row, chosen by hash. Prediction covers whole texts: windows overlap by
the widest filter less one byte, tasks run them in blocks, and a document's probabilities are the mean
over its windows by length. For prediction the filters become tables over byte pairs, which give the
same sums with fewer steps.

Defined results: null text or text without a letter is ``und`` with score 0; null or empty labels are
not learned; a null id hashes like the text ''; repeated rows get the same answer; without labelled
rows every text is ``und``; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 256
WIDTHS = (2, 3, 4)
STRIDE = WINDOW - max(WIDTHS) + 1
EMBEDDING = 8
FILTERS = 16
PER_LANGUAGE = 500
WINDOWS_OF_ROW = 4
EPOCHS = 8
RATE = 0.01
#: Windows that are run at a time.
BLOCK = 128
UNDETERMINED = "und"


@dataclass
class Network:
    """Weights; ``labels`` are the learned languages."""

    labels: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, labels: list[str], rng: np.random.Generator) -> Network:
        hidden = FILTERS * len(WIDTHS)
        return cls(
            labels,
            rng.normal(0, 0.5, (256, EMBEDDING)),
            [rng.normal(0, (2 / (w * EMBEDDING)) ** 0.5, (w * EMBEDDING, FILTERS)) for w in WIDTHS],
            [np.zeros(FILTERS) for _ in WIDTHS],
            rng.normal(0, hidden**-0.5, (hidden, len(labels))),
            np.zeros(len(labels)),
        )

    def weights(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.biases, self.out, self.out_bias]


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def gradients(net: Network, windows: np.ndarray, answers: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross-entropy, in the order of ``weights``; pooling passes it to the winners only."""
    n, rows = len(windows), np.arange(len(windows))[:, None]
    embedded = net.embedding[windows]
    pooled, winners, inputs = [], [], []
    for w, filters, bias in zip(WIDTHS, net.filters, net.biases, strict=True):
        spans = np.concatenate([embedded[:, k : WINDOW - w + 1 + k] for k in range(w)], axis=2)
        found = spans @ filters + bias
        best = found.argmax(axis=1)
        pooled.append(np.take_along_axis(found, best[:, None, :], axis=1)[:, 0])
        winners.append(best)
        inputs.append(spans[rows, best])
    hidden = np.maximum(np.concatenate(pooled, axis=1), 0)
    loss = softmax(hidden @ net.out + net.out_bias)
    loss[np.arange(n), answers] -= 1
    loss /= n
    back = (loss @ net.out.T) * (hidden > 0)
    to_embedding, to_filters, to_biases = np.zeros_like(net.embedding), [], []
    for k, (w, filters) in enumerate(zip(WIDTHS, net.filters, strict=True)):
        own = back[:, k * FILTERS : (k + 1) * FILTERS]
        to_filters.append(np.einsum("nf,nfe->ef", own, inputs[k]))
        to_biases.append(own.sum(axis=0))
        spread = np.einsum("nf,ef->nfe", own, filters).reshape(n, FILTERS, w, EMBEDDING)
        at = windows[rows[:, :, None], winners[k][:, :, None] + np.arange(w)]
        np.add.at(to_embedding, at, spread)
    return [to_embedding, *to_filters, *to_biases, hidden.T @ loss, loss.sum(axis=0)]


def train(windows: np.ndarray, answers: np.ndarray, labels: list[str], seed: int = 0) -> Network:
    """Adam over shuffled batches; windows are cut short at random, so that short texts are learned too."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(labels, rng)
    first = [np.zeros_like(x) for x in net.weights()]
    second = [np.zeros_like(x) for x in net.weights()]
    steps = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), 32):
            some = order[at : at + 32]
            cut = np.where(rng.random(len(some)) < 0.5, WINDOW, rng.integers(12, WINDOW, len(some)))
            batch = np.where(np.arange(WINDOW) < cut[:, None], windows[some], 0)
            steps += 1
            for x, m, v, g in zip(net.weights(), first, second, gradients(net, batch, answers[some]), strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x -= RATE * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
    return net


class Tables:
    """The filters as sums of rows of tables over byte pairs and bytes."""

    def __init__(self, net: Network):
        self.net = net
        single = [[(net.embedding @ f[k * EMBEDDING : (k + 1) * EMBEDDING]).astype(np.float32) for k in range(w)] for w, f in zip(WIDTHS, net.filters, strict=True)]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        self.terms = []  # for each width: (offset, table, whether of pairs)
        for w, tables in zip(WIDTHS, single, strict=True):
            terms = [(k, pair(tables[k], tables[k + 1]), True) for k in range(0, w - 1, 2)]
            self.terms.append(terms + ([(w - 1, tables[w - 1], False)] if w % 2 else []))

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Of the labels, for each row of bytes."""
        out = np.zeros((len(windows), len(self.net.labels)))
        for at in range(0, len(windows), BLOCK):
            some = windows[at : at + BLOCK].astype(np.int32)
            pairs = (some[:, :-1] << 8) | some[:, 1:]
            pooled = []
            for w, terms, bias in zip(WIDTHS, self.terms, self.net.biases, strict=True):
                length = WINDOW - w + 1
                found = None
                for offset, table, of_pairs in terms:
                    part = table[(pairs if of_pairs else some)[:, offset : offset + length]]
                    found = part if found is None else np.add(found, part, out=found)
                pooled.append(found.max(axis=1) + bias)
            hidden = np.maximum(np.concatenate(pooled, axis=1), 0)
            out[at : at + len(some)] = softmax(hidden @ self.net.out + self.net.out_bias)
        return out


def cut_windows(text: bytes) -> tuple[bytes, int]:
    """The text filled up to whole windows, and their number."""
    count = max(1, -(-(len(text) - WINDOW + STRIDE) // STRIDE))
    return text.ljust((count - 1) * STRIDE + WINDOW, b"\0"), count


def stacked(padded: bytes, counts: list[int]) -> np.ndarray:
    """The windows of texts filled up by ``cut_windows`` and joined."""
    starts, at = [], 0
    for n in counts:
        starts.append(at + STRIDE * np.arange(n))
        at += (n - 1) * STRIDE + WINDOW
    return np.lib.stride_tricks.sliding_window_view(np.frombuffer(padded, np.uint8), WINDOW)[np.concatenate(starts)]


def sample(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, answers and languages of a sample of rows (text, lang, id hash): every language, each with a bounded number."""
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counts:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, int), []
    labels = sorted(r.lang for r in counts)
    share = F.create_map(*[x for r in counts for x in (F.lit(r.lang), F.lit(min(1.0, 1.2 * per_language / r.n)))])
    chosen = labelled.filter((F.pmod("hash", F.lit(1 << 30)) / float(1 << 30)) < F.element_at(share, F.col("lang")))

    def some_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, windows = [], []
            for text, lang, own in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), batch.column("hash").to_pylist(), strict=True):
                data = text.encode()
                rng = np.random.default_rng(own & (1 << 62) - 1)
                for _ in range(min(WINDOWS_OF_ROW, 1 + len(data) // WINDOW)):
                    at = int(rng.integers(0, max(1, len(data) - WINDOW + 1)))
                    langs.append(lang)
                    windows.append(data[at : at + WINDOW].ljust(WINDOW, b"\0"))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(windows, pa.binary())], ["lang", "window"])

    most = 2 * per_language * len(labels) * WINDOWS_OF_ROW
    rows = chosen.mapInArrow(some_windows, "lang string, window binary").limit(most).toArrow().sort_by([("lang", "ascending"), ("window", "ascending")])
    if not rows.num_rows:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, int), []
    number = {x: k for k, x in enumerate(labels)}
    windows = np.frombuffer(b"".join(rows["window"].to_pylist()), np.uint8).reshape(-1, WINDOW)
    return windows, np.array([number[x] for x in rows["lang"].to_pylist()]), labels


def remainder(id_col: Column, of: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))), F.lit(of))


def fit(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network learned from the labelled rows for which ``training`` holds; None without such rows."""
    labelled = docs.filter(training & F.col(lang_col).isNotNull() & (F.col(lang_col) != "") & F.col(text_col).rlike(r"\p{L}"))
    windows, answers, labels = sample(
        labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("string"), text_col).alias("hash"))
    )
    return train(windows, answers, labels) if labels else None


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, hash (xxhash64 of the text), lang_pred and score of every row, from the text alone."""

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(net) if net else None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                texts = some.column("text").to_pylist()
                langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
                known = [k for k, x in enumerate(texts) if tables and x and any(map(str.isalpha, x))]
                if known:
                    data = [texts[k].encode() for k in known]
                    filled = [cut_windows(x) for x in data]
                    counts = [n for _, n in filled]
                    found = tables.probabilities(stacked(b"".join(x for x, _ in filled), counts))
                    lengths = np.concatenate([np.r_[np.full(n - 1, STRIDE), max(1, len(x) - (n - 1) * STRIDE)] for x, n in zip(data, counts, strict=True)])
                    firsts = np.cumsum([0, *counts[:-1]])
                    mean = np.add.reduceat(found * lengths[:, None], firsts) / np.add.reduceat(lengths, firsts)[:, None]
                    for k, p in zip(known, mean, strict=True):
                        langs[k], scores[k] = net.labels[int(p.argmax())], min(1.0, float(p.max()))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("hash"), pa.array(langs), pa.array(scores)], ["doc_id", "hash", "lang_pred", "score"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("hash"))
    return rows.mapInArrow(predicted, "doc_id long, hash long, lang_pred string, score double")
