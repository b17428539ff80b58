"""Quality of texts by a convolutional network over bytes, in numpy.

A byte has a learned vector; filters of ``WIDTH`` bytes slide over the whole text.  The text is cut into chunks of
``CHUNK`` bytes that overlap by ``WIDTH`` - 1, so that every window lies in exactly one chunk.  Each filter keeps its
largest answer in each chunk; the mean, the largest and the smallest of these over all chunks, with the logarithm of the
number of windows, go through one hidden layer to a probability.  Vectors, filters and layers are learned together by
gradient descent.  For scoring, vectors and filters are folded into one table for each filter and pair of places, so that
a window costs ``WIDTH`` / 2 look-ups.

A passage of a good text is good: while fitting, texts of label 1 are now and then cut to a short passage, else length
alone would tell.  Fitting takes a bounded sample (documented parameters, since this is a classifier): about ``sample_docs`` labelled
documents of each class, chosen by a hash of the id, none longer than ``SAMPLE_BYTES``.  Scoring reads the text only,
all of it, on the executors; the model is some 100 kB whatever the corpus.

Defined cases: a null text counts as empty; an empty text, and one shorter than a window, is scored with zero bytes put
after it; labels other than 0 and 1 and labels of unknown documents are passed over; with labels of one class only the
score is (n1 + 1) / (n + 2) for every text, 0.5 without labels; repeated rows are scored each; an empty table gives an
empty result; columns of other names are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, text_slices

WIDTH = 6
CHUNK = 160
FILTERS = 12
VECTOR = 8
HIDDEN = 16
#: Bytes of a text of the sample at most.
SAMPLE_BYTES = 1 << 16
#: Bytes that are scored at once.
SCORE_BYTES = 1 << 18


@dataclass
class Model:
    """``parts``: vectors (256, v), filters (w, v, f), their bias (f), hidden layer (3 f + 1, h) and bias, output (h) and bias;
    None where every text has the score ``prior``."""

    parts: list[np.ndarray] | None
    prior: float = 0.5

    def tables(self) -> np.ndarray:
        """(w, 256, f): what a byte in a place of the window adds to each filter."""
        return np.einsum("bv,wvf->wbf", self.parts[0], self.parts[1])


def _padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid end to end, none shorter than a window, and their bounds."""
    texts = [t.ljust(WIDTH, b"\0") for t in texts]
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0] + [len(t) for t in texts])


def _chunks(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window of each chunk, and of each text the number of its first chunk."""
    hop = CHUNK - WIDTH + 1
    n = -(-(np.diff(bounds) - WIDTH + 1) // hop)
    first = np.cumsum(n) - n
    return np.repeat(bounds[:-1] - hop * first, n) + hop * np.arange(n.sum()), first


def _answers(data: np.ndarray, bounds: np.ndarray, pairs: np.ndarray) -> Iterator[np.ndarray]:
    """Each filter's answers at all windows; -inf at those that reach into the next text."""
    both = data[:-1].astype(np.intp) * 256 + data[1:]
    n = len(data) - WIDTH + 1
    across = (bounds[1:-1, None] - np.arange(1, WIDTH)).ravel()
    for f in range(pairs.shape[0]):
        out = pairs[f, 0].take(both[:n])
        for k in range(1, WIDTH // 2):
            out += pairs[f, k].take(both[2 * k : 2 * k + n])
        out[across] = -np.inf
        yield out


def _pair_tables(tables: np.ndarray) -> np.ndarray:
    """(f, w / 2, 65536)"""
    pairs = tables[0::2, :, None, :] + tables[1::2, None, :, :]
    return np.ascontiguousarray(pairs.transpose(3, 0, 1, 2).reshape(tables.shape[2], WIDTH // 2, 65536), dtype=np.float32)


def _head(pooled: np.ndarray, first: np.ndarray, windows: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of pooled answers (chunks, f): activations, features of each text, hidden layer, probability."""
    act = np.tanh(pooled + parts[2])
    n = np.diff(np.append(first, len(act)))[:, None]
    features = np.concatenate([np.add.reduceat(act, first) / n, np.maximum.reduceat(act, first), np.minimum.reduceat(act, first), np.log(windows)[:, None] / 4 - 1], axis=1)
    hidden = np.tanh(features @ parts[3] + parts[4])
    return act, features, hidden, 1 / (1 + np.exp(-np.clip(hidden @ parts[5] + parts[6], -30, 30)))


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.pairs = _pair_tables(model.tables()) if model.parts else None

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if not self.model.parts:
            return np.full(len(bounds) - 1, self.model.prior)
        if (np.diff(bounds) < WIDTH).any():
            data, bounds = _padded([data[a:b].tobytes() for a, b in zip(bounds, bounds[1:])])
        start, first = _chunks(bounds)
        pooled = np.stack([np.maximum.reduceat(x, start) for x in _answers(data, bounds, self.pairs)], axis=1).astype(np.float64)
        return _head(pooled, first, np.diff(bounds) - WIDTH + 1, self.model.parts)[3]


def _gradients(data: np.ndarray, bounds: np.ndarray, labels: np.ndarray, model: Model) -> list[np.ndarray]:
    """Of the mean log loss, for each of the model's parts."""
    parts = model.parts
    tables = model.tables()
    start, first = _chunks(bounds)
    width = np.diff(np.append(start, len(data) - WIDTH + 1))
    pooled, at = [], []
    for x in _answers(data, bounds, _pair_tables(tables)):
        top = np.maximum.reduceat(x, start)
        hits = np.flatnonzero(x == np.repeat(top, width))
        at.append(hits[np.searchsorted(hits, start)])
        pooled.append(top)
    pooled, at = np.stack(pooled, axis=1).astype(np.float64), np.stack(at, axis=1)
    act, features, hidden, p = _head(pooled, first, np.diff(bounds) - WIDTH + 1, parts)
    n = np.diff(np.append(first, len(act)))
    d_out = (p - labels) / len(labels)
    d_hidden = d_out[:, None] * parts[5] * (1 - hidden**2)
    f = act.shape[1]
    d_mean, d_max, d_min = np.split((d_hidden @ parts[3].T)[:, : 3 * f], 3, axis=1)
    d_act = np.repeat(d_mean / n[:, None], n, axis=0)
    for value, d in ((features[:, f : 2 * f], d_max), (features[:, 2 * f : 3 * f], d_min)):
        same = act == np.repeat(value, n, axis=0)
        d_act += same * np.repeat(d / np.add.reduceat(same, first, dtype=np.float64), n, axis=0)
    d_pool = d_act * (1 - act**2)
    d_tables = np.zeros_like(tables)
    for k in range(WIDTH):
        np.add.at(d_tables[k], (data[at + k], np.arange(f)), d_pool)
    return [
        np.einsum("wbf,wvf->bv", d_tables, parts[1]),
        np.einsum("bv,wbf->wvf", parts[0], d_tables),
        d_pool.sum(axis=0),
        features.T @ d_hidden,
        d_hidden.sum(axis=0),
        hidden.T @ d_out,
        np.array(d_out.sum()),
    ]


def _passage(text: bytes, rng: np.random.Generator) -> bytes:
    words = text.split(b" ")
    n = int(rng.integers(1, 15))
    at = int(rng.integers(max(1, len(words) - n)))
    return b" ".join(words[at : at + n])


def fit(rows: list[tuple[int, bytes]], epochs: int = 15, batch: int = 16, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Model:
    """Of (label, text); Adam over mini-batches with a falling rate.  The same rows in any order give the same model."""
    rows = sorted(rows)
    ones = sum(y for y, _ in rows)
    if ones in (0, len(rows)):
        return Model(None, (ones + 1) / (len(rows) + 2))
    rng = np.random.default_rng(seed)
    shapes = [(256, VECTOR), (WIDTH, VECTOR, FILTERS), (FILTERS,), (3 * FILTERS + 1, HIDDEN), (HIDDEN,), (HIDDEN,), ()]
    spread = [0.5, 1 / np.sqrt(WIDTH * VECTOR), 0, 1 / np.sqrt(3 * FILTERS), 0, 1 / np.sqrt(HIDDEN), 0]
    model = Model([np.asarray(rng.normal(size=s) * r) for s, r in zip(shapes, spread, strict=True)])
    m, v = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    steps, total = 0, epochs * -(-len(rows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(rows), batch):
            own = [rows[i] for i in order[k : k + batch]]
            data, bounds = _padded([_passage(t, rng) if y and rng.random() < 0.1 else t for y, t in own])
            steps += 1
            for i, g in enumerate(_gradients(data, bounds, np.array([y for y, _ in own], dtype=np.float64), model)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                step = m[i] / (1 - 0.9**steps) / (np.sqrt(v[i] / (1 - 0.99**steps)) + 1e-8)
                model.parts[i] = model.parts[i] - rate * (1 - 0.9 * steps / total) * (step + decay * model.parts[i])
    return model


def sample(docs: DataFrame, labels: DataFrame, sample_docs: int = 400) -> list[tuple[int, bytes]]:
    """(label, text) of about ``sample_docs`` documents of each class, chosen by a hash of the id; ``labels``: doc_id, label."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.coalesce(*[F.when(F.col("label") == y, F.lit(round(1_000_000 * min(1.0, sample_docs / n)))) for y, n in counts.items()], F.lit(0))
    chosen = known.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1_000_000)) < share)
    chosen = chosen.orderBy(F.xxhash64("doc_id", "label")).limit(3 * sample_docs)  # so it can be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    found = texts.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id", "label", "text")).limit(3 * sample_docs)
    return [(r["label"], r["text"].encode()) for r in found.select("label", "text").collect()]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, the probability of label 1, of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for i, j, data, bounds in text_slices(batch.column(1), SCORE_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(scorer.scores(data, bounds))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, score double")
