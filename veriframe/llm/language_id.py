"""Language identification by prediction by partial matching over bytes.

Every language has a variable-order context tree: for each context of up to ``order`` bytes the counts of the bytes that
followed it.  A byte costs -log2(count / (total + distinct)) in the longest context that has been seen with it; contexts
without it cost an escape of -log2(distinct / (total + distinct)) each (method C, without exclusions), and below order 0
all 256 bytes are equal.  Statistics are frozen after fitting, so a text's code length is the sum over its bytes, and the
language with the shortest code wins.  Because a byte's cost depends on at most ``order`` + 1 bytes, the costs of all
seen sequences are worked out once for all languages, and a text is scored by table look-ups.

Fitting takes a bounded sample: about ``sample_docs`` labelled rows of each language, chosen by a hash of the id (a
documented parameter, since this is a classifier).  Prediction reads the text only, all of it.

Defined cases: text that is null or without letters gives ``und`` with score 0; without training rows everything is
``und``; ties go to the first language by name; repeated rows are predicted each; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, text_slices, worker_keeps

UNDETERMINED = "und"


@dataclass
class Model:
    """Level k has the byte sequences of length k + 1 that occurred: their keys in order (first byte highest), the cost
    of their last byte after the others for each language, and the escape cost of the sequence as a context."""

    languages: list[str]
    keys: list[np.ndarray]
    cost: list[np.ndarray]
    escape: list[np.ndarray]


def fit(texts: list[tuple[str, bytes]], order: int = 4) -> Model:
    """From (language, bytes of a text)."""
    languages = sorted({name for name, _ in texts})
    number = {name: k for k, name in enumerate(languages)}
    kept = [(number[name], raw) for name, raw in texts if raw]
    data = np.frombuffer(b"".join(raw for _, raw in kept), dtype=np.uint8).astype(np.uint64)
    lengths = np.array([len(raw) for _, raw in kept], dtype=np.int64)
    lang = np.repeat(np.array([k for k, _ in kept], dtype=np.int8), lengths)
    since = (np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)  # bytes of the text before this one
    m = len(languages)
    keys, counts, found = [], [], []
    gram = np.zeros(len(data), dtype=np.uint64)
    for k in range(order + 1):
        gram = data.copy() if k == 0 else (np.concatenate([np.zeros(1, np.uint64), gram[:-1]]) << np.uint64(8)) | data
        # one language at a time, as the driver has little memory
        each = [np.unique(gram[(since >= k) & (lang == x)], return_counts=True) for x in range(m)]
        unique = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *[u for u, _ in each]]))
        c = np.zeros((len(unique), m))
        for x, (u, n) in enumerate(each):
            c[np.searchsorted(unique, u), x] = n
        keys.append(unique), counts.append(c)
    for k in range(order + 1):
        # the sequences of level k are the contexts of level k + 1
        c = counts[k]
        parent = np.searchsorted(keys[k - 1], keys[k] >> np.uint64(8)) if k else np.zeros(len(keys[0]), dtype=np.int64)
        total, distinct = np.zeros((max(1, len(keys[k - 1]) if k else 1), m)), np.zeros((max(1, len(keys[k - 1]) if k else 1), m))
        np.add.at(total, parent, c)
        np.add.at(distinct, parent, c > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(distinct > 0, -np.log2(distinct / (total + distinct)), 0.0)
            direct = -np.log2(c / (total + distinct)[parent])
        shorter = found[-1][0][np.searchsorted(keys[k - 1], keys[k] & np.uint64((1 << (8 * k)) - 1))] if k else np.full((len(keys[0]), m), 8.0)
        found.append((np.where(c > 0, direct, shorter + escape[parent]), escape))
    return Model(languages, keys, [x[0].astype(np.float32) for x in found], [x[1].astype(np.float32) for x in found])


class Scorer:
    """Look-up tables of a model: from a seen sequence and the next byte to the longer sequence; 0 is none."""

    def __init__(self, model: Model):
        self.model, self.next = model, []
        for k, keys in enumerate(model.keys):
            parent = np.searchsorted(model.keys[k - 1], keys >> np.uint64(8)) + 1 if k else np.zeros(len(keys), dtype=np.int64)
            t = np.zeros(((len(model.keys[k - 1]) + 1 if k else 1) * 256), dtype=np.int32)
            t[parent * 256 + (keys & np.uint64(255)).astype(np.int64)] = np.arange(1, len(keys) + 1)
            self.next.append(t)

    def bits(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Code lengths of texts laid end to end (row) in each language (column)."""
        out = np.zeros((len(bounds) - 1, len(self.model.languages)))
        full = bounds[1:] > bounds[:-1]
        if not full.any() or not self.model.languages:
            return out
        starts = bounds[:-1][full]
        b = data.astype(np.int64)
        ids = []
        for k, t in enumerate(self.next):
            before = np.zeros(len(b), dtype=np.int64)
            if k:
                before[1:] = ids[-1][:-1]
                before[starts] = 0
                known = t[before * 256 + b]
                known[before == 0] = 0
            else:
                known = t[b]
            ids.append(known)
        costs = np.empty((len(b), len(self.model.languages)), dtype=np.float32)
        costs[:] = self.model.cost[-1][np.maximum(ids[-1] - 1, 0)]
        todo = np.flatnonzero(ids[-1] == 0)
        if len(todo):
            costs[todo] = 0
        for k in range(len(ids) - 2, -1, -1):
            if not len(todo):
                break
            # the context of level k + 1 ends just before, if it has been seen at all
            at = np.maximum(todo - 1, 0)
            context = np.where(np.isin(todo, starts), 0, ids[k][at])
            seen = context > 0
            costs[todo[seen]] += self.model.escape[k + 1][context[seen] - 1]
            hit = ids[k][todo] > 0
            costs[todo[hit]] += self.model.cost[k][ids[k][todo[hit]] - 1]
            todo = todo[~hit]
        if len(todo):
            costs[todo] += 8.0 + self.model.escape[0][0]
        out[full] = np.add.reduceat(costs, starts, axis=0, dtype=np.float64)
        return out


def sample(docs: DataFrame, sample_docs: int) -> list[tuple[str, bytes]]:
    """About ``sample_docs`` rows of each language, chosen by a hash of the id; (language, bytes)."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    counts = {r["lang"]: r["n"] for r in docs.where(F.col("lang").isNotNull()).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    share = F.lit(0)
    for name, n in counts.items():
        share = F.when(F.col("lang") == name, F.lit(round(1_000_000 * min(1.0, sample_docs / n)))).otherwise(share)
    chosen = labelled.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1_000_000)) < share)
    return [(r["lang"], r["text"].encode()) for r in chosen.select("doc_id", "lang", "text").orderBy(F.xxhash64("doc_id")).limit(2 * sample_docs * len(counts)).select("lang", "text").collect()]


#: Bytes that are scored at once.
SCORE_BYTES = 1 << 19


def predict(docs: DataFrame, model: Model, carry: str = "doc_id") -> DataFrame:
    """The column ``carry`` (doc_id, or a struct that holds the text), lang_pred, score (the winner's posterior under equal priors) and bits_per_byte of the
    winner's code."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    own = uuid.uuid4().hex
    nested = carry != "doc_id"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer, names = worker_keeps(own, lambda: Scorer(m)), np.array([*m.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            text = batch.column(0).field("text") if nested else batch.column(2)
            for i, j, data, bounds in text_slices(text, SCORE_BYTES):
                letters = np.asarray(batch.column(1).slice(i, j - i)) & bool(m.languages)
                size = np.maximum(np.diff(bounds), 1)
                if m.languages:
                    bits = scorer.bits(data, bounds)
                    best = bits.argmin(axis=1)
                    least = bits[np.arange(len(best)), best]
                    score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
                else:
                    best, least, score = np.zeros(j - i, dtype=np.int64), np.zeros(j - i), np.zeros(j - i)
                best = np.where(letters, best, len(m.languages))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(names[best].tolist(), pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(np.where(letters, least / size, 0.0))],
                    [carry, "lang_pred", "score", "bits_per_byte"],
                )

    kind = docs.schema[carry].dataType.simpleString()
    text = F.col(f"{carry}.text") if nested else F.col("text")
    read = docs.select(carry, F.coalesce(text.rlike("\\p{L}"), F.lit(False)).alias("_letters"), *([] if nested else ["text"]))
    return read.mapInArrow(lean(run), f"`{carry}` {kind}, lang_pred string, score double, bits_per_byte double")


def identify(docs: DataFrame, training: DataFrame | None = None, order: int = 4, sample_docs: int = 300) -> DataFrame:
    """Fits on a sample of ``training`` (doc_id, text, lang; ``docs`` if none) and predicts ``docs``."""
    return predict(docs, fit(sample(docs if training is None else training, sample_docs), order))


def keep_known(docs: DataFrame, model: Model, max_bits_per_byte: float = 7.0) -> DataFrame:
    """The rows of ``docs`` in a learned language: neither ``und`` nor with a code length near that of random bytes."""
    rows = predict(docs.select(F.struct("*").alias("row")), model, carry="row")
    return rows.where((F.col("lang_pred") != UNDETERMINED) & (F.col("bits_per_byte") <= max_bits_per_byte)).select("row.*")
