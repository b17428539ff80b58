"""Runs of words that repeat with a period.

A run is a stretch of consecutive words with smallest period q (words q apart are the same) of at least ``min_words`` and
``repeats`` * q words that no neighbouring word extends.  A run of period p agrees with itself p words on over a stretch of
at least (``repeats`` - 1) * p words, so that stretch holds a multiple of (``repeats`` - 1) * p: a grid whose points for
all periods add up harmonically, n log n of them in a text of n words.  For all pairs of a period and a grid point at once,
binary search over prefix hashes finds how far the text agrees with itself to both sides.  What is long enough is verified
on the words themselves (where a hash misled, the text is searched word by word for that period), and equal stretches become one
run with the smallest period that found them; by the periodicity lemma that one divides the others.

Everything happens within a text, many texts at a time in a task; nothing is shuffled.

Defined cases: a null text has no words; a row without id keeps its words as they are; without a run the four columns of
the longest one are null and both digests are of what is there; repeated rows are judged each; an empty table gives an
empty result; columns of other names are neither read nor returned.  Pairs of a very long text are worked off in blocks.
"""

from __future__ import annotations

import binascii
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, interval_hashes, lean, text_slices

#: Pairs of a period and a grid point at once.
PAIRS = 1 << 20
#: Bytes of texts at once.
SLICE = 1 << 19

Run = tuple[int, int, int]


def _pairs(n: np.ndarray, min_words: int, repeats: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, period and grid point of all pairs of texts of ``n`` words, in blocks."""
    most = np.where(n >= min_words, n // repeats, 0)
    text = np.repeat(np.arange(len(n)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    step = (repeats - 1) * period
    count = (n[text] - period - 1) // step + 1
    total = np.cumsum(count)
    at = 0
    while at < len(text):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
        own = count[at:end]
        k = np.repeat(np.arange(at, end), own)
        point = (np.arange(len(k)) - np.repeat(np.cumsum(own) - own, own)) * step[k]
        yield text[k], period[k], point
        at = end


def _agree(equal, most: np.ndarray) -> np.ndarray:
    """The largest m up to ``most`` with equal(indexes, m), by binary search for all at once."""
    low, high = np.zeros_like(most), most.copy()
    todo = np.flatnonzero(low < high)
    while len(todo):
        mid = (low[todo] + high[todo] + 1) >> 1
        ok = equal(todo, mid)
        low[todo[ok]] = mid[ok]
        high[todo[~ok]] = mid[~ok] - 1
        todo = todo[low[todo] < high[todo]]
    return low


def _whole(words: list, start: int, end: int, period: int) -> bool:
    return words[start : end - period] == words[start + period : end]


def _stretches(words: list, period: int, least: int) -> Iterator[tuple[int, int]]:
    """All stretches with the period of at least so many words, word by word."""
    start = 0
    for i in range(period, len(words) + 1):
        if i == len(words) or words[i] != words[i - period]:
            if i - start >= least:
                yield start, i
            start = i - period + 1


def find_runs(texts: list[list], hashes: np.ndarray, min_words: int = 6, repeats: int = 4) -> list[list[Run]]:
    """(start, length, period) of the runs of each text, by start and period; ``hashes``: of all words, laid end to end."""
    n = np.array([len(t) for t in texts], dtype=np.int64)
    first = np.cumsum(n) - n
    hash_of = interval_hashes(hashes)
    found: list[dict[tuple[int, int], int]] = [{} for _ in texts]
    for text, period, point in _pairs(n, min_words, repeats):
        here = first[text] + point
        ok = hashes[here] == hashes[here + period]
        text, period, point, here = text[ok], period[ok], point[ok], here[ok]
        there = here + period
        after = _agree(lambda k, m: hash_of(here[k], m) == hash_of(there[k], m), n[text] - point - period)
        before = _agree(lambda k, m: hash_of(here[k] - m, m) == hash_of(there[k] - m, m), point)
        long = np.flatnonzero(before + after + period >= np.maximum(min_words, repeats * period))
        if not len(long):
            continue
        rows = np.unique(np.stack([text[long], (point - before)[long], (point + period + after)[long], period[long]]), axis=1)
        misled = set()
        for t, start, end, p in rows.T.tolist():
            if (start, end) in found[t]:  # by a smaller period, as they come in order
                continue
            if _whole(texts[t], start, end, p):
                found[t][start, end] = p
            else:
                misled.add((t, p))
        for t, p in misled:
            for stretch in _stretches(texts[t], p, max(min_words, repeats * p)):
                found[t][stretch] = min(p, found[t].get(stretch, p))
    return [sorted((s, e - s, p) for (s, e), p in runs.items()) for runs in found]


def kept_words(words: list, runs: list[Run]) -> list:
    """The words that no run holds after its first period."""
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g] if runs else words


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which word stands in each place of a text of ``n`` words whose tail the contract makes periodic; None if it doesn't."""
    if doc_id is None or not n:
        return None
    h = binascii.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def _texts(ids: list, data: np.ndarray, bounds: np.ndarray, plant: bool) -> tuple[list[list[bytes]], np.ndarray]:
    """Words of each text and the hashes of all."""
    texts = [data[a:b].tobytes().split() for a, b in zip(bounds, bounds[1:])]
    hashes, doc, _, _ = hash_words(data, bounds, fold=False)
    if plant:
        order = []
        for k, (i, words) in enumerate(zip(ids, texts)):
            own = planted(i, len(words))
            if own is not None:
                texts[k] = [words[x] for x in own]
                order.append((int(np.searchsorted(doc, k)), own))
        if order:
            take = np.arange(len(hashes))
            for at, own in order:
                take[at : at + len(own)] = at + own
            hashes = hashes[take]
    return texts, hashes


def judge(docs: DataFrame, min_words: int = 6, repeats: int = 4, plant: bool = False, carry: str = "doc_id") -> DataFrame:
    """The column ``carry`` (doc_id, or a struct that holds doc_id and text), n_runs, start, length, period and
    exponent_milli of the longest run (of equally long ones the first, then the smallest period), runs (an array of start,
    length, period), collapsed (the words that stay, joined by one space) and the SHA-256 of both as text.  ``plant``:
    first make the tails periodic that planted() names."""
    nested = carry != "doc_id"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, text = (batch.column(0).field("doc_id"), batch.column(0).field("text")) if nested else (batch.column(0), batch.column(1))
            for i, j, data, bounds in text_slices(text, SLICE):
                texts, hashes = _texts(own.slice(i, j - i).to_pylist(), data, bounds, plant)
                runs = find_runs(texts, hashes, min_words, repeats)
                best = [max(r, key=lambda x: (x[1], -x[0], -x[2])) if r else (None, None, None) for r in runs]
                collapsed = [b" ".join(kept_words(w, r)) for w, r in zip(texts, runs)]
                columns = [
                    batch.column(0).slice(i, j - i),
                    pa.array([len(r) for r in runs], pa.int64()),
                    *[pa.array([b[k] for b in best], pa.int64()) for k in range(3)],
                    pa.array([None if b[0] is None else 1000 * b[1] // b[2] for b in best], pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), x, strict=True)) for x in r] for r in runs], RUNS),
                    pa.array(collapsed, pa.binary()).cast(pa.string()),
                    pa.array([hashlib.sha256("".join("%d,%d,%d\n" % x for x in r).encode()).hexdigest() for r in runs], pa.string()),
                    pa.array([hashlib.sha256(c).hexdigest() for c in collapsed], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [carry, *NAMES])

    kind = docs.schema[carry].dataType.simpleString()
    return docs.select(*dict.fromkeys([carry] if nested else ["doc_id", "text"])).mapInArrow(lean(run), f"`{carry}` {kind}, {COLUMNS}")


RUNS = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
NAMES = ["n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed", "runs_sha256", "collapsed_sha256"]
COLUMNS = "n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start: long, length: long, period: long>>, collapsed string, runs_sha256 string, collapsed_sha256 string"


def collapse(docs: DataFrame, min_words: int = 6, repeats: int = 4) -> DataFrame:
    """The rows of ``docs``, each text with a run without what the run repeats; other texts as they are."""
    found = judge(docs.select(F.struct("*").alias("row")), min_words, repeats, carry="row")
    text = F.when(F.col("n_runs") > 0, F.col("collapsed")).otherwise(F.col("row.text"))
    return found.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
