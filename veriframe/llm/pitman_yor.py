"""Language-model scores by a hierarchical Pitman-Yor model of words in context.

Every word that stands before another one has a restaurant: its customers are the tokens that follow it, its dishes the
words.  New tables of these restaurants are the customers of one restaurant of words, which all contexts share as
parent.  A new table there orders its dish from the spelling restaurants: a word is its bytes and a stop, each served in
the restaurant of the bytes before it; that restaurant's new tables order from the one with a shorter context, up to one
without context and a uniform base.  A spelling context is up to three bytes in 32 classes (the low five bits, which
tell lower-case letters apart), so there are at most 32768 restaurants of 257 dishes on its longest level: that table
has a fixed bound and is what the driver and the broadcasts hold.  Words and pairs of words stay in tables, dealt by
hash, and grow with the corpus.

Seating is sampled by Gibbs sweeps.  A move takes all customers of a dish in a restaurant out, with their tables and these
tables' customers in the parent, and seats them anew: the number of tables is drawn from its exact distribution given all
other customers, which sums over all seatings with so many tables (generalized Stirling numbers).  Moves of one level
are made side by side from the sweep before, so a restaurant of any size is dealt over all tasks.  The random numbers are hashes of dish,
restaurant and sweep: partitions, batches and repeated tasks don't change the result.  Of a
dish with more than 128 customers these sit down first, exactly; the others follow in groups of 1/64 of those already
seated, and a group's expected number of new tables is rounded at random.  A dish
with one customer has one table, always; pairs of words that came once only need no sampling and are kept as hashes.  A
sweep's predictive probabilities are averaged over the sweeps after the first ``burn_in``; the log of the average is the
score.  Discounts are estimated on each level from the dishes with one and with two customers.

A token is a word, with A-Z lower-cased, or the end of the text, which is the empty word; the first word's context is
the end of a text.  A word without training tokens has the probability of its spelling.  So in every context the
probabilities of all words sum to one.

Defined cases: null text counts as empty and is one end token; without training documents every word has its base
spelling probability; repeated rows are counted and scored each; an empty table gives an empty result; two words count
as one only if their 64-bit hashes are equal, two pairs if their 56-bit hashes are.
"""

from __future__ import annotations

import functools
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import as_long, discard, distinct_values, hash_words, lean, lean_group, materialize, mix64, release, text_slices

STOP, SYMBOLS, CLASS_BITS, LEVELS = 256, 257, 5, 4
#: The hash of the empty word, which ends a text.
END = np.uint64(0)
#: Tokens that a task counts before it hands the counts on.
BLOCK_TOKENS = 1_500_000
#: Text bytes of a part of the tables and of a bucket of documents, about.
PART_BYTES = 4 << 20


@dataclass
class Spelling:
    """Predictive probabilities on the longest level: a row for each restaurant with customers, and for every context
    the row that serves it; contexts without customers are served by the nearest shorter one."""

    row: np.ndarray
    table: np.ndarray


def _uniform(key: np.ndarray, sweep: int, draw: int) -> np.ndarray:
    """From 0 to 1, by hash."""
    return (mix64(key ^ mix64(np.array([sweep << 32 | draw], dtype=np.uint64))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


#: Customers of a dish up to which its tables are drawn from their exact conditional distribution.
EXACT = 128


@functools.lru_cache(8)
def _ways(discount: float) -> np.ndarray:
    """[n, t]: log weight of all ways to seat n customers at t tables, a table of m weighing (1 - d) (2 - d) ... (m - 1 - d)."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(EXACT + 1)
    for n in range(EXACT):
        with np.errstate(divide="ignore", invalid="ignore"):
            joined = out[n] + np.log(np.maximum(n - discount * t, 0.0))
        out[n + 1] = np.logaddexp(np.where(np.isnan(joined), -np.inf, joined), np.concatenate([[-np.inf], out[n, :-1]]))
    return out


def seat(customers: np.ndarray, before: np.ndarray, seated: np.ndarray, share: np.ndarray, concentration: float, discount: float, key: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of each dish, reseated: all its customers leave their ``before`` tables of the restaurant's ``seated`` ones
    and sit down again, a new table weighing (concentration + discount * tables) * ``share``, one with m customers
    m - discount.  Summed over the seatings with t tables this gives t's distribution, from which one is drawn.
    ``share``: the parent's, without the dish's own tables; ``key``: 64-bit hash of restaurant and dish."""
    tables = np.minimum(customers, 1).astype(np.int64)
    others = np.maximum(np.asarray(seated, dtype=np.float64) - before, 0.0) * np.ones(len(customers))
    share = np.maximum(share, 1e-300) * np.ones(len(customers))
    drawn = _uniform(key, sweep, 0)
    ways, few = _ways(round(float(discount), 6)), np.minimum(customers, EXACT)
    order = np.flatnonzero(customers > 1)
    order = order[np.argsort(few[order], kind="stable")]
    sizes, starts = np.unique(few[order], return_index=True)
    ends = np.searchsorted(few[order], sizes, side="right")
    for n, i, j in zip(sizes.tolist(), starts.tolist(), ends.tolist(), strict=True):
        for k in range(i, j, max(1, (1 << 21) // n)):
            own = order[k : min(j, k + max(1, (1 << 21) // n))]
            new = np.log((concentration + discount * (others[own, None] + np.arange(n))) * share[own, None])
            weight = ways[n, 1 : n + 1] + np.cumsum(new, axis=1)
            chance = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            tables[own] = 1 + (chance < drawn[own, None] * chance[:, -1:]).sum(axis=1)
    order = np.flatnonzero(customers > EXACT)
    order = order[np.argsort(-customers[order], kind="stable")]
    counts, t, j = customers[order], tables[order], EXACT
    while True:
        active = int(np.searchsorted(-counts, -j, side="left"))  # those with more than j customers
        if not active:
            break
        step = np.minimum(max(1, j // 64), counts[:active] - j)
        alpha = (concentration + discount * (others[order[:active]] + t[:active])) * share[order[:active]]
        p = alpha / (alpha + np.maximum(j - discount * t[:active], 1e-9))
        t[:active] += (step * p + _uniform(key[order[:active]], sweep, j)).astype(np.int64)
        j += max(1, j // 64)
    tables[order] = np.minimum(t, counts)
    return tables


def without_own(share: np.ndarray, mass: np.ndarray, own: np.ndarray, whole: float | np.ndarray) -> np.ndarray:
    """A parent's predictive probability of a dish without ``own`` of its customers.  ``mass``: what a customer of it adds
    to the numerator on average, (customers - discount * tables) / customers; ``whole``: the denominator."""
    return (share * whole - mass * own) / np.maximum(whole - own, 1e-9)


def fit_spelling(context: np.ndarray, symbol: np.ndarray, customers: np.ndarray, seed: int, sweeps: int = 2, discount: float = 0.6, concentration: float = 1.0) -> Spelling:
    """From customers of the longest level, by context and symbol."""
    ids, rows = [None] * LEVELS, [None] * LEVELS
    contexts = np.unique(context) if len(context) else np.zeros(1, dtype=np.int64)
    for k in range(LEVELS - 1, -1, -1):
        ids[k] = contexts
        shorter = np.unique(contexts & ((1 << (CLASS_BITS * max(k - 1, 0))) - 1)) if k else contexts
        rows[k] = np.searchsorted(shorter, contexts & ((1 << (CLASS_BITS * (k - 1))) - 1)) if k else np.zeros(1, dtype=np.int64)
        contexts = shorter
    counts = [np.zeros((len(i), SYMBOLS), dtype=np.int64) for i in ids]
    np.add.at(counts[-1], (np.searchsorted(ids[-1], context), symbol), customers)
    tables = [None] * LEVELS
    base = np.full((1, SYMBOLS), 1 / SYMBOLS)

    def predictive() -> list[np.ndarray]:
        out, parent = [], base
        for k in range(LEVELS):
            total, seated = counts[k].sum(axis=1, keepdims=True), tables[k].sum(axis=1, keepdims=True)
            parent = (counts[k] - discount * tables[k] + (concentration + discount * seated) * parent[rows[k]]) / (concentration + total)
            out.append(parent)
        return out

    for sweep in range(sweeps + 1):
        above, held = (predictive() if sweep else None), [c.copy() if c is not None else None for c in counts]
        for k in range(LEVELS - 1, -1, -1):
            if sweep:
                parent, before = (above[k - 1] if k else base)[rows[k]], np.minimum(tables[k], counts[k])
                if k:
                    mass = (held[k - 1] - discount * tables[k - 1]) / np.maximum(held[k - 1], 1)
                    parent = without_own(parent, mass[rows[k]], tables[k], concentration + held[k - 1].sum(axis=1, keepdims=True)[rows[k]])
                seated = np.broadcast_to(before.sum(axis=1, keepdims=True), counts[k].shape)
                cells = ids[k].astype(np.uint64)[:, None] * np.uint64(SYMBOLS) + np.arange(SYMBOLS, dtype=np.uint64)
                tables[k] = seat(*(x.ravel() for x in (counts[k], before, seated, parent)), concentration, discount, cells.ravel(), seed * 1000 + sweep * LEVELS + k).reshape(counts[k].shape)
            else:
                tables[k] = np.minimum(counts[k], 1)
            if k:
                counts[k - 1] = np.zeros_like(counts[k - 1])
                np.add.at(counts[k - 1], rows[k], tables[k])
    found = predictive()
    row = np.zeros(1 << (CLASS_BITS * (LEVELS - 1)), dtype=np.int32)
    stacked, first, every = [], 0, np.arange(len(row))
    for k in range(LEVELS):
        short = every & ((1 << (CLASS_BITS * k)) - 1)
        at = np.minimum(np.searchsorted(ids[k], short), len(ids[k]) - 1)
        row = np.where(ids[k][at] == short, first + at, row).astype(np.int32)
        stacked.append(found[k])
        first += len(ids[k])
    used, row = np.unique(row, return_inverse=True)
    return Spelling(row.astype(np.int32), np.concatenate(stacked)[used].astype(np.float32))


def spell(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context and symbol of every byte and stop, and where each word begins."""
    lengths = np.array([len(w) for w in words], dtype=np.int64) + 1
    starts = np.cumsum(lengths) - lengths
    symbol = np.zeros(int(lengths.sum()), dtype=np.int64)
    stops = starts + lengths - 1
    inside = np.ones(len(symbol), dtype=bool)
    inside[stops] = False
    symbol[inside] = np.frombuffer(b"".join(words), dtype=np.uint8)
    symbol[stops] = STOP
    since = np.arange(len(symbol)) - np.repeat(starts, lengths)
    context = np.zeros(len(symbol), dtype=np.int64)
    for k in range(1, LEVELS):
        before = np.zeros(len(symbol), dtype=np.int64)
        before[k:] = symbol[:-k] & 31
        context |= np.where(since >= k, before, 0) << (CLASS_BITS * (k - 1))
    return context, symbol, starts


def spelling_probability(model: Spelling, words: list[bytes]) -> np.ndarray:
    if not words:
        return np.zeros(0)
    context, symbol, starts = spell(words)
    return np.exp(np.maximum(np.add.reduceat(np.log(model.table[model.row[context], symbol].astype(np.float64)), starts), -700))


def packed(**columns: np.ndarray) -> bytes:
    """Arrays in little room: their bytes by place, compressed."""
    planes = {name: (x.dtype.str, np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()) for name, x in columns.items()}
    raw = pickle.dumps(planes, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    raw = pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    out = {}
    for name, (kind, planes) in pickle.loads(raw).items():
        dtype = np.dtype(kind)
        flat = np.frombuffer(planes, dtype=np.uint8) if planes else np.zeros(0, dtype=np.uint8)
        out[name] = np.ascontiguousarray(flat.reshape(dtype.itemsize, -1).T).reshape(-1).view(dtype)
    return out


def unpack_all(column: pa.ChunkedArray) -> dict[str, np.ndarray]:
    """The arrays of several packed rows, end to end."""
    found = [unpacked(x) for x in column.to_pylist()]
    return {name: np.concatenate([f[name] for f in found]) for name in found[0]} if found else {}


def pair(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of pairs, 56 bits in the upper part: an eighth less room where they are kept and sent."""
    return mix64(mix64(context + np.uint64(0x632BE59BD9B4E019)) + word) & ~np.uint64(255)


def part(key: np.ndarray, parts: int) -> np.ndarray:
    """Parts are ranges of the hash, so they are slices of sorted keys."""
    return ((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _slices(key: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """The parts of sorted keys."""
    p = part(key, parts)
    starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else []
    for s, e in zip(starts, [*starts[1:], len(p)], strict=True):
        yield int(p[s]), slice(int(s), int(e))


def tokens_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens of several texts with their ends, how many each text has, and each token's bytes."""
    words, doc, start, stop = hash_words(data, bounds)
    rows = len(bounds) - 1
    n = np.bincount(doc, minlength=rows) + 1
    place = np.arange(len(words)) + doc
    token, first, last = np.full(len(words) + rows, END), *np.zeros((2, len(words) + rows), dtype=np.int64)
    token[place], first[place], last[place] = words, start, stop
    return token, n, first, last


def contexts_of(token: np.ndarray) -> np.ndarray:
    """The token before each one; texts lie end to end, so it's an end before a text's first."""
    return np.concatenate([np.array([END]), token[:-1]])


def word_bytes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """Lower-cased words as a binary column."""
    length = last - first
    ends = np.cumsum(length)
    at = np.repeat(first - ends + length, length) + np.arange(int(length.sum()))
    own = data[at]
    own = np.where((own >= 65) & (own <= 90), own + 32, own).astype(np.uint8)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(own.tobytes())])


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sorted distinct keys, the place of one of each, and sums of the values."""
    order = np.argsort(key)
    key = key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    return key[starts], order[starts], [np.add.reduceat(v[order], starts) if len(key) else v for v in values]


def _gathered(training: DataFrame, parts: int) -> DataFrame:
    """Packed counts of a task's pairs (kind 0) and words (kind 1), by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: list[np.ndarray] = []
        words: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not tokens:
                return
            w = np.concatenate(tokens)
            v = np.concatenate([contexts_of(t) for t in tokens])
            tokens.clear()
            g, at, (c,) = _summed(pair(v, w), np.ones(len(w), dtype=np.int64))
            v, w = v[at], w[at]
            rows: list[tuple[int, int, bytes]] = []
            for p, s in _slices(g, parts):
                order = np.argsort(v[s])  # the same context in a row
                rows.append((0, p, packed(v=v[s][order], w=w[s][order], c=c[s][order].astype(np.uint32))))
            h, at, (c,) = _summed(np.concatenate([x[0] for x in words]), np.concatenate([x[1] for x in words]))
            names = pa.concat_arrays([x[2] for x in words]).take(pa.array(at))
            words.clear()
            for p, s in _slices(h, parts):
                own = names[s]
                length = np.diff(np.frombuffer(own.buffers()[1], dtype=np.int32)[own.offset : own.offset + len(own) + 1])
                raw = np.frombuffer(b"".join(own.to_pylist()), dtype=np.uint8)
                rows.append((1, p, packed(h=h[s], c=c[s], length=length.astype(np.uint32), raw=raw)))
            for k in range(0, len(rows), 16):
                kind, p, blob = zip(*rows[k : k + 16], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(p, pa.int32()), pa.array(blob, pa.binary())], ["kind", "part", "packed"])

        held = 0
        for batch in batches:
            for _, _, data, bounds in text_slices(batch.column(0)):
                token, _, first, last = tokens_of(data, bounds)
                tokens.append(token)
                h, at, (c,) = _summed(token, np.ones(len(token), dtype=np.int64))
                words.append((h, c, word_bytes(data, first[at], last[at])))
                held += len(token)
                if held > BLOCK_TOKENS:
                    yield from flush()
                    held = 0
        yield from flush()

    return training.select("text").mapInArrow(lean(run), "kind int, part int, packed binary")


def _tables(gathered: DataFrame) -> DataFrame:
    """The counts of each part, one row for each kind of content.

    kind 0: pairs with several customers (v, w, c and tables t, one each), 1: hashes of pairs with one customer, 2: what
    the latter add to words h as dishes (k) and as contexts (tables), 3: words.  n1 and n2: pairs or words with one and
    with two customers.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        kind, p = key[0].as_py(), key[1].as_py()
        x = unpack_all(rows.column("packed"))
        out: list[tuple[int, bytes, int, int, int, int]] = []
        if kind == 0:
            _, at, (c,) = _summed(pair(x["v"], x["w"]), x["c"].astype(np.int64))
            v, w = x["v"][at], x["w"][at]
            many, once = np.flatnonzero(c > 1), np.flatnonzero(c == 1)
            many = many[np.argsort(v[many])]
            out.append((0, packed(v=v[many], w=w[many], c=c[many], t=np.ones(len(many), dtype=np.uint32)), len(once), int((c == 2).sum()), 0, 0))
            out.append((1, packed(g=pair(v[once], w[once])), 0, 0, 0, 0))
            ones, none = np.ones(len(once), dtype=np.int64), np.zeros(len(once), dtype=np.int64)
            h, _, (k, tables) = _summed(np.concatenate([w[once], v[once]]), np.concatenate([ones, none]), np.concatenate([none, ones]))
            out.append((2, packed(h=h, k=k.astype(np.uint32), tables=tables.astype(np.uint32)), 0, 0, 0, 0))
        else:
            h, at, (c,) = _summed(x["h"], x["c"])
            ends = np.cumsum(x["length"].astype(np.int64))
            length = x["length"][at].astype(np.int64)
            of = np.repeat(ends[at] - np.cumsum(length), length) + np.arange(int(length.sum()))
            out.append((3, packed(h=h, c=c, length=length.astype(np.uint32), raw=x["raw"][of]), 0, 0, int(c.sum()), len(h)))
        names = ["kind", "packed", "n1", "n2", "tokens", "words"]
        table = pa.table(dict(zip(names, map(pa.array, zip(*out, strict=True)), strict=True)))
        return table.append_column("part", pa.array([p] * len(out), pa.int32())).cast(pa.schema([("kind", pa.int32()), ("packed", pa.binary()), ("n1", pa.int64()), ("n2", pa.int64()), ("tokens", pa.int64()), ("words", pa.int64()), ("part", pa.int32())]))

    return gathered.groupBy("kind", "part").applyInArrow(lean_group(run), "kind int, packed binary, n1 long, n2 long, tokens long, words long, part int")


def _words(tables: DataFrame) -> DataFrame:
    """h, word and c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in map(unpacked, batch.column(0).to_pylist()):
                offsets = np.concatenate([[0], np.cumsum(x["length"])]).astype(np.int32)
                word = pa.Array.from_buffers(pa.binary(), len(x["h"]), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(x["raw"].tobytes())])
                whole = pa.RecordBatch.from_arrays([pa.array(as_long(x["h"])), word, pa.array(x["c"])], ["h", "word", "c"])
                for k in range(0, len(whole), 50_000):
                    yield whole.slice(k, 50_000)

    return tables.where("kind = 3").select("packed").mapInArrow(lean(run), "h long, word binary, c long")


def _tables_of_words(pairs: DataFrame, fixed: bool) -> DataFrame:
    """h with k and tables: the tables at which it is the dish, and those in its own restaurant. ``fixed``: from the
    packed sums of pairs with one customer, else from pairs that are seated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in map(unpacked, batch.column(0).to_pylist()):
                if fixed:
                    h, k, tables = x["h"], x["k"], x["tables"]
                else:
                    t = x["t"].astype(np.int64)
                    none = np.zeros(len(t), dtype=np.int64)
                    h, _, (k, tables) = _summed(np.concatenate([x["w"], x["v"]]), np.concatenate([t, none]), np.concatenate([none, t]))
                whole = pa.RecordBatch.from_arrays([pa.array(as_long(h)), pa.array(k.astype(np.int64)), pa.array(tables.astype(np.int64))], ["h", "k", "tables"])
                for s in range(0, len(whole), 100_000):
                    yield whole.slice(s, 100_000)

    return pairs.select("packed").mapInArrow(lean(run), "h long, k long, tables long").groupBy("h").agg(F.sum("k").alias("k"), F.sum("tables").alias("tables"))


@dataclass
class Totals:
    """Of a kept sweep: ``discount``, ``customers`` and ``tables`` of the restaurant of words, and the spelling."""

    tokens: int
    words: int
    pair_discount: float
    discount: list[float]
    customers: list[int]
    tables: list[int]
    spelling: list[Spelling]
    pair_concentration: float = 1.0
    concentration: float = 10.0

    def last(self) -> Totals:
        """With the last sweep only."""
        return replace(self, **{name: getattr(self, name)[-1:] for name in ("discount", "customers", "tables", "spelling")})

    def word_share(self, k: int, customers: np.ndarray, tables: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """Predictive probability in the restaurant of words, in sweep ``k``."""
        new = self.concentration + self.discount[k] * self.tables[k]
        return (customers - self.discount[k] * tables + new * spelled) / (self.concentration + self.customers[k])


def _discount(n1: int, n2: int) -> float:
    return min(0.95, max(0.05, n1 / max(1, n1 + 2 * n2)))


def _spelling_counts(words: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Customers of the longest spelling level; at most 32768 * 257 of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            words = batch.column(0).to_pylist()
            if not words:
                continue
            context, symbol, starts = spell(words)
            weight = np.repeat(np.asarray(batch.column(1)), np.diff(np.append(starts, len(symbol))))
            own, at = np.unique(np.concatenate([keys, context * SYMBOLS + symbol]), return_inverse=True)
            sums = np.bincount(at, weights=np.concatenate([sums, weight]), minlength=len(own)).astype(np.int64)
            keys = own
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], ["key", "n"])

    rows = words.select("word", "tables").mapInArrow(lean(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    rows = rows.sort_values("key")
    key = rows["key"].to_numpy(np.int64)
    return key // SYMBOLS, key % SYMBOLS, rows["n"].to_numpy(np.int64)


def _seat_words(words: DataFrame, totals: Totals, sweep: int) -> DataFrame:
    """Adds the tables of the restaurant of words, given the sweep before (one table each if there is none)."""
    shared = words.sparkSession.sparkContext.broadcast(totals.last())
    schema = words.withColumn("t", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            now, k = shared.value, np.asarray(batch.column("k"))
            if now.spelling and len(k):
                spelled = spelling_probability(now.spelling[-1], batch.column("word").to_pylist())
                # each dish has but one of some thousand tables here, and the spelling some thousand customers
                t = seat(k, np.minimum(k, 1), np.full(len(k), now.tables[-1]), spelled, now.concentration, now.discount[-1], np.asarray(batch.column("h")).view(np.uint64), sweep)
            else:
                t = np.minimum(k, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(t, pa.int64())], schema.names)

    out = materialize(words.mapInArrow(lean(run), schema), "words")
    shared.destroy()
    return out


def _word_shares(seated: DataFrame, totals: Totals, name: str) -> DataFrame:
    """Adds each word's predictive probability in the restaurant of words, in the last sweep."""
    shared = seated.sparkSession.sparkContext.broadcast(totals.last())
    schema = seated.withColumn(name, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spelled = spelling_probability(shared.value.spelling[-1], batch.column("word").to_pylist())
            share = shared.value.word_share(-1, np.asarray(batch.column("k")), np.asarray(batch.column("t")), spelled)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(share)], schema.names)

    out = materialize(seated.mapInArrow(lean(run), schema), "words")
    shared.destroy()
    return out


def _seat_pairs(pairs: DataFrame, words: DataFrame, totals: Totals, sweep: int) -> DataFrame:
    """Seats the customers of all pairs anew. ``words``: h, share, mass (see without_own) and tables of the sweep before.  The pairs' earlier
    tables stay beside them under a name for each sweep."""

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = unpacked(blob)
                h = distinct_values(np.concatenate([x["v"], x["w"]]))
                for s in range(0, len(h), 100_000):
                    own = pa.array(as_long(h[s : s + 100_000]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), p, dtype=np.int32)), own], ["part", "h"])

    known = pairs.select("part", "packed").mapInArrow(lean(wanted), "part int, h long").join(words, "h").select("part", "h", "share", "mass", "tables")
    discount, concentration = totals.pair_discount, totals.pair_concentration
    whole = totals.concentration + totals.customers[-1]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        h = np.asarray(right.column("h").combine_chunks()).view(np.uint64) if len(right) else np.zeros(0, dtype=np.uint64)
        order = np.argsort(h)
        h, share, mass, tables = h[order], *(np.asarray(right.column(c).combine_chunks())[order] if len(right) else np.zeros(0) for c in ("share", "mass", "tables"))
        for p, blob in zip(left.column("part").to_pylist(), left.column("packed").to_pylist(), strict=True):
            x = unpacked(blob)
            if len(x["c"]):
                v, w = np.searchsorted(h, x["v"]), np.searchsorted(h, x["w"])
                before = x["t"].astype(np.int64)
                parent = without_own(share[w], mass[w], before, whole)
                x[f"t{sweep - 1}"] = x["t"]
                x["t"] = seat(x["c"], before, tables[v], parent, concentration, discount, pair(x["v"], x["w"]), sweep).astype(np.uint32)
            else:
                x[f"t{sweep - 1}"] = x["t"]
            out.append((p, packed(**x)))
        return pa.table({"part": pa.array([p for p, _ in out], pa.int32()), "packed": pa.array([b for _, b in out], pa.binary())})

    return pairs.select("part", "packed").groupBy("part").cogroup(known.groupBy("part")).applyInArrow(lean_group(run), "part int, packed binary")


@dataclass
class Model:
    """``words``: h, word, c and for each kept sweep its share and the tables of its restaurant; ``pairs``: packed pairs
    with several customers and their tables in each sweep; ``once``: packed hashes of the others."""

    words: DataFrame
    pairs: DataFrame
    once: DataFrame
    totals: Totals
    sweeps: list[int]
    parts: int


def _parts(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(8, -(-size // PART_BYTES))


def fit(training: DataFrame, burn_in: int = 1, samples: int = 2) -> Model:
    """Learns from all rows of ``training`` (needs text)."""
    spark, parts = training.sparkSession, _parts(training)
    tables = materialize(_tables(_gathered(training, parts)), "tables")
    release(spark)
    row = tables.groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("n1", "n2", "tokens", "words")]).collect()
    of = {r.kind: r for r in row}
    n1, n2 = (of[0].n1, of[0].n2) if 0 in of else (0, 0)
    totals = Totals(of[3].tokens if 3 in of else 0, of[3].words if 3 in of else 0, _discount(n1, n2), [], [], [], [])
    fixed = materialize(_tables_of_words(tables.where("kind = 2"), True).select("h", F.col("k").alias("k0"), F.col("tables").alias("tables0")), "words")
    words = materialize(_words(tables).join(fixed, "h", "left").na.fill(0, ["k0", "tables0"]), "words")
    pairs = materialize(tables.where("kind = 0").select("part", "packed"), "pairs")
    once = materialize(tables.where("kind = 1").select("part", "packed"), "pairs")
    discard(tables, fixed)
    release(spark)
    kept = []
    for sweep in range(burn_in + samples):
        # the restaurant of words and the spelling of this sweep's tables, then the next sweep's pairs
        ours = words.join(_tables_of_words(pairs, False), "h", "left").na.fill(0, ["k", "tables"])
        ours = ours.withColumn("k", F.col("k") + F.col("k0")).withColumn("tables", F.col("tables") + F.col("tables0"))
        seated = _seat_words(ours, totals, sweep)
        sums = seated.agg(F.sum("k").alias("k"), F.sum("t").alias("t"), F.count_if(F.col("k") == 1).alias("n1"), F.count_if(F.col("k") == 2).alias("n2")).first()
        totals.discount.append(_discount(sums.n1, sums.n2))
        totals.customers.append(sums.k or 0)
        totals.tables.append(sums.t or 0)
        totals.spelling.append(fit_spelling(*_spelling_counts(seated.select("word", F.col("t").alias("tables"))), seed=sweep))
        shares = _word_shares(seated, totals, "share")
        discard(seated, words)
        if sweep + 1 < burn_in + samples:
            mass = F.when(F.col("k") > 0, (F.col("k") - totals.discount[-1] * F.col("t")) / F.col("k")).otherwise(0.0)
            before, pairs = pairs, materialize(_seat_pairs(pairs, shares.select("h", "share", mass.alias("mass"), "tables"), totals, sweep + 1), "pairs")
            discard(before)
        kept_columns = [c for c in shares.columns if c.startswith(("share_", "tables_"))]
        now = [F.col("share").alias(f"share_{sweep}"), F.col("tables").alias(f"tables_{sweep}")] if sweep >= burn_in else []
        kept += [sweep] if now else []
        words = shares.select("h", "word", "c", "k0", "tables0", *kept_columns, *now)
        words._shared_path = shares._shared_path
        del ours, seated, shares
        release(spark)
    for name in ("discount", "customers", "tables", "spelling"):
        setattr(totals, name, [x for s, x in enumerate(getattr(totals, name)) if s in kept])
    return Model(words, pairs, once, totals, kept, parts)


def _buckets(docs: DataFrame) -> DataFrame:
    """bucket and packed rows of documents: what a task reads in a row, about PART_BYTES of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                rows = pa.Table.from_batches(held)
                held.clear()
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(rows)
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["bucket", "packed"])

        size = 0
        for batch in batches:
            ends = np.cumsum(np.nan_to_num(pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)))
            at = 0
            while at < len(batch):
                done = ends[at - 1] if at else 0
                n = max(1, int(np.searchsorted(ends, done + PART_BYTES - size, side="right")) - at)
                held.append(batch.slice(at, n))
                size += ends[min(at + n, len(batch)) - 1] - done
                at += n
                if size >= PART_BYTES or at < len(batch):
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.select("doc_id", "text").mapInArrow(lean(run), "bucket long, packed binary")


def _rows(packed_rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(packed_rows)).read_all()


def _all_tokens(texts: pa.ChunkedArray, with_places: bool = False) -> tuple[np.ndarray, np.ndarray, list]:
    """Hashes of all tokens of a bucket, how many each text has, and where to find the bytes of a token."""
    token, n, places = [], [], []
    for _, _, data, bounds in text_slices(texts):
        t, k, first, last = tokens_of(data, bounds)
        token.append(t), n.append(k)
        if with_places:
            places.append((data, first, last))
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none.astype(np.uint64), *token]), np.concatenate([none, *n]), places


def _aligned(answers: pa.ChunkedArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Which of a bucket's keys, in order, have been found, and the columns of those; parts are in order."""
    found = [unpacked(x) for x in answers.to_pylist()]
    hit = np.concatenate([np.unpackbits(f["hit"], count=int(f["n"][0])) for f in found]).astype(bool)
    return hit, {name: np.concatenate([f[name] for f in found]) for name in found[0] if name not in ("hit", "n")}


def _spread(hit: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The values at the keys that have been found, 0 at the others."""
    out = np.zeros(len(hit))
    out[hit] = values
    return out


def score(docs: DataFrame, model: Model, drop_model: bool = False) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10) of every row.  ``drop_model``: the model isn't used
    again, so its tables leave the disks before the texts are dealt out."""
    spark, parts, sweeps = docs.sparkSession, model.parts, model.sweeps
    kind = docs.schema["doc_id"].dataType
    buckets = materialize(_buckets(docs), "buckets")

    def wanted(kind: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct words (kind 1) or pairs (kind 0) of each bucket, by part."""
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                token, _, _ = _all_tokens(_rows(blob).column("text"))
                key = distinct_values(token if kind else pair(contexts_of(token), token))
                asked = [(kind, p, packed(h=key[s])) for p, s in _slices(key, parts)]
                for k in range(0, len(asked), 16):
                    of, p, data = zip(*asked[k : k + 16], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(of), pa.int64()), pa.array(of, pa.int32()), pa.array(p, pa.int32()), pa.array(data, pa.binary())], ["bucket", "kind", "part", "packed"])

    shown = [name for s in sweeps for name in (f"share_{s}", f"tables_{s}")]

    def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words as packed rows by part."""
        for batch in batches:
            h = np.asarray(batch.column(0)).view(np.uint64)
            order = np.argsort(h)
            columns = {"h": h[order]} | {name: np.asarray(batch.column(name)).astype(np.float32 if name.startswith("share") else np.int64)[order] for name in batch.schema.names[1:]}
            found = [(p, packed(**{name: x[s] for name, x in columns.items()})) for p, s in _slices(columns["h"], parts)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())], ["part", "packed"])

    words = model.words.select("h", "c", *shown).mapInArrow(lean(by_part), "part int, packed binary").select(F.lit(1).alias("kind"), "part", "packed")
    pairs = model.pairs.select(F.lit(0).alias("kind"), "part", "packed").union(model.once.select(F.lit(2).alias("kind"), "part", "packed"))
    # the last sweep's tables of pairs have no name of their own
    last = sweeps[-1] if sweeps else 0

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        """Which of the asked words or pairs are there, and the columns of those, in the order of the keys."""
        if not len(left):
            return pa.table({"bucket": pa.array([], pa.int64()), "kind": pa.array([], pa.int32()), "part": pa.array([], pa.int32()), "packed": pa.array([], pa.binary())})
        of, of_kind = left.column("kind")[0].as_py(), np.asarray(right.column("kind").combine_chunks()) if len(right) else np.zeros(0, dtype=np.int32)
        take = lambda k: unpack_all(right.column("packed").take(pa.array(np.flatnonzero(of_kind == k)))) if (of_kind == k).any() else {}
        if of == 1:
            x, names = take(1), ["c", *shown]
        else:
            x, single = take(0), take(2).get("g", np.zeros(0, dtype=np.uint64))
            if x:
                x[f"t{last}"] = x["t"]
            names = ["c", *[f"t{s}" for s in sweeps]]
            ones = np.ones(len(single), dtype=np.uint32)
            x = {"h": np.concatenate([pair(x["v"], x["w"]), single]) if x else single} | {name: np.concatenate([x[name].astype(np.uint32), ones]) if x else ones for name in names}
        h = x.get("h", np.zeros(0, dtype=np.uint64))
        order = np.argsort(h)
        h = h[order]
        columns = {name: x[name][order] if name in x else np.zeros(0) for name in names}
        out = []
        for blob in left.column("packed").to_pylist():
            asked = unpacked(blob)["h"]
            at = np.minimum(np.searchsorted(h, asked), max(len(h) - 1, 0))
            hit = h[at] == asked if len(h) else np.zeros(len(asked), dtype=bool)
            out.append(packed(hit=np.packbits(hit), n=np.array([len(asked)]), **{name: c[at[hit]] for name, c in columns.items()}))
        return pa.table({"bucket": left.column("bucket"), "kind": left.column("kind"), "part": left.column("part"), "packed": pa.array(out, pa.binary())})

    def answered(kind: int, tables: DataFrame) -> DataFrame:
        asked = buckets.mapInArrow(lean(functools.partial(wanted, kind)), "bucket long, kind int, part int, packed binary")
        out = asked.groupBy("part").cogroup(tables.groupBy("part")).applyInArrow(lean_group(answer), "bucket long, kind int, part int, packed binary")
        return materialize(out, "answers")

    # words and pairs one after the other: the disks hold the requests of one kind at a time
    answers = answered(1, words)
    release(spark)
    answers = answers.union(answered(0, pairs))
    if drop_model:
        discard(model.words, model.pairs, model.once)
    release(spark)
    shared = spark.sparkContext.broadcast(model.totals)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        m = shared.value
        ids, n_all, n_known, base_all, score_all = [], [], [], [], []
        right = right.sort_by([("kind", "ascending"), ("part", "ascending")]) if len(right) else right
        of_kind = np.asarray(right.column("kind").combine_chunks()) if len(right) else np.zeros(0)
        for blob in left.column("packed").to_pylist():
            rows = _rows(blob)
            token, n, places = _all_tokens(rows.column("text"), True)
            h, first, word = np.unique(token, return_index=True, return_inverse=True)
            (is_known, x), (hit, y) = (_aligned(right.column("packed").take(pa.array(np.flatnonzero(of_kind == k)))) for k in (1, 0))
            c = _spread(is_known, x["c"])
            # bytes of the words without training tokens
            new = np.flatnonzero(~is_known)
            starts = np.cumsum([0, *[len(f) for _, f, _ in places]])
            slice_of = np.searchsorted(starts, first[new], side="right") - 1
            spelled_words: list[bytes] = [b""] * len(new)
            for s, (data, begin, stop) in enumerate(places):
                own = np.flatnonzero(slice_of == s)
                at = first[new[own]] - starts[s]
                for k, w in zip(own.tolist(), word_bytes(data, begin[at], stop[at]).to_pylist(), strict=True):
                    spelled_words[k] = w
            g, pair_of = np.unique(pair(contexts_of(token), token), return_inverse=True)
            seen = {name: _spread(hit, y[name]) for name in ["c", *[f"t{s}" for s in sweeps]]}
            context = np.concatenate([[np.searchsorted(h, END)], word[:-1]])
            total = c[context]
            mean = np.zeros(len(token))
            for k, s in enumerate(sweeps):
                share = _spread(is_known, x[f"share_{s}"])
                if len(new):
                    share[new] = m.word_share(k, np.zeros(len(new)), np.zeros(len(new)), spelling_probability(m.spelling[k], spelled_words))
                tables = _spread(is_known, x[f"tables_{s}"])[context]
                back = (m.pair_concentration + m.pair_discount * tables) * share[word]
                here = seen["c"][pair_of] - m.pair_discount * seen[f"t{s}"][pair_of]
                mean += np.where(total > 0, (here + back) / (m.pair_concentration + total), share[word])
            value = np.log10(np.maximum(mean / len(sweeps), 1e-300))
            base = np.log10((c + 0.5) / (m.tokens + 0.5 * (m.words + 1)))[word]
            at = np.cumsum(n) - n
            ids.append(rows.column("doc_id"))
            n_all.append(n)
            for kept, values in ((n_known, (c > 0).astype(np.int64)[word]), (base_all, base), (score_all, value)):
                kept.append(np.add.reduceat(values, at) if len(at) else values)
        if not ids:
            return pa.table({"doc_id": pa.array([], docs_type), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        return pa.table({"doc_id": pa.chunked_array([c for i in ids for c in i.chunks], docs_type), "n_tokens": np.concatenate(n_all).astype(np.int64), "n_known": np.concatenate(n_known).astype(np.int64), "base_score": np.concatenate(base_all).astype(float), "score": np.concatenate(score_all).astype(float)})

    docs_type = to_arrow_type(kind)
    out = buckets.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(lean_group(run), f"doc_id {kind.simpleString()}, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(model.totals.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(scores: DataFrame) -> DataFrame:
    """perplexity and base_perplexity over all tokens of score()'s rows."""
    return scores.agg(F.pow(10.0, -F.sum("score") / F.sum("n_tokens")).alias("perplexity"), F.pow(10.0, -F.sum("base_score") / F.sum("n_tokens")).alias("base_perplexity"))
