import math
import os
from collections import Counter, defaultdict

import numpy as np
import pytest

from veriframe.llm import common, pitman_yor

from . import brute
from .texts import ODD, documents

SF = "/root/testdata/sf0.01"


def tokens(text):
    return [w.encode() for w in brute.words(brute.lower(text))] + [b""]


def check(rows, texts, train):
    counts = Counter(w for i in train for w in tokens(texts[i]))
    n = sum(counts.values())
    for r in rows:
        t = tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(counts[w] > 0 for w in t), n)
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (len(counts) + 1))) for w in t)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-6)
        assert r.score <= 0 and math.isfinite(r.score)
    return counts


class Plain:
    """The probabilities of a model from its tables, word by word."""

    def __init__(self, model):
        self.m, self.totals = model, model.totals
        rows = model.words.collect()
        self.word = {bytes(r.word): r for r in rows}
        self.name = {r.h & (2**64 - 1): bytes(r.word) for r in rows}
        self.pairs = defaultdict(dict)
        for r in model.pairs.collect():
            x = pitman_yor.unpacked(r.packed)
            seats = [x.get(f"t{s}", x["t"]) for s in model.sweeps]
            for k, (v, w, c) in enumerate(zip(x["v"].tolist(), x["w"].tolist(), x["c"].tolist(), strict=True)):
                self.pairs[self.name[v]][self.name[w]] = (c, [int(t[k]) for t in seats])
        self.once = {g for r in model.once.collect() for g in pitman_yor.unpacked(r.packed)["g"].tolist()}

    def share(self, k, w):
        s = self.m.sweeps[k]
        if w in self.word:
            return self.word[w][f"share_{s}"]
        spelled = pitman_yor.spelling_probability(self.totals.spelling[k], [w])[0]
        return (self.totals.concentration + self.totals.discount[k] * self.totals.tables[k]) * spelled / (self.totals.concentration + self.totals.customers[k])

    def seen(self, v, w):
        if w in self.pairs[v]:
            return self.pairs[v][w]
        if v in self.word and w in self.word:
            h = np.array([self.word[v].h, self.word[w].h]).view(np.uint64)
            if int(pitman_yor.pair(h[:1], h[1:])[0]) in self.once:
                return 1, [1] * len(self.m.sweeps)
        return 0, [0] * len(self.m.sweeps)

    def probability(self, v, w):
        total, (c, seats), d, theta = self.word[v].c if v in self.word else 0, self.seen(v, w), self.totals.pair_discount, self.totals.pair_concentration
        found = []
        for k, s in enumerate(self.m.sweeps):
            if total:
                found.append((c - d * seats[k] + (theta + d * self.word[v][f"tables_{s}"]) * self.share(k, w)) / (theta + total))
            else:
                found.append(self.share(k, w))
        return sum(found) / len(found)

    def score(self, text):
        t = tokens(text)
        return sum(math.log10(self.probability(v, w)) for v, w in zip([b"", *t], t, strict=False))


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = pitman_yor.fit(docs.where("crc32(cast(doc_id as string)) % 5 <> 1"))
    scores = pitman_yor.score(docs, model)
    rows = scores.collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    train = [i for i in texts if brute.fold(i, 5) != 1]
    check(rows, texts, train)
    held = [r for r in rows if brute.fold(r.doc_id, 5) == 1]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert pitman_yor.perplexity(scores.where("crc32(cast(doc_id as string)) % 5 = 1")).where("perplexity < base_perplexity").count() == 1
    plain = Plain(model)
    for r in rows[:40]:
        assert math.isclose(r.score, plain.score(texts[r.doc_id]), rel_tol=1e-6)
    # customers of the pairs are the tokens; their tables the customers of the words
    pairs = Counter()
    for i in train:
        t = tokens(texts[i])
        pairs.update(zip([b"", *t], t, strict=False))
    assert {(v, w): c for v, own in plain.pairs.items() for w, (c, _) in own.items()} == {p: c for p, c in pairs.items() if c > 1}
    assert len(plain.once) == sum(c == 1 for c in pairs.values())
    for k, s in enumerate(model.sweeps):
        tables = sum(t[k] for own in plain.pairs.values() for _, t in own.values()) + len(plain.once)
        assert tables == model.totals.customers[k] == sum(r[f"tables_{s}"] for r in plain.word.values())
        assert all(1 <= t[k] <= c for own in plain.pairs.values() for c, t in own.values())
        # the words of a context and those without training tokens have one probability in all
        spelled = pitman_yor.spelling_probability(model.totals.spelling[k], list(plain.word))
        new = (model.totals.concentration + model.totals.discount[k] * model.totals.tables[k]) * (1 - spelled.sum()) / (model.totals.concentration + model.totals.customers[k])
        assert math.isclose(sum(plain.share(k, w) for w in plain.word) + new, 1, rel_tol=1e-9)
        for v in [b"", *sorted(plain.word)[500:3000:500]]:
            d, theta, r = model.totals.pair_discount, model.totals.pair_concentration, plain.word[v]
            own = sum(c - d * t[k] for c, t in (plain.seen(v, w) for w in {w for u, w in pairs if u == v}))
            assert math.isclose(own + theta + d * r[f"tables_{s}"], theta + r.c, rel_tol=1e-9)
    # words have contexts
    some = docs.where("doc_id < 200 and n_chars > 400").selectExpr("doc_id", "array_join(reverse(split(text, ' ')), ' ') AS text")
    turned = {r.doc_id: r.score for r in pitman_yor.score(some, model).collect()}
    assert sum(r.score for r in rows if r.doc_id in turned) > sum(turned.values()) + 1


def test_partitions_do_not_matter(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = {r.doc_id: r.score for r in pitman_yor.score(docs, pitman_yor.fit(docs)).collect()}
    monkeypatch.setattr(pitman_yor, "BLOCK_TOKENS", 3000)
    monkeypatch.setattr(pitman_yor, "PART_BYTES", 20_000)
    dealt = docs.repartition(5)
    for r in pitman_yor.score(dealt, pitman_yor.fit(dealt)).collect():
        assert math.isclose(r.score, whole[r.doc_id], rel_tol=1e-6)


def test_odd_texts(spark):
    docs = documents(spark)
    model = pitman_yor.fit(docs.where("doc_id > 4"))
    rows = pitman_yor.score(docs, model).collect()
    assert len(rows) == len(ODD)
    check(rows, dict(enumerate(ODD)), range(5, len(ODD)))
    none = pitman_yor.fit(docs.limit(0))
    assert all(r.n_known == 0 and r.score < 0 for r in pitman_yor.score(docs, none).collect())
    assert pitman_yor.score(docs.limit(0), model).count() == 0
    twice = pitman_yor.score(docs.union(docs.selectExpr("null AS doc_id", *docs.columns[1:])), model).collect()
    assert len(twice) == 2 * len(ODD) and sum(r.doc_id is None for r in twice) == len(ODD)


def test_packing_of_arrays():
    rng = np.random.default_rng(2)
    for n in (0, 1, 1000):
        x = {"a": rng.integers(0, 2**63, n).astype(np.uint64), "b": rng.random(n), "c": np.zeros(n, np.uint8), "d": rng.integers(0, 9, 2 * n).astype(np.uint32)}
        got = pitman_yor.unpacked(pitman_yor.packed(**x))
        assert all(np.array_equal(got[k], x[k]) and got[k].dtype == x[k].dtype for k in x)


def test_spelling_sums_to_one():
    words = [b"the", b"then", b"cat", b"", "é".encode()] * 5
    context, symbol, _ = pitman_yor.spell(words)
    model = pitman_yor.fit_spelling(context, symbol, np.ones(len(symbol), dtype=np.int64), seed=1)
    assert np.allclose(model.table.sum(axis=1), 1)
    assert pitman_yor.spelling_probability(model, [b"the"])[0] > pitman_yor.spelling_probability(model, [b"zzz"])[0] > 0


def seatings(n):
    """All ways to seat n customers, as sizes of tables."""
    if not n:
        return [[]]
    return [w for rest in seatings(n - 1) for w in [[*rest, 1], *[[*rest[:k], rest[k] + 1, *rest[k + 1 :]] for k in range(len(rest))]]]


def weights(n, d):
    """Of t tables, summed over all seatings, by enumeration."""
    out = [0.0] * (n + 1)
    for sizes in seatings(n):
        out[len(sizes)] += math.prod(i - d for m in sizes for i in range(1, m))
    return out


def opened(t, others, theta, d, share):
    return math.prod((theta + d * (others + i)) * share for i in range(t))


@pytest.mark.parametrize(("theta", "d", "share"), [(0.1, 0.8, 0.3), (3.0, 0.4, 0.05), (1.0, 0.6, 0.9)])
def test_tables_have_their_exact_distribution(theta, d, share):
    rng, many = np.random.default_rng(7), 40_000
    for n in (2, 3, 6):
        w = [x * opened(t, 5, theta, d, share) for t, x in enumerate(weights(n, d))]
        got = pitman_yor.seat(np.full(many, n), np.full(many, 2), np.full(many, 7), np.full(many, share), theta, d, rng.integers(0, 2**63, many).astype(np.uint64), 3)
        assert np.abs(np.bincount(got, minlength=n + 1) / many - np.array(w) / sum(w)).max() < 0.01


def test_sweeps_have_the_exact_posterior_as_limit():
    """Two dishes of a restaurant with a fixed parent, many chains: the joint distribution of their tables."""
    theta, d, share, n, many = 0.5, 0.7, (0.2, 0.4), (4, 3), 30_000
    exact = np.zeros((5, 4))
    for a in range(1, 5):
        for b in range(1, 4):
            together = math.prod(theta + d * i for i in range(a + b)) * share[0] ** a * share[1] ** b
            exact[a, b] = weights(4, d)[a] * weights(3, d)[b] * together
    exact /= exact.sum()
    key = np.random.default_rng(3).integers(0, 2**62, many).astype(np.uint64)
    t = [np.full(many, 4), np.full(many, 1)]
    for sweep in range(1, 25):
        for k in (0, 1):
            t[k] = pitman_yor.seat(np.full(many, n[k]), t[k], t[0] + t[1], np.full(many, share[k]), theta, d, key * np.uint64(2) + np.uint64(k), sweep)
    got = np.zeros((5, 4))
    np.add.at(got, (t[0], t[1]), 1 / many)
    assert np.abs(got - exact).max() < 0.01


def test_dishes_with_many_customers(monkeypatch):
    rng, many = np.random.default_rng(5), 4000
    given = (np.full(many, 2), np.full(many, 40), np.full(many, 0.01), 1.0, 0.6, rng.integers(0, 2**63, many).astype(np.uint64), 1)
    for n in (1, 200, 5000):
        got = pitman_yor.seat(np.full(many, n), *given)
        assert got.min() >= 1 and got.max() <= n
    groups = pitman_yor.seat(np.full(many, 250), *given).mean()
    monkeypatch.setattr(pitman_yor, "EXACT", 250)
    pitman_yor._ways.cache_clear()
    exact = pitman_yor.seat(np.full(many, 250), *given).mean()
    pitman_yor._ways.cache_clear()
    print("tables of 250 customers, exact and in groups:", exact, groups)
    assert abs(exact - groups) < 0.15 * exact


def test_own_tables_leave_the_parent():
    customers, tables, d, theta, above = np.array([7.0, 3.0]), np.array([2.0, 1.0]), 0.5, 2.0, np.array([0.3, 0.7])
    whole = theta + customers.sum()
    share = (customers - d * tables + (theta + d * tables.sum()) * above) / whole
    out = pitman_yor.without_own(share, (customers - d * tables) / customers, np.array([7.0, 0.0]), whole)
    assert np.allclose(out, [(theta + d * 3) * 0.3 / (whole - 7), share[1]])


def test_groups_hand_their_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "_give_back", lambda: calls.append(1))
    assert common.lean_group(lambda key, rows: (key, rows))(1, 2) == (1, 2) and calls == [1]


def test_model_leaves_the_disks(spark):
    docs = documents(spark)
    kept = pitman_yor.fit(docs)
    whole = pitman_yor.score(docs, kept).toPandas()
    again = pitman_yor.score(docs, kept, drop_model=True)
    for df in (kept.words, kept.pairs, kept.once):
        assert not os.path.exists(df._shared_path)
    assert sorted(again.toPandas().score) == sorted(whole.score)


def test_distinct_values():
    rng = np.random.default_rng(4)
    for x in (rng.integers(0, 2**63, 1000).astype(np.uint64), rng.integers(0, 9, 1000), np.zeros(0, np.uint64)):
        assert np.array_equal(common.distinct_values(x), np.unique(x)) and common.distinct_values(x).dtype == x.dtype
