import binascii
import hashlib
import random

import numpy as np
import pytest

from veriframe.llm import periodic_runs
from veriframe.llm.queries import op13_periodic_runs

from . import brute
from .texts import ODD, documents

SF = "/root/testdata/sf0.001"


def plain_runs(w, min_words=6, repeats=4):
    """Every period, every place."""
    found = {}
    for p in range(1, len(w) // repeats + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(min_words, repeats * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def plain_row(doc_id, text, plant):
    w = brute.words(text)
    n = len(w)
    h = binascii.crc32(str(doc_id).encode())
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    collapsed = " ".join(x for i, x in enumerate(w) if i not in gone)
    digest = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(digest.encode()).hexdigest(), hashlib.sha256(collapsed.encode()).hexdigest())


def values(r):
    return (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)


def test_query_against_plain(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op13_periodic_runs(spark, SF).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: values(r) for r in got} == {i: plain_row(i, t, True) for i, t in docs.items()}
    assert sum(r.n_runs > 0 for r in got) > 10


def fibonacci(n):
    a, b = ["a"], ["a", "b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def thue_morse(n):
    return ["ab"[bin(i).count("1") % 2] for i in range(n)]


def coded(words):
    return np.array([hash(w) & 0xFFFFFFFFFFFFFFFF for w in words], dtype=np.uint64)


@pytest.mark.parametrize("pairs", [7, 1 << 20])
@pytest.mark.parametrize("repeats", [2, 3, 4])
def test_runs_of_many_shapes(monkeypatch, pairs, repeats):
    monkeypatch.setattr(periodic_runs, "PAIRS", pairs)
    rng = random.Random(3)
    texts = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 50, fibonacci(150), thue_morse(256), ["a", "b", "c"] * 9 + ["a", "b", "b"] * 8, (["a"] * 7 + ["b"]) * 6]
    for _ in range(120):
        base = [rng.choice("abc") for _ in range(rng.randrange(1, 9))]
        texts.append([rng.choice("ab") for _ in range(rng.randrange(20))] + base * rng.randrange(1, 9) + base[: rng.randrange(len(base) + 1)] + [rng.choice("abc") for _ in range(rng.randrange(30))])
    got = periodic_runs.find_runs(texts, coded([w for t in texts for w in t]), repeats=repeats)
    assert got == [plain_runs(t, repeats=repeats) for t in texts]


def test_hashes_that_collide_are_worked_out_from_the_words():
    rng = random.Random(8)
    texts = [[rng.choice("abcd") for _ in range(rng.randrange(6, 60))] + [rng.choice("ab")] * rng.randrange(12) for _ in range(80)]
    same = np.array([ord(w) % 2 for t in texts for w in t], dtype=np.uint64)  # a = c, b = d
    got = periodic_runs.find_runs(texts, same)
    assert got == [plain_runs(t) for t in texts]
    assert any(plain_runs(t) for t in texts)


def test_odd_texts(spark):
    docs = documents(spark, [*ODD, "a b " * 40_000, "A a A a A a A a x", "x " * 30])
    rows = docs.collect()
    got = {r.doc_id: r for r in periodic_runs.judge(docs).collect()}
    for r in rows:
        if len(r.text or "") < 20_000:
            assert values(got[r.doc_id]) == plain_row(r.doc_id, r.text, False), r.doc_id
    assert values(got[len(ODD)])[:5] == (1, 0, 80_000, 2, 40_000_000) and got[len(ODD)].collapsed == "a b"
    assert got[0].n_runs == 0 and got[0].start is None and got[0].runs_sha256 == hashlib.sha256(b"").hexdigest() == got[0].collapsed_sha256
    assert periodic_runs.judge(docs.limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, "z " * 12), (None, None), (3, "q")], "doc_id long, text string")
    assert sorted(r.n_runs for r in periodic_runs.judge(nameless, plant=True).collect()) == [0, 0, 1]


def test_collapse_keeps_rows_and_columns(spark):
    rows = [(1, "x y " * 6, "a"), (1, "other text", "b"), (None, "q " * 9 + "end", "c"), (4, None, "d"), (5, "kept  as\nit is", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, collapsed string")
    out = periodic_runs.collapse(docs)
    assert out.columns == docs.columns
    assert sorted((r.collapsed, r.text) for r in out.collect()) == [("a", "x y"), ("b", "other text"), ("c", "q end"), ("d", None), ("e", "kept  as\nit is")]
