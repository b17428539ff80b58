import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veriframe.llm import jaccard_join

from . import brute
from .texts import ODD, documents

SF = "/root/testdata/sf0.01"


def plain(rows, width, percent):
    sets = [(i, brute.shingles(t, width)) for i, t in rows]
    links = []
    for (i, a), (j, b) in combinations([x for x in sets if x[1]], 2):
        if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
            common = len(a & b)
            if 100 * common >= percent * (len(a) + len(b) - common):
                links.append((i, j))
    return {i: len(s) for i, s in sets}, brute.components([i for i, _ in sets], links)


def check(df, rows, width, percent, **more):
    sizes, parts = plain(rows, width, percent)
    got = jaccard_join.jaccard_components(df, width, percent, **more).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((i, sizes[i], parts[i]) for i, _ in rows)


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_whole_table(spark, width, percent):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(docs, [(r.doc_id, r.text) for r in docs.collect()], width, percent)


def test_odd_texts(spark):
    docs = documents(spark)
    check(docs, list(enumerate(ODD)), 4, 85)
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0
    blank = docs.limit(3)
    assert {r.component_id for r in jaccard_join.jaccard_components(blank).collect()} == {0, 1, 2}
    assert jaccard_join.jaccard_components(docs.union(docs)).count() == 2 * len(ODD)


def test_chains_and_large_keys(spark, monkeypatch):
    """Copies that drift apart, a passage that all share, and keys above the limit for pairs."""
    monkeypatch.setattr(jaccard_join, "SMALL_KEY", 3)
    rng = random.Random(9)
    word = lambda: "w%d" % rng.randrange(5000)
    rows, passage = [], [word() for _ in range(40)]
    for _ in range(6):
        text = passage + [word() for _ in range(rng.randrange(15, 60))]
        for _ in range(25):
            rows.append((len(rows), " ".join(text)))
            text = text.copy()
            for _ in range(rng.randrange(3)):
                text[rng.randrange(len(text))] = word()
    rows += [(len(rows) + k, " ".join(passage + [word() for _ in range(4)])) for k in range(60)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for percent in (85, 60):
        check(df, rows, 4, percent, chunk=16)


def test_bounds():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.random() * 0.2], rng.integers(0, 2**63, int(rng.integers(0, 30))).astype(np.uint64)]))
        if not len(b):
            continue
        distance = len(np.setxor1d(a, b))
        p, q = jaccard_join.bit_sketch(a), jaccard_join.bit_sketch(b)
        w = min(len(p), len(q))
        assert np.bitwise_count(jaccard_join.fold(p, w) ^ jaccard_join.fold(q, w)).sum() <= distance
        common = len(np.intersect1d(a, b))
        for percent in (60, 80, 85, 95):
            if 100 * common >= percent * (len(a) + len(b) - common):
                assert jaccard_join.within(np.array([distance]), np.array([len(a) + len(b)]), percent)[0]
                sizes = np.array([len(a), len(b)])
                keys, who = jaccard_join.symbols(np.concatenate([a, b]), np.repeat([0, 1], sizes), sizes, percent)
                upper, _, spare = jaccard_join.bands(percent, 1 << 40)
                band = int(np.searchsorted(upper, sizes.max()))
                shared = np.intersect1d(keys[who == 0], keys[who == 1])
                assert ((shared & np.uint64(255)) == np.uint64(band)).sum() > spare[band]


@pytest.mark.parametrize("counted", [3, 1 << 20])
def test_sizes_of_keys_over_batches(monkeypatch, counted):
    """However the rows are cut to batches, all rows of a key get its number of sets, or the bound."""
    monkeypatch.setattr(jaccard_join, "COUNTED", counted)
    rng = random.Random(4)

    class Rows:
        def __init__(self, rows, cuts):
            self.rows, self.cuts = rows, cuts

        def repartition(self, *_):
            return self

        sortWithinPartitions = repartition

        def mapInArrow(self, run, _):
            parts = [self.rows[i:j] for i, j in zip([0, *self.cuts], [*self.cuts, len(self.rows)], strict=True)]
            batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in p], pa.int64()) for k in (0, 1)], ["key", "fp"]) for p in parts]
            return sorted(tuple(r.values()) for b in run(iter(batches)) for r in b.to_pylist())

    for _ in range(200):
        rows = sorted((rng.randrange(6), rng.randrange(12)) for _ in range(rng.randrange(1, 40)))
        cuts = sorted(rng.randrange(len(rows) + 1) for _ in range(rng.randrange(8)))
        size = {k: min(counted, len({f for q, f in rows if q == k})) for k, _ in rows}
        assert jaccard_join._shared_keys(Rows(rows, cuts)) == sorted((k, f, size[k]) for k, f in set(rows) if size[k] > 1)


def kept_texts(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in jaccard_join.keep_one(df).collect())


def test_keep_one_by_text(spark):
    """Rows without id, ids with several texts, and columns with the names that the operator uses inside."""
    rng = random.Random(3)
    a, b, c, d = (" ".join("w%d" % rng.randrange(900) for _ in range(60)) for _ in range(4))
    rows = [(1, a), (2, a), (2, b), (3, b), (None, a), (None, c), (None, c), (5, d), (5, d), (6, d), (7, None), (7, None), (None, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = kept_texts(df.withColumn("_gone", F.lit(1)).withColumn("_own", F.lit(2)).withColumn("_fp", F.lit("x")))
    assert got == sorted([(False, 1, a), (False, 2, b), (True, 0, c), (False, 5, d), (False, 5, d), (False, 7, ""), (False, 7, ""), (True, 0, ""), (False, 8, "")])
    plain = spark.createDataFrame([(1, a), (2, a), (3, b)], "doc_id long, text string")
    assert kept_texts(plain) == [(False, 1, a), (False, 3, b)]


def test_rows_that_stay_are_not_shuffled(spark, tmp_path):
    rows = [(k, " ".join(f"{w}x{k // 2 if k < 40 else k}" for w in range(60))) for k in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs, before = spark.read.parquet(f"{tmp_path}/docs"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = jaccard_join.keep_one(docs)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.doc_id for r in out.collect()) == [k for k in range(400) if k >= 40 or not k % 2]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Union" in plan and "SortMergeJoin" in plan
