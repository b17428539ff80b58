import math

import numpy as np

from veriframe.llm import whitening
from veriframe.llm.queries import op12_whitening

SF = "/root/testdata/sf0.001"


def plain(vectors, components):
    """x, deviations, eigenvalues, whitened rows and shares by numpy alone, with exact integers."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    offsets = n * x - sums
    y = (offsets / n).astype(np.float64)
    values, vecs = np.linalg.eigh(y.T @ y / n)
    values, vecs = values[::-1], vecs[:, ::-1]
    return n, (offsets**2).sum(axis=1), (y @ vecs / np.sqrt(np.maximum(values, 1e-300)))[:, :components], values / values.sum()


def same(got, ids, n, deviations, whitened, shares):
    k = whitened.shape[1]
    assert len(got) == len(ids) * k
    rows = {}
    for r in got:
        assert r.n == n and math.isclose(r.explained, shares[r.component - 1], rel_tol=1e-6) and r.identity_error <= 1e-8
        rows.setdefault(r.vec_id, {})[r.component] = (r.whitened, r.deviation)
    table = np.array([[rows[i][c + 1][0] for c in range(k)] for i in ids])
    assert [rows[i][1][1] for i in ids] == list(deviations)
    for c in range(k):
        sign = np.sign(table[:, c] @ whitened[:, c])
        assert np.abs(table[:, c] * sign - whitened[:, c]).max() < 1e-6, c


def test_query_against_numpy(spark):
    table = [r for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    got = op12_whitening(spark, SF).collect()
    assert {c: t for c, t in op12_whitening(spark, SF).dtypes} == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    same(got, [r.vec_id for r in table], *plain([r.embedding for r in table], 32))


def test_odd_vectors(spark):
    rng = np.random.default_rng(5)
    good = [(10 + i, (rng.normal(size=5) * [9, 5, 3, 2, 1]).tolist()) for i in range(60)]
    good += [(100, good[0][1]), (101, good[0][1])]
    bad = [(1, None), (2, []), (3, [math.nan, 1.0, 1.0, 1.0, 1.0]), (4, [None, 1.0, 1.0, 1.0, 1.0]), (5, [1.0, 1.0, math.inf, 1.0, 1.0]), (6, [1.0]), (7, [-math.inf] * 5)]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in [*bad, *good]], "vec_id long, embedding array<double>, n int, component string, x int").repartition(4)
    got = whitening.whitened_components(df).collect()
    same(got, [i for i, _ in good], *plain([v for _, v in good], 5))
    assert whitening.whitened_components(df, components=2).where("component > 2").count() == 0
    assert whitening.whitened_components(df.limit(0)).count() == 0
    assert whitening.whitened_components(df.where("vec_id < 7")).count() == 0
    assert whitening.whitened_components(df.where("vec_id in (10, 100, 101)")).count() == 0
    assert whitening.whitened_components(df.where("vec_id = 10")).count() == 0
    # two distinct rows span one component
    assert {r.component for r in whitening.whitened_components(df.where("vec_id in (10, 11, 100)")).collect()} == {1}


def test_far_from_zero(spark):
    """Rows whose mean is a million times their spread keep all digits."""
    rng = np.random.default_rng(6)
    rows = [(i, (1e7 + rng.normal(size=3) * [4, 2, 1]).tolist()) for i in range(200)]
    got = whitening.whitened_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    same(got, [i for i, _ in rows], *plain([v for _, v in rows], 3))
