import math
import random

import numpy as np
import pytest

from veriframe.llm import embedding_dedup, graph

from . import brute

SF = "/root/testdata/sf0.001"


def plain(rows, threshold):
    good = [(k, np.array(v, dtype=np.float64)) for k, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    pairs = [(a, b) for i, (a, x) in enumerate(good) for b, y in good[:i] if len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold]
    links = [0] * len(rows)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    parts = brute.components([i for i, _ in rows], [(rows[a][0], rows[b][0]) for a, b in pairs])
    return links, parts


def test_whole_table_recall(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    links, parts = plain(rows, 0.95)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    want, have = sum(links), sum(r.n_links for r in got.values())
    assert 0.9 * want <= have <= want
    assert all(got[i].n_links <= n for (i, _), n in zip(rows, links, strict=True))
    assert sum(got[i].component_id == c for i, c in parts.items()) >= 0.9 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


@pytest.mark.parametrize("chunk", [4, 1024])
def test_odd_vectors_and_a_large_group(spark, chunk):
    rng = np.random.default_rng(3)
    base = rng.normal(size=8)
    rows = [(1, None), (2, []), (3, [0.0] * 8), (4, [math.nan] + [1.0] * 7), (5, [math.inf] + [1.0] * 7), (6, [None] + [1.0] * 7), (7, [1.0] * 5)]
    rows += [(100 + i, (base + rng.normal(size=8) * 0.2).tolist()) for i in range(40)]
    rows += [(200 + i, base.tolist()) for i in range(15)] + [(300, (base * 3).tolist()), (300, (base * 2).tolist())]
    rows += [(400 + i, rng.normal(size=8).tolist()) for i in range(30)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, n_links int, kept string").repartition(5)
    links, parts = plain(rows, 0.95)
    got = embedding_dedup.near_duplicates(df, target_recall=1.0, chunk=chunk).collect()
    assert sorted((r.vec_id, r.n_links) for r in got) == sorted((i, n) for (i, _), n in zip(rows, links, strict=True))
    assert {r.vec_id: r.component_id for r in got} == parts
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    assert {r.n_links for r in embedding_dedup.near_duplicates(df.where("vec_id < 7")).collect()} == {0}


def test_components(spark):
    rng = random.Random(4)
    for n, m in ((30, 10), (200, 150), (60, 200)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(500 + i, 501 + i) for i in range(20)]
        got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        want = brute.components({x for e in edges for x in e}, edges)
        linked = {x for a, b in edges if a != b for x in (a, b)}
        assert got == {k: v for k, v in want.items() if k in linked}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_recall_on_planted_groups(spark):
    """12000 vectors in groups around the threshold, with the default parameters, against brute force."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(2000, 64))
    owner = np.concatenate([np.arange(2000), rng.integers(0, 2000, 10_000)])
    vectors = centres[owner] + rng.normal(size=(12_000, 64)) * rng.choice([0.05, 0.12, 0.16, 0.2], size=(12_000, 1))
    rng.shuffle(vectors)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(8)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    links = np.concatenate([(unit[k : k + 2000] @ unit.T >= 0.95).sum(axis=1) - 1 for k in range(0, len(unit), 2000)])
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    found = np.array([got[i] for i in range(len(unit))])
    print("links found", found.sum(), "of", links.sum())
    assert links.sum() > 20_000 and (found <= links).all() and found.sum() >= 0.9 * links.sum()
