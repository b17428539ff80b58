import math
import uuid

import public_tokenizers as P
import pytest

from veriframe.llm import sharding, token_counts
from veriframe.llm.common import shared_dir
from veriframe.llm.queries import ARRIVALS, op6_sharding

from . import brute
from .texts import ODD, documents

SF = "/root/testdata/sf0.001"


def plain_tokens(word, scores, byte_score):
    best = [(0.0, 0)] + [None] * len(word)
    for j in range(1, len(word) + 1):
        size = len(word[j - 1].encode())
        options = [(-(best[j - 1][0] + size * byte_score), best[j - 1][1] + size)]
        options += [(-(best[i][0] + scores[word[i:j]]), best[i][1] + 1) for i in range(max(0, j - 40), j) if word[i:j] in scores]
        value, n = min(options)
        best[j] = (-value, n)
    return best[-1][1]


@pytest.fixture(scope="module")
def scores():
    return token_counts.zipf_scores(P.path("piece_bpe_32k.model"))


def test_counts_equal_plain_viterbi(spark, scores):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, scores).collect()}
    known = {}
    for r in docs.collect():
        w = brute.words(r.text)
        for x in w:
            if x not in known:
                known[x] = plain_tokens(token_counts.SPACE_MARK + x, scores, -20.0)
        assert (got[r.doc_id].n_words, got[r.doc_id].n_tokens) == (len(w), sum(known[x] for x in w))


def test_odd_counts(spark, scores, monkeypatch):
    docs = documents(spark)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, scores).collect()}
    for i, t in enumerate(ODD):
        if len(t or "") < 10_000:
            assert got[i] == sum(plain_tokens(token_counts.SPACE_MARK + w, scores, -20.0) for w in brute.words(t))
    assert got[0] == got[1] == got[2] == 0
    assert token_counts.count_tokens(docs.limit(0), scores).count() == 0
    trie = token_counts.Trie({"▁a": -1.0, "b": -1.0, "ab": math.log(0.5)}, -20.0)
    monkeypatch.setattr(token_counts, "TRIE_NODES", 2)
    assert [trie.words([b"ab", b"abb"]), trie.words([b"b"]), trie.words([b"ab"])] == [2 + 3, 3 + 1, 2]


def store(spark, name, **kind):
    return sharding.ShardStore(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", **kind)


def test_append_compact_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    s = store(spark, "shards", shard_rows=20, target_bytes=300_000, min_run=3)
    assert s.append(docs) == 1 and s.append(docs) == 2
    before = s.manifest()[2]
    assert len(before) >= 20
    version = s.compact()
    number, _, shards = s.manifest()
    assert number == version and len(shards) < len(before)
    assert not s.runs(shards)
    assert len({x.path for x in shards if x.level}) > 1 and max(x.size for x in shards) < 2 * s.target_bytes
    assert sorted(map(tuple, s.read().collect())) == sorted(map(tuple, docs.union(docs).collect()))
    assert s.read(1).count() == docs.count()
    assert s.vacuum() > 0 and s.vacuum() == 0
    rows = s.places("doc_id").collect()
    assert len({(r.shard, r.shard_row) for r in rows}) == len(rows) == 2 * docs.count()
    assert {r.shard for r in rows} == {x.path.removeprefix("data/") for x in shards}


def test_versions_are_committed_once(spark):
    s = store(spark, "races", shard_rows=10)
    s.append(documents(spark))
    with pytest.raises(sharding.Conflict):
        s._commit(1, None, [])
    assert s.versions() == [1]
    s.append(documents(spark).limit(0))
    assert s.versions()[-1] == 2 and s.read().count() == len(ODD)


def test_empty_store(spark):
    s = store(spark, "none")
    assert s.versions() == [] and s.compact() == 0 and s.vacuum() == 0
    s.append(documents(spark).limit(0))
    assert s.places("doc_id").count() == 0


def test_arrivals_with_other_columns(spark):
    s = store(spark, "wide", min_run=2)
    s.append(spark.range(5).selectExpr("id", "id * 2 AS a"))
    s.append(spark.range(5, 8).selectExpr("id", "'x' AS b"))
    s.compact()
    s.vacuum()
    rows = {r.id: (r.a, r.b) for r in s.read().collect()}
    assert rows == {k: (2 * k, None) if k < 5 else (None, "x") for k in range(8)}
    version = s.manifest()[0]
    for bad in ("'text' AS id", "id, 1 AS B"):
        with pytest.raises(ValueError):
            s.append(spark.range(2).selectExpr(*bad.split(", ")))
    assert s.manifest()[0] == version and s.read().count() == 8


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_compacts(spark, sf):
    """Every arrival is a version, and what is returned went through at least one merge after them."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = op6_sharding(spark, f"/root/testdata/{sf}").collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert {r.version for r in rows} == {max(r.version for r in rows)} and rows[0].version > ARRIVALS
    merged = {r.shard for r in rows if r.level >= 1}
    assert merged and len({r.shard for r in rows}) <= ARRIVALS - sharding.ShardStore(spark, "/tmp/none").min_run + 1
    assert len({(r.shard, r.shard_row) for r in rows}) == len(rows)
