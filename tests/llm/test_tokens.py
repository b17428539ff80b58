import base64
import hashlib
import random
import zlib
from collections import defaultdict

import public_tokenizers as P
import pytest

from veriframe.llm import byte_bpe, packing

from . import brute
from .texts import ODD, documents

SF = "/root/testdata/sf0.001"
MULTI, PLAIN = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_codec_equals_rank_merging(reference):
    c, same = byte_bpe.Codec(MULTI, P.PATTERN), byte_bpe.Codec(MULTI, byte_bpe.PIECES)
    rng = random.Random(5)
    texts = [t or "" for t in ODD]
    texts += ["".join(rng.choice("ab \n'sé日😀1") for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += [rng.choice("abcXYZ.,-=_é日") * rng.randrange(1, 90) for _ in range(500)]
    texts += ["".join(rng.choice(("th", "e", "in", "g", "er", "a", "ch", "ß", "un")) for _ in range(rng.randrange(1, 14))) for _ in range(20000)]
    for t in texts:
        ids = c.encode(t)
        assert list(memoryview(ids).cast("I")) == reference.encode_ordinary(t), t
        assert c.decode(ids).decode() == t
        assert same.encode(t) == ids


def test_latin_cuts():
    import regex

    rng = random.Random(2)
    general, c = regex.compile(P.PATTERN).findall, byte_bpe.Codec(PLAIN, P.PATTERN)
    for _ in range(4000):
        t = "".join(rng.choice((chr(rng.randrange(256)), " ", "a", "'", "s", "l", "7", "\n")) for _ in range(rng.randrange(25)))
        assert c._split(t) == general(t), t
    assert c._split("aŁ²") == general("aŁ²") == ["aŁ", "²"]


def test_forgetting(monkeypatch):
    c = byte_bpe.Codec(PLAIN, byte_bpe.PIECES)
    texts = [f"w{i} x{i % 7} y{i % 3}\n" * 3 for i in range(400)] + ["", "w1 w2"]
    want = list(c.encode_texts(texts))
    monkeypatch.setattr(byte_bpe, "CACHE_PIECES", 10)
    monkeypatch.setattr(byte_bpe, "LEARN_PIECES", 20)
    assert list(byte_bpe.Codec(PLAIN, P.PATTERN).encode_texts(texts)) == want


def test_whole_table(spark, reference):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in byte_bpe.digests(docs, MULTI, P.PATTERN).collect()}
    for r in docs.collect():
        ids = reference.encode_ordinary(r.text or "")
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())


def test_round_trip_and_offsets(spark):
    docs = documents(spark)
    coded = byte_bpe.encode(docs, MULTI, P.PATTERN)
    back = {r.doc_id: r.text for r in byte_bpe.decode(coded, MULTI, P.PATTERN).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}
    for r in coded.collect():
        text = ODD[r.doc_id] or ""
        assert len(r.ids) == len(r.starts) == len(r.ends)
        assert all(a < b for a, b in zip(r.starts, r.ends, strict=True))
        assert not text or (r.starts[0] == 0 and r.ends[-1] == len(text))
    assert byte_bpe.digests(docs.limit(0), MULTI, P.PATTERN).count() == 0
    assert byte_bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), MULTI, P.PATTERN).first().text == ""


def check_packing(rows, texts, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PLAIN)
    t.encode_special_tokens = True
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    total = 0
    for i, text in texts.items():
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert len(own) == 1 if len(ids) <= capacity else all(r.length == capacity for r in own[1:])
        at = 0
        for r in own:
            assert r.start == at and 0 < r.length <= capacity
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    assert all(brute.gapless(spans, capacity) for spans in bins.values())
    return len(bins), -(-total // capacity)


def test_packing_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(docs, PLAIN, P.PATTERN).collect()
    used, least = check_packing(rows, {r.doc_id: r.text for r in docs.collect()}, 2048)
    assert used <= least + 2


def test_packing_odd(spark):
    docs = documents(spark)
    rows = packing.pack(docs, PLAIN, P.PATTERN, capacity=64, with_ids=True).collect()
    check_packing(rows, dict(enumerate(ODD)), 64)
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    assert packing.pack(docs.limit(0), PLAIN, P.PATTERN).count() == 0
    twice = docs.limit(3).union(docs.limit(3))
    assert packing.pack(twice, PLAIN, P.PATTERN).count() == 6


def test_plan_is_best_fit():
    rng = random.Random(1)
    for _ in range(60):
        capacity = rng.randrange(5, 60)
        histogram = {n: rng.randrange(1, 40) for n in rng.sample(range(1, capacity + 1), rng.randrange(1, min(capacity, 15)))}
        ranges = packing.plan(histogram, capacity)
        bins, ranks = defaultdict(list), defaultdict(list)
        for length, rank, number, first, offset in ranges:
            ranks[length] += range(rank, rank + number)
            for k in range(number):
                bins[first + k].append((offset, length))
        assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in histogram.items()}
        assert all(brute.gapless(spans, capacity) for spans in bins.values())
        room = []  # best fit, piece by piece
        for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
            fit = [r for r in room if r >= n]
            room.append(capacity - n if not fit else min(fit) - n)
            if fit:
                room.remove(min(fit))
        assert len(bins) == len(room)


def test_planned_join_equals_broadcast(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(packing, "BROADCAST_RANGES", 0)
    rows = packing.pack(docs, PLAIN, P.PATTERN).collect()
    check_packing(rows, {r.doc_id: r.text for r in docs.collect()}, 2048)
