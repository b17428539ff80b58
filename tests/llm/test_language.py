import math
from collections import defaultdict

import numpy as np

from veriframe.llm import language_id

from . import brute
from .texts import ODD, documents

SF = "/root/testdata/sf0.01"


def plain_bits(training, text, order):
    """Code lengths by dictionaries, byte by byte."""
    out = {}
    for lang in sorted({name for name, _ in training}):
        counts = defaultdict(lambda: defaultdict(int))
        for name, raw in training:
            if name == lang:
                for i in range(len(raw)):
                    for k in range(min(i, order) + 1):
                        counts[raw[i - k : i]][raw[i]] += 1
        total = 0.0
        for i in range(len(text)):
            for k in range(min(i, order), -1, -1):
                c = counts.get(text[i - k : i])
                if not c:
                    continue
                n, q = sum(c.values()), len(c)
                if text[i] in c:
                    total -= math.log2(c[text[i]] / (n + q))
                    break
                total -= math.log2(q / (n + q))
            else:
                total += 8
        out[lang] = total
    return out


def test_code_lengths_are_exact():
    training = [("a", b"the cat sat on the mat"), ("a", "the hat é".encode()), ("b", b"der hund und die katze"), ("b", b""), ("b", b"x")]
    texts = [b"", b"the", b"zzz the \xff dog und", "katzé sat".encode(), b"q", b"the cat sat on the mat and then some more"]
    for order in (1, 2, 4):
        scorer = language_id.Scorer(language_id.fit(training, order))
        bounds = np.cumsum([0] + [len(t) for t in texts])
        got = scorer.bits(np.frombuffer(b"".join(texts), dtype=np.uint8), bounds)
        for row, t in zip(got, texts, strict=True):
            assert np.allclose(row, list(plain_bits(training, t, order).values()), atol=1e-3), (order, t)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    train = docs.where("crc32(cast(doc_id as string)) % 4 <> 2")
    rows = language_id.identify(docs, train).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in rows if brute.fold(r.doc_id, 4) == 2 and r.lang and r.lang_pred != "und"]
    assert len(held) > 50
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_texts(spark):
    docs = documents(spark)
    train = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "fr"), (4, "x y", None)], "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in language_id.identify(docs, train).collect()}
    for i, t in enumerate(ODD):
        assert (rows[i].lang_pred == "und") == (not any(c.isalpha() for c in t or "")), i
    assert rows[0].score == 0
    assert {r.lang_pred for r in language_id.identify(docs, train.limit(0)).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), train).count() == 0
