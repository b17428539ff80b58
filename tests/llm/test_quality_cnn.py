import numpy as np
import pytest

from veriframe.llm import quality_cnn
from veriframe.llm.queries import op11_quality_classifier

from . import brute
from .texts import ODD, documents

SF = "/root/testdata/sf0.01"


def plain_score(model, text):
    """Window by window with the vectors and filters themselves."""
    vectors, filters, bias, hidden, hidden_bias, out, out_bias = model.parts
    text = text.ljust(quality_cnn.WIDTH, b"\0")
    windows = len(text) - quality_cnn.WIDTH + 1
    hop = quality_cnn.CHUNK - quality_cnn.WIDTH + 1
    answers = np.array([np.einsum("wv,wvf->f", vectors[list(text[i : i + quality_cnn.WIDTH])], filters) for i in range(windows)])
    act = np.tanh(np.array([answers[i : i + hop].max(axis=0) for i in range(0, windows, hop)]) + bias)
    features = np.concatenate([act.mean(axis=0), act.max(axis=0), act.min(axis=0), [np.log(windows) / 4 - 1]])
    return 1 / (1 + np.exp(-(np.tanh(features @ hidden + hidden_bias) @ out + out_bias)))


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(2)
    rows = [(y, b" ".join(rng.choice([b"the", b"cat", b"sat", b"mat"] if y else [b"@@@", b"##", b"x!"], size=30))) for y in (0, 1) for _ in range(30)]
    return quality_cnn.fit(rows, epochs=4)


def test_scores_are_those_of_the_network(model):
    texts = [b"", b"cat", b"the cat sat on the mat", b"### x! @@@ " * 40, b"the mat " * 100 + b"##", bytes(range(256)) * 3]
    bounds = np.cumsum([0] + [len(t) for t in texts])
    got = quality_cnn.Scorer(model).scores(np.frombuffer(b"".join(texts), dtype=np.uint8), bounds)
    assert np.allclose(got, [plain_score(model, t) for t in texts], atol=1e-5)
    alone = [quality_cnn.Scorer(model).scores(np.frombuffer(t, dtype=np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(got, alone, atol=1e-6)
    assert got[2] > 0.5 > got[3]


def test_gradients_are_those_of_the_loss(model):
    texts, labels = [b"the cat sat", b"### " * 90, b"mat x! " * 60], np.array([1.0, 0.0, 1.0])
    data, bounds = quality_cnn._padded(texts)

    def loss(parts):
        p = np.array([plain_score(quality_cnn.Model(parts), t) for t in texts])
        return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean()

    parts = [np.array(x, dtype=np.float64) for x in model.parts]
    got = quality_cnn._gradients(data, bounds, labels, quality_cnn.Model(parts))
    rng = np.random.default_rng(4)
    for i, g in enumerate(got):
        assert g.shape == parts[i].shape
        for _ in range(4):
            at = tuple(rng.integers(s) for s in g.shape) if i else (ord("e"), int(rng.integers(quality_cnn.VECTOR)))
            sides = []
            for step in (1e-5, -1e-5):
                moved = [x.copy() for x in parts]
                moved[i][at] += step
                sides.append(loss(moved))
            assert abs((sides[0] - sides[1]) / 2e-5 - g[at]) < 1e-4 + 0.02 * abs(g[at]), (i, at)


def test_held_out_quality(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op11_quality_classifier(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (brute.fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.97 * len(held)
    good = [r for r in held if labels[r.doc_id]]
    assert sum(r.predicted for r in good) >= 0.98 * len(good)


def test_odd_texts_and_labels(spark, model):
    docs = documents(spark, [*ODD, *ODD[:3]])
    rows = {r.doc_id: r.score for r in quality_cnn.score(docs, model).collect()}
    assert len(rows) == len(ODD) + 3 and all(0 <= s <= 1 for s in rows.values())
    assert rows[0] == rows[1] == rows[len(ODD)]
    assert quality_cnn.score(docs.limit(0), model).count() == 0
    shape = "doc_id long, label int, text string"
    none = spark.createDataFrame([(None, 1, "x"), (999, 1, "x"), (1, None, "x"), (2, 7, "x")], shape)
    assert quality_cnn.sample(docs, none) == []
    assert {r.score for r in quality_cnn.score(docs, quality_cnn.fit([])).collect()} == {0.5}
    one = quality_cnn.sample(docs, spark.createDataFrame([(0, 1, "x"), (4, 1, "x")], shape))
    assert sorted(one) == [(1, b""), (1, ODD[4].encode())] and quality_cnn.fit(one).prior == 0.75
