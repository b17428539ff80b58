import uuid
from itertools import combinations

import corpus_pipeline
from veriframe.llm.common import shared_dir

from . import brute
from .test_substring import exact_repeats
from .test_tokens import check_packing
from .texts import ODD, documents

SF = "/root/testdata/sf0.001"


def stages(spark, docs):
    out, run = [], uuid.uuid4().hex
    for name, f in corpus_pipeline.STAGES:
        path = f"{shared_dir(spark)}/test-{run}-{name}"
        f(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good, known, single, cut, packed = stages(spark, docs)
    assert all(d.columns == docs.columns for d in (good, known, single, cut))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(brute.quality(r.text)[-1] is False and r.text == texts[r.doc_id] for r in good.collect())
    assert known.count() == good.count()
    rows = known.collect()
    sets = {r.doc_id: brute.shingles(r.text, 5) for r in rows}
    links = [(i, j) for i, j in combinations(sets, 2) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    parts = brute.components(sets, links)
    assert {r.doc_id for r in single.collect()} == {i for i, c in parts.items() if i == c}
    left = [(r.doc_id, r.text) for r in cut.collect()]
    assert not exact_repeats(left)[0]
    assert {r.doc_id for r in single.collect()} == {i for i, _ in left}
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    check_packing(packed.collect(), dict(left), 2048)


def test_whole_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_odd_documents(spark):
    docs = documents(spark, [*ODD, *ODD[:3]])
    good, known, single, cut, packed = stages(spark, docs)
    assert all(d.columns == docs.columns and d.count() <= docs.count() for d in (good, known, single, cut))
    assert stages(spark, docs.limit(0))[-1].count() == 0
