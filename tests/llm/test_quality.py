from veriframe.llm import quality_rules

from . import brute
from .texts import ODD, documents

SF = "/root/testdata/sf0.001"


def check(judged, texts):
    rows = {r.doc_id: r for r in judged.collect()}
    assert set(rows) == set(texts)
    for i, t in texts.items():
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(t), i
        assert not (r.base_failed and r.kept)
    return rows


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(quality_rules.apply(docs), {r.doc_id: r.text for r in docs.collect()})


def test_odd_texts(spark):
    docs = documents(spark)
    rows = check(quality_rules.apply(docs), dict(enumerate(ODD)))
    assert not rows[0].kept and rows[0].rejected_by == "base"
    assert quality_rules.apply(docs.limit(0)).count() == 0
    assert quality_rules.apply(docs.union(docs)).count() == 2 * len(ODD)


def test_verdict_does_not_depend_on_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rules = quality_rules.QualityRules()
    a = {r.doc_id: r.kept for r in quality_rules.apply(docs, rules, rules.rules()).collect()}
    b = {r.doc_id: r.kept for r in quality_rules.apply(docs, rules, rules.rules()[::-1]).collect()}
    assert a == b


def test_labelled_good_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_rules.apply(docs).join(labels, "doc_id").select("quality", "kept", "base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.99 * len(good)
    assert sum(bad) <= 0.5 * len(bad)


def test_plan_uses_no_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = quality_rules.apply(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_columns_with_names_used_inside(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 AS _words", "2 AS _lines", "3 AS _windows", "4 AS _row", "5 AS rejected_by")
    judged = quality_rules.apply(docs)
    assert {"_words", "_lines", "_windows", "_row"} <= set(judged.columns)
    good = quality_rules.keep_good(docs)
    assert good.columns == docs.columns and good.where("_words = 1 and _row = 4 and rejected_by = 5").count() == good.count()
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in judged.where("kept").select("doc_id").collect())


def test_order_by_rejection_per_cost(spark):
    """A rule that rejects most and costs little comes first, one that rejects nothing last."""
    docs = spark.createDataFrame([(k, "### " * 60 if k % 2 else "plain words of a text " * 20) for k in range(400)], "doc_id long, text string")
    order = [r.name for r in quality_rules.plan(docs, quality_rules.QualityRules())]
    assert set(order) == {"symbols", "mean_word", "dup_lines", "alpha_words", "upper_case"}
    assert order.index("symbols") < order.index("upper_case") and order.index("alpha_words") < order.index("dup_lines")
