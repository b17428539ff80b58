import re

import pytest
from pyspark.sql import functions as F

from veriframe.functions.scope import predicate, rules_of
from veriframe.plans import contract as c


def one(df, o):
    return df.select(F.col("id").cast("string").alias("subject"), F.lit("bad").alias("message"))


def test_specs():
    assert [s.name for s in c.normalize(["a", ("b", {"x": 1})])] == ["a", "b"]
    with pytest.raises(ValueError, match="twice"):
        c.normalize(["a", "a"])
    assert len(c.normalize(["a", "a"], unique=False)) == 2
    with pytest.raises(ValueError, match="unknown"):
        c.normalize(["z"], {"a": one})
    with pytest.raises(ValueError, match="mapping"):
        c.CheckSpec("a", [1])


def test_overrides():
    base = ["a", ("b", {"x": 1, "y": 2})]
    assert c.with_overrides(base, False) == []
    assert c.with_overrides(base, None) == c.normalize(base)
    got = c.with_overrides(base, [("c", {}), ("b", {"z": 3})])
    assert [(s.name, dict(s.options)) for s in got] == [("a", {}), ("b", {"z": 3}), ("c", {})]


def test_run_and_guard(spark):
    df = spark.range(3)
    issues = c.run("f", df, ["one", ("two", {"validate": False})], {"one": one, "two": one}, spark)
    assert [(f.name, f.dataType) for f in issues.schema] == [(f.name, f.dataType) for f in c.ISSUES] and issues.count() == 3
    assert c.run("f", df, [], {}, spark).count() == 0
    for wrong in (lambda d, o: [1], lambda d, o: d.select(F.lit(1).alias("extra")), lambda d, o: d.select(F.lit(1).alias("message"))):
        with pytest.raises(c.ContractError):
            c.run("f", df, ["w"], {"w": wrong}, spark)


def test_reports(spark):
    issues = c.run("f", spark.range(2), ["one"], {"one": one}, spark)
    assert [r.text for r in c.format_many(issues).orderBy("subject").collect()] == ["one: bad", "one: bad"]
    with pytest.raises(c.IssuesFound, match="one: bad"):
        c.assert_no_issues(issues)
    c.assert_no_issues(issues.limit(0))
    assert [r.subject for r in c.ordered(issues).collect()] == ["0", "1"]


@pytest.mark.parametrize(
    ("rule", "want"),
    [
        ({}, {1, 2, 3, 4}),
        ({"where": {"s": "app"}}, {1, 2}),
        ({"where": {"s": re.compile("p")}}, {1, 2, 3}),
        ({"where": {"s": ["x", re.compile("^pub")]}}, {3}),
        ({"where": [{"s": "app", "t": "b"}, {"s": "public"}]}, {2, 3}),
        ({"except": {"s": "app"}}, {3, 4}),
        ({"where": {"s": "app"}, "except": {"t": "b"}}, {1}),
        ({"where": {"cols": "k"}}, {1, 3}),
        ({"except": {"cols": re.compile("k")}}, {2, 4}),
    ],
)
def test_scope_truth_table(spark, rule, want):
    df = spark.createDataFrame([(1, "app", "a", ["k", "l"]), (2, "app", "b", []), (3, "public", None, ["k"]), (4, None, "a", None)], "id int, s string, t string, cols array<string>")
    keys = {"s": "s", "t": "t", "cols": "cols"}
    assert {r.id for r in df.where(predicate(rule, keys, ["cols"])).collect()} == want


def test_scope_errors():
    for rule in ({"where": {"z": "x"}}, {"where": []}, {"where": {"s": 1.5j}}, {"where": {"s": []}}):
        with pytest.raises(ValueError):
            predicate(rule, {"s": "s"})
    with pytest.raises(ValueError, match="required"):
        rules_of({}, ("a",), default=False)
    with pytest.raises(ValueError, match="unknown"):
        rules_of({"rules": {"b": 1}}, ("a",))
    with pytest.raises(ValueError, match="required"):
        rules_of({"rules": [{"where": {"s": "x"}}]}, ("a",), required=("a",))
    assert rules_of({"rules": [{"a": 1}, {"a": 2, "validate": False}]}, ("a",)) == [{"a": 1}]
