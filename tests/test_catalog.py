import random
import re

import pytest

from veriframe.operators import catalog as cat
from veriframe.sources import postgres

EMPTY = {"indexes": [], "constraints": [], "columns": [], "tables": []}


def reader(spark, **rows):
    """Rows without the target."""

    def read(name):
        schema = cat.SCHEMAS[name].split(", ", 1)[1]
        return spark.createDataFrame(rows.get(name, []), schema)

    return read


def index(table, name, cols, n=None, unique=False, valid=True, predicate=None, primary=False):
    return ("app", table, name, "btree", unique, valid, primary, True, True, True, False, n or len(cols), cols, ["o"], [True] * len(cols), ["c"], [True] * len(cols), [0], None, predicate)


def fk(table, name, cols, ref="users", ref_cols=("id",), delete="a", update="a"):
    return ("app", table, name, "f", list(cols), "app", ref, list(ref_cols), delete, update)


def column(table, name, at=1, kind="bigint", firm=True):
    return ("app", table, name, at, kind, firm)


def issues(spark, specs, **rows):
    found = postgres.validate(spark, {"db": reader(spark, **rows)}, specs)
    return sorted((r.subject, r.code) for r in found.collect())


def table(name, kind="r"):
    return ("app", name, kind, True)


def test_foreign_key_indexes(spark):
    keys = [fk(t, f"{t}_fk", c) for t, c in (("plain", ["a"]), ("swapped", ["a", "b"]), ("partial", ["a"]), ("late", ["a"]), ("included", ["a", "b"]), ("broken", ["a"]))]
    indexes = [index("plain", "i", ["a"]), index("swapped", "i", ["b", "a"]), index("partial", "i", ["a"], predicate="x"), index("late", "i", ["s", "a"]), index("included", "i", ["a", "b"], n=1), index("broken", "i", ["a"], valid=False)]
    got = issues(spark, ["missing_foreign_key_indexes"], constraints=keys, indexes=indexes)
    assert got == [(f"app.{t}", "missing_foreign_key_index") for t in ("broken", "included", "late", "partial")]


def test_primary_keys_with_several_rules(spark):
    rows = {
        "tables": [table(t) for t in ("a", "b", "c")] + [table("v", "v")],
        "columns": [column("a", "id", kind="uuid"), column("b", "id", kind="integer")],
        "constraints": [("app", t, f"{t}_pkey", "p", ["id"], None, None, None, None, None) for t in ("a", "b")],
    }
    assert issues(spark, [("primary_key_type", {"rules": {"types": ["uuid"]}})], **rows) == [("app.b", "wrong_type"), ("app.c", "missing_primary_key")]
    both = {"rules": [{"types": ["uuid"]}, {"types": ["integer"], "where": {"tables": "b"}}]}
    assert issues(spark, [("primary_key_type", both)], **rows) == [("app.c", "missing_primary_key")]
    # a missing key has no column, so a matcher on columns never selects it
    assert issues(spark, [("primary_key_type", {"rules": {"types": ["uuid"], "where": {"columns": re.compile(".")}}})], **rows) == [("app.b", "wrong_type")]


def test_actions_and_rules(spark):
    keys = [fk("m", "m_fk", ["user_id"], delete="c", update="r")]
    rule = {"on_delete": "restrict", "on_update": "restrict", "where": {"referenced_tables": "users", "columns": ["user_id"]}}
    assert issues(spark, [("foreign_key_actions", {"rules": rule})], constraints=keys) == [("app.m", "on_delete")]
    assert issues(spark, [("foreign_key_actions", {"rules": rule | {"except": {"constraints": re.compile("^m")}}})], constraints=keys) == []
    for bad in ({"rules": {"where": {"tables": "m"}}}, {"rules": {"on_delete": "explode"}}, {}):
        with pytest.raises(ValueError):
            issues(spark, [("foreign_key_actions", bad)], constraints=keys)


def test_types_and_columns(spark):
    rows = {"tables": [table("t")], "columns": [column("t", "a", 1, "json"), column("t", "b", 2, "character(8)"), column("t", "user_id", 3)]}
    rule = {"rules": {"types": [{"type": "json", "prefer": "jsonb", "reason": "no index"}, re.compile("^char")]}}
    found = postgres.validate(spark, {"db": reader(spark, **rows)}, [("forbidden_column_types", rule)]).orderBy("seq").collect()
    assert [r.message for r in found] == ["app.t.a has the forbidden type json; prefer jsonb: no index", "app.t.b has the forbidden type character(8)"]
    got = issues(spark, ["missing_foreign_key_constraints", ("required_columns", {"rules": {"columns": ["a", "z"]}})], **rows)
    assert got == [("app.t", "missing_columns"), ("app.t", "missing_foreign_key")]


def test_unreadable_targets(spark):
    def broken(name):
        raise ConnectionError("no server")

    good = reader(spark, tables=[table("t")])
    rows = postgres.validate(spark, {"one": good, "two": broken}, [("primary_key_type", {"rules": {"types": ["bigint"]}})]).collect()
    assert sorted((r.target, r.code) for r in rows) == [("one", "missing_primary_key"), ("two", "unreadable")]
    with pytest.raises(ValueError, match="targets"):
        postgres.load(spark, {})


def test_options(spark):
    whole, _ = postgres.load(spark, {"db": reader(spark)})
    with pytest.raises(ValueError, match="true or false"):
        cat.validate(whole, [("duplicate_indexes", {"validate": 1})])
    assert cat.validate(whole, [("duplicate_indexes", {"validate": False}), "duplicate_indexes"]).count() == 0
    with pytest.raises(ValueError, match="paths or modules"):
        cat.validate(whole, [("changeset_check_constraints", {})])


@pytest.mark.parametrize("kind", ["unique", "foreign_key", "check"])
def test_handled_constraints(spark, kind):
    rng = random.Random(kind)
    word = lambda n: "".join(rng.choice("ab_") for _ in range(rng.randrange(n + 1)))
    places = [("db", "M", f"f{k}", 1) for k in range(12)] + [("other", None, "f0", 1)]
    rows = [(*p, t, f"{t}_{word(3)}{rng.choice(['_index', '_fkey', ''])}") for p in places for t in ("t", "a_b") for _ in range(6)]
    rows += [(*places[0], "t", None), rows[0], (*places[1], "t", "t_index"), (*places[2], "é", "é_a_index")]
    calls = []
    for p in places:
        for _ in range(rng.randrange(4)):
            how = rng.choice([None, "exact", "prefix", "suffix", "regex"])
            given = rng.choice([None, word(3), "t_" + word(2), word(2) + "_index", rng.choice(rows)[5]])
            calls.append((*p, kind, rng.choice([None, ["a"], ["a", "b"], [], ["", None]]), "^" + given if given and how == "regex" else given, how))

    def handles(row, call):
        if row[:4] != call[:4] or None in row[:4] or row[5] is None:
            return False
        fields, given, how = call[5:]
        if given is None:
            if kind == "check" or fields is None or (kind == "foreign_key" and (not fields or fields[0] is None)):
                return False
            part = "_".join(f for f in fields if f is not None) if kind == "unique" else fields[0]
            return row[5] == f"{row[4]}_{part}{cat.SUFFIX[kind]}"
        return {"prefix": row[5].startswith, "suffix": row[5].endswith, "regex": lambda g: bool(re.search(g, row[5]))}.get(how, row[5].__eq__)(given)

    df = spark.createDataFrame(rows, "target string, module string, function string, arity int, table_name string, name string")
    made = spark.createDataFrame(calls, cat.SCHEMAS["calls"])
    got = cat._unhandled(df, made, kind)
    want = [r for r in rows if not any(handles(r, c) for c in calls)]
    assert 0 < len(want) < len(rows)
    order = lambda v: sorted(map(str, v))
    assert order(tuple(r) for r in got.select(df.columns).collect()) == order(want)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
