import pytest

from veriframe.operators import catalog as cat
from veriframe.sources import postgres, targets

from .test_catalog import column, fk, index, reader, table

NAMES = {text: name for name, text in postgres.SQL.items()}


class Cursor:
    """Answers the catalog's queries for a target ``db<n>``: n tables, every third target without an index."""

    def __init__(self, target):
        self.target, self.rows, self.description = target, [], None

    def execute(self, sql):
        name = NAMES[sql]
        if self.target.startswith("late") and name == "indexes":
            raise TimeoutError("took too long")
        if self.target.startswith("only_indexes") and name != "indexes":
            raise AssertionError(f"asked for {name}")
        n = int("".join(c for c in self.target if c.isdigit()) or 0)
        self.rows = answers(n)[name]
        fields = [c.split()[0] for c in cat.SCHEMAS[name].split(", ")[1:]]
        self.description = [(f, None) for f in ("further", *reversed(fields))]
        self.rows = [("x", *reversed(r)) for r in self.rows]

    def fetchmany(self, size):
        found, self.rows = self.rows[:size], self.rows[size:]
        return found

    def close(self):
        pass


class Connection:
    def __init__(self, target):
        if target.startswith("down"):
            raise ConnectionError("no server")
        self.target = target

    def cursor(self):
        return Cursor(self.target)

    def close(self):
        pass


def answers(n):
    tables = [f"t{k}" for k in range(n % 4)]
    return {
        "tables": [table(t) for t in tables],
        "columns": [column(t, "user_id") for t in tables],
        "constraints": [fk(t, f"{t}_fk", ["user_id"]) for t in tables],
        "indexes": [index(t, f"{t}_i", ["user_id"]) for t in tables if n % 3],
    }


def test_same_as_one_by_one(spark):
    names = [f"db{n}" for n in range(9)]
    specs = ["missing_foreign_key_indexes", "missing_foreign_key_constraints", ("primary_key_type", {"rules": {"types": ["bigint"]}})]
    want = postgres.validate(spark, {t: reader(spark, **answers(n)) for n, t in enumerate(names)}, specs)
    got = targets.validate(spark, names + names[:2], Connection, specs)
    assert got.schema.simpleString() == want.schema.simpleString()
    order = lambda df: sorted(map(str, df.collect()))
    assert order(got) == order(want) != []


def test_many_targets_in_one_scan(spark):
    names = [f"db{n}" for n in range(1000)] + ["down", "late7"]
    found = targets.scan(spark, names, Connection)
    assert found.rdd.getNumPartitions() == 1002
    assert "BatchScan" in found._jdf.queryExecution().executedPlan().toString()
    rows = targets.validate(spark, names, Connection, ["missing_foreign_key_indexes"]).collect()
    assert {(r.target, r.message) for r in rows if r.code == "unreadable"} == {("down", "ConnectionError: no server"), ("late7", "TimeoutError: took too long")}
    # what a target gave before it failed isn't audited
    assert {r.target for r in rows if r.code != "unreadable"} == {f"db{n}" for n in range(1000) if n % 4 and n % 3 == 0}


def test_pushed_conditions(spark):
    found = targets.scan(spark, ["db3", "only_indexes7", "down", "db5"], Connection)
    own = found.where("part = 'indexes' AND target IN ('only_indexes7', 'db5')")
    assert own.rdd.getNumPartitions() == 2
    assert sorted((r.target, r.indexes.index_name) for r in own.collect()) == [("db5", "t0_i")] + [("only_indexes7", f"t{k}_i") for k in range(3)]
    assert found.where("target = 'nobody'").count() == 0
    assert [r.target for r in found.where("part = 'error'").select("target").collect() if r.target != "only_indexes7"] == ["down"]


def test_no_targets(spark):
    with pytest.raises(ValueError, match="targets"):
        targets.load(spark, [], Connection)
