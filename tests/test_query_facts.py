"""Facts by column expressions, against the plain walk over each tree."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from veriframe.operators import querylint
from veriframe.sources import query_ir

from . import plain_query_facts, query_trees


def facts(spark, trees, indent=None, only=query_ir.NAMES):
    rows = [(k, json.dumps(t, indent=indent, ensure_ascii=bool(k % 2))) for k, t in enumerate(trees)]
    return query_ir.compile_queries(spark.createDataFrame(rows, "query_id long, tree string").repartition(8), only=only)


def classes(joins):
    """Signatures by which earlier join has the same one."""
    seen = [j["signature"] for j in joins]
    return [dict(j, signature=seen.index(j["signature"])) for j in joins]


def vals(fact):
    """Values as they read in JSON, whatever is escaped."""
    for b in fact["branches"]:
        for d in b["predicates"]:
            for p in d:
                p["vals"] = sorted(v if v == "null" else json.dumps(json.loads(v)) for v in p["vals"])
    return fact


@pytest.mark.parametrize(("seed", "indent"), [(1, None), (2, 1)])
def test_facts_are_those_of_the_plain_walk(spark, seed, indent):
    trees = query_trees.trees(300, seed)
    rows = {r.query_id: r.asDict(recursive=True) for r in facts(spark, trees, indent).collect()}
    assert len(rows) == len(trees)
    for k, t in enumerate(trees):
        want, got = vals(plain_query_facts.compile_query(t)), vals(rows[k])
        for name, value in want.items():
            mine = got[name]
            if name == "joins":
                value, mine = classes(value), classes(mine)
            assert mine == value, (name, json.dumps(t))


def wide(n, field="id", extra=None):
    """n disjunctions of two in a conjunction: 2^n branches."""
    parts = [["or", ["==", ["field", 0, field], ["lit", k]], ["==", ["field", 0, f"f{k}"], ["lit", k]]] for k in range(n)]
    return {"from": {"schema": "Post"}, "wheres": [{"op": "and", "expr": ["and", *parts, *(extra or [])]}]}


def test_facts_beyond_the_limit(spark):
    left = {"joins": [{"qual": "left", "schema": "Author"}]}
    trees = [wide(11), wide(13), wide(13, extra=[["in", ["field", 0, "day"], []], ["==", ["field", 1, "id"], ["lit", 3]]]) | left, {"from": {"subquery": wide(10)}, "wheres": wide(4)["wheres"]}]
    rows = {r.query_id: r.asDict(recursive=True) for r in facts(spark, trees, only=("branches", "over_limit", "keys_over")).collect()}
    for k, t in enumerate(trees):
        want, got = vals(plain_query_facts.compile_query(t)), vals(rows[k])
        assert (got["over_limit"], got["keys_over"]) == (want["over_limit"], want["keys_over"])
        for name in ("predicates", "mentions", "rejects"):
            assert got["branches"][0][name] == want["branches"][0][name], (k, name)
        assert sorted(map(sorted, got["branches"][0]["keys"])) == sorted(map(sorted, want["branches"][0]["keys"]))
    assert [rows[k]["over_limit"] for k in range(4)] == [False, True, True, False]


def test_depth_against_recursive_sql(spark):
    """Queries within queries at depth 1 to 20, counted by DuckDB's recursion over the same trees."""
    trees = [query_trees.deep(n) for n in range(1, 21)]
    table = facts(spark, trees, only=("operation", "schema", "table_name", "db_schema", "units"))
    got = {r.query_id: (r.n, r.schema) for r in table.selectExpr("query_id", "size(units) AS n", "schema").collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (query_id BIGINT, tree JSON)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [(k, json.dumps(t)) for k, t in enumerate(trees)])
    want = con.execute("""WITH RECURSIVE r(query_id, q) AS (SELECT query_id, tree FROM t UNION ALL SELECT query_id, q->'from'->'subquery' FROM r WHERE (q->'from'->'subquery') IS NOT NULL)
SELECT query_id, count(*), max((q->'from')->>'schema') FROM r GROUP BY 1""").fetchall()
    assert got == {k: (n, s) for k, n, s in want}
    for check in ("offset_without_limit", "required_order"):
        assert querylint.validate(querylint.Queries(table), [check]).count() == 20


def test_signatures_are_equal_where_normalized_trees_are(spark):
    on = lambda k, flip=False: ["and", *[["==", *(x[::-1] if flip else x)] for x in ([["field", 0, "id"], ["field", k, "id"]], [["field", k, "day"], ["lit", 1]])][:: -1 if flip else 1]]
    one = lambda k, flip=False, **more: {"qual": "inner", "schema": "Author", "on": on(k, flip)} | more
    joins = [one(1), one(2, True), one(3, qual="left"), one(4), one(5, assoc="x")]
    where = [{"op": "and", "expr": ["and", ["==", ["field", 4, "title"], ["lit", "x"]], ["==", ["field", 0, "title"], ["lit", "x"]]]}]
    row = facts(spark, [{"from": {"schema": "Post"}, "joins": joins, "wheres": where}], only=["joins"]).first()
    assert [j["signature"] for j in classes([j.asDict() for j in row.joins])] == [0, 0, 2, 3, 4]


def test_no_python_and_only_what_a_check_reads(spark):
    trees = spark.createDataFrame([(1, json.dumps(query_trees.deep(2)))], "query_id long, tree string")
    fields = spark.createDataFrame([("Post", "id", "id", "id", True)], "schema string, field string, column_name string, type string, is_pk boolean")
    related = spark.createDataFrame([("Post", "author", "Author", False)], "schema string, name string, related string, filtered boolean")
    options = {"mandatory_join_keys": {"keys": ["id"]}, "mandatory_where_keys": {"rules": {"fields": ["id"]}}, "explicit_visibility_predicates": {"rules": {"fields": ["id"]}}}
    for check in querylint.CHECKS:
        table = query_ir.compile_queries(trees, only=querylint.READS[check])
        plan = querylint.validate(querylint.Queries(table, fields, related), [(check, options.get(check, {}))])._jdf.queryExecution().executedPlan().toString()
        for node in ("Python", "Arrow", "Pandas"):
            assert node not in plan, check


def test_trees_that_cannot_be_read(spark):
    for bad in (None, "{", "[1"):
        with pytest.raises(Exception, match="null|MALFORMED|malformed"):
            query_ir.compile_queries(spark.createDataFrame([(1, bad)], "query_id long, tree string"), only=["bounded"]).collect()
    assert query_ir.compile_queries(spark.createDataFrame([], "query_id long, tree string"), only=["units"]).count() == 0


def test_one_tree_in_several_tasks(spark):
    """Queries that all have one tree don't meet its facts in one task."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        trees = spark.createDataFrame([(k, '{"operation":"stream","from":{"schema":"Post"}}') for k in range(4000)], "query_id long, tree string")
        rows = query_ir.compile_queries(trees, only=["operation", "schema"]).groupBy(F.spark_partition_id().alias("task"), "operation", "schema").agg(F.count("*").alias("n"), F.count_distinct("query_id").alias("ids")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r.n for r in rows) == sum(r.ids for r in rows) == 4000 and {(r.operation, r.schema) for r in rows} == {("stream", "Post")}
    assert max(r.n for r in rows) < 2000


def test_duplicate_joins_stay_in_their_rows(spark):
    """The first of equal joins is told from the query's own row, without a shuffle of its joins."""
    join = lambda alias: {"qual": "inner", "schema": "Author", "as": alias}
    trees = [{"from": {"schema": "Post"}, "joins": [join("a"), join("b") | {"qual": "left"}, join("a"), join("b") | {"qual": "left"}, join("a")]}, {"from": {"schema": "Post"}}]
    table = facts(spark, trees, only=querylint.READS["duplicate_joins"]).localCheckpoint()
    issues = querylint.duplicate_joins(querylint.Queries(table, None, None, None), {})
    assert sorted((r.subject_order, r.seq, json.loads(r.meta)["original"]) for r in issues.collect()) == [(0, 2, 0), (0, 3, 1), (0, 4, 0)]
    assert "Exchange" not in issues._jdf.queryExecution().executedPlan().toString()


def test_associations_come_to_the_joins(spark):
    """Joins with one pair of schemas don't meet in one task, even where Spark broadcasts nothing by itself."""
    table = facts(spark, [{"from": {"schema": "Post"}, "joins": [{"qual": "inner", "schema": "Author"}]}] * 3, only=querylint.READS["manual_join_instead_of_assoc"]).localCheckpoint()
    related = spark.createDataFrame([("Post", "author", "Author", False)], "schema string, name string, related string, filtered boolean")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        issues = querylint.manual_join_instead_of_assoc(querylint.Queries(table, None, related, None), {})
        assert issues.count() == 3 and "SortMergeJoin" not in issues._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
