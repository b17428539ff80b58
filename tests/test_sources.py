import json

import pytest

from veriframe.operators import querylint
from veriframe.operators import source as src
from veriframe.plans.queries import query_facts
from veriframe.sources import elixir
from veriframe.sources.code import Source, show

from .plain_query_facts import boundedness, branches, compile_query

LIT = lambda v: ["lit", v]


@pytest.mark.parametrize(
    ("wheres", "want"),
    [
        ([], "unrestricting"),
        ([("and", LIT(True))], "unrestricting"),
        ([("and", LIT(False))], "empty"),
        ([("and", ["not", LIT(True)])], "empty"),
        ([("and", ["field", 0, "a"])], "restricting"),
        ([("and", ["or", ["field", 0, "a"], LIT(True)])], "unrestricting"),
        ([("and", ["and", ["field", 0, "a"], LIT(False)])], "empty"),
        ([("or", LIT(False)), ("or", ["field", 0, "a"])], "restricting"),
        ([("and", ["field", 0, "a"]), ("or", LIT(True))], "unrestricting"),
    ],
)
def test_boundedness(wheres, want):
    assert boundedness([{"op": op, "expr": e} for op, e in wheres]) == want


def test_branch_laws():
    leaf = lambda e, neg: [f"{'!' if neg else ''}{e}"]
    assert branches(["and", ["or", "a", "b"], "c"], leaf) == [["a", "c"], ["b", "c"]]
    assert branches(["not", ["or", "a", ["not", "b"]]], leaf) == [["!a", "b"]]
    assert branches(["not", ["and", "a", "b"]], leaf) == [["!a"], ["!b"]]


def test_too_many_branches(spark):
    wide = ["or", *[["==", ["field", 0, "title"], ["lit", str(k)]] for k in range(20)]]
    tree = {"from": {"schema": "Post", "table": "posts", "as": "p"}, "wheres": [{"op": "and", "expr": wide}] * 4}
    assert compile_query(tree)["over_limit"]
    q = query_facts(spark, spark.createDataFrame([(1, json.dumps(tree))], "query_id long, tree string"), reads("conflicting_where_predicates"))
    assert [r.code for r in querylint.validate(q, ["conflicting_where_predicates"]).collect()] == ["analysis-limit"]


def reads(*specs):
    return [c for s in specs for c in querylint.READS[s if isinstance(s, str) else s[0]]]


def lint(spark, tree, *specs):
    q = query_facts(spark, spark.createDataFrame([(1, json.dumps({"from": {"schema": "Post", "table": "posts", "prefix": "app", "as": "p"}} | tree))], "query_id long, tree string"), reads(*specs))
    return [(r.check, r.code, json.loads(r.meta or "{}")) for r in querylint.validate(q, specs).collect()]


def test_checks_beyond_the_branch_limit(spark):
    eq = lambda f, v=1, b=0: ["==", ["field", b, f], ["lit", v]]
    wide = [{"op": "and", "expr": ["or", eq(f"a{k}"), eq(f"b{k}")]} for k in range(13)]
    other = [{"op": "and", "expr": ["or", eq("tenant_id"), ["and", eq("tenant_id", 2), eq("z")]]}]
    left = {"joins": [{"qual": "left", "as": "c", "table": "c", "on": eq("id", 1, 1)}]}
    keys = lambda *f, **how: ("mandatory_where_keys", {"rules": {"fields": list(f)} | how})
    assert compile_query({"from": {"schema": "Post"}, "wheres": wide})["over_limit"]

    def codes(wheres, spec, more=None):
        facts = query_facts(spark, spark.createDataFrame([(1, json.dumps({"from": {"schema": "S", "table": "s"}, "wheres": wheres} | (more or {})))], "query_id long, tree string"), reads(spec)).facts
        fields = spark.createDataFrame([("S", f, f, "string", False) for f in ("deleted_at", "tenant_id", "x")], "schema string, field string, column_name string, type string, is_pk boolean")
        return [(r.code, json.loads(r.meta or "{}").get("field")) for r in querylint.validate(querylint.Queries(facts, fields), [spec]).collect()]

    assert codes(wide, "hard_delete_on_soft_delete_schema", {"operation": "delete_all"}) == [("hard_delete", "deleted_at")]
    assert codes(wide, "empty_in_predicates") == []
    assert codes([*wide, {"op": "and", "expr": ["in", ["field", 0, "x"], []]}], "empty_in_predicates") == [("empty_in", "x")]
    assert codes(wide, keys("tenant_id", match="all")) == [("missing_where_key", None)]
    assert codes(wide + other, keys("tenant_id", match="all")) == [] == codes(wide + other, keys("tenant_id", "x"))
    assert codes(wide, keys("tenant_id")) == [("analysis-limit", None)]
    few = [{"op": "and", "expr": ["or", eq("x"), eq("tenant_id")]}] * 13
    assert codes(few, keys("tenant_id", "x")) == [] and codes(few, keys("tenant_id")) == [("missing_where_key", None)]
    seen = ("explicit_visibility_predicates", {"rules": {"fields": ["tenant_id", "x"]}})
    assert codes(wide + other, seen) == [("missing_visibility", "x")]
    assert codes(wide, "left_join_where_predicates", left) == []
    assert codes([*wide, {"op": "and", "expr": ["or", eq("p", 1, 1), eq("q", 1, 1)]}], "left_join_where_predicates", left) == [("left_join_rejected", None)]


def test_nested_queries(spark):
    inner = {"from": {"table": "b", "as": "b"}, "limit": ["lit", 3], "offset": ["param", None]}
    assert lint(spark, {"ctes": [{"name": "c", "query": inner}]}, "required_order") == [("required_order", "missing_order", {"reasons": ["limit", "offset"]})]
    assert lint(spark, {"combinations": [{"op": "union", "query": inner | {"offset": ["lit", 1], "limit": None}}]}, "offset_without_limit") != []
    lateral = {"joins": [{"qual": "inner_lateral", "as": "l", "on": ["lit", True], "subquery": {"from": {"table": "b", "as": "b"}, "wheres": [{"op": "and", "expr": ["==", ["field", 0, "id"], ["parent", "id"]]}]}}]}
    assert lint(spark, lateral, "cartesian_joins") == []
    lateral["joins"][0]["subquery"]["wheres"] = []
    assert len(lint(spark, lateral, "cartesian_joins")) == 1


def test_scopes_and_branches(spark):
    where = lambda f: [{"op": "and", "expr": ["==", ["field", "p", f], ["lit", 1]]}]
    other = {"from": {"schema": "Post", "table": "posts", "as": "p"}, "wheres": where("title")}
    rule = {"rules": {"fields": ["tenant_id"], "where": {"tables": "posts"}}}
    tree = {"wheres": where("tenant_id"), "combinations": [{"op": "union", "query": other}]}
    got = lint(spark, tree, ("mandatory_where_keys", rule))
    assert got == [("mandatory_where_keys", "missing_where_key", {"keys": ["tenant_id"], "branch": "union:0"})]
    assert lint(spark, tree, ("mandatory_where_keys", {"rules": {"fields": ["tenant_id"], "except": {"tables": "posts"}}})) == []
    sub = {"from": {"subquery": {"from": {"schema": "Post", "table": "posts", "as": "p"}, "wheres": where("tenant_id")}, "as": "s"}}
    assert lint(spark, sub, ("mandatory_where_keys", rule)) == []


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ("a |> b(1) |> C.d()", "|>(|>(a,b(1)),.(__aliases__('C'),:d)())"),
        ("f x, y: 1, z: 2", "f(x,[{:y,1},{:z,2}])"),
        ("not a in b", "not(in(a,b))"),
        ("a not in b", "not(in(a,b))"),
        ("%S{a | b: 1}", "%(__aliases__('S'),%{}(|(a,[{:b,1}])))"),
        ("&(&1 + 1)", "&(+(&(1),1))"),
        ("x = fn a, b -> a\n  c -> c end", "=(x,fn(->([a,b],a),->([c],c)))"),
        ("@spec f(a :: t()) :: b | c", "@(spec(::(f(::(a,t())),|(b,c))))"),
        ('"a#{b <> "}"}c"', '"a#{<>(b,"}")}c"'),
        ("a[:b].c", ".(access(a,:b),:c)()"),
        ("<<x::8, y::binary>>", "<<>>(::(x,8),::(y,binary))"),
        ("foo\n|> bar", "|>(foo,bar)"),
        ("-1 + f -1", "+(-(1),f(-(1)))"),
    ],
)
def test_elixir_reader(code, want):
    got = show(elixir.parse(code)[0])
    assert got.replace("__aliases__(C)", "__aliases__('C')") == want


def test_unreadable_source_gives_nothing(spark):
    files = spark.createDataFrame([("a.ex", "def f( do"), ("b.ex", None), ("c_test.exs", ")")], "file string, content string")
    assert src.validate(files, ["elixir.no_raise", "elixir.no_then"]).count() == 0


CODE = """defmodule A do
  # checks:disable-for-next-definition elixir.no_then
  def f(x) do
    then(x, &g/1)
    raise "no"
  end

  # checks:disable-for-next-definition
  def g(x) do
    raise "no"
  end

  def h(x), do: then(x, &g/1)
  # checks:disable-for-next-definition
end

defmodule B do
  def f(x), do: raise("no")
end
"""


def test_suppression(spark):
    files = spark.createDataFrame([("a.ex", CODE)], "file string, content string")
    rows = src.validate(files, ["elixir.no_then", "elixir.no_raise"]).collect()
    assert sorted((r.check, json.loads(r.meta)["line"]) for r in rows) == [("elixir.no_raise", 5), ("elixir.no_raise", 18), ("elixir.no_then", 13)]


def test_template_positions():
    t = Source("a.heex", '<div\n  class="x"\n>{@a}<!-- <b> --><.c /></div>').templates[0]
    assert [(type(x).__name__, x.line, x.column) for x in t.tokens] == [("Tag", 1, 1), ("Expression", 3, 2), ("Tag", 3, 18), ("Close", 3, 24)]
    assert (t.tags[0].attrs[0].line, t.tags[0].attrs[0].column) == (2, 3)


def test_reading_files(spark, tmp_path):
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib/a.ex").write_text("x |> then(&f/1)")
    (tmp_path / "lib/b.heex").write_text("<img>")
    (tmp_path / "lib/c.txt").write_text("no")
    files = src.read_files(spark, str(tmp_path))
    assert sorted(r.file.rsplit("/", 1)[-1] for r in files.collect()) == ["a.ex", "b.heex"]
    assert sorted(r.code for r in src.validate(files, ["elixir.no_then", "heex.require_image_alt"]).collect()) == ["elixir.no_then", "heex.require_image_alt"]


def test_every_text_has_its_issues_at_their_places():
    """All texts of the source queries, with lines and columns written down beside them."""
    from veriframe.operators.source import CHECKS, _sorted
    from veriframe.plans import source_queries as q
    from veriframe.sources.code import Source

    assert set(q.EXAMPLES) == set(q.PLACES) == set(CHECKS) and set(q.MORE) <= set(CHECKS)
    for check, e in q.EXAMPLES.items():
        for file, text, places in q.variants(check):
            found = _sorted(CHECKS[check].run(Source(file.replace("{n}", "4"), text), e.options))
            assert " ".join(f"{line}:{column}" for (line, column), _ in found) == places, (check, text)


def test_unclosed_templates_have_no_tokens():
    from veriframe.sources import templates

    for text in ('<p class="a"', "<p class='a>", "<p {@x", "{@x", "<!-- x", "<%= x", "</p", '<p id={%{a: "}"}'):
        assert templates.read(text).tokens == [], text
    assert len(templates.read('<p id={%{a: "}"}}>x</p>').tokens) == 3
