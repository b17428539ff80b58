"""A query for each check over the driver's tables, with the same result in plain SQL.

The tables hold no catalogs, queries or layouts, so subjects are derived from them by expressions that both engines
evaluate alike: pages get markup put in front of them, orders become snapshots with a rectangle for each line, parts
become tables of a catalog, and orders become query trees.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, html, layout, querylint
from ..sources.query_ir import NAMES, compile_queries
from ..streaming import readiness

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = run, sql


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# HTML: markup in front of each page, some of it wrong.

MARKUP = """concat('<div>',
  CASE WHEN page_id % 3 = 0 THEN '<img src="a.png">' ELSE '<img src="a.png" alt="">' END,
  CASE WHEN page_id % 4 = 0 THEN '<button>Go</button>' WHEN page_id % 4 = 1 THEN '<button type=" Submit ">Go</button>' ELSE '<button type="go">Go</button>' END,
  CASE WHEN page_id % 5 = 0 THEN '<input name="q">' WHEN page_id % 5 = 1 THEN '<input type="hidden" name="q">' ELSE '<input type="email" autocomplete="email">' END,
  CASE WHEN page_id % 6 = 0 THEN '<a>x</a><a name="y">y</a>' ELSE '<a href="/x">x</a>' END,
  CASE WHEN page_id % 7 = 0 THEN '<p style="color:red">p</p>' ELSE '<p>p</p>' END,
  CASE WHEN page_id % 8 = 0 THEN '<p class="a" id="i" class="b" id="j">p</p>' ELSE '<p class="a">p</p>' END,
  CASE WHEN page_id % 9 = 0 THEN '<a href=" # " phx-click="act">x</a>' WHEN page_id % 9 = 1 THEN '<a href="JavaScript:void(0);" phx-click="act">x</a>' ELSE '<a href="/y" phx-click="act">x</a>' END,
  CASE WHEN page_id % 10 = 0 THEN '<span phx-click="[[&quot;push&quot;,{}],[&quot;navigate&quot;,{}]]">n</span>' WHEN page_id % 10 = 1 THEN '<span phx-click="[[&quot;push&quot;,{}]]">n</span>' ELSE '<span phx-click="navigate">n</span>' END,
  '</div>', html)"""
#: Start tags of a page and their places, by patterns: comments and what is in scripts don't count.
TAGS = f"""WITH plain AS (SELECT page_id, regexp_replace(regexp_replace({MARKUP}, '(?is)(<script[^>]*>).*?</script>', '\\1', 'g'), '(?s)<!--.*?-->', '', 'g') AS h FROM pages),
tags AS (SELECT page_id, unnest(regexp_extract_all(h, '(?is)<[a-z][^>]*>')) AS snippet, generate_subscripts(regexp_extract_all(h, '(?is)<[a-z][^>]*>'), 1) - 1 AS seq FROM plain)"""


def _tags(where: str, message: str) -> str:
    return f"""{TAGS}
SELECT page_id, CAST(seq AS INTEGER) AS seq, {message} AS message, regexp_extract(snippet, '^<([a-zA-Z0-9]+)', 1) AS tag, snippet FROM tags {where}"""


_HTML_SQL = {
    "no_duplicate_attributes": _tags("""CROSS JOIN (VALUES ('class'), ('id')) names(n) WHERE snippet = '<p class="a" id="i" class="b" id="j">'""", "'<p> has the attribute ' || n || ' more than once'"),
    "no_inline_style": _tags(r"""WHERE regexp_matches(snippet, '(?i)\sstyle\s*=')""", "'<' || regexp_extract(snippet, '^<([a-zA-Z0-9]+)', 1) || '> has an inline style'"),
    "prefer_button_for_action": _tags(r"""WHERE regexp_matches(snippet, '(?i)^<a href="\s*(#|javascript:void\(0\);?)?\s*" phx-click=')""", "'a link that only acts should be a <button>'"),
    "prefer_link_for_navigation": _tags(r"""WHERE regexp_matches(snippet, '^<span phx-click="\[\[.*&quot;navigate&quot;')""", "'navigation should be an <a>; phx-click does navigate on <span>'"),
    "require_button_type": _tags("""WHERE snippet LIKE '<button%' AND NOT regexp_matches(snippet, '(?i)type="[ ]*(button|submit|reset)[ ]*"')""", "'<button> needs a type: button, submit or reset'"),
    "require_image_alt": _tags("""WHERE snippet LIKE '<img%' AND NOT regexp_matches(snippet, '[ ]alt')""", "'<img> needs an alt attribute'"),
    "require_input_autocomplete": _tags("""WHERE snippet LIKE '<input%' AND NOT regexp_matches(snippet, 'type="hidden"|autocomplete="[^" ]+"')""", "'<input> needs an autocomplete attribute'"),
    "require_link_href": _tags("""WHERE regexp_matches(snippet, '^<a( |>)') AND NOT regexp_matches(snippet, '[ ]href')""", "'<a> needs an href attribute'"),
}


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").selectExpr("page_id", f"{MARKUP} AS html")


def _html(check: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        issues = html.validate(marked_pages(spark, sf_dir), [check])
        return issues.select(F.col("subject_order").alias("page_id"), "seq", "message", "tag", "snippet")

    return run


for _check in html.CHECKS:
    _add(f"html_{_check}", _html(_check), _HTML_SQL[_check])


# Layout: an order is a snapshot, its lines are rectangles and the members of one collection.

_LINES = """SELECT l_orderkey AS snapshot_id, l_linenumber AS ix, (l_suppkey % 10) = 0 AS hidden,
  CAST(l_partkey % 97 * 8 AS DOUBLE) AS x, CAST(l_linenumber * 40 AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS width, CAST(l_discount AS DOUBLE) * 100 + 1 AS height FROM lineitem"""
VIEW = (600.0, 240.0)


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Snapshots, targets (item1, item2, ...) and members (of items)."""
    lines = _read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS snapshot_id", "l_linenumber AS ix", "(l_suppkey % 10) = 0 AS hidden", "CAST(l_partkey % 97 * 8 AS DOUBLE) AS x", "CAST(l_linenumber * 40 AS DOUBLE) AS y",
        "CAST(l_quantity AS DOUBLE) AS width", "CAST(l_discount AS DOUBLE) * 100 + 1 AS height",
    )
    views = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("snapshot_id"), F.lit(VIEW[0]).alias("viewport_width"), F.lit(VIEW[1]).alias("viewport_height"))
    targets = lines.withColumn("target", F.concat(F.lit("item"), F.col("ix").cast("string"))).groupBy("snapshot_id", "target").agg(
        F.count("*").cast("int").alias("match_count"), *[F.first(c).alias(c) for c in ("hidden", "x", "y", "width", "height")]
    )
    members = lines.withColumn("member_ix", F.row_number().over(_by_line()) - 1).withColumn("target", F.lit("items"))
    return views, targets, members.drop("ix")


def _by_line():
    from pyspark.sql import Window

    # the SQL's order, and what else tells two lines apart: lines that stay equal are the same rectangle
    return Window.partitionBy("snapshot_id").orderBy("ix", "x", "width", "height", "hidden")


_RECT = "l.hidden, l.x, l.y, l.width, l.height, l.x + l.width AS r, l.y + l.height AS b"
_PAIR_FROM = f"""WITH lines AS ({_LINES}), n AS (SELECT snapshot_id, ix, count(*) AS n, first(hidden) AS hidden, first(x) AS x, first(y) AS y, first(width) AS width, first(height) AS height FROM lines GROUP BY 1, 2),
one AS (SELECT l.snapshot_id, l.ix, l.n, {_RECT} FROM n l),
j AS (SELECT o_orderkey AS snapshot_id, s.n AS sn, s.hidden AS sh, s.x AS sx, s.y AS sy, s.width AS sw, s.height AS shh, s.r AS sr, s.b AS sb,
  q.n AS rn, q.hidden AS rh, q.x AS rx, q.y AS ry, q.width AS rw, q.height AS rhh, q.r AS rr, q.b AS rb
  FROM orders LEFT JOIN one s ON s.snapshot_id = o_orderkey AND s.ix = 1 LEFT JOIN one q ON q.snapshot_id = o_orderkey AND q.ix = 2),
g AS (SELECT *, {{}} AS gs, {{}} AS gr FROM j),
o AS (SELECT *, greatest(0, least(sr, rr) - greatest(sx, rx)) AS ox, greatest(0, least(sb, rb) - greatest(sy, ry)) AS oy,
  greatest(0, rx - sx, sr - rr, ry - sy, sb - rb) AS spill FROM g)"""


def _gate(n: str, hidden: str, w: str, h: str) -> str:
    return f"CASE WHEN coalesce({n}, 0) = 0 THEN 'missing-element' WHEN {n} > 1 THEN 'duplicate-element' WHEN {hidden} THEN 'hidden-element' WHEN {w} = 0 OR {h} = 0 THEN 'zero-size-element' END"


def _pair_sql(code: str, actual: str, single: bool = False) -> str:
    base = _PAIR_FROM.format(_gate("sn", "sh", "sw", "shh"), "CAST(NULL AS VARCHAR)" if single else _gate("rn", "rh", "rw", "rhh"))
    return f"""{base}
SELECT snapshot_id, gs AS code, 'subject' AS operand, CAST(NULL AS DOUBLE) AS actual FROM o WHERE gs IS NOT NULL
UNION ALL SELECT snapshot_id, gr, 'reference', NULL FROM o WHERE gr IS NOT NULL
UNION ALL SELECT snapshot_id, code, NULL, round(actual, 6) FROM (SELECT snapshot_id, {code} AS code, {actual} AS actual FROM o WHERE gs IS NULL AND gr IS NULL) WHERE code IS NOT NULL"""


def _ordering(gap: str) -> tuple[str, str]:
    return f"CASE WHEN greatest(0, -({gap})) > 2 THEN 'ordering-violation' WHEN {gap} < 1 OR {gap} > 30 THEN 'gap-out-of-range' END", gap


_PAIRS = {
    "align": (layout.align("item1", "item2", "centerX", 40), "CASE WHEN abs((sx + sr) / 2 - (rx + rr) / 2) > 40 THEN 'alignment-mismatch' END", "abs((sx + sr) / 2 - (rx + rr) / 2)"),
    "above": (layout.above("item1", "item2", (1, 30), 2), *_ordering("ry - sb")),
    "below": (layout.below("item1", "item2", (1, 30), 2), *_ordering("sy - rb")),
    "left_of": (layout.left_of("item1", "item2", (1, 30), 2), *_ordering("rx - sr")),
    "right_of": (layout.right_of("item1", "item2", (1, 30), 2), *_ordering("sx - rr")),
    "overlap": (layout.overlap("item1", "item2", (1, 10), (1, 5)), "CASE WHEN NOT (ox > 0 AND oy > 0) THEN 'missing-overlap' WHEN ox < 1 OR ox > 10 OR oy < 1 OR oy > 5 THEN 'overlap-out-of-range' END", "least(ox, oy)"),
    "not_overlap": (layout.not_overlap("item1", "item2"), "CASE WHEN ox > 0 AND oy > 0 THEN 'overlap-out-of-range' END", "least(ox, oy)"),
    "inside": (layout.inside("item1", "item2", 30), "CASE WHEN NOT (ox > 0 AND oy > 0) OR spill > 30 THEN 'containment-overflow' END", "spill"),
    "same_width": (layout.same_width("item1", "item2", 5), "CASE WHEN abs(sw - rw) > 5 THEN 'size-mismatch' END", "abs(sw - rw)"),
    "same_height": (layout.same_height("item1", "item2", 2), "CASE WHEN abs(shh - rhh) > 2 THEN 'size-mismatch' END", "abs(shh - rhh)"),
    "same_size": (layout.same_size("item1", "item2", 4), "CASE WHEN abs(sw - rw) > 4 OR abs(shh - rhh) > 4 THEN 'size-mismatch' END", "greatest(abs(sw - rw), abs(shh - rhh))"),
}
_SINGLES = {
    "width": (layout.width("item1", 10, 40), "CASE WHEN sw < 10 OR sw > 40 THEN 'dimension-out-of-range' END", "sw"),
    "height": (layout.height("item1", None, 8), "CASE WHEN shh > 8 THEN 'dimension-out-of-range' END", "shh"),
    "in_viewport": (layout.in_viewport("item1"), f"CASE WHEN NOT (sx >= 0 AND sy >= 0 AND sr <= {VIEW[0]} AND sb <= {VIEW[1]}) THEN 'viewport-overflow' END", f"greatest(-sx, -sy, sr - {VIEW[0]}, sb - {VIEW[1]})"),
}


def _layout(rule: layout.Rule, columns: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rules, _ = layout.rule_table(spark, [rule])
        found = layout.evaluate(rules, *snapshots(spark, sf_dir))
        places = {c: F.coalesce(c, F.lit(-1)) for c in ("member_ix", "other_ix")}
        return found.withColumns(places | {"actual": F.round("actual", 6)}).select("snapshot_id", *columns)

    return run


for _name, (_rule, _code, _actual) in (_PAIRS | _SINGLES).items():
    _add(f"layout_{_name}", _layout(_rule, ("code", "operand", "actual")), _pair_sql(_code, _actual, _name in _SINGLES))

_GROUP_FROM = f"""WITH lines AS ({_LINES}), m AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY ix, x, width, height) - 1 AS k FROM lines),
c AS (SELECT snapshot_id, count(*) AS n, first(hidden) AS hidden, first(x) AS x, first(y) AS y, first(width) AS width, first(height) AS height FROM lines WHERE ix = 1 GROUP BY 1),
a AS (SELECT o_orderkey AS snapshot_id, m.k, m.x, m.y, m.width, m.height, m.x + m.width AS r, m.y + m.height AS b,
  CASE WHEN m.k IS NULL THEN 'empty-collection' WHEN m.hidden THEN 'hidden-element' WHEN m.width = 0 OR m.height = 0 THEN 'zero-size-element' END AS gm,
  c.n AS cn, c.hidden AS ch, c.x AS cx, c.y AS cy, c.x + c.width AS cr, c.y + c.height AS cb, c.width AS cw, c.height AS chh
  FROM orders LEFT JOIN m ON m.snapshot_id = o_orderkey LEFT JOIN c ON c.snapshot_id = o_orderkey),
g AS (SELECT *, {{}} AS gr FROM a),
ok AS (SELECT * FROM g WHERE snapshot_id NOT IN (SELECT snapshot_id FROM g WHERE gm IS NOT NULL OR gr IS NOT NULL))"""


def _group_sql(found: str, container: bool = False) -> str:
    return f"""{_GROUP_FROM.format(_gate("cn", "ch", "cw", "chh") if container else "CAST(NULL AS VARCHAR)")}
SELECT snapshot_id, code, coalesce(member_ix, -1) AS member_ix, coalesce(other_ix, -1) AS other_ix, actual FROM (SELECT snapshot_id, gm AS code, CAST(k AS INT) AS member_ix, CAST(NULL AS INT) AS other_ix, CAST(NULL AS DOUBLE) AS actual FROM g WHERE gm IS NOT NULL
UNION ALL SELECT DISTINCT snapshot_id, gr, CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS DOUBLE) FROM g WHERE gr IS NOT NULL
UNION ALL SELECT snapshot_id, code, CAST(member_ix AS INT), CAST(other_ix AS INT), round(actual, 6) FROM ({found}) WHERE code IS NOT NULL)"""


_GROUPS = {
    "every_inside": (layout.every_inside("items", "item1", 100), _group_sql("""SELECT snapshot_id, CASE WHEN NOT (least(r, cr) - greatest(x, cx) > 0 AND least(b, cb) - greatest(y, cy) > 0) OR greatest(0, cx - x, r - cr, cy - y, b - cb) > 100 THEN 'collection-containment-overflow' END AS code,
  k AS member_ix, NULL AS other_ix, greatest(0, cx - x, r - cr, cy - y, b - cb) AS actual FROM ok""", True)),
    "equal_widths": (layout.equal_widths("items", 6), _group_sql("""SELECT snapshot_id, CASE WHEN k > 0 AND d > 6 THEN 'collection-width-mismatch' END AS code, k AS member_ix, NULL AS other_ix, d AS actual
  FROM (SELECT *, round(abs(width - first_value(width) OVER (PARTITION BY snapshot_id ORDER BY k)) * 1e12) / 1e12 AS d FROM ok)""")),
    "vertically_ordered": (layout.vertically_ordered("items", (30, 36)), _group_sql("""SELECT snapshot_id, CASE WHEN gap < 0 THEN 'collection-ordering-violation' WHEN gap < 30 OR gap > 36 THEN 'collection-gap-out-of-range' END AS code, k AS member_ix, k + 1 AS other_ix, gap AS actual
  FROM (SELECT *, lead(y) OVER (PARTITION BY snapshot_id ORDER BY k) - b AS gap FROM ok)""")),
    "pairwise_not_overlap": (layout.pairwise_not_overlap("items"), _group_sql("""SELECT p.snapshot_id, CASE WHEN least(p.r, q.r) - greatest(p.x, q.x) > 0 AND least(p.b, q.b) - greatest(p.y, q.y) > 0 THEN 'collection-overlap' END AS code, p.k AS member_ix, q.k AS other_ix,
  least(least(p.r, q.r) - greatest(p.x, q.x), least(p.b, q.b) - greatest(p.y, q.y)) AS actual FROM ok p JOIN ok q ON p.snapshot_id = q.snapshot_id AND p.k < q.k""")),
}
for _name, (_rule, _sql) in _GROUPS.items():
    _add(f"layout_{_name}", _layout(_rule, ("code", "member_ix", "other_ix", "actual")), _sql)



def _diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, _ = layout.rule_table(spark, [layout.same_width("item1", "item2", 0.3)])
    found = layout.diagnostics(layout.evaluate(rules, *snapshots(spark, sf_dir)), rules)
    return found.select("snapshot_id", "code", "expected", layout.plain(F.col("excess")).alias("excess"), "text")


_TEXT = "concat('rule 0: ', code, chr(10), 'subject: \"item1\"', chr(10), 'reference: \"item2\"', {})"
_add(
    "layout_diagnostics", _diagnostics,
    f"""WITH f AS ({_pair_sql(*_PAIRS["same_width"][1:]).replace("> 5 ", "> 0.3 ").replace("round(actual, 6)", "actual")}),
e AS (SELECT *, CAST(CAST(actual AS VARCHAR) AS DECIMAL(37,18)) AS d FROM f),
t AS (SELECT *, regexp_replace(CAST(d AS VARCHAR), '\\.?0+$', '') AS a, regexp_replace(CAST(d - CAST(0.3 AS DECIMAL(37,18)) AS VARCHAR), '\\.?0+$', '') AS x FROM e)
SELECT snapshot_id, code, CASE WHEN actual IS NOT NULL THEN 'at most 0.3px' END AS expected, x AS excess,
CASE WHEN actual IS NULL THEN {_TEXT.format("chr(10), 'operand: ', operand")} ELSE {_TEXT.format("chr(10), 'expected: at most 0.3px', chr(10), 'actual: ', a, 'px', chr(10), 'excess: ', x, 'px'")} END AS text FROM t""",
)


# Readiness: a user is a session, an event is a frame of two targets; some events hide one or show two of it.

_WAIT_MS = 5 * 24 * 3600 * 1000
_WAIT_FOR = {"header": ("x",), "list": ("y",)}


def session_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    nothing = "CAST(NULL AS DOUBLE)"
    shown = [
        f"named_struct('target', 'header', 'match_count', IF(event_type = 'error', 0, 1), 'x', floor(value / 100) * 1D, 'y', {nothing}, 'width', {nothing}, 'height', {nothing})",
        f"named_struct('target', 'list', 'match_count', IF(event_type = 'view', 2, 1), 'x', {nothing}, 'y', floor(value / 200) * 1D, 'width', {nothing}, 'height', {nothing})",
    ]
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return _read(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), number.cast("long").alias("frame_no"), F.col("ts").alias("at"), F.array(*map(F.expr, shown)).alias("targets"))


def _readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = readiness.sessions(session_frames(spark, sf_dir), _WAIT_FOR, _WAIT_MS)
    counts = F.array_join(F.transform("last_observed", lambda t: F.concat(t["target"], F.lit(":"), t["match_count"].cast("string"))), ",")
    return found.select("session_id", "outcome", "frame_no", *[F.coalesce(F.array_join(c, ","), F.lit("")).alias(c) for c in ("unresolved", "unstable")], F.coalesce(counts, F.lit("")).alias("last_observed"))


_add("readiness_sessions", _readiness, f"""WITH f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, epoch_ms(ts) AS ms, event_type, value FROM events),
g AS (SELECT *, min(CASE WHEN ms - start >= {_WAIT_MS} THEN n END) OVER (PARTITION BY user_id) AS stop FROM (SELECT *, min(ms) OVER (PARTITION BY user_id) AS start FROM f)),
t AS (SELECT user_id, n, 'header' AS target, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS shown, floor(value / 100) AS v FROM g WHERE stop IS NULL OR n <= stop
UNION ALL SELECT user_id, n, 'list', CASE WHEN event_type = 'view' THEN 2 ELSE 1 END, floor(value / 200) FROM g WHERE stop IS NULL OR n <= stop),
s AS (SELECT *, CASE WHEN shown = 1 THEN v END AS sig FROM t),
h AS (SELECT *, CASE WHEN sig IS NULL THEN 'unresolved' WHEN sig = lag(sig, 1) OVER w AND sig = lag(sig, 2) OVER w THEN 'held' ELSE 'unstable' END AS state FROM s WINDOW w AS (PARTITION BY user_id, target ORDER BY n)),
r AS (SELECT user_id, n, count(*) FILTER (WHERE state <> 'held') = 0 AS ready, coalesce(string_agg(target, ',' ORDER BY target) FILTER (WHERE state = 'unresolved'), '') AS unresolved,
  coalesce(string_agg(target, ',' ORDER BY target) FILTER (WHERE state = 'unstable'), '') AS unstable, string_agg(target || ':' || shown, ',' ORDER BY target) AS seen FROM h GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ready DESC, CASE WHEN ready THEN n ELSE -n END) AS k FROM r)
SELECT user_id AS session_id, CASE WHEN ready THEN 'ready' ELSE 'timed-out' END AS outcome, n AS frame_no, unresolved, unstable, CASE WHEN ready THEN '' ELSE seen END AS last_observed FROM p WHERE k = 1""")


# Catalogs: a part is a table; its columns, keys and indexes depend on its number.

_T = "concat('db', CAST(p_partkey % 5 AS {s})) AS target, CASE WHEN p_partkey % 11 = 0 THEN 'pg_x' WHEN p_partkey % 11 = 1 THEN 'pgdata' ELSE 'app' END AS schema_name, concat('t', CAST(p_partkey AS {s})) AS table_name"
_REF = "CASE WHEN p_partkey % 11 = 0 THEN 'pg_x' WHEN p_partkey % 11 = 1 THEN 'pgdata' ELSE 'app' END"


def catalog_sql(engine: str) -> dict[str, str]:
    """The catalog's tables as SQL over part."""
    spark = engine == "spark"
    s = "STRING" if spark else "VARCHAR"
    arr = (lambda *v: f"array({', '.join(v)})") if spark else (lambda *v: f"[{', '.join(v)}]")
    t = _T.format(s=s)
    null = f"CAST(NULL AS {s})"
    nulls = f"CAST(NULL AS {'ARRAY<STRING>' if spark else 'VARCHAR[]'})"
    k = "p_partkey"

    def column(name: str, at: int, kind: str, firm: str, when: str = "true") -> str:
        return f"SELECT {t}, '{name}' AS column_name, {at} AS ordinal, {kind} AS type_name, {firm} AS not_null FROM part WHERE {when}"

    def constraint(name: str, kind: str, cols: str, when: str, ref: str = null, ref_cols: str = nulls, delete: str = null, update: str = null) -> str:
        return f"SELECT {t}, concat('t', CAST({k} AS {s}), '{name}') AS name, '{kind}' AS kind, {cols} AS columns, {null if ref == null else _REF} AS ref_schema, {ref} AS ref_table, {ref_cols} AS ref_columns, {delete} AS on_delete, {update} AS on_update FROM part WHERE {when}"

    def index(name: str, unique: str, cols: str, n: str, when: str, predicate: str = null, valid: str = "true", live: str = "true", default: str = "true") -> str:
        two = arr(default, "true", "true")
        return (
            f"SELECT {t}, concat('t', CAST({k} AS {s}), '{name}') AS index_name, 'btree' AS method, {unique} AS is_unique, {valid} AS is_valid, false AS is_primary, {live} AS is_ready, true AS is_live, true AS is_immediate, ({k} % 3 = 0) AS nulls_not_distinct, {n} AS n_key_atts, "
            f"{cols} AS all_columns, {arr(chr(39) + 'int8' + chr(39))} AS opclasses, {two} AS opclass_is_default, {arr(chr(39) + 'c' + chr(39))} AS collations, {arr('true', 'true', 'true')} AS collation_is_column, {arr('0')} AS options, {null} AS expressions, {predicate} AS predicate FROM part WHERE {when}"
        )

    other = f"concat('t', CAST({k} + 55 AS {s}))"
    names = lambda *v: arr(*[f"'{x}'" for x in v])
    return {
        "tables": f"SELECT {t}, CASE WHEN {k} % 13 = 0 THEN 'v' WHEN {k} % 13 = 1 THEN 'p' ELSE 'r' END AS relkind, {k} % 2 = 0 AS visible FROM part",
        "columns": " UNION ALL ".join([
            column("id", 1, f"CASE WHEN {k} % 6 = 0 THEN 'integer' ELSE 'bigint' END", "true"), column("user_id", 2, "'bigint'", f"{k} % 4 <> 0"),
            column("tenant_id", 3, "'bigint'", "true", f"{k} % 3 <> 2"), column("account_id", 4, "'bigint'", "false", f"{k} % 7 = 0"),
            column("data", 5, f"CASE WHEN {k} % 5 = 0 THEN 'json' ELSE 'jsonb' END", "false"), column("inserted_at", 6, "'timestamp'", "true", f"{k} % 9 <> 0"),
        ]),
        "constraints": " UNION ALL ".join([
            constraint("_pkey", "p", names("id"), f"{k} % 8 <> 0"),
            constraint("_user_id_fkey", "f", names("user_id"), f"{k} % 5 <> 4", other, names("id"), f"CASE WHEN {k} % 2 = 0 THEN 'c' ELSE 'a' END", f"CASE WHEN {k} % 10 = 0 THEN 'r' ELSE 'a' END"),
            constraint("_tenant_fkey", "f", names("user_id", "tenant_id"), f"{k} % 9 = 0", other, names("id", "tenant_id"), "'r'", "'a'"),
            constraint("_positive", "c", names("user_id"), f"{k} % 10 < 3"),
        ]),
        "indexes": " UNION ALL ".join([
            index("_a", "true", names("user_id", "tenant_id"), "2", f"{k} % 2 = 0", live=f"({k} % 16 <> 2)"), index("_b", "true", names("user_id", "tenant_id"), "2", f"{k} % 6 = 0"),
            index("_c", "false", names("tenant_id", "user_id"), "2", f"{k} % 4 = 3", default="false"), index("_d", "true", names("tenant_id", "user_id"), "1", f"{k} % 5 = 0"),
            index("_p", "true", names("user_id"), "1", f"{k} % 7 = 3", predicate="'x > 0'"), index("_v", "true", names("user_id"), "1", f"{k} % 7 = 4", valid=f"({k} % 3 = 0)"),
        ]),
        "candidates": f"SELECT {t}, concat('M', CAST({k} AS {s})) AS module, 'changeset' AS function, 2 AS arity, CASE WHEN {k} % 3 = 0 THEN {names('user_id')} ELSE {names('user_id', 'tenant_id', 'data')} END AS fields FROM part",
        "calls": " UNION ALL ".join(
            f"SELECT concat('db', CAST({k} % 5 AS {s})) AS target, concat('M', CAST({k} AS {s})) AS module, 'changeset' AS function, 2 AS arity, '{kind}' AS kind, {names('user_id')} AS fields, {name} AS name, {match} AS match FROM part WHERE {when}"
            for kind, name, match, when in (("unique", f"concat('t', CAST({k} AS {s}), '_a')", null, f"{k} % 4 = 0"), ("unique", "'_b'", "'suffix'", f"{k} % 12 = 0"), ("foreign_key", null, null, f"{k} % 2 = 1"), ("check", "'_positive'", "'suffix'", f"{k} % 20 = 0"))
        ),
    }


def part_catalog(spark: SparkSession, sf_dir: str) -> catalog.Catalog:
    part = _read(spark, sf_dir, "part")
    sql = catalog_sql("spark")
    return catalog.Catalog.load(spark, lambda name: spark.sql(sql[name].replace("FROM part", "FROM {part}"), part=part))


_USER = "schema_name <> 'information_schema' AND NOT starts_with(schema_name, 'pg_')"
_CAT = {
    "duplicate_indexes": ({}, f"""SELECT i.target, i.table_name, array_to_string(list_sort(list(index_name)), ',') AS detail FROM indexes i JOIN ut USING (target, schema_name, table_name)
GROUP BY i.target, i.schema_name, i.table_name, method, is_unique, is_valid, n_key_atts, all_columns, opclasses, collations, options, expressions, predicate HAVING count(*) > 1""", "index_names"),
    "forbidden_column_types": ({"rules": {"types": ["json"], "where": {"columns": "data"}, "except": {"schemas": "pgdata"}}}, "SELECT target, table_name, column_name AS detail FROM columns JOIN ut USING (target, schema_name, table_name) WHERE type_name = 'json' AND column_name = 'data' AND schema_name <> 'pgdata'", "column"),
    "foreign_key_actions": ({"rules": {"on_delete": "cascade", "on_update": "no_action"}}, f"""SELECT target, table_name, name || ':' || part AS detail FROM (SELECT *, unnest(['on_delete', 'on_update']) AS part, unnest([on_delete, on_update]) AS act, unnest(['c', 'a']) AS want FROM constraints WHERE kind = 'f' AND {_USER}) WHERE act <> want""", None),
    "foreign_key_nullability": ({}, f"SELECT c.target, c.table_name, f.name || ':' || c.column_name AS detail FROM (SELECT target, schema_name, table_name, name, unnest(columns) AS column_name FROM constraints WHERE kind = 'f' AND {_USER}) f JOIN columns c USING (target, schema_name, table_name, column_name) WHERE NOT c.not_null", None),
    "missing_foreign_key_constraints": ({}, """SELECT c.target, c.table_name, c.column_name AS detail FROM columns c JOIN ut USING (target, schema_name, table_name) WHERE c.column_name <> 'id' AND ends_with(c.column_name, '_id')
AND NOT EXISTS (SELECT 1 FROM constraints k WHERE k.kind IN ('f', 'p') AND k.target = c.target AND k.schema_name = c.schema_name AND k.table_name = c.table_name AND list_contains(k.columns, c.column_name))""", "column"),
    "missing_foreign_key_indexes": ({}, f"""SELECT f.target, f.table_name, f.name AS detail FROM constraints f WHERE f.kind = 'f' AND {_USER.replace("schema_name", "f.schema_name")}
AND NOT EXISTS (SELECT 1 FROM indexes i WHERE i.target = f.target AND i.schema_name = f.schema_name AND i.table_name = f.table_name AND i.is_valid AND i.predicate IS NULL AND i.n_key_atts >= len(f.columns) AND list_has_all(i.all_columns[1:len(f.columns)], f.columns))""", "constraint"),
    "primary_key_type": ({"rules": {"types": ["bigint"]}}, """SELECT ut.target, ut.table_name, 'missing' AS detail FROM ut WHERE NOT EXISTS (SELECT 1 FROM constraints k WHERE k.kind = 'p' AND k.target = ut.target AND k.schema_name = ut.schema_name AND k.table_name = ut.table_name)
UNION ALL SELECT c.target, c.table_name, c.column_name FROM columns c JOIN ut USING (target, schema_name, table_name) JOIN constraints k USING (target, schema_name, table_name) WHERE k.kind = 'p' AND list_contains(k.columns, c.column_name) AND c.type_name <> 'bigint'""", None),
    "required_columns": ({"rules": {"columns": ["inserted_at", "tenant_id"], "except": {"tables": "t1"}}}, """SELECT ut.target, ut.table_name, array_to_string(list_sort(list(w)), ',') AS detail FROM ut CROSS JOIN (SELECT unnest(['inserted_at', 'tenant_id']) AS w)
WHERE ut.table_name <> 't1' AND NOT EXISTS (SELECT 1 FROM columns c WHERE c.target = ut.target AND c.schema_name = ut.schema_name AND c.table_name = ut.table_name AND c.column_name = w) GROUP BY ut.target, ut.schema_name, ut.table_name""", "missing_columns"),
    "scoped_foreign_keys": ({"rules": {"scope_columns": ["tenant_id"]}}, f"""SELECT f.target, f.table_name, f.name AS detail FROM constraints f WHERE f.kind = 'f' AND {_USER.replace("schema_name", "f.schema_name")}
AND EXISTS (SELECT 1 FROM columns c WHERE c.target = f.target AND c.schema_name = f.schema_name AND c.table_name = f.table_name AND c.column_name = 'tenant_id')
AND EXISTS (SELECT 1 FROM columns c WHERE c.target = f.target AND c.schema_name = f.ref_schema AND c.table_name = f.ref_table AND c.column_name = 'tenant_id')
AND NOT (list_contains(f.columns, 'tenant_id') AND list_contains(f.ref_columns, 'tenant_id'))""", "constraint"),
    "changeset_unique_constraints": ({"modules": re.compile("^M")}, f"""SELECT i.target, i.table_name, i.index_name AS detail FROM indexes i JOIN candidates c USING (target, schema_name, table_name) WHERE i.is_unique AND i.is_valid AND NOT i.is_primary AND i.predicate IS NULL AND i.expressions IS NULL AND {_USER}
AND list_has_all(c.fields, i.all_columns[1:i.n_key_atts]) AND NOT EXISTS (SELECT 1 FROM calls k WHERE k.kind = 'unique' AND k.target = i.target AND k.module = c.module AND CASE WHEN k.match = 'suffix' THEN ends_with(i.index_name, k.name) ELSE k.name = i.index_name END)""", "constraint"),
    "changeset_foreign_key_constraints": ({"modules": re.compile("^M")}, f"""SELECT f.target, f.table_name, f.name AS detail FROM constraints f JOIN candidates c USING (target, schema_name, table_name) WHERE f.kind = 'f' AND {_USER} AND list_has_all(c.fields, f.columns)
AND NOT EXISTS (SELECT 1 FROM calls k WHERE k.kind = 'foreign_key' AND k.target = f.target AND k.module = c.module AND f.name = f.table_name || '_user_id_fkey')""", "constraint"),
    "changeset_check_constraints": ({"modules": re.compile("^M")}, f"""SELECT f.target, f.table_name, f.name AS detail FROM constraints f JOIN candidates c USING (target, schema_name, table_name) WHERE f.kind = 'c' AND {_USER} AND list_has_all(c.fields, f.columns)
AND NOT EXISTS (SELECT 1 FROM calls k WHERE k.kind = 'check' AND k.target = f.target AND k.module = c.module AND ends_with(f.name, k.name))""", "constraint"),
}


def _detail(check: str, part: str | None):
    j = lambda k: F.get_json_object("meta", f"$.{k}")
    if check == "foreign_key_actions":
        return F.concat(j("constraint"), F.lit(":"), F.col("code"))
    if check == "foreign_key_nullability":
        return F.concat(j("constraint"), F.lit(":"), j("column"))
    if check == "primary_key_type":
        return F.coalesce(j("column"), F.lit("missing"))
    return F.regexp_replace(j(part), '[\\[\\]"]', "")


def _catalog(check: str, options: dict, part: str | None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        issues = catalog.validate(part_catalog(spark, sf_dir), [(check, options)])
        return issues.select("target", F.get_json_object("meta", "$.table").alias("table_name"), _detail(check, part).alias("detail"))

    return run


_WITH = "WITH " + ", ".join(f"{k} AS ({v})" for k, v in catalog_sql("duckdb").items()) + f", ut AS (SELECT * FROM tables WHERE relkind IN ('r', 'p') AND {_USER}) "
for _check, (_options, _sql, _part) in _CAT.items():
    _add(f"catalog_{_check}", _catalog(_check, _options, _part), _WITH + _sql)


def _unique_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.unique_keys(part_catalog(spark, sf_dir)).select("target", F.coalesce("schema_name", F.lit("")).alias("schema_name"), "table_name", F.array_join("columns", ",").alias("key"))


_add("catalog_unique_keys", _unique_keys, _WITH + """, u AS (SELECT DISTINCT i.target, i.schema_name, i.table_name, array_to_string(i.all_columns[1:i.n_key_atts], ',') AS key, ut.visible FROM indexes i JOIN ut USING (target, schema_name, table_name)
WHERE is_unique AND is_valid AND is_ready AND is_live AND is_immediate AND predicate IS NULL AND expressions IS NULL AND method = 'btree' AND NOT list_contains(i.opclass_is_default[1:i.n_key_atts], false)
AND (nulls_not_distinct OR NOT EXISTS (SELECT 1 FROM columns c WHERE c.target = i.target AND c.schema_name = i.schema_name AND c.table_name = i.table_name AND list_contains(i.all_columns[1:i.n_key_atts], c.column_name) AND NOT c.not_null)
  AND (nulls_not_distinct OR (SELECT count(*) FROM columns c WHERE c.target = i.target AND c.schema_name = i.schema_name AND c.table_name = i.table_name AND list_contains(i.all_columns[1:i.n_key_atts], c.column_name)) = i.n_key_atts)))
SELECT target, schema_name, table_name, key FROM u UNION ALL SELECT DISTINCT target, '', table_name, key FROM u WHERE visible""")


# Query trees: an order is a query whose shape depends on its number.

_FIELDS = [("Post", f, f, t, f == "id") for f, t in (("id", "id"), ("tenant_id", "integer"), ("title", "string"), ("day", "date"), ("at", "utc_datetime"), ("until", "naive_datetime"), ("deleted_at", "utc_datetime"))]
_FIELDS += [("Author", "id", "id", "id", True), ("Author", "at", "at", "utc_datetime", False), ("Author", "tenant_id", "tenant_id", "integer", False)]


def query_facts(spark: SparkSession, trees: DataFrame, only: Iterable[str] = NAMES) -> querylint.Queries:
    fields = spark.createDataFrame(_FIELDS, "schema string, field string, column_name string, type string, is_pk boolean")
    related = spark.createDataFrame([("Post", "author", "Author", False), ("Post", "editor", "Author", True)], "schema string, name string, related string, filtered boolean")
    keys = spark.createDataFrame([("app", "posts", ["tenant_id", "title"])], "db_schema string, table_name string, columns array<string>")
    return querylint.Queries(compile_queries(trees, only=only), fields, related, keys)


_ROOT = '"from":{"schema":"Post","table":"posts","prefix":"app","as":"p"}'
_AUTHOR = '{"qual":"%s","schema":"Author","table":"authors","as":"a"%s}'


def _tree(*parts: str) -> str:
    """SQL for the tree; parts are SQL string expressions of JSON members."""
    return "concat('{', " + ", ',', ".join(parts) + ", '}')"


def _case(modulus: int, **by: str) -> str:
    """A JSON member by o_orderkey modulo; the last is for the rest."""
    items = list(by.values())
    return "CASE o_orderkey % " + str(modulus) + "".join(f" WHEN {k} THEN '{v}'" for k, v in enumerate(items[:-1])) + f" ELSE '{items[-1]}' END"


def _where(e: str) -> str:
    return '"wheres":[{"op":"and","expr":' + e + "}]"


_F = lambda name, b="0": f'["field",{b},"{name}"]'
_L = lambda v, t="string": f'["lit",{v},"{t}"]'
_EQ = lambda a, b, op="==": f'["{op}",{a},{b}]'
_JOIN = lambda qual, on="", n=1: '"joins":[' + ",".join([_AUTHOR % (qual, f',"on":{on}' if on else "")] * n) + "]"
_ON = _EQ(_F("tenant_id"), _F("tenant_id", "1"))
_T1, _T2 = _EQ(_F("title"), _L('"x"')), _EQ(_F("title"), _L('"y"'))
_TENANT = _EQ(_F("tenant_id"), '["param",7,"integer"]')
_ALL, _DELETE, _UPDATE = '"operation":"all"', '"operation":"delete_all"', '"operation":"update_all"'

#: check -> (options, tree members, what the issues are as SQL over orders)
_LINT: dict[str, tuple[dict, list[str], str]] = {
    "cartesian_joins": ({}, [f"'{_ALL}'", _case(4, a=_JOIN("cross"), b=_JOIN("inner", '["lit",true,"boolean"]'), c=_JOIN("inner", _ON), d=_JOIN("left", _ON))], "o_orderkey % 4 IN (0, 1)"),
    "conflicting_where_predicates": ({}, [f"'{_ALL}'", _case(4, a=_where(f'["and",{_T1},{_T2}]'), b=_where(f'["or",["and",{_T1},{_T2}],{_T1}]'), c=_where(f'["and",{_EQ(_F("title"), "[" + _L(chr(34) + "a" + chr(34)) + "]", "in")},{_T1}]'), d=_where(_T1))], "o_orderkey % 4 IN (0, 2)"),
    "date_datetime_mixed_comparisons": ({}, [f"'{_ALL}'", _case(5, a=_where(_EQ(_F("day"), _F("at"), "<")), b=_where(_EQ(_F("at"), _F("day"))), c=_where(_EQ(_F("day"), f'["type",{_F("at")},"date"]')), d=_where(f'["not",{_EQ(_F("day"), _F("until"), ">")}]'), e=_where(_T1))], "o_orderkey % 5 IN (0, 1, 3)"),
    "deterministic_order": ({}, [f"'{_ALL}'", _case(4, a=f'"order_by":[{_F("title")}]', b=f'"order_by":[{_F("title")},{_F("id")}]', c=f'"order_by":[{_F("title")},{_F("tenant_id")}]', d='"order_by":[]')], "o_orderkey % 4 = 0"),
    "duplicate_joins": ({}, [f"'{_ALL}'", _case(3, a=_JOIN("inner", "", 2), b=_JOIN("inner", _ON), c='"joins":[' + _AUTHOR % ("inner", "") + "," + _AUTHOR % ("left", "") + "]")], "o_orderkey % 3 = 0"),
    "empty_in_predicates": ({}, [f"'{_ALL}'", _case(4, a=_where(f'["in",{_F("title")},[]]'), b=_where(f'["or",["in",{_F("title")},[]],{_T1}]'), c=_where(f'["in",{_F("title")},[["lit",null]]]'), d=_where(_T1))], "o_orderkey % 4 IN (0, 2)"),
    "explicit_visibility_predicates": ({"rules": {"fields": ["deleted_at"]}}, [f"'{_ALL}'", _case(4, a=_where(f'["is_nil",{_F("deleted_at")}]'), b=_where(f'["or",["is_nil",{_F("deleted_at")}],{_T1}]'), c=_where(f'["not",["is_nil",{_F("deleted_at")}]]'), d=_where(_T1))], "o_orderkey % 4 IN (1, 3)"),
    "half_open_temporal_intervals": ({}, [f"'{_ALL}'", _case(4, a=_where(_EQ(_F("at"), _L('"2024-01-01"', "utc_datetime"), ">")), b=_where(_EQ(_F("at"), _L('"2024-01-01"', "utc_datetime"), "<")), c=_where(_EQ(_L('"2024-01-01"', "utc_datetime"), _F("at"), ">=")), d=_where(f'["not",{_EQ(_F("at"), _L(chr(34) + "z" + chr(34)), ">")}]'))], "o_orderkey % 4 IN (0, 2)"),
    "hard_delete_on_soft_delete_schema": ({}, [_case(2, a=_DELETE, b=_UPDATE)], "o_orderkey % 2 = 0"),
    "left_join_where_predicates": ({}, [f"'{_ALL}'", f"'{_JOIN('left', _ON)}'", _case(5, a=_where(_EQ(_F("at", "1"), _L('"z"'), ">")), b=_where(f'["is_nil",{_F("id", "1")}]'), c=_where(f'["or",{_EQ(_F("id", "1"), _L("1"))},{_T1}]'), d=_where(f'["not",["is_nil",{_F("id", "1")}]]'), e=_where(_EQ(f'["is_nil",{_F("id", "1")}]', '["lit",false,"boolean"]')))], "o_orderkey % 5 IN (0, 3, 4)"),
    "mandatory_join_keys": ({"keys": ["tenant_id"]}, [f"'{_ALL}'", _case(3, a=_JOIN("inner", _ON), b=_JOIN("inner", _EQ(_F("id"), _F("id", "1"))), c=_JOIN("inner", f'["or",{_ON},{_T1}]'))], "o_orderkey % 3 IN (1, 2)"),
    "mandatory_where_keys": ({"rules": {"fields": ["tenant_id"], "where": {"tables": "posts"}}}, [f"'{_ALL}'", _case(5, a=_where(_TENANT), b=_where(f'["or",{_TENANT},{_T1}]'), c=_where(f'["and",{_T1},["in",{_F("tenant_id")},[["lit",1,"integer"]]]]'), d=_where(_EQ(_F("tenant_id"), _F("id"))), e='"wheres":[]')], "o_orderkey % 5 IN (1, 3, 4)"),
    "manual_join_instead_of_assoc": ({}, [f"'{_ALL}'", _case(2, a=_JOIN("inner", _ON), b='"joins":[{"qual":"inner","assoc":"author","as":"a"}]')], "o_orderkey % 2 = 0"),
    "named_bindings": ({}, [f"'{_ALL}'", _case(2, a='"joins":[{"qual":"inner","schema":"Author"}]', b=_JOIN("inner", _ON.replace("0,", '"p",').replace("1,", '"a",')))], "o_orderkey % 2 = 0"),
    "offset_without_limit": ({}, [f"'{_ALL}'", _case(4, a='"offset":["lit",5]', b='"offset":["lit",5],"limit":["lit",5]', c='"offset":["lit",5],"limit":["param",null]', d='"offset":["param",null]')], "o_orderkey % 4 IN (0, 2)"),
    "required_order": ({}, [_case(2, a=_ALL, b='"operation":"stream"'), _case(3, a='"limit":["param",null]', b='"limit":["lit",1],"select":["lit",1]', c=f'"limit":["lit",9],"order_by":[{_F("id")}]')], "o_orderkey % 3 = 0"),
    "unbounded_deletes": ({}, [_case(2, a=_DELETE, b=_ALL), _case(3, a=_where('["lit",true]'), b=_where('["lit",false]'), c=_where(_T1))], "o_orderkey % 6 = 0"),
    "unbounded_updates": ({}, [_case(2, a=_UPDATE, b=_ALL), _case(3, a='"wheres":[]', b=_where(f'["or",{_T1},["lit",true]]'), c=_where(_T1))], "o_orderkey % 2 = 0 AND o_orderkey % 3 IN (0, 1)"),
    "utc_datetime_naive_comparisons": ({}, [f"'{_ALL}'", _case(3, a=_where(_EQ(_F("at"), _L('"2024-01-01T00:00:00"', "naive_datetime"), ">=")), b=_where(_EQ(_F("at"), _L('"2024-01-01T00:00:00Z"', "utc_datetime"))), c=_where(f'["in",{_F("at")},[{_L(chr(34) + "t" + chr(34), "naive_datetime")}]]'))], "o_orderkey % 3 IN (0, 2)"),
}


#: check -> (code, meta) of the issues above, as SQL over orders; the place is the first for each of them.
_SAID: dict[str, tuple[str, str]] = {
    "cartesian_joins": ("cartesian_join", """'{"qual":"' || CASE o_orderkey % 4 WHEN 0 THEN 'cross' ELSE 'inner' END || '","schema":"Author"}'"""),
    "conflicting_where_predicates": ("conflicting_predicates", """'{"field":"title"}'"""),
    "date_datetime_mixed_comparisons": ("date_datetime_comparison", """'{"field":"day","operators":["' || CASE o_orderkey % 5 WHEN 0 THEN '<' WHEN 1 THEN '==' ELSE '>' END || '"]}'"""),
    "deterministic_order": ("unstable_order", """'{"fields":["title"]}'"""),
    "duplicate_joins": ("duplicate_join", """'{"original":0}'"""),
    "empty_in_predicates": ("empty_in", """'{"field":"title"}'"""),
    "explicit_visibility_predicates": ("missing_visibility", """'{"field":"deleted_at"}'"""),
    "half_open_temporal_intervals": ("closed_interval", """'{"field":"at","operators":["' || CASE o_orderkey % 4 WHEN 0 THEN '>' ELSE '<=' END || '"]}'"""),
    "hard_delete_on_soft_delete_schema": ("hard_delete", """'{"schema":"Post","field":"deleted_at"}'"""),
    "left_join_where_predicates": ("left_join_rejected", """'{"fields":["' || CASE o_orderkey % 5 WHEN 0 THEN 'at' ELSE 'id' END || '"],"alias":"a"}'"""),
    "mandatory_join_keys": ("missing_join_key", """'{"keys":["tenant_id"]}'"""),
    "mandatory_where_keys": ("missing_where_key", """'{"keys":["tenant_id"],"branch":""}'"""),
    "manual_join_instead_of_assoc": ("manual_join", """'{"associations":["author"]}'"""),
    "named_bindings": ("unnamed_join", """'{"detail":"0"}'"""),
    "offset_without_limit": ("offset_without_limit", "CAST(NULL AS VARCHAR)"),
    "required_order": ("missing_order", """'{"reasons":["limit"' || CASE WHEN o_orderkey % 2 = 1 THEN ',"stream"' ELSE '' END || ']}'"""),
    "unbounded_deletes": ("unbounded_delete", "CAST(NULL AS VARCHAR)"),
    "unbounded_updates": ("unbounded_update", "CAST(NULL AS VARCHAR)"),
    "utc_datetime_naive_comparisons": ("naive_comparison", """'{"field":"at"}'"""),
}

# A second query for each order is made of its lines: a line gives a condition, a join or an order, and the SQL side
# tells from the lines which issues there must be. Equal conditions come once, those joined by and before those joined
# by or, so a query's branches are its and-lines together and each of its or-lines.

_AND, _OR = "and", "or"
_OF_JOIN = _EQ(_F("tenant_id"), _F("tenant_id", "@"))
_AS = lambda qual, on="", alias=',"as":"a@"': '{"qual":"%s","schema":"Author","table":"authors"%s%s}' % (qual, alias, f',"on":{on}' if on else "")  # noqa: E731, UP031
_AT = lambda op, v, t: _EQ(_F("at"), _L(v, t), op)
_TENANT_IS = lambda v: _EQ(_F("tenant_id"), _L(v, "integer"))
_BOTH = """(SELECT query_id, {} FROM q LEFT JOIN ln USING (query_id) GROUP BY query_id)"""
_HAS = lambda *kinds: f"coalesce(bool_or(kind IN ({', '.join(map(str, kinds))})), false)"
_FIRST = lambda field, code, ops, kinds: f"""SELECT query_id, min(pos) AS seq, '{code}' AS code, '{{"field":"{field}","operators":["' || array_to_string(list_sort(list(DISTINCT CASE kind {ops} END)), '","') || '"]}}' AS meta
FROM ln WHERE kind IN {kinds} GROUP BY query_id"""  # noqa: E731


def _one_of(code: str, has: str, where: str, meta: str = "CAST(NULL AS VARCHAR)") -> str:
    return f"SELECT query_id, 0 AS seq, '{code}' AS code, {meta} AS meta FROM {_BOTH.format(has)} WHERE {where}"


#: check -> (member of the tree, further members, what a line gives by its supplier's number, the issues as SQL over
#: q(query_id) and ln(query_id, kind, pos))
_LINES: dict[str, tuple[str, list[str], list, str]] = {
    "cartesian_joins": ("joins", [_ALL], [_AS("cross"), _AS("inner", '["lit",true,"boolean"]'), _AS("inner", _OF_JOIN), _AS("left", _OF_JOIN)],
        """SELECT query_id, pos AS seq, 'cartesian_join' AS code, '{"qual":"' || CASE kind WHEN 0 THEN 'cross' ELSE 'inner' END || '","schema":"Author"}' AS meta FROM ln WHERE kind IN (0, 1)"""),
    "conflicting_where_predicates": ("wheres", [_ALL], [(_AND, _T1), (_AND, _T2), (_AND, _TENANT_IS(1)), (_AND, _TENANT_IS(2)), (_AND, _EQ(_F("id"), _L(1, "integer"))), (_OR, _EQ(_F("title"), _L('"z"')))],
        """SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY field) - 1 AS seq, 'conflicting_predicates' AS code, '{"field":"' || field || '"}' AS meta
FROM (SELECT query_id, CASE WHEN kind < 2 THEN 'title' ELSE 'tenant_id' END AS field FROM ln WHERE kind < 4 GROUP BY ALL HAVING count(DISTINCT kind) > 1) WHERE query_id NOT IN (SELECT query_id FROM ln WHERE kind = 5)"""),
    "date_datetime_mixed_comparisons": ("wheres", [_ALL], [(_AND, _EQ(_F("day"), _F("at"), "<")), (_AND, _EQ(_F("at"), _F("day"))), (_AND, _EQ(_F("day"), f'["type",{_F("at")},"date"]')), (_AND, f'["not",{_EQ(_F("day"), _F("until"), ">")}]'), (_AND, _T1)],
        _FIRST("day", "date_datetime_comparison", "WHEN 0 THEN '<' WHEN 1 THEN '==' WHEN 3 THEN '>'", "(0, 1, 3)")),
    "deterministic_order": ("order_by", [_ALL], [_F("title"), _F("tenant_id"), _F("day"), _F("at"), _F("id")],
        """SELECT query_id, 0 AS seq, 'unstable_order' AS code, '{"fields":["' || string_agg(CASE kind WHEN 0 THEN 'title' WHEN 1 THEN 'tenant_id' WHEN 2 THEN 'day' ELSE 'at' END, '","' ORDER BY pos) || '"]}' AS meta
FROM ln GROUP BY query_id HAVING NOT bool_or(kind = 4) AND NOT (bool_or(kind = 0) AND bool_or(kind = 1))"""),
    "duplicate_joins": ("joins", [_ALL], [_AS("inner", alias=""), _AS("inner", _OF_JOIN, ""), _AS("left", alias="")],
        """SELECT query_id, pos AS seq, 'duplicate_join' AS code, '{"original":' || first || '}' AS meta FROM (SELECT *, min(pos) OVER (PARTITION BY query_id, kind) AS first FROM ln) WHERE pos > first"""),
    "empty_in_predicates": ("wheres", [_ALL], [(_AND, f'["in",{_F("title")},[]]'), (_AND, _T1), (_OR, f'["in",{_F("tenant_id")},[]]'), (_OR, f'["in",{_F("title")},[]]'), (_OR, _T2)],
        f"""SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY field) - 1 AS seq, 'empty_in' AS code, '{{"field":"' || field || '"}}' AS meta
FROM (SELECT DISTINCT query_id, CASE kind WHEN 2 THEN 'tenant_id' ELSE 'title' END AS field FROM ln WHERE kind IN (0, 2, 3)) JOIN {_BOTH.format(f"{_HAS(4)} OR ({_HAS(0, 1)} AND NOT {_HAS(0)}) AS other")} USING (query_id) WHERE NOT other"""),
    "explicit_visibility_predicates": ("wheres", [_ALL], [(_AND, f'["is_nil",{_F("deleted_at")}]'), (_AND, _TENANT_IS(1)), (_AND, _T1), (_OR, f'["is_nil",{_F("deleted_at")}]'), (_OR, _T2)],
        _one_of("missing_visibility", f"{_HAS(0, 1, 2, 3, 4)} AS given, {_HAS(4)} OR ({_HAS(1, 2)} AND NOT {_HAS(0)}) AS bare", "bare OR NOT given", """'{"field":"deleted_at"}'""")),
    "half_open_temporal_intervals": ("wheres", [_ALL], [(_AND, _AT(">", '"2024-01-01"', "utc_datetime")), (_AND, _AT("<", '"2024-01-01"', "utc_datetime")), (_AND, _EQ(_L('"2024-01-01"', "utc_datetime"), _F("at"), ">=")), (_AND, f'["not",{_AT(">", chr(34) + "z" + chr(34), "string")}]'), (_AND, _AT(">=", '"2024-01-01"', "utc_datetime"))],
        _FIRST("at", "closed_interval", "WHEN 0 THEN '>' WHEN 2 THEN '<='", "(0, 2)")),
    "left_join_where_predicates": ("wheres", [_ALL, _JOIN("left", _ON)], [(_AND, _EQ(_F("at", "1"), _L('"z"'), ">")), (_AND, f'["is_nil",{_F("id", "1")}]'), (_AND, _T1), (_OR, _EQ(_F("id", "1"), _L(1, "integer"))), (_OR, _T2)],
        _one_of("left_join_rejected", f"{_HAS(0)} AS by_at, {_HAS(3)} AS by_id, {_HAS(4)} OR ({_HAS(1, 2)} AND NOT {_HAS(0)}) AS kept", "(by_at OR by_id) AND NOT kept", """'{"fields":["' || CASE WHEN by_at AND by_id THEN 'at","id' WHEN by_at THEN 'at' ELSE 'id' END || '"],"alias":"a"}'""")),
    "mandatory_join_keys": ("joins", [_ALL], [_AS("inner", _OF_JOIN), _AS("inner", _EQ(_F("id"), _F("id", "@"))), _AS("left", f'["or",{_OF_JOIN},{_T1}]'), _AS("left", f'["and",{_T1},{_OF_JOIN}]')],
        """SELECT query_id, pos AS seq, 'missing_join_key' AS code, '{"keys":["tenant_id"]}' AS meta FROM ln WHERE kind IN (1, 2)"""),
    "mandatory_where_keys": ("wheres", [_ALL], [(_AND, _TENANT), (_AND, f'["in",{_F("tenant_id")},[["lit",1,"integer"]]]'), (_AND, _EQ(_F("tenant_id"), _F("id"))), (_AND, _T1), (_OR, _TENANT), (_OR, _T2)],
        _one_of("missing_where_key", f"{_HAS(0, 1, 2, 3, 4, 5)} AS given, {_HAS(5)} OR ({_HAS(2, 3)} AND NOT {_HAS(0, 1)}) AS bare", "bare OR NOT given", """'{"keys":["tenant_id"],"branch":""}'""")),
    "manual_join_instead_of_assoc": ("joins", [_ALL], [_AS("inner", _OF_JOIN), '{"qual":"inner","assoc":"author","as":"a@"}', _AS("left", _OF_JOIN)],
        """SELECT query_id, pos AS seq, 'manual_join' AS code, '{"associations":["author"]}' AS meta FROM ln WHERE kind <> 1"""),
    "named_bindings": ("joins", [_ALL], [_AS("inner", alias=""), _AS("inner", _EQ('["field","p","id"]', '["field","a@","id"]'))],
        """SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS seq, 'unnamed_join' AS code, '{"detail":"' || pos || '"}' AS meta FROM ln WHERE kind = 0"""),
    "unbounded_deletes": ("wheres", [_DELETE], [(_AND, '["lit",true]'), (_AND, _T1), (_OR, '["lit",false]'), (_OR, _T2), (_OR, '["lit",true]')],
        _one_of("unbounded_delete", f"NOT {_HAS(0, 1, 2, 3, 4)} OR {_HAS(4)} OR ({_HAS(0)} AND NOT {_HAS(1)}) AS whole", "whole")),
    "unbounded_updates": ("wheres", [_UPDATE], [(_AND, '["not",["lit",false]]'), (_AND, _T1), (_OR, '["not",["lit",true]]'), (_OR, f'["and",{_T2},["lit",true]]'), (_OR, f'["or",{_T2},["lit",true]]')],
        _one_of("unbounded_update", f"NOT {_HAS(0, 1, 2, 3, 4)} OR {_HAS(4)} OR ({_HAS(0)} AND NOT {_HAS(1)}) AS whole", "whole")),
    "utc_datetime_naive_comparisons": ("wheres", [_ALL], [(_AND, _AT(">=", '"2024-01-01T00:00:00"', "naive_datetime")), (_AND, _AT("==", '"2024-01-01T00:00:00Z"', "utc_datetime")), (_AND, _T1), (_OR, _EQ(_L('"t"', "naive_datetime"), _F("at"), "<")), (_OR, _T2)],
        """SELECT query_id, min(pos) AS seq, 'naive_comparison' AS code, '{"field":"at"}' AS meta FROM ln WHERE kind IN (0, 3) GROUP BY query_id"""),
}


def _line_trees(spark: SparkSession, sf_dir: str, check: str) -> DataFrame:
    """query_id (the order's number, negative, less one) and tree of each order's second query."""
    member, others, gives, _ = _LINES[check]
    texts = [g if isinstance(g, str) else f'{{"op":"{g[0]}","expr":{g[1]}}}' for g in gives]
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % len(gives)).alias("kind"))
    kinds = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("kind")).alias("kinds"))
    if member == "wheres":
        kinds = kinds.withColumn("kinds", F.array_distinct("kinds"))
    text = F.transform("kinds", lambda k, i: F.replace(F.get(F.array(*map(F.lit, texts)), k.cast("int")), F.lit("@"), (i + 1).cast("string")))
    orders = _read(spark, sf_dir, "orders").select("o_orderkey").join(kinds, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    head = "{" + ",".join([_ROOT, *others]) + f',"{member}":['
    return orders.select((-F.col("o_orderkey") - 1).alias("query_id"), F.concat(F.lit(head), F.coalesce(F.array_join(text, ","), F.lit("")), F.lit("]}")).alias("tree"))


def _lint(check: str, options: dict, members: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        trees = _read(spark, sf_dir, "orders").selectExpr("o_orderkey AS query_id", f"{_tree(chr(39) + _ROOT + chr(39), *members)} AS tree")
        if check in _LINES:
            trees = trees.union(_line_trees(spark, sf_dir, check))
        issues = querylint.validate(query_facts(spark, trees, querylint.READS[check]), [(check, options)])
        return issues.select(F.col("subject_order").alias("query_id"), "seq", "code", "meta")

    return run


def _lint_sql(check: str, bad: str) -> str:
    code, meta = _SAID[check]
    cases = f"SELECT o_orderkey AS query_id, {1 if check == 'duplicate_joins' else 0} AS seq, '{code}' AS code, {meta} AS meta FROM orders WHERE {bad}"
    if check not in _LINES:
        return cases
    member, _, gives, sql = _LINES[check]
    each = "SELECT DISTINCT" if member == "wheres" else "SELECT"
    return f"""WITH q AS (SELECT -o_orderkey - 1 AS query_id FROM orders),
kinds AS ({each} query_id, l_suppkey % {len(gives)} AS kind FROM q JOIN lineitem ON query_id = -l_orderkey - 1),
ln AS (SELECT query_id, kind, row_number() OVER (PARTITION BY query_id ORDER BY kind) - 1 AS pos FROM kinds)
{cases}
UNION ALL SELECT query_id, seq, code, meta FROM ({sql})"""


for _check, (_options, _members, _bad) in _LINT.items():
    _add(f"query_{_check}", _lint(_check, _options, _members), _lint_sql(_check, _bad))
