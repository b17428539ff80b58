import random

import pytest
from pyspark.sql import functions as F

from veriframe.operators import layout as lay
from veriframe.plans.queries import QUERIES
from veriframe.streaming import readiness

T = "snapshot_id bigint, target string, match_count int, hidden boolean, x double, y double, width double, height double"
M = "snapshot_id bigint, target string, member_ix int, hidden boolean, x double, y double, width double, height double"


def codes(spark, rules, targets=(), members=()):
    good, bad = lay.rule_table(spark, rules)
    views = spark.createDataFrame([(1, 100.0, 100.0)], "snapshot_id bigint, viewport_width double, viewport_height double")
    found = lay.evaluate(good, views, spark.createDataFrame([(1, *t) for t in targets], T), spark.createDataFrame([(1, *m) for m in members], M))
    return sorted((r.rule_index, r.code, r.operand, r.member_ix) for r in found.collect()), bad.count(), (found, views, good, bad)


def box(name, x, y, w, h, count=1, hidden=False):
    return (name, count, hidden, float(x), float(y), float(w), float(h))


def test_gate(spark):
    targets = [box("a", 0, 0, 5, 5), box("twice", 0, 0, 5, 5, 2), box("gone", 0, 0, 5, 5, 0), box("dark", 0, 0, 5, 5, 1, True), box("flat", 0, 0, 5, 0)]
    rules = [lay.inside("a", n) for n in ("twice", "gone", "dark", "flat", "never")] + [lay.same_size("dark", "dark")]
    got, _, _ = codes(spark, rules, targets)
    assert got == [(0, "duplicate-element", "reference", None), (1, "missing-element", "reference", None), (2, "hidden-element", "reference", None), (3, "zero-size-element", "reference", None), (4, "missing-element", "reference", None), (5, "hidden-element", "subject", None)]


def test_edges_touch(spark):
    targets = [box("a", 0, 0, 10, 10), box("b", 10, 0, 10, 10), box("c", 2, 2, 3, 3)]
    rules = [lay.not_overlap("a", "b"), lay.overlap("a", "b"), lay.left_of("a", "b"), lay.inside("c", "a"), lay.inside("a", "c"), lay.left_of("b", "a"), lay.left_of("a", "b", (1, None)), lay.align("a", "b", "top"), lay.in_viewport("a")]
    got, _, _ = codes(spark, rules, targets)
    assert [(k, c) for k, c, _, _ in got] == [(1, "missing-overlap"), (4, "containment-overflow"), (5, "ordering-violation"), (6, "gap-out-of-range")]


def test_collections(spark):
    members = [("m", 0, False, 0.0, 0.0, 10.0, 10.0), ("m", 1, False, 0.0, 8.0, 12.0, 10.0), ("m", 2, False, 0.0, 40.0, 10.0, 10.0), ("d", 0, True, 0.0, 0.0, 1.0, 1.0)]
    rules = [lay.vertically_ordered("m", (0, 10)), lay.equal_widths("m", 1), lay.pairwise_not_overlap("m"), lay.every_inside("m", "box"), lay.equal_widths("none"), lay.equal_widths("d"), lay.every_inside("m", "gone")]
    got, _, _ = codes(spark, rules, [box("box", 0, 0, 11, 100)], members)
    assert got == [(0, "collection-gap-out-of-range", None, 1), (0, "collection-ordering-violation", None, 0), (1, "collection-width-mismatch", None, 1), (2, "collection-overlap", None, 0), (3, "collection-containment-overflow", None, 1), (4, "empty-collection", "collection", None), (5, "hidden-element", "collection", 0), (6, "missing-element", "container", None)]


def test_overlaps_over_the_grid(spark):
    rng = random.Random(8)
    members = [("m", k, False, rng.uniform(-1500, 1500), rng.uniform(-1500, 1500), rng.uniform(1, 900), rng.uniform(1, 900)) for k in range(40)]
    _, _, (found, *_) = codes(spark, [lay.pairwise_not_overlap("m")], (), members)
    inter = lambda a, b: min(a[3] + a[5], b[3] + b[5]) > max(a[3], b[3]) and min(a[4] + a[6], b[4] + b[6]) > max(a[4], b[4])
    want = [(a[1], b[1]) for i, a in enumerate(members) for b in members[i + 1 :] if inter(a, b)]
    assert sorted((r.member_ix, r.other_ix) for r in found.collect()) == sorted(want)


def test_laws(spark):
    """Overlap and its negation complement each other; a rectangle equals and lies in itself; scale changes nothing."""
    rng = random.Random(5)
    for scale in (1.0, 4.0):
        rng.seed(5)
        targets = [box(f"t{k}", *(scale * rng.uniform(-1000, 1000) for _ in range(2)), *(scale * rng.uniform(0.01, 100) for _ in range(2))) for k in range(12)]
        targets += [box(f"u{k}", t[3] + scale * rng.uniform(-50, 50), t[4], t[5], t[6]) for k, t in enumerate(targets)]
        rules = [r for k in range(12) for r in (lay.overlap(f"t{k}", f"u{k}"), lay.not_overlap(f"t{k}", f"u{k}"), lay.inside(f"t{k}", f"t{k}"), lay.same_size(f"t{k}", f"t{k}"))]
        got, _, _ = codes(spark, rules, targets)
        hit = {k for k, *_ in got}
        assert all((4 * k in hit) != (4 * k + 1 in hit) and not {4 * k + 2, 4 * k + 3} & hit for k in range(12))
        first = hit if scale == 1.0 else first
    assert first == hit


def test_rule_validation(spark):
    assert [c for c, _ in lay.validate({"kind": "align", "subject": "a", "alignment": "middle", "tolerance": -1, "x": 1})] == ["unknown-field", "missing-field", "invalid-value", "invalid-value"]
    for bad in (lambda: lay.above("a", "b", (5, 1)), lambda: lay.overlap("a", "b", (None, 0)), lambda: lay.width("a"), lambda: lay.inside("", "b"), lambda: lay.Rule("float", "a")):
        with pytest.raises(ValueError):
            bad()
    got, bad, (found, views, good, invalid) = codes(spark, [{"kind": "width", "subject": "a", "h_max": 3}, {"kind": "height"}], [box("a", 0, 0, 5, 5)])
    assert got == [(0, "dimension-out-of-range", None, None)] and bad == 2
    row = lay.report(found, views, good, invalid).first()
    assert (row.passed, row.failed_rules, row.skipped_rules) == (False, 2, 0)
    assert "dimension-out-of-range" in lay.describe(found.first().asDict())


def test_invalid_snapshots(spark):
    views = spark.createDataFrame([(1, 100.0, 100.0), (2, 0.0, 5.0), (3, 10.0, 10.0)], "snapshot_id bigint, viewport_width double, viewport_height double")
    targets = spark.createDataFrame([(1, *box("a", 0, 0, 1, 1)), (3, *box("b", 0, 0, -1, 1)), (3, *box("c", 0, 0, 1, 1)), (3, *box("c", 0, 0, 1, 1))], T)
    got = {(r.snapshot_id, r.problem) for r in lay.invalid_snapshots(views, targets, spark.createDataFrame([], M)).collect()}
    assert got == {(2, "viewport"), (3, "rectangle"), (3, "repeated-target")}


@pytest.mark.parametrize(
    ("problem", "view", "target", "member"),
    [("viewport", (0.0, 5.0), None, None), ("rectangle", None, (2, *box("a", 0, 0, -1, 1)), None), ("repeated-target", None, (1, *box("a", 0, 0, 1, 1)), None), ("member", None, None, (2, "items", 5, None, 0.0, 0.0, 1.0, 1.0)), ("match-count", None, (2, "z", -1, None, None, None, None, None), None)],
)
def test_malformed_snapshots_stop_the_evaluation(spark, problem, view, target, member):
    views = spark.createDataFrame([(1, 100.0, 100.0), (2, *(view or (9.0, 9.0)))], "snapshot_id bigint, viewport_width double, viewport_height double")
    targets = spark.createDataFrame([(1, *box("a", 0, 0, 1, 1)), *([target] if target else [])], T)
    members = spark.createDataFrame([(1, "items", 0, False, 0.0, 0.0, 1.0, 1.0), *([member] if member else [])], M)
    rules, _ = lay.rule_table(spark, [lay.in_viewport("a"), lay.pairwise_not_overlap("items")])
    assert lay.evaluate(rules, views.where("snapshot_id = 1"), targets.where("snapshot_id = 1").limit(1), members.where("snapshot_id = 1")).count() == 0
    with pytest.raises(Exception, match=f"malformed snapshot {1 if problem == 'repeated-target' else 2}: {problem}"):
        lay.evaluate(rules, views, targets, members).collect()


def overlapping(spark, boxes):
    views = spark.createDataFrame([(1, 1e9, 1e9)], "snapshot_id bigint, viewport_width double, viewport_height double")
    members = spark.createDataFrame([(1, "items", k, False, *map(float, r)) for k, r in enumerate(boxes)], M)
    rules, _ = lay.rule_table(spark, [lay.pairwise_not_overlap("items")])
    return lay.evaluate(rules, views, spark.createDataFrame([], T), members)


def test_overlaps_of_all_sizes(spark):
    rng = random.Random(9)
    size = lambda: rng.choice([0.3, 1, 2, 7.5, 64, 1000, 2**20]) * rng.choice([1, 1, rng.random() + 0.01])
    boxes = [(rng.uniform(-50, 2000), rng.uniform(-50, 2000), size(), size()) for _ in range(250)] + [(k, 0, 1, 1) for k in range(20)] + [(5, 5, 2, 2)] * 3
    meets = lambda p, q: min(p[0] + p[2], q[0] + q[2]) - max(p[0], q[0]) > 0 and min(p[1] + p[3], q[1] + q[3]) - max(p[1], q[1]) > 0
    want = sorted((i, j) for i in range(len(boxes)) for j in range(i + 1, len(boxes)) if meets(boxes[i], boxes[j]))
    got = sorted((r.member_ix, r.other_ix) for r in overlapping(spark, boxes).collect())
    assert got == want and len(want) > 100


def joined_rows(spark, boxes):
    """Rows that the joins by cells give, of a run."""
    df = overlapping(spark, boxes)
    n = df.count()
    df.write.format("noop").mode("overwrite").save()
    found = []

    def walk(node):
        name = node.nodeName()
        if "Join" in name and node.metrics().contains("numOutputRows"):
            found.append(node.metrics().apply("numOutputRows").value())
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return n, max(found, default=0)


def test_overlaps_in_bounded_rows(spark):
    """A square of a million pixels among small ones, and many small or thin ones side by side: no pair but the large one's."""
    large = [(0, 0, 1e6, 1e6)] + [(2e6 + 10 * k, 0, 5, 5) for k in range(3000)]
    small = [(10 * (k % 60) + 0.5, 10 * (k // 60) + 0.5, 9, 9) for k in range(3000)]
    thin = [(0.2 * k, 0, 0.1, 1000) for k in range(3000)]
    for boxes in (large, small, thin):
        n, rows = joined_rows(spark, boxes)
        assert n == 0 and rows < 40 * len(boxes)


FRAMES = [("a", 1, [5, 6, 6, 6, 7]), ("b", 1, [1, 1, None, 1, 1]), ("c", 1, [2, 2, 2, 3, 3])]


def frames(spark):
    rows = [(1, k, t, 0 if x is None else n, float(x or 0), float(k), 1.0, 1.0) for t, n, xs in FRAMES for k, x in enumerate(xs)]
    return spark.createDataFrame(rows, readiness.FRAMES)


def test_readiness(spark):
    wanted = readiness.needs([lay.align("a", "b", "left"), lay.left_of("c", "a")])
    assert wanted == {"a": ("x", "width"), "b": ("x",), "c": ("x", "width")}
    out = readiness.ready(frames(spark), wanted, 2)
    assert {r.target: r.ready_frame for r in out.collect()} == {"a": 3, "b": None, "c": 2}
    assert readiness.unready(out).first().targets == ["b"]


def test_readiness_stream(spark, tmp_path):
    wanted = {"a": ("x",), "b": ("x",), "c": ("x",)}
    df = frames(spark).coalesce(1)
    for k in range(5):
        df.where(f"frame_no = {k}").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = readiness.ready_stream(stream, wanted, 2).writeStream.format("memory").queryName("ready").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.target, r.ready_frame) for r in spark.table("ready").collect()} == {("a", 3), ("c", 2)}


def test_exact_diagnostics(spark):
    rules, _ = lay.rule_table(spark, [lay.same_width("a", "b", 0.1), lay.above("a", "b", (1, None), 0.2), lay.width("a", 2)])
    row = lambda rule, code, actual, category="layout": (1, rule, 0, category, code, 'a"', "b", None, None, None, actual)
    given = [row(0, "size-mismatch", 0.3), row(0, "size-mismatch", 0.1 + 0.2), row(0, "size-mismatch", 1e-7), row(0, "size-mismatch", 1e25), row(0, "size-mismatch", 123456789.125), row(1, "ordering-violation", -0.5), row(1, "gap-out-of-range", -0.0), row(2, "dimension-out-of-range", 1.5), row(0, "missing-element", None, "element-resolution"), row(9, "size-mismatch", 1.0)]
    df = spark.createDataFrame([(k, *g[1:]) for k, g in enumerate(given)], lay.FINDINGS)
    got = {r.snapshot_id: r for r in lay.diagnostics(df, rules).withColumn("said", lay.plain(F.col("excess"))).collect()}
    assert [got[k].said for k in range(10)] == ["0.2", "0.20000000000000004", None, None, "123456789.025", "0.3", None, None, None, None]
    assert [got[k].expected for k in (0, 5, 6, 7, 8, 9)] == ["at most 0.1px", "at most 0.2px", "gap at least 1px", "across at least 2px", None, None]
    assert got[0].text == 'rule 0: size-mismatch\nsubject: "a\\""\nreference: "b"\nexpected: at most 0.1px\nactual: 0.3px\nexcess: 0.2px'
    assert "actual: 0px" in got[6].text and "actual: 0.0000001px" in got[2].text and "actual: 1.0E25px" in got[3].text and got[9].text is None


@pytest.mark.parametrize("name", ["equal_widths", "every_inside", "vertically_ordered", "pairwise_not_overlap"])
def test_equal_lines_in_any_order(spark, tmp_path, name):
    """Lines that differ only in being hidden are the same members however the table's rows lie."""
    line = "l_orderkey bigint, l_linenumber int, l_suppkey bigint, l_partkey bigint, l_quantity double, l_discount double"
    lines = [(1, 1, 3, 5, 4.0, 0.01), (1, 2, 10, 5, 4.0, 0.01), (1, 2, 7, 5, 4.0, 0.01), (1, 2, 20, 102, 4.0, 0.01), (1, 2, 9, 5, 4.0, 0.01)]
    got = []
    for k, rows in enumerate((lines, lines[::-1], lines[2:] + lines[:2])):
        spark.createDataFrame(rows, line).coalesce(1).write.parquet(f"{tmp_path}/{k}/lineitem.parquet")
        spark.createDataFrame([(1,)], "o_orderkey bigint").write.parquet(f"{tmp_path}/{k}/orders.parquet")
        got.append(sorted(map(tuple, QUERIES[f"layout_{name}"](spark, f"{tmp_path}/{k}").collect())))
    assert got[0] == got[1] == got[2] and [r[2] for r in got[0]] == [3, 4]
