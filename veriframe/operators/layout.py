"""Layout rules over snapshots of named rectangles.

Facts: ``snapshots`` (snapshot_id, viewport_width, viewport_height), ``targets`` (snapshot_id, target, match_count,
hidden, x, y, width, height) and ``members`` (snapshot_id, target, member_ix, hidden, x, y, width, height).  Rules are
made by the constructors below and become a small table that is joined with the facts, so all snapshots and rules are
one job.  A rule whose rectangles are missing, repeated, hidden or without size is not evaluated but reported as such.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EDGES = ("left", "right", "top", "bottom", "centerX", "centerY")
PAIRS = ("align", "above", "below", "leftOf", "rightOf", "overlap", "notOverlap", "inside", "sameWidth", "sameHeight", "sameSize")
SINGLE = ("width", "height", "inViewport")
COLLECTIONS = ("everyInside", "equalWidths", "verticallyOrdered", "pairwiseNotOverlap")
RULE_SCHEMA = "rule_index int, kind string, subject string, reference string, alignment string, tolerance double, gap_min double, gap_max double, h_min double, h_max double, v_min double, v_max double"
FINDINGS = "snapshot_id bigint, rule_index int, seq int, category string, code string, subject string, reference string, operand string, member_ix int, other_ix int, actual double"


@dataclass(frozen=True)
class Rule:
    kind: str
    subject: str
    reference: str | None = None
    alignment: str | None = None
    tolerance: float = 0.0
    gap_min: float | None = None
    gap_max: float | None = None
    h_min: float | None = None
    h_max: float | None = None
    v_min: float | None = None
    v_max: float | None = None

    def __post_init__(self) -> None:
        if problems := validate(asdict(self)):
            raise ValueError("; ".join(m for _, m in problems))


def validate(rule: Mapping[str, Any]) -> list[tuple[str, str]]:
    """(code, message) of everything wrong with a rule; codes missing-field, invalid-type, invalid-value, unknown-field."""
    out: list[tuple[str, str]] = []
    kind = rule.get("kind")
    if kind is None:
        return [("missing-field", "kind is missing")]
    if kind not in PAIRS + SINGLE + COLLECTIONS:
        return [("invalid-value", f"kind {kind!r} is unknown")]
    numbers = ("tolerance", "gap_min", "gap_max", "h_min", "h_max", "v_min", "v_max")
    out += [("unknown-field", f"{k} is unknown") for k in rule if k not in ("kind", "subject", "reference", "alignment", *numbers)]
    needed = ["subject", *(["reference"] if kind in PAIRS or kind == "everyInside" else []), *(["alignment"] if kind == "align" else [])]
    for k in needed:
        if rule.get(k) is None:
            out.append(("missing-field", f"{k} is missing"))
        elif not isinstance(rule[k], str):
            out.append(("invalid-type", f"{k} must be a string"))
        elif not rule[k].strip():
            out.append(("invalid-value", f"{k} is blank"))
    if kind == "align" and isinstance(rule.get("alignment"), str) and rule["alignment"] not in EDGES:
        out.append(("invalid-value", f"alignment {rule['alignment']!r} is unknown"))
    for k in numbers:
        v = rule.get(k)
        if v is None:
            continue
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            out.append(("invalid-type", f"{k} must be a number"))
        elif not math.isfinite(v) or (v < 0 and k != "gap_min" and k != "gap_max"):
            out.append(("invalid-value", f"{k} must be finite and not negative"))
    for low, high in (("gap_min", "gap_max"), ("h_min", "h_max"), ("v_min", "v_max")):
        a, b = rule.get(low), rule.get(high)
        if isinstance(a, (int, float)) and isinstance(b, (int, float)) and a > b:
            out.append(("invalid-value", f"{low} is above {high}"))
    if kind == "overlap":
        out += [("invalid-value", f"{k} must be above 0") for k in ("h_max", "v_max") if isinstance(rule.get(k), (int, float)) and rule[k] <= 0]
    if kind in ("width", "height") and rule.get("h_min") is None and rule.get("h_max") is None:
        out.append(("missing-field", "h_min or h_max is missing"))
    return out


def align(subject: str, reference: str, edge: str, tolerance: float = 0.0) -> Rule:
    return Rule("align", subject, reference, alignment=edge, tolerance=tolerance)


def _order(kind: str):
    def make(subject: str, reference: str, gap: tuple[float | None, float | None] = (None, None), tolerance: float = 0.0) -> Rule:
        return Rule(kind, subject, reference, tolerance=tolerance, gap_min=gap[0], gap_max=gap[1])

    make.__name__ = kind
    return make


above, below, left_of, right_of = _order("above"), _order("below"), _order("leftOf"), _order("rightOf")


def overlap(subject: str, reference: str, horizontal: tuple = (None, None), vertical: tuple = (None, None)) -> Rule:
    return Rule("overlap", subject, reference, h_min=horizontal[0], h_max=horizontal[1], v_min=vertical[0], v_max=vertical[1])


def not_overlap(subject: str, reference: str) -> Rule:
    return Rule("notOverlap", subject, reference)


def inside(subject: str, reference: str, tolerance: float = 0.0) -> Rule:
    return Rule("inside", subject, reference, tolerance=tolerance)


def same_width(subject: str, reference: str, tolerance: float = 0.0) -> Rule:
    return Rule("sameWidth", subject, reference, tolerance=tolerance)


def same_height(subject: str, reference: str, tolerance: float = 0.0) -> Rule:
    return Rule("sameHeight", subject, reference, tolerance=tolerance)


def same_size(subject: str, reference: str, tolerance: float = 0.0) -> Rule:
    return Rule("sameSize", subject, reference, tolerance=tolerance)


def width(target: str, least: float | None = None, most: float | None = None) -> Rule:
    return Rule("width", target, h_min=least, h_max=most)


def height(target: str, least: float | None = None, most: float | None = None) -> Rule:
    return Rule("height", target, h_min=least, h_max=most)


def in_viewport(target: str) -> Rule:
    return Rule("inViewport", target)


def every_inside(collection: str, container: str, tolerance: float = 0.0) -> Rule:
    return Rule("everyInside", collection, container, tolerance=tolerance)


def equal_widths(collection: str, tolerance: float = 0.0) -> Rule:
    return Rule("equalWidths", collection, tolerance=tolerance)


def vertically_ordered(collection: str, gap: tuple[float | None, float | None] = (None, None)) -> Rule:
    return Rule("verticallyOrdered", collection, gap_min=gap[0], gap_max=gap[1])


def pairwise_not_overlap(collection: str) -> Rule:
    return Rule("pairwiseNotOverlap", collection)


def rule_table(spark: SparkSession, rules: Iterable[Rule | Mapping[str, Any]]) -> tuple[DataFrame, DataFrame]:
    """The valid rules, and a finding (without snapshot) for everything wrong with the others."""
    good, bad = [], []
    for k, rule in enumerate(rules):
        given = asdict(rule) if isinstance(rule, Rule) else dict(rule)
        problems = validate(given)
        bad += [(k, n, "invalid-rule", code, message) for n, (code, message) in enumerate(problems)]
        if not problems:
            number = lambda key, g=given: None if g.get(key) is None else float(g[key])
            good.append((k, given["kind"], given["subject"], given.get("reference"), given.get("alignment"), float(given.get("tolerance") or 0), *map(number, ("gap_min", "gap_max", "h_min", "h_max", "v_min", "v_max"))))
    return spark.createDataFrame(good, RULE_SCHEMA), spark.createDataFrame(bad, "rule_index int, seq int, category string, code string, message string")


def _finite(*columns: Column | str) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)) for c in columns])


def _shape() -> Column:
    return _finite("x", "y", "width", "height") & _finite(F.col("x") + F.col("width"), F.col("y") + F.col("height")) & (F.col("width") >= 0) & (F.col("height") >= 0)


def invalid_snapshots(snapshots: DataFrame, targets: DataFrame, members: DataFrame) -> DataFrame:
    """snapshot_id and problem of malformed facts; evaluate() fails on those."""
    finite, shape = _finite, _shape
    view = snapshots.where(~(finite("viewport_width", "viewport_height") & (F.col("viewport_width") > 0) & (F.col("viewport_height") > 0))).select("snapshot_id", F.lit("viewport").alias("problem"))
    one = targets.where(F.coalesce(F.col("match_count"), F.lit(-1)) < 0).select("snapshot_id", F.lit("match-count").alias("problem"))
    rect = targets.where((F.col("match_count") == 1) & ~(shape() & F.col("hidden").isNotNull())).select("snapshot_id", F.lit("rectangle").alias("problem"))
    many = members.where(~(shape() & F.col("hidden").isNotNull())).select("snapshot_id", F.lit("member").alias("problem"))
    twice = targets.groupBy("snapshot_id", "target").count().where("count > 1").select("snapshot_id", F.lit("repeated-target").alias("problem"))
    return reduce(DataFrame.union, [view, one, rect, many, twice]).distinct()


def _checked(rows: DataFrame, *problems: tuple[str, Column]) -> DataFrame:
    """``rows`` whose ids can't be read where there is a problem: the plan itself fails, with the snapshot and the first
    problem, and needs no pass of its own."""
    bad = F.lit(None).cast("string")
    for name, cond in reversed(problems):
        bad = F.when(cond, name).otherwise(bad)
    own = F.col("snapshot_id")
    told = F.raise_error(F.concat(F.lit("malformed snapshot "), F.coalesce(own.cast("string"), F.lit("without id")), F.lit(": "), bad))
    return rows.withColumn("snapshot_id", F.when(bad.isNull(), own).otherwise(told.cast(rows.schema["snapshot_id"].dataType)))


def _guarded(snapshots: DataFrame, targets: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The facts, which fail where invalid_snapshots() has something to say."""
    view, shape = _finite("viewport_width", "viewport_height") & (F.col("viewport_width") > 0) & (F.col("viewport_height") > 0), _shape() & F.col("hidden").isNotNull()
    twice = F.count("*").over(Window.partitionBy("snapshot_id", "target"))
    one = _checked(targets.withColumn("_times", twice), ("match-count", F.coalesce(F.col("match_count"), F.lit(-1)) < 0), ("rectangle", (F.col("match_count") == 1) & ~shape), ("repeated-target", F.col("_times") > 1))
    return _checked(snapshots, ("viewport", ~view)), one.drop("_times"), _checked(members, ("member", ~shape))


def _edges(side: str) -> dict[str, Column]:
    x, y, w, h = (F.col(f"{side}.{c}") for c in ("x", "y", "width", "height"))
    return {"x": x, "y": y, "w": w, "h": h, "right": x + w, "bottom": y + h}


def _outside(value: Column, low: str, high: str) -> Column:
    """Bounds are inclusive, a missing one is open."""
    return F.coalesce(value < F.col(low), F.lit(False)) | F.coalesce(value > F.col(high), F.lit(False))


def _depth(a: dict[str, Column], b: dict[str, Column]) -> tuple[Column, Column]:
    zero = F.lit(0.0)
    return (F.greatest(zero, F.least(a["right"], b["right"]) - F.greatest(a["x"], b["x"])), F.greatest(zero, F.least(a["bottom"], b["bottom"]) - F.greatest(a["y"], b["y"])))


def _overflow(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return F.greatest(F.lit(0.0), b["x"] - a["x"], a["right"] - b["right"], b["y"] - a["y"], a["bottom"] - b["bottom"])


def _pair_code() -> tuple[Column, Column]:
    """Code (null if the rule holds) and the number it's about."""
    s, r, kind, tol = _edges("s"), _edges("r"), F.col("kind"), F.col("tolerance")

    def at(e: dict[str, Column]) -> Column:
        a = F.col("alignment")
        return F.when(a == "left", e["x"]).when(a == "right", e["right"]).when(a == "top", e["y"]).when(a == "bottom", e["bottom"]).when(a == "centerX", (e["x"] + e["right"]) / 2).otherwise((e["y"] + e["bottom"]) / 2)

    apart = F.abs(at(s) - at(r))
    gap = F.when(kind == "leftOf", r["x"] - s["right"]).when(kind == "rightOf", s["x"] - r["right"]).when(kind == "above", r["y"] - s["bottom"]).otherwise(s["y"] - r["bottom"])
    across, down = _depth(s, r)
    meets = (across > 0) & (down > 0)
    overflow = _overflow(s, r)
    wide, high = F.abs(s["w"] - r["w"]), F.abs(s["h"] - r["h"])
    order = kind.isin("above", "below", "leftOf", "rightOf")
    code = (
        F.when(kind == "align", F.when(apart > tol, "alignment-mismatch"))
        .when(order, F.when(F.greatest(F.lit(0.0), -gap) > tol, "ordering-violation").when(_outside(gap, "gap_min", "gap_max"), "gap-out-of-range"))
        .when(kind == "notOverlap", F.when(meets, "overlap-out-of-range"))
        .when(kind == "overlap", F.when(~meets, "missing-overlap").when(_outside(across, "h_min", "h_max") | _outside(down, "v_min", "v_max"), "overlap-out-of-range"))
        .when(kind == "inside", F.when(~meets | (overflow > tol), "containment-overflow"))
        .when(kind == "sameWidth", F.when(wide > tol, "size-mismatch"))
        .when(kind == "sameHeight", F.when(high > tol, "size-mismatch"))
        .when(kind == "sameSize", F.when((wide > tol) | (high > tol), "size-mismatch"))
    )
    actual = F.when(kind == "align", apart).when(order, gap).when(kind.isin("overlap", "notOverlap"), F.least(across, down)).when(kind == "inside", overflow).when(kind == "sameWidth", wide).when(kind == "sameHeight", high).otherwise(F.greatest(wide, high))
    return code, actual


def _single_code() -> tuple[Column, Column]:
    s, kind = _edges("s"), F.col("kind")
    outside = ~((s["x"] >= 0) & (s["y"] >= 0) & (s["right"] <= F.col("viewport_width")) & (s["bottom"] <= F.col("viewport_height")))
    size = F.when(kind == "width", s["w"]).otherwise(s["h"])
    code = F.when(kind == "inViewport", F.when(outside, "viewport-overflow")).when(_outside(size, "h_min", "h_max"), "dimension-out-of-range")
    spill = F.greatest(-s["x"], -s["y"], s["right"] - F.col("viewport_width"), s["bottom"] - F.col("viewport_height"))
    return code, F.when(kind == "inViewport", spill).otherwise(size)


def _gate(side: str) -> Column:
    """Why a rectangle can't be evaluated, first reason only; null if it can."""
    t = F.col(side)
    n = F.coalesce(t["match_count"], F.lit(0))
    return F.when(n == 0, "missing-element").when(n > 1, "duplicate-element").when(t["hidden"], "hidden-element").when((t["width"] == 0) | (t["height"] == 0), "zero-size-element")


def _row(seq: Column, category: Column | str, code: Column, operand: Column | None = None, member: Column | None = None, other: Column | None = None, actual: Column | None = None) -> list[Column]:
    null = F.lit(None)
    return [
        F.col("snapshot_id").cast("long").alias("snapshot_id"), F.col("rule_index"), seq.cast("int").alias("seq"), (F.lit(category) if isinstance(category, str) else category).alias("category"), code.alias("code"), F.col("subject"), F.col("reference"),
        (null if operand is None else operand).cast("string").alias("operand"), (null if member is None else member).cast("int").alias("member_ix"), (null if other is None else other).cast("int").alias("other_ix"), (null if actual is None else actual).cast("double").alias("actual"),
    ]


def _gated(code: Column) -> Column:
    return F.when(code.isin("missing-element", "duplicate-element", "empty-collection"), "element-resolution").otherwise("element-visibility")


def _findings(rows: DataFrame, *found: tuple[Column, list[Column]]) -> DataFrame:
    """The findings of each row, in one pass: (condition, _row) for each that it may have."""
    return rows.select(F.inline(F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(*parts)) for cond, parts in found]), lambda x: x.isNotNull())))


def evaluate(rules: DataFrame, snapshots: DataFrame, targets: DataFrame, members: DataFrame) -> DataFrame:
    """Findings (FINDINGS) of all valid rules on all snapshots.  Only what the rules' kinds need is part of the plan, and
    malformed facts among that make it fail with the snapshot's id."""
    snapshots, targets, members = _guarded(snapshots, targets, members)
    kinds = {r.kind for r in rules.select("kind").distinct().collect()}  # a rule table is configuration, not data
    few = F.broadcast(rules)
    rect = F.struct("match_count", "hidden", "x", "y", "width", "height")
    one = targets.select("snapshot_id", "target", rect.alias("t"))
    views = snapshots.select("snapshot_id", "viewport_width", "viewport_height")
    found = []
    if kinds & {*PAIRS, *SINGLE}:
        found.append(_singular(few, views, one, bool(kinds & set(PAIRS))))
    if kinds & set(COLLECTIONS):
        found += _collections(few, views, one, members, kinds)
    return reduce(DataFrame.union, found) if found else snapshots.sparkSession.createDataFrame([], FINDINGS)


def _singular(rules: DataFrame, views: DataFrame, one: DataFrame, pairs: bool) -> DataFrame:
    rows = views.join(rules.where(F.col("kind").isin(*PAIRS, *SINGLE)))
    rows = rows.join(one.select("snapshot_id", F.col("target").alias("subject"), F.col("t").alias("s")), ["snapshot_id", "subject"], "left")
    if pairs:
        rows = rows.join(one.select("snapshot_id", F.col("target").alias("reference"), F.col("t").alias("r")), ["snapshot_id", "reference"], "left")
    else:
        rows = rows.withColumn("r", F.lit(None).cast(one.schema["t"].dataType))
    is_pair = F.col("kind").isin(*PAIRS)
    # subject and reference may be one target: then its problem is told once
    second = is_pair & (F.col("subject") != F.col("reference"))
    pair, single = _pair_code(), _single_code()
    rows = rows.withColumn("gs", _gate("s")).withColumn("gr", F.when(second, _gate("r")))
    seen = F.col("gs").isNull() & F.col("gr").isNull()
    code, actual = (F.when(is_pair, pair[0]).otherwise(single[0]), F.when(is_pair, pair[1]).otherwise(single[1])) if pairs else single
    return _findings(
        rows.withColumn("code", F.when(seen, code)),
        (F.col("gs").isNotNull(), _row(F.lit(0), _gated(F.col("gs")), F.col("gs"), F.lit("subject"))),
        (F.col("gr").isNotNull(), _row(F.lit(1), _gated(F.col("gr")), F.col("gr"), F.lit("reference"))),
        (F.col("code").isNotNull(), _row(F.lit(0), "layout", F.col("code"), actual=actual)),
    )


def _collections(rules: DataFrame, views: DataFrame, one: DataFrame, members: DataFrame, kinds: set[str]) -> list[DataFrame]:
    box = F.struct("member_ix", "hidden", "x", "y", "width", "height").alias("m")
    own = members.select("snapshot_id", F.col("target").alias("subject"), box)
    group = views.select("snapshot_id").join(rules.where(F.col("kind").isin(*COLLECTIONS)))
    if "everyInside" in kinds:
        group = group.join(one.select("snapshot_id", F.col("target").alias("reference"), F.col("t").alias("r")), ["snapshot_id", "reference"], "left")
        group = group.withColumn("gr", F.when(F.col("kind") == "everyInside", _gate("r")))
    else:
        group = group.withColumn("r", F.lit(None).cast(one.schema["t"].dataType)).withColumn("gr", F.lit(None).cast("string"))
    rows = group.join(own, ["snapshot_id", "subject"], "left")
    m, kind = F.col("m"), F.col("kind")
    bad = F.when(m["member_ix"].isNull(), "empty-collection").when(m["hidden"], "hidden-element").when((m["width"] == 0) | (m["height"] == 0), "zero-size-element")
    # the members of one collection, in order: one sort serves all that is asked of them
    whole = Window.partitionBy("snapshot_id", "rule_index")
    by = whole.orderBy(m["member_ix"])
    rows = rows.withColumn("gm", bad).withColumns({
        "barred": (F.count("gm").over(whole) > 0) | F.col("gr").isNotNull(), "place": F.row_number().over(by), "first": F.first(m["width"]).over(by), "next": F.lead("m").over(by),
    })
    good, s, r = ~F.col("barred"), _edges("m"), _edges("r")
    across, down = _depth(s, r)
    overflow = _overflow(s, r)
    apart = F.round(F.abs(m["width"] - F.col("first")) * 1e12) / 1e12
    gap = F.col("next")["y"] - (m["y"] + m["height"])
    order = F.when(gap < 0, "collection-ordering-violation").when(_outside(gap, "gap_min", "gap_max"), "collection-gap-out-of-range")
    found = [
        (F.col("gm").isNotNull(), _row(F.coalesce(m["member_ix"], F.lit(0)), _gated(F.col("gm")), F.col("gm"), F.lit("collection"), m["member_ix"])),
        ((F.col("place") == 1) & F.col("gr").isNotNull(), _row(F.lit(-1), _gated(F.col("gr")), F.col("gr"), F.lit("container"))),
    ]
    if "everyInside" in kinds:
        outside = ~((across > 0) & (down > 0)) | (overflow > F.col("tolerance"))
        found.append((good & (kind == "everyInside") & outside, _row(m["member_ix"], "layout", F.lit("collection-containment-overflow"), member=m["member_ix"], actual=overflow)))
    if "equalWidths" in kinds:
        other = (m["member_ix"] > 0) & (apart > F.col("tolerance"))
        found.append((good & (kind == "equalWidths") & other, _row(m["member_ix"], "layout", F.lit("collection-width-mismatch"), member=m["member_ix"], actual=apart)))
    if "verticallyOrdered" in kinds:
        found.append((good & (kind == "verticallyOrdered") & F.col("next").isNotNull() & order.isNotNull(), _row(m["member_ix"], "layout", order, member=m["member_ix"], other=F.col("next")["member_ix"], actual=gap)))
    out = [_findings(rows, *found)]
    return [*out, _overlaps(rows.where(good & (kind == "pairwiseNotOverlap")))] if "pairwiseNotOverlap" in kinds else out


def _overlaps(good: DataFrame) -> DataFrame:
    """Pairs of members that overlap.

    Members are joined by cells of grids, never each with each.  A member's own grid has cells as wide and as high as the
    next powers of four, so it touches four of them at most, whatever its size.  Two members meet in the grid of the larger
    width and the larger height of the two: that of one of them, which owns it, or one that has one's width and the
    other's height.  So a member is entered once in each grid of its collection that is as coarse as its own or coarser,
    and there an owner meets all, and who owns the width meets who owns the height.  A pair counts in the cell of its
    intersection's upper left corner only.  Rows besides the pairs: members times the distinct powers of four, squared."""
    level = lambda size: (2 * F.ceil(F.log2(size) / 2)).cast("int")
    group = Window.partitionBy("snapshot_id", "rule_index")
    box = ("member_ix", "x", "y", "width", "height")
    rows = good.select("snapshot_id", "rule_index", "subject", "reference", *[F.col("m")[c].alias(c) for c in box]).withColumns({"own_x": level("width"), "own_y": level("height")})
    rows = rows.withColumns({"xs": F.collect_set("own_x").over(group), "ys": F.collect_set("own_y").over(group)})
    coarser = lambda levels, own: F.explode(F.filter(levels, lambda k: k >= F.col(own)))
    rows = rows.withColumn("lx", coarser("xs", "own_x")).withColumn("ly", coarser("ys", "own_y"))
    cell = lambda v, k: F.floor(v / F.pow(F.lit(2.0), F.col(k)))
    span = lambda low, size, k: F.explode(F.sequence(cell(F.col(low), k), cell(F.col(low) + F.col(size), k)))
    rows = rows.withColumn("cx", span("x", "width", "lx")).withColumn("cy", span("y", "height", "ly"))
    by = ["snapshot_id", "rule_index", "lx", "ly", "cx", "cy"]
    owns_x, owns_y = F.col("lx") == F.col("own_x"), F.col("ly") == F.col("own_y")
    owns = (owns_x & owns_y).alias("owns")
    one = lambda where: rows.where(where).select(*by, "subject", "reference", F.struct(*box).alias("a"))
    other = lambda where: rows.where(where).select(*by, F.struct(*box).alias("b"), owns)
    a, b = _edges("a"), _edges("b")
    across, down = _depth(a, b)
    home = (cell(F.greatest(a["x"], b["x"]), "lx") == F.col("cx")) & (cell(F.greatest(a["y"], b["y"]), "ly") == F.col("cy"))
    # two owners of one grid meet once
    met = one(owns_x & owns_y).join(other(F.lit(True)), by).where(~F.col("owns") | (F.col("a.member_ix") < F.col("b.member_ix")))
    met = met.unionByName(one(owns_x & ~owns_y).join(other(~owns_x & owns_y), by))
    pairs = met.where((F.col("a.member_ix") != F.col("b.member_ix")) & (across > 0) & (down > 0) & home)
    first, second = F.least("a.member_ix", "b.member_ix"), F.greatest("a.member_ix", "b.member_ix")
    return pairs.select(*_row(first, "layout", F.lit("collection-overlap"), member=first, other=second, actual=F.least(across, down)))


def report(findings: DataFrame, snapshots: DataFrame, rules: DataFrame, invalid: DataFrame) -> DataFrame:
    """snapshot_id, passed, failed_rules and skipped_rules; an invalid rule fails every snapshot."""
    skipped = F.col("category").isin("element-resolution", "element-visibility")
    sums = findings.groupBy("snapshot_id").agg(F.count_distinct(F.when(~skipped, F.col("rule_index"))).alias("f"), F.count_distinct(F.when(skipped, F.col("rule_index"))).alias("skipped_rules"), F.count("*").alias("n"))
    bad = invalid.select("rule_index").distinct().count()
    return snapshots.select(F.col("snapshot_id").cast("long")).join(sums, "snapshot_id", "left").select(
        "snapshot_id",
        (F.coalesce("n", F.lit(0)) + bad == 0).alias("passed"),
        (F.coalesce("f", F.lit(0)) + bad).alias("failed_rules"),
        F.coalesce("skipped_rules", F.lit(0)).alias("skipped_rules"),
    )


def exact(value: Column) -> Column:
    """A double as the decimal that its shortest text names; null for what has more than 19 digits before the point, or
    isn't finite.  Digits from the 19th after the point on are rounded."""
    return value.cast("string").try_cast("decimal(37,18)")


def plain(number: Column) -> Column:
    """A decimal as text, without zeros at its end and without an exponent."""
    return F.regexp_replace(F.regexp_replace(F.format_number(number, 18), ",", ""), "\\.?0+$", "")


def _pixels(value: Column) -> Column:
    return F.concat(F.coalesce(plain(exact(value)), value.cast("string")), F.lit("px"))


#: Findings whose rule allows a tolerance, and how far apart things are from the finding's number.
_APART = ("alignment-mismatch", "size-mismatch", "containment-overflow", "collection-containment-overflow", "collection-width-mismatch")
_BEHIND = ("ordering-violation", "collection-ordering-violation")


def diagnostics(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """The findings with expected, excess and text.  ``excess`` (decimal) is by how much a tolerance is passed, worked
    out on decimals, so that 0.3 beyond a tolerance of 0.1 is 0.2; null where nothing is tolerated or the number is
    beyond ``exact``.  ``text`` is a diagnosis in lines; findings of unknown rules have none of the three."""
    bounds = ("tolerance", "gap_min", "gap_max", "h_min", "h_max", "v_min", "v_max")
    rows = findings.join(F.broadcast(rules.select("rule_index", *[F.col(b).alias(f"_{b}") for b in bounds], F.lit(True).alias("_known"))), "rule_index", "left")
    code, actual = F.col("code"), F.col("actual")
    apart = F.when(code.isin(*_APART), actual).when(code.isin(*_BEHIND), -actual)
    excess = exact(apart) - exact(F.col("_tolerance"))

    def within(label: str, low: str, high: str) -> Column:
        low, high = F.col(f"_{low}"), F.col(f"_{high}")
        said = F.when(low.isNotNull() & high.isNotNull(), F.concat(_pixels(low), F.lit(" to "), _pixels(high))).when(low.isNotNull(), F.concat(F.lit("at least "), _pixels(low))).when(high.isNotNull(), F.concat(F.lit("at most "), _pixels(high)))
        return F.concat(F.lit(label), said)

    spans = F.concat_ws(", ", within("gap ", "gap_min", "gap_max"), within("across ", "h_min", "h_max"), within("down ", "v_min", "v_max"))
    expected = F.when(apart.isNotNull(), F.concat(F.lit("at most "), _pixels(F.col("_tolerance")))).when((F.col("category") == "layout") & (spans != ""), spans)
    quoted = lambda c: F.to_json(F.struct(c)).substr(F.lit(len(c) + 5), F.length(F.to_json(F.struct(c))) - len(c) - 5)
    line = lambda label, c: F.concat(F.lit(label), c)
    text = F.concat_ws(
        "\n", F.concat(F.lit("rule "), F.col("rule_index").cast("string"), F.lit(": "), code), line("subject: ", quoted("subject")), line("reference: ", quoted("reference")),
        line("operand: ", F.col("operand")), line("member: ", F.col("member_ix").cast("string")), line("other member: ", F.col("other_ix").cast("string")),
        line("expected: ", F.col("expected")), line("actual: ", _pixels(actual)), line("excess: ", F.concat(plain(F.col("excess")), F.lit("px"))),
    )
    rows = rows.withColumns({"expected": expected, "excess": F.when(excess > 0, excess)})
    return rows.withColumn("text", F.when(F.col("_known"), text)).select(*findings.columns, "expected", "excess", "text")


def describe(finding: Mapping[str, Any]) -> str:
    """A line for people about one finding."""
    where = f" member {finding['member_ix']}" if finding.get("member_ix") is not None else ""
    to = f" and {json.dumps(finding['reference'])}" if finding.get("reference") else ""
    return f"rule {finding['rule_index']}: {finding['code']} at {json.dumps(finding['subject'])}{where}{to}" + (f" ({format(Decimal(repr(finding['actual'])), 'f')} px)" if finding.get("actual") is not None else "")
