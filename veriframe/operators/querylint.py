"""Checks of queries over their compiled facts.

Facts are the table of ``sources.query_ir`` and, where a check needs them, ``fields`` (schema, field, column_name, type,
is_pk), ``associations`` (schema, name, related, filtered) and ``unique_keys`` (db_schema, table_name, columns).  What is
true of all branches of a query is a higher-order function over its row; only what needs schema facts is a join.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scope import predicate, rules_of
from ..plans.contract import CheckSpec, meta, normalize, run
from ..plans.store import stored

#: Type names of the schema language.
TEMPORAL = ("date", "time", "time_usec", "naive_datetime", "naive_datetime_usec", "utc_datetime", "utc_datetime_usec")
DATETIMES = ("naive_datetime", "naive_datetime_usec", "utc_datetime", "utc_datetime_usec")
SOFT_DELETE = ("deleted_at", "archived_at")
KEYS = {"ecto_schemas": "schema", "tables": "table_name", "db_schemas": "db_schema", "operations": "operation"}
MIRROR = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}


@dataclass(frozen=True)
class Queries:
    facts: DataFrame
    fields: DataFrame | None = None
    associations: DataFrame | None = None
    unique_keys: DataFrame | None = None


def _scope(rows: DataFrame, options: Mapping[str, Any], allowed: Iterable[str] = ()) -> DataFrame:
    rules = rules_of(options, allowed)
    cond = F.lit(False)
    for r in rules:
        cond = cond | predicate(r, KEYS)
    return rows.where(cond)


def _issues(rows: DataFrame, code: str | Column, message: Column | str, seq: Column | None = None, **parts: Column | str) -> DataFrame:
    return rows.select(
        F.col("query_id").cast("string").alias("subject"), F.col("query_id").alias("subject_order"), (F.lit(0) if seq is None else seq).cast("int").alias("seq"),
        F.lit("query").alias("category"), (F.lit(code) if isinstance(code, str) else code).alias("code"), (F.lit(message) if isinstance(message, str) else message).alias("message"),
        (meta(**parts) if parts else F.lit(None).cast("string")).alias("meta"),
    )


#: What queries with too many branches to tell get: an issue of its own, never a silent pass.
LIMIT, LIMIT_MESSAGE = "analysis-limit", "too many branches to analyze"


def _all_branches(test) -> Column:
    """Whether every branch of every set-operation branch passes ``test(branch)``; false without branches."""
    return (F.size("branches") > 0) & F.forall("branches", test)


def cartesian_joins(q: Queries, options: Mapping[str, Any]) -> DataFrame:
    rows = _scope(q.facts, options).select("query_id", F.explode("joins").alias("j"))
    j = F.col("j")
    cross = j["qual"].isin("cross", "cross_lateral") | (j["on_true"] & j["assoc"].isNull())
    return _issues(rows.where(cross & ~j["correlated"]), "cartesian_join", F.concat(F.lit("join "), j["join_index"].cast("string"), F.lit(" has no condition")), j["join_index"], qual=j["qual"], schema=j["schema"])


def _meet(d: Column, p: Column) -> Column:
    """What all the non-empty predicates of one field in a branch allow."""
    same = F.filter(d, lambda x: (x["field"] == p["field"]) & (F.size(x["vals"]) > 0))
    return F.aggregate(same, p["vals"], lambda acc, x: F.array_intersect(acc, x["vals"]))


def _conflict(d: Column, p: Column) -> Column:
    return (F.size(p["vals"]) > 0) & (F.size(_meet(d, p)) == 0)


def conflicting_where_predicates(q: Queries, options: Mapping[str, Any]) -> DataFrame:
    """No branch can hold, and some field's predicates contradict each other."""
    rows = _scope(q.facts, options).where("schema is not null")
    none = lambda b: F.forall(b["predicates"], lambda d: F.exists(d, lambda p: _conflict(d, p) | (F.size(p["vals"]) == 0)))
    clash = F.flatten(F.transform("branches", lambda b: F.flatten(F.transform(b["predicates"], lambda d: F.transform(F.filter(d, lambda p: _conflict(d, p)), lambda p: p["field"])))))
    over = F.col("over_limit")
    names = F.when(over, F.array(F.lit(None).cast("string"))).when(_all_branches(none), F.array_sort(F.array_distinct(clash)))
    found = rows.select("query_id", "over_limit", F.posexplode(names).alias("k", "field"))
    code, message = F.when(over, LIMIT).otherwise("conflicting_predicates"), F.when(over, LIMIT_MESSAGE).otherwise(F.concat(F.lit("predicates on "), F.col("field"), F.lit(" contradict each other")))
    return _issues(found, code, message, F.col("k"), field="field").withColumn("meta", F.when(F.col("code") != LIMIT, F.col("meta")))


def empty_in_predicates(q: Queries, options: Mapping[str, Any]) -> DataFrame:
    rows = _scope(q.facts, options)
    empty = lambda p: (p["op"] == "in") & (F.size(p["vals"]) == 0)
    every = lambda b: F.forall(b["predicates"], lambda d: F.exists(d, empty))
    names = F.flatten(F.transform("branches", lambda b: F.flatten(F.transform(b["predicates"], lambda d: F.transform(F.filter(d, empty), lambda p: p["field"])))))
    found = rows.where(_all_branches(every)).select("query_id", F.posexplode(F.array_sort(F.array_distinct(names))).alias("k", "field"))
    return _issues(found, "empty_in", F.concat(F.col("field"), F.lit(" is compared with an empty list in every branch")), F.col("k"), field="field")


def _compared(q: Queries, options: Mapping[str, Any]) -> DataFrame:
    """Comparisons with the schema types of their fields: query_id, k, c, ta, tb."""
    rows = _scope(q.facts, options, ("fields",)).select("query_id", F.posexplode("comparisons").alias("k", "c"))
    types = q.fields.select("schema", "field", "type")
    for side in "ab":
        t = types.select(F.col("schema").alias(f"s{side}"), F.col("field").alias(f"f{side}"), F.col("type").alias(f"t{side}"))
        rows = rows.withColumns({f"s{side}": F.col(f"c.{side}.schema"), f"f{side}": F.col(f"c.{side}.field")}).join(t, [f"s{side}", f"f{side}"], "left")
    return rows


def date_datetime_mixed_comparisons(q: Queries, options: Mapping[str, Any]) -> DataFrame:
    """A date field compared with a date and time that isn't cast to a date; one issue for each date field."""
    rows = _compared(q, options)
    kind = lambda t, s: F.coalesce(F.col(f"c.{s}.cast"), F.col(t), F.col(f"c.{s}.literal"))
    a, b = kind("ta", "a"), kind("tb", "b")
    one = (F.col("fa").isNotNull() & (a == "date") & b.isin(*DATETIMES), "fa")
    two = (F.col("fb").isNotNull() & (b == "date") & a.isin(*DATETIMES), "fb")
    field = F.when(one[0], F.col(one[1])).when(two[0], F.col(two[1]))
    op = F.when(one[0], F.col("c.op")).otherwise(_mirrored(F.col("c.op")))
    found = rows.select("query_id", "k", field.alias("field"), op.alias("op")).where("field is not null")
    found = found.groupBy("query_id", "field").agg(F.min("k").alias("k"), F.array_sort(F.collect_set("op")).alias("ops"))
    return _issues(found, "date_datetime_comparison", F.concat(F.lit("date field "), F.col("field"), F.lit(" is compared with a datetime")), F.col("k"), field="field", operators="ops")


def _mirrored(op: Column) -> Column:
    out = op
    for a, b in MIRROR.items():
        out = F.when(op == a, b).otherwise(out)
    return out


def deterministic_order(q: Queries, options: Mapping[str, Any]) -> DataFrame:
    """An order that neither the primary key nor a unique key makes total.  Keys come from ``unique_keys``, if given."""
    rows = _scope(q.facts, options).where("ordered and schema is not null").select("query_id", "schema", "table_name", "db_schema", "order_fields")
    columns = q.fields.groupBy("schema").agg(
        F.collect_set(F.when(F.col("is_pk"), F.col("column_name"))).alias("pk"), F.map_from_entries(F.collect_list(F.struct("field", "column_name"))).alias("names")
    )
    rows = rows.join(columns, "schema").withColumn("by", F.transform("order_fields", lambda f: F.coalesce(F.try_element_at("names", f), f)))
    rows = rows.where(~((F.size("pk") > 0) & (F.size(F.array_except("pk", "by")) == 0)))
    if q.unique_keys is not None:
        keys = q.unique_keys.select(F.col("db_schema").alias("ks"), F.col("table_name").alias("kt"), F.col("columns").alias("key"))
        rows = rows.join(keys, (F.col("kt") == F.col("table_name")) & F.col("ks").eqNullSafe(F.col("db_schema")) & (F.size(F.array_except("key", "by")) == 0), "left_anti")
    return _issues(rows, "unstable_order", "the order isn't total: no primary or unique key is in it", fields="order_fields")


def duplicate_joins(q: Queries, options: Mapping[str, Any]) -> DataFrame:
    # a query's joins are in its row, in order: no row has to move
    at = lambda j: F.array_position(F.transform("joins", lambda x: x["signature"]), j["signature"]).cast("int") - 1
    pairs = F.transform("joins", lambda j: F.struct(j["join_index"].alias("i"), F.get("joins", at(j))["join_index"].alias("first")))
    found = _scope(q.facts, options).select("query_id", F.inline(F.filter(pairs, lambda p: p["i"] > p["first"])))
    return _issues(found, "duplicate_join", F.concat(F.lit("join "), F.col("i").cast("string"), F.lit(" repeats join "), F.col("first").cast("string")), F.col("i"), original="first")


def explicit_visibility_predicates(q: Queries, options: Mapping[str, Any]) -> DataFrame:
    """Configured fields of the schema that some branch doesn't mention."""
    rules = rules_of(options, ("fields",), required=("fields",), default=False)
    have = q.fields.groupBy("schema").agg(F.collect_set("field").alias("have"))
    rows = q.facts.join(have, "schema", "left")
    wanted = F.array_distinct(F.flatten(F.array(*[F.when(predicate(r, KEYS), F.array(*map(F.lit, r["fields"]))).otherwise(F.array().cast("array<string>")) for r in rules])))
    wanted = F.when(F.col("have").isNull(), wanted).otherwise(F.array_intersect(wanted, "have"))
    missing = F.filter(wanted, lambda f: F.exists("branches", lambda b: F.exists(b["mentions"], lambda d: ~F.array_contains(d, f))))
    found = rows.select("query_id", F.posexplode(missing).alias("k", "field"))
    return _issues(found, "missing_visibility", F.concat(F.col("field"), F.lit(" is not mentioned in every branch")), F.col("k"), field="field")


def half_open_temporal_intervals(q: Queries, options: Mapping[str, Any]) -> DataFrame:
    """Root time fields bounded by > or <= instead of >= and <."""
    rows = _compared(q, options).where(~F.col("c.under_not") & (F.col("c.clause") == "where"))
    names = options.get("fields")
    temporal = lambda f, t: F.col(f).isin(*names) if names else F.col(t).isin(*TEMPORAL)
    left = (F.col("c.a.binding") == 0) & F.col("fb").isNull() & temporal("fa", "ta")
    right = (F.col("c.b.binding") == 0) & F.col("fa").isNull() & temporal("fb", "tb")
    rows = rows.select("query_id", "k", F.when(left, F.col("fa")).when(right, F.col("fb")).alias("field"), F.when(left, F.col("c.op")).otherwise(_mirrored(F.col("c.op"))).alias("op"))
    found = rows.where(F.col("field").isNotNull() & F.col("op").isin(">", "<=")).groupBy("query_id", "field").agg(F.min("k").alias("k"), F.array_sort(F.collect_set("op")).alias("ops"))
    return _issues(found, "closed_interval", F.concat(F.col("field"), F.lit(" should be bounded by >= and <")), F.col("k"), field="field", operators="ops")


def hard_delete_on_soft_delete_schema(q: Queries, options: Mapping[str, Any]) -> DataFrame:
    rows = _scope(q.facts, options).where(F.col("operation") == "delete_all").select("query_id", F.explode("branches").alias("b")).select("query_id", F.col("b.schema").alias("schema"))
    soft = q.fields.where(F.col("field").isin(*SOFT_DELETE)).select("schema", "field")
    found = rows.join(soft, "schema").groupBy("query_id", "schema").agg(F.min("field").alias("field"))
    return _issues(found, "hard_delete", F.concat(F.col("schema"), F.lit(" has "), F.col("field"), F.lit(", but rows are deleted")), schema="schema", field="field")


def left_join_where_predicates(q: Queries, options: Mapping[str, Any]) -> DataFrame:
    """Left joins whose null rows every branch rejects."""
    rows = _scope(q.facts, options).select("query_id", F.explode("branches").alias("b")).select("query_id", "b.rejects", "b.path", F.posexplode("b.left_joins").alias("k", "j"))
    own = lambda d: F.filter(d, lambda r: r["binding"] == F.col("j.binding"))
    names = F.array_sort(F.array_distinct(F.transform(F.flatten(F.transform("rejects", own)), lambda r: r["field"])))
    found = rows.where((F.size("rejects") > 0) & F.forall("rejects", lambda d: F.size(own(d)) > 0)).withColumn("names", names)
    return _issues(found, "left_join_rejected", "where rejects the rows that the left join keeps", F.col("k"), fields="names", alias=F.col("j.alias"))


def mandatory_join_keys(q: Queries, options: Mapping[str, Any]) -> DataFrame:
    """Schema joins that don't equate the keys with an earlier binding's."""
    keys, every = options.get("keys"), options.get("match", "any") == "all"
    if not keys:
        raise ValueError("keys are required")
    rows = _scope(q.facts, options).select("query_id", F.explode("joins").alias("j")).where("j.schema is not null and j.assoc is null")
    wanted = F.array(*map(F.lit, keys))
    missing = F.array_except(wanted, F.col("j.key_fields"))
    bad = F.size(missing) > 0 if every else F.size(missing) == len(set(keys))
    return _issues(rows.where(bad), "missing_join_key", F.concat(F.lit("join "), F.col("j.join_index").cast("string"), F.lit(" lacks the keys "), F.array_join(missing, ", ")), F.col("j.join_index"), keys=missing)


def mandatory_where_keys(q: Queries, options: Mapping[str, Any]) -> DataFrame:
    """Branches of the query without the keys: any of them, or all for ``match: all``."""
    rules = rules_of(options, ("fields", "match"), required=("fields",), default=False)
    have = q.fields.groupBy("schema").agg(F.collect_set("field").alias("have")) if q.fields is not None else None
    rows = q.facts.join(have, "schema", "left") if have is not None else q.facts.withColumn("have", F.lit(None).cast("array<string>"))
    nothing = F.array().cast("array<string>")

    def found(k: int, r: Mapping[str, Any]) -> Column:
        """The branches that lack keys under a rule, and those for which it can't be told."""
        wanted = F.array(*map(F.lit, r["fields"]))
        usable = F.when(F.col("have").isNull(), wanted).otherwise(F.array_intersect(wanted, "have"))

        def of(b: Column, n: Column) -> Column:
            if r.get("match", "any") == "all":
                unknown, missing = F.lit(False), F.filter(usable, lambda f: F.exists(b["keys"], lambda d: ~F.array_contains(d, f)))
            else:
                bare = F.exists(b["keys"], lambda d: ~F.arrays_overlap(d, usable))
                # beyond the limit only the fields in every branch are known: without one of them it can't be told
                unknown = F.col("keys_over") & bare
                missing = F.when(bare & ~unknown, usable).otherwise(nothing)
            return F.struct((F.lit(k * 1000) + n).alias("seq"), missing.alias("missing"), b["path"].alias("path"), unknown.alias("unknown"))

        own = predicate(r, KEYS) & (F.size(usable) > 0)
        return F.filter(F.transform("branches", of), lambda x: own & (x["unknown"] | (F.size(x["missing"]) > 0)))

    rows = rows.select("query_id", F.concat(*[found(k, r) for k, r in enumerate(rules)]).alias("all"))
    told, untold = F.filter("all", lambda x: ~x["unknown"]), F.filter("all", lambda x: x["unknown"])
    rows = rows.select("query_id", F.explode(F.concat(told, F.slice(untold, 1, 1))).alias("x")).select("query_id", "x.*")
    code, message = F.when(F.col("unknown"), LIMIT).otherwise("missing_where_key"), F.when(F.col("unknown"), LIMIT_MESSAGE).otherwise(F.concat(F.lit("a branch isn't restricted by "), F.array_join("missing", ", ")))
    issues = _issues(rows, code, message, F.when(F.col("unknown"), 0).otherwise(F.col("seq")), keys="missing", branch="path")
    return issues.withColumn("meta", F.when(F.col("code") != LIMIT, F.col("meta")))


def manual_join_instead_of_assoc(q: Queries, options: Mapping[str, Any]) -> DataFrame:
    rows = _scope(q.facts, options).select("query_id", "schema", F.explode("joins").alias("j")).where("j.assoc is null and j.schema is not null").withColumn("related", F.col("j.schema"))
    known = q.associations.where(~F.col("filtered")).groupBy("schema", "related").agg(F.array_sort(F.collect_set("name")).alias("names"))
    # associations are a program's own, few; most joins share one pair of schemas
    return _issues(rows.join(F.broadcast(known), ["schema", "related"]), "manual_join", F.concat(F.lit("join "), F.col("j.join_index").cast("string"), F.lit(" could use the association "), F.array_join("names", " or ")), F.col("j.join_index"), associations="names")


def named_bindings(q: Queries, options: Mapping[str, Any]) -> DataFrame:
    rows = _scope(q.facts, options).select("query_id", F.posexplode("unnamed").alias("k", "u"))
    return _issues(rows, F.concat(F.lit("unnamed_"), F.col("u.kind")), F.concat(F.lit("a binding needs a name: "), F.col("u.detail")), F.col("k"), detail=F.col("u.detail"))


def offset_without_limit(q: Queries, options: Mapping[str, Any]) -> DataFrame:
    found = _scope(q.facts, options).where(F.exists("units", lambda u: u["offset_value"] & ~u["limit_value"]))
    return _issues(found, "offset_without_limit", "an offset needs a limit")


def required_order(q: Queries, options: Mapping[str, Any]) -> DataFrame:
    """Limit, offset or stream without an order, at any depth."""
    rows = _scope(q.facts, options)
    open_ = F.filter("units", lambda u: ~u["ordered"] & ~u["probe"])
    why = F.flatten(F.transform(open_, lambda u: F.array_compact(F.array(F.when(u["limit_node"], "limit"), F.when(u["offset_node"], "offset"), F.when(u["operation"] == "stream", "stream")))))
    found = rows.withColumn("why", F.array_distinct(why)).where(F.size("why") > 0)
    return _issues(found, "missing_order", F.concat(F.array_join("why", " and "), F.lit(" without an order")), reasons="why")


def _unbounded(q: Queries, options: Mapping[str, Any], operation: str, code: str) -> DataFrame:
    found = _scope(q.facts, options).where((F.col("operation") == operation) & (F.col("bounded") == "unrestricting"))
    return _issues(found, code, f"{operation} has no restricting where")


def unbounded_deletes(q: Queries, options: Mapping[str, Any]) -> DataFrame:
    return _unbounded(q, options, "delete_all", "unbounded_delete")


def unbounded_updates(q: Queries, options: Mapping[str, Any]) -> DataFrame:
    return _unbounded(q, options, "update_all", "unbounded_update")


def utc_datetime_naive_comparisons(q: Queries, options: Mapping[str, Any]) -> DataFrame:
    """Root UTC fields compared with a value without time zone."""
    rows = _compared(q, options).where(F.col("c.clause") == "where")
    names = options.get("fields")
    utc = lambda f, t: F.col(f).isin(*names) if names else F.col(t).startswith("utc_datetime")
    naive = lambda s: F.coalesce(F.col(f"c.{s}.cast"), F.col(f"c.{s}.literal")).startswith("naive_datetime") & F.col(f"c.{s}.field").isNull()
    field = F.when((F.col("c.a.binding") == 0) & utc("fa", "ta") & naive("b"), F.col("fa")).when((F.col("c.b.binding") == 0) & utc("fb", "tb") & naive("a"), F.col("fb"))
    found = rows.select("query_id", "k", field.alias("field")).where("field is not null").groupBy("query_id", "field").agg(F.min("k").alias("k"))
    return _issues(found, "naive_comparison", F.concat(F.lit("UTC field "), F.col("field"), F.lit(" is compared with a naive datetime")), F.col("k"), field="field")


CHECKS = {
    f.__name__: f
    for f in (
        cartesian_joins, conflicting_where_predicates, date_datetime_mixed_comparisons, deterministic_order, duplicate_joins, empty_in_predicates,
        explicit_visibility_predicates, half_open_temporal_intervals, hard_delete_on_soft_delete_schema, left_join_where_predicates, mandatory_join_keys,
        mandatory_where_keys, manual_join_instead_of_assoc, named_bindings, offset_without_limit, required_order, unbounded_deletes, unbounded_updates,
        utc_datetime_naive_comparisons,
    )
}


_SCOPE = ("operation", "schema", "table_name", "db_schema")
#: The facts that each check reads; compile_queries() then works out no others.
READS = {
    name: (*_SCOPE, *more)
    for name, more in {
        "cartesian_joins": ("joins",), "conflicting_where_predicates": ("branches", "over_limit"), "date_datetime_mixed_comparisons": ("comparisons",), "deterministic_order": ("ordered", "order_fields"),
        "duplicate_joins": ("joins",), "empty_in_predicates": ("branches",), "explicit_visibility_predicates": ("branches",), "half_open_temporal_intervals": ("comparisons",),
        "hard_delete_on_soft_delete_schema": ("branches",), "left_join_where_predicates": ("branches",), "mandatory_join_keys": ("joins",), "mandatory_where_keys": ("branches", "keys_over"),
        "manual_join_instead_of_assoc": ("joins",), "named_bindings": ("unnamed",), "offset_without_limit": ("units",), "required_order": ("units",), "unbounded_deletes": ("bounded",),
        "unbounded_updates": ("bounded",), "utc_datetime_naive_comparisons": ("comparisons",),
    }.items()
}


def validate(queries: Queries, specs: Iterable[str | tuple | CheckSpec]) -> DataFrame:
    """Issues of all queries; a check may come once.  For several checks the facts are worked out once and stored."""
    specs = normalize(specs, CHECKS)
    facts = stored(queries.facts) if sum(s.options.get("validate", True) is not False for s in specs) > 1 else queries.facts
    return run("query", replace(queries, facts=facts), specs, CHECKS, facts.sparkSession)
