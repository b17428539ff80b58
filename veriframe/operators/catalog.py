"""Checks of database catalogs, for many targets in one job.

Facts are the tables of Catalog; every row names its target.  System schemas (information_schema and those that begin
with ``pg_``) are left out, and only ordinary and partitioned tables count.  Rules use the scope language over the keys
of each check's rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, fields
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scope import matches, predicate, rules_of
from ..plans.contract import CheckSpec, meta, normalize, run

SCHEMAS = {
    "tables": "target string, schema_name string, table_name string, relkind string, visible boolean",
    "columns": "target string, schema_name string, table_name string, column_name string, ordinal int, type_name string, not_null boolean",
    "constraints": "target string, schema_name string, table_name string, name string, kind string, columns array<string>, ref_schema string, ref_table string, ref_columns array<string>, on_delete string, on_update string",
    "indexes": "target string, schema_name string, table_name string, index_name string, method string, is_unique boolean, is_valid boolean, is_primary boolean, is_ready boolean, is_live boolean, is_immediate boolean, nulls_not_distinct boolean, n_key_atts int, all_columns array<string>, opclasses array<string>, opclass_is_default array<boolean>, collations array<string>, collation_is_column array<boolean>, options array<int>, expressions string, predicate string",
    "candidates": "target string, schema_name string, table_name string, module string, function string, arity int, fields array<string>",
    "calls": "target string, module string, function string, arity int, kind string, fields array<string>, name string, match string",
}
#: How a catalog codes what a foreign key does.
ACTIONS = {"a": "no_action", "r": "restrict", "c": "cascade", "n": "set_null", "d": "set_default"}
TABLE = ["target", "schema_name", "table_name"]
BASE_KEYS = {"schemas": "schema_name", "tables": "table_name"}
FK_KEYS = BASE_KEYS | {"constraints": "constraint_name", "columns": "column_names", "referenced_schemas": "ref_schema", "referenced_tables": "ref_table", "referenced_columns": "ref_columns"}
FK_ARRAYS = ("columns", "referenced_columns")


@dataclass(frozen=True)
class Catalog:
    tables: DataFrame
    columns: DataFrame
    constraints: DataFrame
    indexes: DataFrame
    candidates: DataFrame | None = None
    calls: DataFrame | None = None

    @staticmethod
    def load(spark: SparkSession, read) -> Catalog:
        """``read(name)`` gives each table of SCHEMAS, as JDBC or Parquet has it, or None."""
        return Catalog(**{f.name: (None if (df := read(f.name)) is None else df.select(*[c.split()[0] for c in SCHEMAS[f.name].split(", ")])) for f in fields(Catalog)})


def user_tables(c: Catalog) -> DataFrame:
    return c.tables.where(F.col("relkind").isin("r", "p") & _user_schema())


def _user_schema() -> Column:
    return (F.col("schema_name") != "information_schema") & ~F.col("schema_name").startswith("pg_")


def _foreign_keys(c: Catalog) -> DataFrame:
    return c.constraints.where((F.col("kind") == "f") & _user_schema()).withColumnsRenamed({"name": "constraint_name", "columns": "column_names"})


def _in_any(rows: DataFrame, rules: Iterable[Mapping[str, Any]], keys: Mapping[str, str], arrays: Iterable[str] = ()) -> DataFrame:
    return rows.where(reduce(lambda a, b: a | b, [predicate(r, keys, arrays) for r in rules], F.lit(False)))


def _scoped(rows: DataFrame, options: Mapping[str, Any], keys: Mapping[str, str], arrays: Iterable[str] = ()) -> DataFrame:
    return _in_any(rows, rules_of(options, ()), keys, arrays)


def _per_rule(rows: DataFrame, rules: list[Mapping[str, Any]], keys: Mapping[str, str], arrays: Iterable[str], extra) -> DataFrame:
    """The rows once for each rule in whose scope they are; ``extra(rule)``: the rule's own columns."""
    entry = [F.when(predicate(r, keys, arrays), F.struct(F.lit(k).alias("rule"), *[v.alias(n) for n, v in extra(r).items()])) for k, r in enumerate(rules)]
    return rows.withColumn("_rule", F.explode(F.array_compact(F.array(*entry)))).select(*rows.columns, "_rule.*")


def _issues(rows: DataFrame, code: str | Column, message: Column, seq: Column | None = None, **parts: Column | str) -> DataFrame:
    return rows.select(
        "target", F.concat_ws(".", "schema_name", "table_name").alias("subject"), (F.lit(0) if seq is None else seq).cast("int").alias("seq"),
        F.lit("catalog").alias("category"), (F.lit(code) if isinstance(code, str) else code).alias("code"), message.alias("message"),
        meta(schema="schema_name", table="table_name", **parts).alias("meta"),
    )


def _said(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _list(name: str) -> Column:
    return F.array_join(name, ", ")



def _name() -> Column:
    return F.concat_ws(".", "schema_name", "table_name")


def duplicate_indexes(c: Catalog, options: Mapping[str, Any]) -> DataFrame:
    """Indexes of a table that are equal in everything but the name."""
    same = [*TABLE, "method", "is_unique", "is_valid", "n_key_atts", "all_columns", "opclasses", "collations", "options", "expressions", "predicate"]
    own = c.indexes.join(user_tables(c).select(*TABLE), TABLE, "left_semi")
    found = own.groupBy(*same).agg(F.array_sort(F.collect_list("index_name")).alias("index_names")).where(F.size("index_names") > 1)
    found = _scoped(found, options, BASE_KEYS | {"indexes": "index_names"}, ["indexes"])
    return _issues(found, "duplicate_indexes", _said(_name(), " has equal indexes: ", _list("index_names")), index_names="index_names")


def forbidden_column_types(c: Catalog, options: Mapping[str, Any]) -> DataFrame:
    """Columns of a forbidden type; ``types`` is a list of strings, patterns or mappings with type, prefer and reason."""
    rules = rules_of(options, ("types",), required=("types",), default="types" in options)
    keys = BASE_KEYS | {"columns": "column_name", "types": "type_name"}
    wanted = []
    for rule in rules:
        for t in rule["types"] if isinstance(rule["types"], (list, tuple)) else [rule["types"]]:
            one = t if isinstance(t, Mapping) else {"type": t}
            wanted.append((rule, one))
    rows = c.columns.join(user_tables(c).select(*TABLE), TABLE, "left_semi")
    null = F.lit(None).cast("string")
    hits = [
        F.when(predicate(rule, keys) & matches(F.col("type_name"), t["type"]), F.struct(F.lit(k).alias("k"), (F.lit(t["prefer"]) if t.get("prefer") else null).alias("prefer"), (F.lit(t["reason"]) if t.get("reason") else null).alias("reason")))
        for k, (rule, t) in enumerate(wanted)
    ]
    found = rows.withColumn("_hit", F.explode(F.array_compact(F.array(*hits)))).select(*rows.columns, "_hit.*")
    message = F.concat_ws("", _said(_name(), ".", F.col("column_name"), " has the forbidden type ", F.col("type_name")), _said("; prefer ", F.col("prefer")), _said(": ", F.col("reason")))
    return _issues(found, "forbidden_column_type", message, F.col("k"), column="column_name", type="type_name", prefer="prefer", reason="reason")


def foreign_key_actions(c: Catalog, options: Mapping[str, Any]) -> DataFrame:
    """Foreign keys that do something else on delete or update than a rule wants."""
    rules = rules_of(options, ("on_delete", "on_update"), default=bool({"on_delete", "on_update"} & set(options)))
    for r in rules:
        given = [r[k] for k in ("on_delete", "on_update") if r.get(k)]
        if not given or any(g not in ACTIONS.values() for g in given):
            raise ValueError("a rule needs on_delete or on_update: " + ", ".join(ACTIONS.values()))
    words = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    rows = _foreign_keys(c).withColumns({k: F.coalesce(F.try_element_at(words, F.col(k)), F.col(k)) for k in ("on_delete", "on_update")})
    want = lambda r: {f"want_{k}": F.lit(r.get(k)).cast("string") for k in ("on_delete", "on_update")}
    rows = _per_rule(rows, rules, FK_KEYS, FK_ARRAYS, want)
    both = F.array(*[F.struct(F.lit(k).alias("part"), F.lit(n).alias("n"), F.col(k).alias("actual"), F.col(f"want_{k}").alias("expected")) for n, k in enumerate(("on_delete", "on_update"))])
    found = rows.withColumn("_p", F.explode(both)).select(*rows.columns, "_p.*").where("expected is not null and not (actual <=> expected)")
    message = _said(_name(), " foreign key ", F.col("constraint_name"), ": ", F.col("part"), " is ", F.coalesce("actual", F.lit("unknown")), ", not ", F.col("expected"))
    return _issues(found, F.col("part"), message, F.col("rule") * 2 + F.col("n"), constraint="constraint_name", expected="expected", actual="actual")


def foreign_key_nullability(c: Catalog, options: Mapping[str, Any]) -> DataFrame:
    """Columns of a foreign key that may be null."""
    keys = _foreign_keys(c).select(*TABLE, "constraint_name", "ref_schema", "ref_table", F.posexplode("column_names").alias("at", "column_name"))
    nullable = c.columns.where(~F.col("not_null")).select(*TABLE, "column_name")
    found = _scoped(keys.join(nullable, [*TABLE, "column_name"]), options, FK_KEYS | {"columns": "column_name", "referenced_columns": "column_name"})
    return _issues(found, "nullable_foreign_key", _said(_name(), ".", F.col("column_name"), " of foreign key ", F.col("constraint_name"), " may be null"), F.col("at"), constraint="constraint_name", column="column_name")


def missing_foreign_key_constraints(c: Catalog, options: Mapping[str, Any]) -> DataFrame:
    """Columns named like references that are in no foreign key and not in the primary key."""
    rows = c.columns.join(user_tables(c).select(*TABLE), TABLE, "left_semi").where(F.col("column_name").endswith("_id") & (F.col("column_name") != "id"))
    bound = c.constraints.where(F.col("kind").isin("f", "p")).select(*TABLE, F.explode("columns").alias("column_name")).distinct()
    found = _scoped(rows.join(bound, [*TABLE, "column_name"], "left_anti"), options, BASE_KEYS | {"columns": "column_name"})
    return _issues(found, "missing_foreign_key", _said(_name(), ".", F.col("column_name"), " is no foreign key"), F.col("ordinal"), column="column_name")


def missing_foreign_key_indexes(c: Catalog, options: Mapping[str, Any]) -> DataFrame:
    """Foreign keys without a valid, whole index that begins with their columns, in any order."""
    usable = c.indexes.where(F.col("is_valid") & F.col("predicate").isNull()).select(*TABLE, "n_key_atts", "all_columns")
    keys = _foreign_keys(c)
    n = F.size("column_names")
    serves = (F.col("n_key_atts") >= n) & (F.size(F.array_except("column_names", F.slice("all_columns", F.lit(1), n))) == 0)
    on = reduce(lambda a, b: a & b, [F.col(f"k.{t}") == F.col(f"i.{t}") for t in TABLE]) & serves
    found = _scoped(keys.alias("k").join(usable.alias("i"), on, "left_anti"), options, FK_KEYS, FK_ARRAYS)
    return _issues(found, "missing_foreign_key_index", _said(_name(), " foreign key ", F.col("constraint_name"), " has no index on ", _list("column_names")), constraint="constraint_name", columns="column_names")


def primary_key_type(c: Catalog, options: Mapping[str, Any]) -> DataFrame:
    """Tables without primary key, and key columns of a type that no matching rule allows."""
    rules = rules_of(options, ("types",), required=("types",), default="types" in options)
    tables = user_tables(c).select(*TABLE)
    keys = c.constraints.where(F.col("kind") == "p").select(*TABLE, F.explode("columns").alias("column_name"))
    typed = keys.join(c.columns.select(*TABLE, "column_name", "type_name"), [*TABLE, "column_name"]).join(tables, TABLE, "left_semi")
    null = F.lit(None).cast("string")
    rows = tables.join(typed.select(*TABLE).distinct(), TABLE, "left_anti").select(*TABLE, null.alias("column_name"), null.alias("type_name"))
    rows = rows.unionByName(typed.select(*TABLE, "column_name", "type_name"))
    scope = BASE_KEYS | {"columns": "column_name"}
    allowed = F.array_distinct(F.flatten(F.array(*[F.when(predicate(r, scope), F.array(*[F.lit(t) for t in ([r["types"]] if isinstance(r["types"], str) else r["types"])])).otherwise(F.array().cast("array<string>")) for r in rules])))
    found = rows.withColumn("allowed", allowed).where((F.size("allowed") > 0) & (F.col("type_name").isNull() | ~F.array_contains("allowed", F.col("type_name"))))
    missing = F.col("column_name").isNull()
    message = F.when(missing, _said(_name(), " has no primary key")).otherwise(_said(_name(), ".", F.col("column_name"), " has type ", F.col("type_name"), ", not ", _list("allowed")))
    return _issues(found, F.when(missing, "missing_primary_key").otherwise("wrong_type"), message, column="column_name", type="type_name", allowed="allowed")


def required_columns(c: Catalog, options: Mapping[str, Any]) -> DataFrame:
    """Tables that lack columns that a rule wants."""
    rules = rules_of(options, ("columns",), required=("columns",), default="columns" in options)
    have = c.columns.groupBy(*TABLE).agg(F.collect_set("column_name").alias("have"))
    rows = user_tables(c).select(*TABLE).join(have, TABLE, "left")
    rows = _per_rule(rows, rules, BASE_KEYS, (), lambda r: {"wanted": F.array(*[F.lit(x) for x in ([r["columns"]] if isinstance(r["columns"], str) else r["columns"])])})
    missing = F.array_sort(F.array_except("wanted", F.coalesce("have", F.array().cast("array<string>"))))
    found = rows.withColumn("missing", missing).where(F.size("missing") > 0)
    return _issues(found, "missing_columns", _said(_name(), " lacks the columns ", _list("missing")), F.col("rule"), missing_columns="missing")


def scoped_foreign_keys(c: Catalog, options: Mapping[str, Any]) -> DataFrame:
    """Foreign keys between tables that both have the scope columns, but that leave them out on either side."""
    rules = rules_of(options, ("scope_columns",), required=("scope_columns",), default="scope_columns" in options)
    have = c.columns.groupBy(*TABLE).agg(F.collect_set("column_name").alias("have"))
    keys = _foreign_keys(c).join(have, TABLE).join(have.select("target", F.col("schema_name").alias("ref_schema"), F.col("table_name").alias("ref_table"), F.col("have").alias("ref_have")), ["target", "ref_schema", "ref_table"])
    keys = _per_rule(keys, rules, FK_KEYS, FK_ARRAYS, lambda r: {"scope": F.array(*[F.lit(x) for x in ([r["scope_columns"]] if isinstance(r["scope_columns"], str) else r["scope_columns"])])})
    holds = lambda cols: F.size(F.array_except("scope", cols)) == 0
    found = keys.where(holds("have") & holds("ref_have") & ~(holds("column_names") & holds("ref_columns")))
    return _issues(found, "unscoped_foreign_key", _said(_name(), " foreign key ", F.col("constraint_name"), " leaves out ", _list("scope")), F.col("rule"), constraint="constraint_name", scope_columns="scope", columns="column_names", referenced_columns="ref_columns")


def unique_keys(c: Catalog) -> DataFrame:
    """target, schema_name, table_name, columns of every unique key that makes an order total; tables on the search
    path also without schema."""
    usable = c.indexes.where(F.col("is_unique") & F.col("is_valid") & F.col("is_ready") & F.col("is_live") & F.col("is_immediate") & F.col("predicate").isNull() & F.col("expressions").isNull() & (F.col("method") == "btree"))
    n = F.col("n_key_atts")
    usable = usable.where(F.forall(F.slice("opclass_is_default", F.lit(1), n), lambda x: x) & F.forall(F.slice("collation_is_column", F.lit(1), n), lambda x: x))
    usable = usable.join(user_tables(c).select(*TABLE, "visible"), TABLE).withColumn("columns", F.slice("all_columns", F.lit(1), n))
    firm = c.columns.where("not_null").groupBy(*TABLE).agg(F.collect_set("column_name").alias("firm"))
    usable = usable.join(firm, TABLE, "left").where(F.coalesce("nulls_not_distinct", F.lit(False)) | (F.size(F.array_except("columns", F.coalesce("firm", F.array().cast("array<string>")))) == 0))
    named = usable.select(*TABLE, "columns", "visible").distinct()
    return named.select(*TABLE, "columns").unionByName(named.where("visible").select("target", F.lit(None).cast("string").alias("schema_name"), "table_name", "columns").distinct())


#: Endings of inferred constraint names.
SUFFIX = {"unique": "_index", "foreign_key": "_fkey"}


PLACE = ["target", "module", "function", "arity"]


def _unhandled(rows: DataFrame, calls: DataFrame, kind: str) -> DataFrame:
    """The ``rows`` (PLACE, table_name, name) that no call of their function handles.  Exact and inferred names are
    equal keys; for prefixes and suffixes a name is cut at the lengths that its function's calls have, and the cuts are
    equal keys.  Patterns are tested on the names that are left."""
    calls = calls.select(*PLACE, F.coalesce("match", F.lit("exact")).alias("how"), F.col("name").alias("given"), F.col("fields").alias("call_fields"))
    named = calls.where("given IS NOT NULL").select(*PLACE, "how", "given").distinct()
    affixes = named.where(F.col("how").isin("prefix", "suffix"))
    exact = named.where(~F.col("how").isin("prefix", "suffix", "regex")).select(*PLACE, F.col("given").alias("name"))
    rows = rows.join(exact, [*PLACE, "name"], "left_anti")
    if kind in SUFFIX:
        # a composite unique key is named after all fields, a foreign key after the first
        part = F.array_join("call_fields", "_") if kind == "unique" else F.get("call_fields", F.lit(0))
        inferred = calls.where("given IS NULL").select(*PLACE, part.alias("_part")).distinct()
        before, after = F.length("table_name") + 1, len(SUFFIX[kind])
        fits = F.col("name").startswith(F.concat("table_name", F.lit("_"))) & F.col("name").endswith(SUFFIX[kind]) & (F.length("name") >= before + after)
        middle = F.when(fits, F.substring(F.col("name"), before + 1, F.length("name") - before - after))
        rows = rows.withColumn("_part", middle).join(inferred, [*PLACE, "_part"], "left_anti").drop("_part")
    lengths = affixes.groupBy(*PLACE, "how").agg(F.collect_set(F.length("given")).alias("lengths"))
    names = rows.select(*PLACE, "name").distinct().join(lengths, PLACE)
    names = names.select(*PLACE, "name", "how", F.explode(F.filter("lengths", lambda n: n <= F.length("name"))).alias("n"))
    cut = F.when(F.col("how") == "prefix", F.left("name", F.col("n"))).otherwise(F.right("name", F.col("n")))
    rows = rows.join(names.withColumn("given", cut).join(affixes, [*PLACE, "how", "given"], "left_semi").select(*PLACE, "name").distinct(), [*PLACE, "name"], "left_anti")
    patterns = named.where("how = 'regex'").select(*PLACE, "given")
    matched = rows.select(*PLACE, "name").distinct().join(patterns, PLACE).where("name RLIKE given").select(*PLACE, "name").distinct()
    return rows.join(matched, [*PLACE, "name"], "left_anti")


def _changeset(c: Catalog, options: Mapping[str, Any], kind: str, constraints: DataFrame) -> DataFrame:
    """Functions that take in all fields of a constraint without handling its violation.

    ``constraints``: TABLE, name, columns.  A call handles it if its name matches exactly, by suffix, prefix or pattern,
    or, without a name, if the name inferred from table and fields is the constraint's; check constraints are never
    inferred.
    """
    if not options.get("paths") and not options.get("modules"):
        raise ValueError("paths or modules are required")
    if c.candidates is None or c.calls is None:
        raise ValueError("the catalog has no candidates and calls")
    rows = c.candidates.withColumn("schema_name", F.coalesce("schema_name", F.lit("public")))
    if options.get("modules"):
        rows = rows.where(matches(F.col("module"), options["modules"]))
    rows = rows.join(constraints, TABLE).where((F.size("columns") > 0) & (F.size(F.array_except("columns", "fields")) == 0))
    found = _unhandled(rows, c.calls.where(F.col("kind") == kind), kind)
    message = _said(F.col("module"), ".", F.col("function"), "/", F.col("arity").cast("string"), " takes in the fields of ", F.col("name"), " but doesn't handle it")
    return _issues(found, f"unhandled_{kind}", message, constraint="name", columns="columns", module="module", function="function")


def changeset_unique_constraints(c: Catalog, options: Mapping[str, Any]) -> DataFrame:
    own = c.indexes.where(F.col("is_unique") & F.col("is_valid") & ~F.col("is_primary") & F.col("predicate").isNull() & F.col("expressions").isNull() & _user_schema())
    return _changeset(c, options, "unique", own.select(*TABLE, F.col("index_name").alias("name"), F.slice("all_columns", F.lit(1), F.col("n_key_atts")).alias("columns")))


def changeset_foreign_key_constraints(c: Catalog, options: Mapping[str, Any]) -> DataFrame:
    return _changeset(c, options, "foreign_key", _foreign_keys(c).select(*TABLE, F.col("constraint_name").alias("name"), F.col("column_names").alias("columns")))


def changeset_check_constraints(c: Catalog, options: Mapping[str, Any]) -> DataFrame:
    return _changeset(c, options, "check", c.constraints.where((F.col("kind") == "c") & _user_schema()).select(*TABLE, "name", "columns"))


CHECKS = {
    f.__name__: f
    for f in (
        duplicate_indexes, forbidden_column_types, foreign_key_actions, foreign_key_nullability, missing_foreign_key_constraints, missing_foreign_key_indexes,
        primary_key_type, required_columns, scoped_foreign_keys, changeset_unique_constraints, changeset_foreign_key_constraints, changeset_check_constraints,
    )
}


def validate(catalog: Catalog, specs: Iterable[str | tuple | CheckSpec]) -> DataFrame:
    """Issues of all targets; a check may come several times, with other options."""
    for s in (specs := normalize(specs, CHECKS, unique=False)):
        if not isinstance(s.options.get("validate", True), bool):
            raise ValueError(f"validate of {s.name} must be true or false")
    return run("catalog", catalog, specs, CHECKS, catalog.tables.sparkSession, unique=False)
