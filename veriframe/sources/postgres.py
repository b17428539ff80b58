"""Catalog tables of PostgreSQL databases, read by JDBC, one query for each table and target.

A target is a name with a reader: a function from the name of a catalog table to a DataFrame, as ``jdbc`` gives it or a
test makes it.  A reader that fails makes one issue for its target; the other targets are audited all the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog
from ..plans.contract import ISSUES, CheckSpec

Reader = Callable[[str], DataFrame]

_NAME = "n.nspname AS schema_name, c.relname AS table_name"
_FROM = "pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace"


def _columns(numbers: str, relation: str) -> str:
    return f"ARRAY(SELECT a.attname::text FROM unnest({numbers}) WITH ORDINALITY k(num, pos) JOIN pg_attribute a ON a.attrelid = {relation} AND a.attnum = k.num ORDER BY k.pos)"


SQL = {
    "tables": f"SELECT {_NAME}, c.relkind::text AS relkind, pg_table_is_visible(c.oid) AS visible FROM {_FROM} WHERE c.relkind IN ('r', 'p')",
    "columns": f"SELECT {_NAME}, a.attname AS column_name, a.attnum::int AS ordinal, format_type(a.atttypid, a.atttypmod) AS type_name, a.attnotnull AS not_null FROM {_FROM} JOIN pg_attribute a ON a.attrelid = c.oid AND a.attnum > 0 AND NOT a.attisdropped WHERE c.relkind IN ('r', 'p')",
    "constraints": f"""SELECT {_NAME}, k.conname AS name, k.contype::text AS kind, {_columns("k.conkey", "k.conrelid")} AS columns, m.nspname AS ref_schema, r.relname AS ref_table, {_columns("k.confkey", "k.confrelid")} AS ref_columns, k.confdeltype::text AS on_delete, k.confupdtype::text AS on_update
FROM pg_constraint k JOIN pg_class c ON c.oid = k.conrelid JOIN pg_namespace n ON n.oid = c.relnamespace LEFT JOIN pg_class r ON r.oid = k.confrelid LEFT JOIN pg_namespace m ON m.oid = r.relnamespace WHERE k.contype IN ('p', 'f', 'u', 'c')""",
    "indexes": f"""SELECT {_NAME}, ic.relname AS index_name, am.amname AS method, i.indisunique AS is_unique, i.indisvalid AS is_valid, i.indisprimary AS is_primary, i.indisready AS is_ready, i.indislive AS is_live, i.indimmediate AS is_immediate,
coalesce((to_jsonb(i) ->> 'indnullsnotdistinct')::boolean, false) AS nulls_not_distinct, i.indnkeyatts::int AS n_key_atts, {_columns("i.indkey", "i.indrelid")} AS all_columns, i.indclass::oid[]::text[] AS opclasses,
ARRAY(SELECT o.opcdefault FROM unnest(i.indclass) WITH ORDINALITY k(num, pos) JOIN pg_opclass o ON o.oid = k.num ORDER BY k.pos) AS opclass_is_default, i.indcollation::oid[]::text[] AS collations,
ARRAY(SELECT coalesce(a.attcollation = k.num, true) FROM unnest(i.indcollation) WITH ORDINALITY k(num, pos) LEFT JOIN pg_attribute a ON a.attrelid = i.indrelid AND a.attnum = i.indkey[k.pos - 1] ORDER BY k.pos) AS collation_is_column,
i.indoption::int2[]::int[] AS options, pg_get_expr(i.indexprs, i.indrelid) AS expressions, pg_get_expr(i.indpred, i.indrelid) AS predicate
FROM pg_index i JOIN pg_class c ON c.oid = i.indrelid JOIN pg_namespace n ON n.oid = c.relnamespace JOIN pg_class ic ON ic.oid = i.indexrelid JOIN pg_am am ON am.oid = ic.relam""",
}


def jdbc(spark: SparkSession, url: str, properties: Mapping[str, str] | None = None) -> Reader:
    """Reads from a database; its server does the joins within pg_catalog."""
    options = {"driver": "org.postgresql.Driver"} | dict(properties or {})
    return lambda name: spark.read.format("jdbc").options(url=url, query=SQL[name], **options).load()


def load(spark: SparkSession, targets: Mapping[str, Reader]) -> tuple[catalog.Catalog, DataFrame]:
    """The catalog of all targets together, and an issue for each target that can't be read."""
    if not targets:
        raise ValueError("no targets")
    found: dict[str, list[DataFrame]] = {name: [] for name in SQL}
    errors = []
    for target, read in targets.items():
        try:
            own = {name: read(name).withColumn("target", F.lit(target)) for name in SQL}
        except Exception as e:  # whatever the driver raises is told as an issue of its target
            errors.append((target, f"{type(e).__name__}: {e}"[:1000]))
        else:
            for name, df in own.items():
                found[name].append(df)
    empty = lambda name: spark.createDataFrame([], catalog.SCHEMAS[name])
    whole = catalog.Catalog.load(spark, lambda name: None if name not in SQL else reduce(DataFrame.unionByName, found[name]) if found[name] else empty(name))
    rows = [("catalog", "source", -1, target, None, None, 0, "source", "unreadable", message, None, None, None) for target, message in errors]
    return whole, spark.createDataFrame(rows, ISSUES)


def validate(spark: SparkSession, targets: Mapping[str, Reader], specs: Iterable[str | tuple | CheckSpec]) -> DataFrame:
    """Issues of all targets, and those of reading them."""
    whole, errors = load(spark, targets)
    return catalog.validate(whole, specs).unionByName(errors)
