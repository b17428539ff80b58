"""The contract between checks and runner.

A check is a function ``(facts, options) -> DataFrame`` with the columns of ISSUES or a part of them; missing columns
are filled with nulls.  No rows means passed.  Anything else than such a table is an error of the check, and raised.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ISSUES = T.StructType(
    [
        T.StructField("family", T.StringType()),
        T.StructField("check", T.StringType()),
        T.StructField("check_order", T.IntegerType()),
        T.StructField("target", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("subject_order", T.LongType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("category", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("tag", T.StringType()),
        T.StructField("snippet", T.StringType()),
        T.StructField("meta", T.StringType()),
    ]
)

Check = Callable[[Any, Mapping[str, Any]], DataFrame]


class ContractError(TypeError):
    """A check gave something else than an issue table."""


class IssuesFound(AssertionError):
    """assert_no_issues() found some."""


@dataclass(frozen=True)
class CheckSpec:
    """A check by name, with its options."""

    name: str
    options: Mapping[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not isinstance(self.options, Mapping) or not all(isinstance(k, str) for k in self.options):
            raise ValueError(f"options of {self.name} must be a mapping with string keys")


def normalize(specs: Iterable[str | tuple[str, Mapping[str, Any]] | CheckSpec], known: Mapping[str, Check] | None = None, unique: bool = True) -> list[CheckSpec]:
    """Specs in order; unknown names and, if ``unique``, repeated ones are errors."""
    out = [s if isinstance(s, CheckSpec) else CheckSpec(s) if isinstance(s, str) else CheckSpec(*s) for s in specs]
    names = [s.name for s in out]
    if unique and len(set(names)) < len(names):
        raise ValueError(f"checks given twice: {sorted({n for n in names if names.count(n) > 1})}")
    if known is not None and (missing := [n for n in names if n not in known]):
        raise ValueError(f"unknown checks: {missing}")
    return out


def with_overrides(base: Iterable, override: Iterable | bool | None) -> list[CheckSpec]:
    """``False``: no checks.  Else an override of the same name replaces the options in place; others are appended."""
    specs = normalize(base)
    if override is False:
        return []
    if override is None or override is True:
        return specs
    new = {s.name: s for s in normalize(override)}
    return [new.pop(s.name, s) for s in specs] + list(new.values())


def as_issues(df: Any, family: str, check: str, order: int) -> DataFrame:
    """The check's rows with all columns of ISSUES; raises unless it is an issue table."""
    if not isinstance(df, DataFrame):
        raise ContractError(f"{check} gave {type(df).__name__}, not a DataFrame")
    kinds = {f.name: f.dataType for f in df.schema}
    if extra := set(kinds) - set(ISSUES.names):
        raise ContractError(f"{check} gave columns that issues don't have: {sorted(extra)}")
    for f in ISSUES:
        if f.name in kinds and not isinstance(kinds[f.name], T.NullType) and kinds[f.name] != f.dataType and not (isinstance(f.dataType, T.LongType) and isinstance(kinds[f.name], T.IntegerType)):
            raise ContractError(f"{check} gave {f.name} as {kinds[f.name].simpleString()}, not {f.dataType.simpleString()}")
    fixed = {"family": F.lit(family), "check": F.lit(check), "check_order": F.lit(order)}
    return df.select(*[fixed.get(f.name, F.col(f.name) if f.name in kinds else F.lit(None)).cast(f.dataType).alias(f.name) for f in ISSUES])


def run(family: str, facts: Any, specs: Iterable, checks: Mapping[str, Check], spark, unique: bool = True) -> DataFrame:
    """Issues of all specs as one plan; an empty table without specs, or if all are disabled."""
    found = [as_issues(checks[s.name](facts, s.options), family, s.name, k) for k, s in enumerate(normalize(specs, checks, unique)) if s.options.get("validate", True) is not False]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], ISSUES)


def ordered(issues: DataFrame) -> DataFrame:
    """In order of subject, check and sequence; for output, as it sorts everything."""
    return issues.orderBy("target", "subject_order", "subject", "check_order", "seq")


def text(with_meta: bool = False) -> Column:
    """``check: message`` and, if asked for and there, the meta in brackets."""
    line = F.concat(F.col("check"), F.lit(": "), F.col("message"))
    return F.when(F.col("meta").isNotNull() & ~F.col("meta").isin("", "{}"), F.concat(line, F.lit(" "), F.col("meta"))).otherwise(line) if with_meta else line


def format_many(issues: DataFrame, by: str = "subject", with_meta: bool = False) -> DataFrame:
    """One text for each ``by``, its issues in order, one a line."""
    item = F.struct("check_order", "seq", text(with_meta).alias("line"))
    return issues.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["line"]), "\n").alias("text"))


def assert_no_issues(issues: DataFrame, show: int = 20) -> None:
    rows = issues.select(text().alias("line")).limit(show + 1).collect()
    if rows:
        raise IssuesFound("\n".join(r.line for r in rows[:show]) + ("\n..." if len(rows) > show else ""))


def meta(**parts: Column | str) -> Column:
    """Parts as JSON with null ones left out."""
    return F.to_json(F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in parts.items()]))
