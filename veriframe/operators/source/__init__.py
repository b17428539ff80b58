"""Checks of source files, for many files in one job.

Every file is read once on an executor for all the checks that are asked for; files are independent of each other, so
there is no shuffle.  Issues that a comment suppresses are taken out by a join on ranges of lines.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...plans.contract import ISSUES, CheckSpec, normalize
from ...sources.code import DEFINITIONS, Source
from ...sources.elixir import Node
from . import ecto, framework, language, templates  # noqa: F401  they register their checks
from .registry import CHECKS

FOUND = "file string, name string, ord int, seq int, line int, col int, category string, message string"
SUPPRESSED = "file string, name string, first int, last int"
MARK = re.compile(r"#\s*\S*disable-for-next-definition\b[ \t]*([\w.]*)")


def _place(at: Any) -> tuple[int, int]:
    return at if isinstance(at, tuple) else (getattr(at, "line", 0), getattr(at, "column", 0))


def inspect(files: DataFrame, specs: Iterable[str | tuple[str, Mapping[str, Any]] | CheckSpec]) -> DataFrame:
    """FOUND for ``files`` (file, content); a file that can't be read gives no issues of code. Null content is empty."""
    wanted = [s for s in normalize(specs, CHECKS) if s.options.get("validate", True) is not False]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                src = Source(file, content)
                for order, spec in enumerate(wanted):
                    c = CHECKS[spec.name]
                    for seq, (at, message) in enumerate(_sorted(c.run(src, spec.options))):
                        rows.append((file, spec.name, order, seq, *at, c.category, message))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["file", "name", "ord", "seq", "line", "col", "category", "message"])

    return files.select("file", "content").mapInArrow(run, FOUND)


def _sorted(found: Iterable[tuple[Any, str]]) -> list[tuple[tuple[int, int], str]]:
    return sorted(((_place(at), m) for at, m in found), key=lambda x: x[0])


def suppressions(files: DataFrame) -> DataFrame:
    """SUPPRESSED: the lines of the definition after each ``disable-for-next-definition`` comment, and the check that it
    names (null: all).  A comment before the end of its module covers nothing; nor does a definition without a known
    end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not content or "disable-for-next-definition" not in content:
                    continue
                src = Source(file, content)
                modules = [(m.line, m.end_line) for _, m in src.modules if m.end_line]
                for line, text in src.comments:
                    m = MARK.match(text)
                    around = max((x for x in modules if x[0] <= line <= x[1]), default=None)
                    if not m or not around:
                        continue
                    after = [x for x in src.nodes if isinstance(x, Node) and x.name in (*DEFINITIONS, "defmodule") and around[0] < line < x.line <= around[1]]
                    nearest = min(after, key=lambda x: x.line, default=None)
                    if nearest is not None and nearest.name != "defmodule" and nearest.end_line:
                        rows.append((file, m[1] or None, nearest.line, nearest.end_line))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int32()), strict=True)], ["file", "name", "first", "last"])

    return files.select("file", "content").mapInArrow(run, SUPPRESSED)


def validate(files: DataFrame, specs: Iterable[str | tuple | CheckSpec]) -> DataFrame:
    """Issues of all files, without those that comments suppress."""
    found = inspect(files, specs)
    gone = suppressions(files).toDF("f", "n", "first", "last")
    hit = (F.col("file") == F.col("f")) & F.col("line").between(F.col("first"), F.col("last")) & (F.col("n").isNull() | (F.col("n") == F.col("name")))
    left = found.join(gone, hit, "left_anti")
    rows = left.select(
        F.col("file").alias("subject"), "seq", "category", F.col("name").alias("code"), "message", F.to_json(F.struct("line", F.col("col").alias("column"))).alias("meta"), F.col("name").alias("check"), F.col("ord").alias("check_order")
    )
    given = {f.name for f in rows.schema}
    return rows.select(*[(F.lit("source") if f.name == "family" else F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in ISSUES])


def read_files(spark: SparkSession, root: str, include: Iterable[str] = ("*.ex", "*.exs", "*.heex"), exclude: Iterable[str] = ()) -> DataFrame:
    """file and content of the files below ``root`` whose path ends as a pattern of ``include`` says."""
    patterns = [re.compile(fnmatch.translate(p)) for p in include]
    df = spark.read.option("recursiveFileLookup", "true").format("binaryFile").load(root)
    base = F.regexp_replace("path", "^.*/", "")
    keep = F.lit(False)
    for p in patterns:
        keep = keep | base.rlike(p.pattern.replace("(?s:", "(?:").replace(r")\Z", ")$").replace(r")\z", ")$"))
    for e in exclude:
        keep = keep & ~F.col("path").contains(e)
    return df.where(keep).select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("content"))
