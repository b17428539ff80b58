"""Catalogs of many PostgreSQL databases in one scan, with a partition for each target.

``connect`` opens a DB-API connection to a target, on the executor that reads it; a task asks for all catalog tables of
its target and streams their rows.  A target that can't be read, at the start or midway, gives one issue, and what it
gave before that is left out.  Conditions on ``target`` and ``part`` (``=`` and ``IN``) are pushed down: other targets
get no partition and other catalog tables no query.

Defined cases: repeated targets are read once; a target without tables gives no rows and no issue; columns that a query
gives besides the catalog's are passed over, and one that it lacks makes its target unreadable.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from contextlib import closing
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..operators import catalog
from ..plans.contract import ISSUES, CheckSpec
from ..plans.store import stored
from .postgres import SQL

#: Rows that are taken from a cursor at once.
FETCH = 2000
ERROR = "error"


def _own(name: str) -> str:
    """The columns of a catalog table without its target."""
    return catalog.SCHEMAS[name].split(", ", 1)[1]


class _Reader(DataSourceReader):
    def __init__(self, targets: list[str], connect: Callable[[str], Any], sql: Mapping[str, str], kinds: dict[str, pa.DataType]):
        self.targets, self.connect, self.sql, self.kinds = targets, connect, dict(sql), kinds
        self.parts = list(self.sql)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            wanted = (f.value,) if isinstance(f, EqualTo) else f.value if isinstance(f, In) else None
            if wanted is not None and f.attribute == ("target",):
                self.targets = [t for t in self.targets if t in wanted]
            elif wanted is not None and f.attribute == ("part",) and ERROR not in wanted:
                self.parts = [p for p in self.parts if p in wanted]
            yield f  # Spark tests them again: errors are rows of their own part

    def partitions(self) -> list[InputPartition]:
        # a scan has one partition at least
        return [InputPartition(t) for t in self.targets] or [InputPartition(None)]

    def _batch(self, target: str, part: str, error: str | None, rows: list[dict]) -> pa.RecordBatch:
        n = len(rows) or 1
        columns = [pa.array([target] * n, pa.string()), pa.array([part] * n, pa.string()), pa.array([error] * n, pa.string())]
        columns += [pa.array(rows, kind) if name == part else pa.nulls(n, kind) for name, kind in self.kinds.items()]
        return pa.RecordBatch.from_arrays(columns, ["target", "part", "error", *self.kinds])

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        target = partition.value
        if target is None:
            return
        try:
            with closing(self.connect(target)) as connection:
                for part in self.parts:
                    wanted = [field.name for field in self.kinds[part]]
                    with closing(connection.cursor()) as cursor:
                        cursor.execute(self.sql[part])
                        at = {d[0]: k for k, d in enumerate(cursor.description)}
                        places = [(name, at[name]) for name in wanted]
                        while rows := cursor.fetchmany(FETCH):
                            yield self._batch(target, part, None, [{name: r[k] for name, k in places} for r in rows])
        except Exception as e:  # whatever the driver raises is told as an issue of its target
            yield self._batch(target, ERROR, f"{type(e).__name__}: {e}"[:1000], [])


def scan(spark: SparkSession, targets: Iterable[str], connect: Callable[[str], Any], sql: Mapping[str, str] = SQL) -> DataFrame:
    """target, part (a catalog table's name, or ``error``), error, and a struct for each catalog table, null but for the
    row's part.  Turns on the session's filter pushdown into Python data sources."""
    targets = list(dict.fromkeys(targets))
    if not targets:
        raise ValueError("no targets")
    fields = ", ".join(f"{name} struct<{_own(name)}>" for name in sql)
    kinds = {name: to_arrow_type(StructType.fromDDL(_own(name))) for name in sql}

    class Targets(DataSource):
        @classmethod
        def name(cls) -> str:
            return "catalog_targets"

        def schema(self) -> str:
            return f"target string, part string, error string, {fields}"

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Reader(targets, connect, sql, kinds)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Targets)
    return spark.read.format("catalog_targets").load()


def load(spark: SparkSession, targets: Iterable[str], connect: Callable[[str], Any], sql: Mapping[str, str] = SQL) -> tuple[catalog.Catalog, DataFrame]:
    """The catalog of all targets that can be read, and an issue for each other one.  Targets are read once."""
    found = stored(scan(spark, targets, connect, sql))
    failed = found.where(F.col("part") == ERROR)

    def part(name: str) -> DataFrame | None:
        if name not in sql:
            return None
        own = found.where(F.col("part") == name).select("target", f"{name}.*")
        return own.join(failed.select("target"), "target", "left_anti")

    given = {
        "family": F.lit("catalog"), "check": F.lit("source"), "check_order": F.lit(-1), "target": F.col("target"), "seq": F.lit(0),
        "category": F.lit("source"), "code": F.lit("unreadable"), "message": F.col("error"),
    }
    issues = failed.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ISSUES])
    return catalog.Catalog.load(spark, part), issues


def validate(spark: SparkSession, targets: Iterable[str], connect: Callable[[str], Any], specs: Iterable[str | tuple | CheckSpec], sql: Mapping[str, str] = SQL) -> DataFrame:
    """Issues of all targets, and those of reading them."""
    whole, errors = load(spark, targets, connect, sql)
    return catalog.validate(whole, specs).unionByName(errors)
