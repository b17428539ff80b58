"""Shards with size-tiered compaction and a versioned manifest.

Arrivals are appended as small immutable Parquet files.  Compaction sorts the live shards into tiers by size, cuts each
tier into runs of up to the target size, and writes every run of enough shards as one file, one task each, without a
shuffle.  A version is a JSON manifest that names the live shards; it's written aside and renamed to the next number,
which fails if another writer was first, so readers see either the old or the new version.  Files of a job that failed
or lost the race are named by no manifest and are never read.

Defined cases: an empty arrival adds a version without shards; null and repeated rows are kept as they are; column names
are free, but columns whose names differ in case only are refused; columns that an arrival adds are null in the shards
before, columns that it lacks are null in its own; an arrival with another type for a known column is refused and
changes nothing; a shard larger than the target stays alone.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Runs that one job merges at most; keeps plans small.
RUNS_PER_JOB = 64


@dataclass(frozen=True)
class Shard:
    path: str
    size: int
    level: int


class Conflict(RuntimeError):
    """Another writer committed this version first."""


class ShardStore:
    """A folder of shards.  ``shard_rows``: of an arriving shard at most; by default a task of the arrival writes one shard,
    so shards are as large as what a task reads.  ``target_bytes``: of a merged one, about."""

    def __init__(self, spark: SparkSession, root: str, shard_rows: int = 0, target_bytes: int = 64 << 20, min_run: int = 4):
        self._spark, self.root = spark, root.rstrip("/")
        self.shard_rows, self.target_bytes, self.min_run = shard_rows, target_bytes, min_run
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def versions(self) -> list[int]:
        folder = self._path("manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, str | None, list[Shard]]:
        """Version, schema and shards; version 0 is empty."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return 0, None, []
        rows = self._spark.read.text(f"{self.root}/manifests/v{version:012d}.json", wholetext=True).collect()
        found = json.loads(rows[0].value)
        return version, found["schema"], [Shard(**s) for s in found["shards"]]

    def _commit(self, version: int, schema: str | None, shards: list[Shard]) -> int:
        text = json.dumps({"version": version, "schema": schema, "shards": [asdict(s) for s in shards]})
        aside, name = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/v{version:012d}.json")
        out = self._fs.create(aside, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self._spark._jsc.hadoopConfiguration())
        none = self._spark.sparkContext._gateway.new_array(self._spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(aside, name, none)
        except Exception as e:
            self._fs.delete(aside, False)
            if self._fs.exists(name):
                raise Conflict(f"version {version} exists") from e
            raise
        return version

    @staticmethod
    def _folder(level: int) -> str:
        return f"data/level{level}-{uuid.uuid4().hex}"

    def _written(self, folder: str, level: int) -> list[Shard]:
        status = self._fs.listStatus(self._path(folder))
        files = sorted((s.getPath().getName(), s.getLen()) for s in status if s.getPath().getName().endswith(".parquet"))
        return [Shard(f"{folder}/{name}", size, level) for name, size in files]

    def append(self, arrivals: DataFrame) -> int:
        version, schema, shards = self.manifest()
        schema = self._widened(self._schema(schema), arrivals.schema).json()
        folder = self._folder(0)
        arrivals.write.option("maxRecordsPerFile", self.shard_rows).parquet(f"{self.root}/{folder}")
        return self._commit(version + 1, schema, shards + self._written(folder, 0))

    @staticmethod
    def _widened(known: StructType, new: StructType) -> StructType:
        """The known columns, then those that are new."""
        out = {f.name: f for f in known}
        for f in new:
            if f.name in out and out[f.name].dataType != f.dataType:
                raise ValueError(f"column {f.name} is {out[f.name].dataType.simpleString()}, the arrival has {f.dataType.simpleString()}")
            out.setdefault(f.name, StructField(f.name, f.dataType, True, f.metadata))
        if len({name.lower() for name in out}) < len(out):
            raise ValueError(f"columns differ in case only: {sorted(out)}")
        return StructType(list(out.values()))

    def _schema(self, schema: str | None) -> StructType:
        return StructType.fromJson(json.loads(schema)) if schema else StructType([])

    def runs(self, shards: list[Shard]) -> list[list[Shard]]:
        """Similarly sized shards that together make about a target-sized file."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.size < self.target_bytes // 2:
                tiers.setdefault(int(math.log2(max(s.size, 1)) // 2), []).append(s)
        found = []
        for tier in sorted(tiers):
            run: list[Shard] = []
            for s in sorted(tiers[tier], key=lambda s: (s.size, s.path)):
                if run and sum(x.size for x in run) + s.size > self.target_bytes:
                    found.append(run)
                    run = []
                run.append(s)
            found.append(run)
        return [run for run in found if len(run) >= self.min_run]

    def compact(self) -> int:
        """Merges until no tier has a run of ``min_run`` shards; the version of the result. Old files stay for
        readers of older versions until vacuum()."""
        while True:
            version, schema, shards = self.manifest()
            runs = self.runs(shards)
            if not runs:
                return version
            kept = set(shards).difference(s for run in runs for s in run)
            merged = []
            for k in range(0, len(runs), RUNS_PER_JOB):
                part = runs[k : k + RUNS_PER_JOB]
                frames = [self._spark.read.schema(self._schema(schema)).parquet(*[f"{self.root}/{s.path}" for s in run]).coalesce(1) for run in part]
                level = 1 + max(s.level for run in part for s in run)
                folder = self._folder(level)
                self._write_each(frames, f"{self.root}/{folder}")
                merged += self._written(folder, level)
            self._commit(version + 1, schema, sorted(kept, key=lambda s: s.path) + merged)

    def _write_each(self, frames: list[DataFrame], path: str) -> None:
        """A file for each frame, by a task each.  Spark would else take one-partition frames for one partition."""
        key = "spark.sql.unionOutputPartitioning"
        before = self._spark.conf.get(key, None)
        self._spark.conf.set(key, "false")
        try:
            reduce(DataFrame.union, frames).write.option("maxRecordsPerFile", 0).parquet(path)
        finally:
            self._spark.conf.unset(key) if before is None else self._spark.conf.set(key, before)

    def vacuum(self) -> int:
        """Deletes the files that the newest version doesn't name; how many."""
        live = {s.path for s in self.manifest()[2]}
        gone = 0
        folder = self._path("data")
        for d in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            for f in self._fs.listStatus(d.getPath()):
                name = f"data/{d.getPath().getName()}/{f.getPath().getName()}"
                if name.endswith(".parquet") and name not in live:
                    gone += bool(self._fs.delete(f.getPath(), False))
        return gone

    def read(self, version: int | None = None) -> DataFrame:
        _, schema, shards = self.manifest(version)
        if not shards:
            return self._spark.createDataFrame([], self._schema(schema))
        return self._spark.read.schema(self._schema(schema)).parquet(*[f"{self.root}/{s.path}" for s in shards])

    def places(self, id_column: str, version: int | None = None) -> DataFrame:
        """The id of each row with its shard, its row in it, how often the shard was merged, and the version."""
        number, _, shards = self.manifest(version)
        df = self.read(number)
        if not shards:
            return df.selectExpr(f"`{id_column}`", "'' AS shard", "0L AS shard_row", "0 AS level", f"{number} AS version")
        file = F.element_at(F.split(F.col("_metadata.file_path"), "/data/"), -1)
        return df.select(id_column, file.alias("shard"), F.col("_metadata.row_index").alias("shard_row"), F.regexp_extract(file, "^level([0-9]+)-", 1).cast("int").alias("level"), F.lit(number).alias("version"))
