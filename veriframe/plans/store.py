"""Facts that several checks read, written once to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """``df`` from a written table in spark.checkpoint.dir, so that its readers don't each work it out again and lost
    executors lose nothing of it.  Where that is unset, a local master gets a folder of its own; on a cluster, which has
    no other shared folder, ``df`` stays as it is."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            return df
        root = getattr(spark, "_facts_dir", None) or tempfile.mkdtemp(prefix="veriframe-facts-")
        spark._facts_dir = root
    path = f"{root.rstrip('/')}/facts-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
