"""Whitening of embeddings.

Entries become integers x = floor(scale * c) + shift, so that the sums S of all n rows are exact and n * x - S is the
exact n-fold of a centred row.  The rows (n * x - S) / n go into an MLlib RowMatrix, whose Gramian over n is the
covariance V: summed on the executors, one matrix of the dimension's square on the driver.  ``eigh`` there gives the
components, which go to the executors by broadcast (dimension x components doubles, independent of the rows) and project
the same exact rows.  The covariance of what comes out is measured the same way, as a check that is part of the result.

Rows are counted, summed and squared by DataFrame functions; only the projection runs in Python, on Arrow batches.

Defined cases: a vector that is null, or holds null, nan or infinite entries, is dropped; of vectors with other lengths
than the most frequent one (of equally frequent ones the longest), all are dropped, and so are those without entries;
repeated rows and ids count as often as they come; a component whose eigenvalue isn't above rounding (rank times 1e-12 of
the largest) doesn't exist, as nothing can have variance 1 along it, so equal rows, one row or an empty table give an
empty result; an n-fold squared deviation beyond 64 bits is an error of Spark's integer arithmetic (ANSI mode, the
default), no wrong number; columns of other names are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

SCALE, SHIFT = 64, 1_000_000


@dataclass(frozen=True)
class Model:
    """``components``: unit eigenvectors of the covariance as columns, ``eigenvalues`` falling, both for those kept."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def valid(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Id and x, an array of long, of the rows that count."""
    whole = F.col(column).isNotNull() & ~F.exists(column, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & (F.size(column) > 0)
    good = vectors.where(whole)
    sizes = good.groupBy(F.size(column).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    # only of finite entries, as the optimizer may work this out before the rows are filtered
    x = F.transform(column, lambda c: F.when(F.abs(c) < float("inf"), F.floor(c.cast("double") * SCALE).cast("long") + SHIFT))
    return good.where(F.size(column) == (sizes[0]["size"] if sizes else 0)).select(id_column, x.alias("x"))


def _gramian(rows: DataFrame) -> np.ndarray:
    """Of one column of double arrays: the sum of x x'."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(rows.columns[0]).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def _offsets(model: Model):
    """n * x - S, an exact array of long."""
    sums = F.array(*[F.lit(s).cast("long") for s in model.sums])
    return F.zip_with("x", sums, lambda x, s: x * F.lit(model.n).cast("long") - s)


def fit(rows: DataFrame, components: int = 32) -> Model | None:
    """Of rows with x, as valid() gives them; None without rows."""
    found = rows.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.count("*").alias("n"), F.sum("x").alias("s")).orderBy("at").collect()
    if not found:
        return None
    n, sums = found[0]["n"], tuple(r["s"] for r in found)
    empty = Model(n, sums, np.zeros((len(sums), 0)), np.zeros(0), 0.0)
    centred = rows.select(F.transform(_offsets(empty), lambda d: d.cast("double") / F.lit(n).cast("double")).alias("y"))
    covariance = _gramian(centred) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = int(min(components, (values > len(values) * 1e-12 * max(values[0], 0)).sum()))
    return Model(n, sums, np.ascontiguousarray(vectors[:, :kept]), values[:kept].copy(), float(np.trace(covariance)))


def whiten(rows: DataFrame, model: Model) -> DataFrame:
    """The columns of ``rows`` but x, with deviation, the squared length of n * x - S, and whitened, an array of double."""
    names = [c for c in rows.columns if c != "x"]
    offsets = rows.select(*names, _offsets(model).alias("offsets"))
    deviation = F.aggregate("offsets", F.lit(0).cast("long"), lambda acc, d: acc + d * d).alias("deviation")
    shared = rows.sparkSession.sparkContext.broadcast((model.n, model.components, np.sqrt(model.eigenvalues)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, components, scale = shared.value
        for pdf in batches:
            if len(pdf):
                y = np.stack(pdf["offsets"].to_numpy()).astype(np.float64) / n
                yield pdf.drop(columns="offsets").assign(whitened=list(y @ components / scale))

    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in names)
    return offsets.select(*names, "offsets", deviation).mapInPandas(lean(run), f"{kinds}deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, n: int) -> float:
    """The largest absolute entry of the covariance of whitened rows, minus the identity.  They are centred as they come:
    each is a projection of an exactly centred row."""
    covariance = _gramian(whitened.select("whitened")) / n
    return float(np.abs(covariance - np.eye(len(covariance))).max())


def whitened_components(vectors: DataFrame, components: int = 32, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """A row for each vector that counts and each component, numbered from 1: the id, component, n, deviation, whitened,
    explained (the component's share of the variance) and identity_error."""
    rows = valid(vectors, id_column, column)
    model = fit(rows, components)
    shape = f"`{id_column}` {rows.schema[id_column].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.eigenvalues):
        return rows.sparkSession.createDataFrame([], shape)
    found = whiten(rows, model)
    error = identity_error(found, model.n)
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues])
    out = found.select(id_column, "deviation", F.posexplode("whitened").alias("at", "w"))
    return out.select(id_column, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("w").alias("whitened"), F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
