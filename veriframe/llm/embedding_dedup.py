"""Near-duplicate vectors by an inverted multi-index.

Independent codebooks on the two halves of the unit vectors make a product grid.  Every vector is indexed in its own
cell; as a query it visits cells in the order of its summed distance to the two half centroids (multi-sequence
traversal) up to ``slack`` above the nearest cell's.  The slack is fitted on the sample: it lets ``target_recall`` of
probes at exactly the threshold's cosine be found, and of the sample's own pairs.  Every visited vector is verified by
its cosine in double precision.

Only the codebooks and the slack come from a bounded sample (``sample_vectors``); all vectors are indexed and queried.
Equal vectors form a class, numbered by a hash of its vector.  Cells are cut into chunks of about ``chunk`` vectors, queries too,
and each task compares one chunk of each: it gives back sums of links and a spanning forest, never pairs, so a cell with
a third of all vectors is spread over many tasks.

Defined cases: vectors that are null, empty, zero, hold null or non-finite components, or have another number of
components than the most common one link with nothing; equal ids are separate vectors; ties at the threshold link;
an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize
from .graph import components


@dataclass
class Index:
    """Codebooks of the halves; ``slack`` in squared distance."""

    first: np.ndarray
    second: np.ndarray
    slack: float

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of the halves of unit vectors to the centroids."""
        h = self.first.shape[1]
        out = []
        for x, c in ((unit[:, :h], self.first), (unit[:, h:], self.second)):
            out.append(np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1), 0))
        return out[0], out[1]

    def traverse(self, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        """Cells of one vector, nearest first, within the slack."""
        o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
        s1, s2 = d1[o1], d2[o2]
        limit = s1[0] + s2[0] + self.slack
        ends = np.searchsorted(s2, limit - s1[s1 + s2[0] <= limit], side="right")
        i = np.repeat(np.arange(len(ends)), ends)
        j = np.arange(len(i)) - np.repeat(np.cumsum(ends) - ends, ends)
        order = np.argsort(s1[i] + s2[j], kind="stable")
        return o1[i[order]] * len(d2) + o2[j[order]]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), size=k, replace=False)]
    for _ in range(rounds):
        own = np.argmin((c * c).sum(axis=1) - 2 * x @ c.T, axis=1)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def fit(sample: np.ndarray, total: int, threshold: float, target_recall: float = 0.99, per_cell: int = 64) -> Index:
    """``sample``: some vectors; ``total``: of all, which sets the number of cells (at most 1024 a half)."""
    unit = _unit(sample.astype(np.float64))
    rng = np.random.default_rng(11)
    half = max(1, unit.shape[1] // 2)
    k = int(np.clip(np.sqrt(max(1, total) / per_cell), 1, min(1024, len(unit))))
    index = Index(_means(unit[:, :half], k, rng), _means(unit[:, half:], k, rng), 0.0)

    def slack(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        (dx1, dx2), (dy1, dy2) = index.distances(x), index.distances(y)
        rows = np.arange(len(x))
        return dx1[rows, dy1.argmin(axis=1)] + dx2[rows, dy2.argmin(axis=1)] - dx1.min(axis=1) - dx2.min(axis=1)

    probes = unit[rng.permutation(len(unit))[:4000]]
    away = rng.normal(size=probes.shape)
    away -= (away * probes).sum(axis=1)[:, None] * probes
    norm = np.sqrt((away * away).sum(axis=1))
    away = np.where(norm[:, None] > 0, away / np.maximum(norm, 1e-300)[:, None], 0)
    seen = [slack(probes, _unit(threshold * probes + np.sqrt(max(0.0, 1 - threshold**2)) * away))]
    for i in range(0, min(len(unit), 4000), 500):
        a, b = np.nonzero(unit[i : i + 500] @ unit.T >= threshold)
        keep = rng.permutation(len(a))[:20_000]
        seen.append(slack(unit[i + a[keep]], unit[b[keep]]))
    index.slack = max(float(np.quantile(s, target_recall)) for s in seen if len(s))
    return index


def _matrix(packed: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(packed), dtype=kind).reshape(len(packed), -1).astype(np.float64)


def _forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning label for each node with a link: the smallest node of its component within this block."""
    rows, cols = linked.any(axis=1), linked.any(axis=0)
    linked, left, right = linked[np.ix_(rows, cols)], left[rows], right[cols]
    if not len(left):
        return left, left
    a, b = left.copy(), right.copy()
    high = np.iinfo(np.int64).max
    while True:
        new_b = np.minimum(b, np.where(linked, a[:, None], high).min(axis=0))
        new_a = np.minimum(a, np.where(linked, new_b[None, :], high).min(axis=1))
        if (new_a == a).all() and (new_b == b).all():
            return np.concatenate([left, right]), np.concatenate([a, b])
        a, b = new_a, new_b


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, target_recall: float = 0.99, sample_vectors: int = 10_000, chunk: int = 1024, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``id_column``, n_links, component_id, kept, class_id (of equal vectors) of every row."""
    spark = vectors.sparkSession
    kind = vectors.schema[vector_column].dataType.elementType.simpleString()
    dtype = "<f4" if kind == "float" else "<f8"
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast(f"array<{'float' if kind == 'float' else 'double'}>").alias("v"))
    finite = F.size("v") > 0
    finite &= F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(finite, F.lit(False)))
    sizes = rows.where("ok").groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    dim = sizes[0]["n"] if sizes else 0
    rows = rows.withColumn("ok", F.col("ok") & (F.size("v") == dim)).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    good = rows.where("ok")
    classes = materialize(good.groupBy("h1", "h2").agg(F.min("id").alias("first_id"), F.count("*").alias("m"), F.first("v").alias("v")).withColumn("rep", F.xxhash64("h1", "h2")), "classes")
    total = classes.count()
    if total < 1:
        return rows.select(F.col("id").alias(id_column), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"), F.col("id").alias("class_id"))
    share = min(1.0, sample_vectors / total)
    few = classes.where(F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20))).select("v").limit(2 * sample_vectors).collect() if share < 1 else classes.select("v").collect()
    few = few or classes.select("v").limit(1).collect()
    index = spark.sparkContext.broadcast(fit(np.array([r.v for r in few], dtype=np.float64), total, threshold, target_recall))

    def grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Own cell (query false) and visited cells (query true) of each class."""
        g = index.value
        for whole in batches:
            for k in range(0, len(whole), 1000):
                batch = whole.slice(k, 1000)
                raw = np.asarray(batch.column(2).flatten(), dtype=dtype).reshape(len(batch), -1)
                d1, d2 = g.distances(_unit(raw.astype(np.float64)))
                own = d1.argmin(axis=1) * len(g.second) + d2.argmin(axis=1)
                visited = [g.traverse(a, b) for a, b in zip(d1, d2, strict=True)]
                n = np.array([len(v) for v in visited])
                at = np.concatenate([np.arange(len(batch)), np.repeat(np.arange(len(batch)), n)])
                packed = pa.array([r.tobytes() for r in raw], pa.binary())
                for i in range(0, len(at), 20_000):
                    part = pa.array(at[i : i + 20_000])
                    cells = np.concatenate([own, *visited])[i : i + 20_000]
                    query = np.arange(i, i + len(cells)) >= len(batch)
                    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(query), batch.column(0).take(part), batch.column(1).take(part), packed.take(part)], ["cell", "query", "rep", "m", "raw"])

    cells = classes.select("rep", "m", "v").mapInArrow(lean(grid), "cell long, query boolean, rep long, m long, raw binary")
    sums = cells.groupBy("cell").agg(F.count_if(~F.col("query")).alias("stored"), F.count_if("query").alias("asked")).where("stored > 0")
    sums = sums.select("cell", F.ceil(F.col("stored") / chunk).cast("int").alias("ic"), F.ceil(F.col("asked") / chunk).cast("int").alias("qc"))
    own_chunk = F.pmod(F.xxhash64("rep"), F.when(F.col("query"), F.col("qc")).otherwise(F.col("ic"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("query"), F.col("ic")).otherwise(F.col("qc")) - 1)
    units = cells.join(sums, "cell").withColumn("own", own_chunk).withColumn("other", F.explode(others))
    units = units.select("cell", F.when(F.col("query"), F.col("other")).otherwise(F.col("own")).alias("ic"), F.when(F.col("query"), F.col("own")).otherwise(F.col("other")).alias("qc"), "query", "rep", "m", "raw")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        g = index.value
        asked, stored = pdf[pdf["query"]], pdf[~pdf["query"]]
        if not len(asked) or not len(stored):
            return pd.DataFrame({"rep": [], "links": [], "label": []}).astype("int64")
        x, y = _unit(_matrix(list(asked["raw"]), dtype)), _unit(_matrix(list(stored["raw"]), dtype))
        a, b = asked["rep"].to_numpy(np.int64), stored["rep"].to_numpy(np.int64)
        linked = (x @ y.T >= threshold) & (a[:, None] != b[None, :])
        keep = linked.any(axis=1)
        x, a, ma, linked = x[keep], a[keep], asked["m"].to_numpy(np.int64)[keep], linked[keep]
        if not len(a):
            return pd.DataFrame({"rep": [], "links": [], "label": []}).astype("int64")
        mb = stored["m"].to_numpy(np.int64)
        # a stored vector whose own query doesn't come to this query's cell is credited here
        (x1, x2), (y1, y2) = g.distances(x), g.distances(y)
        back = y1[:, x1.argmin(axis=1)] + y2[:, x2.argmin(axis=1)] <= (y1.min(axis=1) + y2.min(axis=1) + g.slack)[:, None]
        node, label = _forest(linked, a, b)
        return pd.DataFrame({
            "rep": np.concatenate([a, b, node]),
            "links": np.concatenate([linked.astype(np.int64) @ mb, (linked & ~back.T).astype(np.int64).T @ ma, np.zeros(len(node), np.int64)]),
            "label": np.concatenate([a, b, label]),
        })

    found = materialize(units.groupBy("cell", "ic", "qc").applyInPandas(compare, "rep long, links long, label long").where("links > 0 or rep <> label"), "links")
    groups = components(found.select("rep", "label"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    per_class = classes.select("h1", "h2", "rep", "first_id", "m").join(links, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    per_class = per_class.withColumn("component", F.coalesce("component", "rep"))
    smallest = per_class.groupBy("component").agg(F.min("first_id").alias("component_id"))
    per_class = per_class.join(smallest, "component").select("h1", "h2", "first_id", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.join(per_class.withColumn("ok", F.lit(True)), ["h1", "h2", "ok"], "left")
    own = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), own.alias("component_id"), (F.col("id") == own).alias("kept"), F.coalesce("first_id", "id").alias("class_id"))
