"""Best-fit packing of token sequences by a plan over the histogram of lengths.

Documents become pieces of at most ``capacity`` tokens.  Only the histogram of piece lengths goes to the driver (at most
``capacity`` numbers).  Best fit, longest first, runs over its counts: a step puts many pieces of one length into many
bins with the same room at once, so the plan is a list of ranges "pieces of this length with ranks a to b go to the bins
from c on, at this offset".  Every length splits at most one range and opens at most one, so at most 2 * ``capacity``
ranges are open at any time, whatever the number of documents.  Pieces then take their slots by their rank within
their length; ranks are counted within buckets and shifted by the sums of the buckets before, so that one very common
length isn't ranked in one task.

Defined cases: null text counts as empty, a document of no words still has its end token; repeated rows are packed each
(``piece`` rows of equal ids follow each other); an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import codec
from .common import lean, materialize

#: Ranges that are sent to all executors at most, 40 bytes each; a longer plan is joined instead.
BROADCAST_RANGES = 500_000


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens; all but the first are full."""
    first = n % capacity or capacity
    return [(0, min(first, n))] + [(k, capacity) for k in range(first, n, capacity)]


def pieces(docs: DataFrame, path: str, pattern: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit) of every piece."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for k in range(0, len(batch), 512):
                part = batch.slice(k, 512)
                row, at, start, length, crc, raw = [], [], [], [], [], []
                for i, ids in enumerate(c.encode_texts([t or "" for t in part.column(1).to_pylist()])):
                    ids += end
                    for p, (s, m) in enumerate(cut(len(ids) // 4, capacity)):
                        own = ids[4 * s : 4 * (s + m)]
                        row.append(i), at.append(p), start.append(s), length.append(m), crc.append(zlib.crc32(own))
                        if with_ids:
                            raw.append(own)
                columns = [part.column(0).take(pa.array(row, pa.int64())), pa.array(at, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(raw, pa.binary())] * with_ids, ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, number, first bin, offset): best fit, longest first, over counts."""
    ranges = []
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> (first bin, number of bins)
    rooms: list[int] = []  # in order, those of room that are not empty
    bins = 0

    def give(r: int, first: int, number: int) -> None:
        if r:
            if r not in room:
                room[r] = []
                insort(rooms, r)
            room[r].append((first, number))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        k = bisect_left(rooms, length)
        fit = rooms[k:]  # what this length frees is smaller than any later choice for it, or tried in turn below
        while left:
            if fit:
                r = fit[0]
                first, number = room[r].pop()
                take = min(left, number)
                if take < number:
                    room[r].append((first + take, number - take))
                if not room[r]:
                    del room[r]
                    rooms.remove(r)
            else:
                r, first, take = capacity, bins, -(-left // (capacity // length))
                take = min(left, take)
                bins += take
            ranges.append((length, rank, take, first, capacity - r))
            give(r - length, first, take)
            left, rank = left - take, rank + take
            fit = rooms[bisect_left(rooms, length) :]
    return ranges


def place(found: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to materialized pieces."""
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total = sum(histogram.values())
    ranges = np.array(plan(histogram, capacity), dtype=np.int64).reshape(-1, 5)
    buckets = max(64, total // 200_000)
    keyed = found.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).drop("_n")
    ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_bucket", "_before")
    if len(ranges) > BROADCAST_RANGES:
        spark = found.sparkSession
        plans = spark.createDataFrame(ranges.tolist(), "_length long, _first long, _number long, _bin long, offset long")
        placed = ranked.join(plans, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_number")))
        return placed.withColumn("sequence_id", F.col("_bin") + F.col("_rank") - F.col("_first")).drop("_length", "_first", "_number", "_bin", "_rank")
    shared = found.sparkSession.sparkContext.broadcast(ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        span = int(r[:, 1:3].sum(axis=1).max()) + 1 if len(r) else 1
        order = np.argsort(r[:, 0] * span + r[:, 1])
        r = r[order]
        keys = r[:, 0] * span + r[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "_rank"))
            own = r[np.searchsorted(keys, length * span + rank, side="right") - 1]
            names = [c for c in batch.schema.names if c != "_rank"]
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(own[:, 3] + rank - own[:, 1], pa.int64()), pa.array(own[:, 4], pa.int64())], [*names, "sequence_id", "offset"])

    ranked = ranked.withColumn("_rank", F.col("_rank").cast("long"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInArrow(lean(run), f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, pattern: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, ids if asked for, sequence_id, offset."""
    found = materialize(pieces(docs, path, pattern, capacity, end_id, with_ids), "pieces")
    out = place(found, capacity)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "sequence_id", "offset")
