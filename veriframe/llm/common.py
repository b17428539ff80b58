"""What the operators of this subpackage share: tables, shared storage, hashing of words.

Words are maximal runs of bytes other than space and \\t \\n \\v \\f \\r, with A-Z lower-cased.  That is what
``bytes.lower().split()`` gives; the numpy functions here do the same over a whole Arrow batch at once.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that the numpy functions take at once; a longer text is taken alone.
SLICE_BYTES = 1 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Of each byte its number in a word's hash: itself and one, with A-Z lower-cased or not.
_FOLDED, _PLAIN = _LOWER.astype(np.uint64) + np.uint64(1), np.arange(1, 257, dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; one of our own only where it is unset."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        set_dir = getattr(spark, "_own_shared_dir", None) or tempfile.mkdtemp(prefix="veriframe-")
        spark._own_shared_dir = set_dir
    return set_dir.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage, and lost executors lose nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what materialize() wrote, once nothing reads it any more."""
    for df in frames:
        path = getattr(df, "_shared_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing holds any more; it does so when the driver's garbage
    collector finds them, which on its own may come after the disks are full.  The thread's last plan is held until
    another one runs."""
    gc.collect()
    spark.range(1).write.format("noop").mode("overwrite").save()
    spark._jvm.System.gc()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores in front if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Bits of a filter of ids at most: 8 MB on every executor, whatever the number of ids.
FILTER_BITS = 1 << 26
_FILTER_SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], dtype=np.uint64)


def _filter_places(ids: np.ndarray, bits: int) -> np.ndarray:
    return mix64(ids.astype(np.int64).view(np.uint64)[:, None] ^ _FILTER_SEEDS) & np.uint64(bits - 1)


def bloom(ids: DataFrame, column: str):
    """A function that tells on executors which of an array of 64-bit values may be among ``column`` of ``ids`` (without
    nulls): none that is there is left out.  For very many it lets more through."""
    spark, n = ids.sparkSession, ids.count()
    bits = 1 << min(FILTER_BITS.bit_length() - 1, max(16, (16 * n).bit_length()))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_filter_places(np.asarray(batch.column(0)), bits).ravel())
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(as_long(word)), pa.array(as_long(mask))], ["word", "mask"])

    found = ids.select(column).mapInArrow(lean(words), "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros(bits >> 6, dtype=np.uint64)
    table[found.column("word").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(table)

    def there(values: np.ndarray) -> np.ndarray:
        at = _filter_places(values, bits)
        return ((shared.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)

    return there


def rows_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the rows of ``docs`` with one of ``ids`` (column doc_id, distinct, materialized); a null among
    them stands for all rows without an id.

    A Bloom filter of the ids leaves most of the other texts out before the join shuffles them.  Its size is bounded; for
    very many ids it lets more through, which the join then drops.
    """
    known = ids.select(F.col("doc_id").cast("long"))
    there = bloom(known.where("doc_id is not null"), "doc_id")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0)
            yield batch.filter(pa.array(there(np.asarray(own.fill_null(0))) | np.asarray(own.is_null())))

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(keep), "doc_id long, text string")
    known = known.withColumnRenamed("doc_id", "known")
    # one plan at every size: the filter has made this side small already
    return rows.join(known.hint("merge"), rows["doc_id"].eqNullSafe(known["known"]), "left_semi")


def apart(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two parts: the rows whose doc_id may be among ``ids`` (column doc_id, materialized), and those whose
    isn't, which so needn't be shuffled for a join.  Rows without an id are in one of the parts."""
    there = bloom(ids.where("doc_id is not null").select(F.col("doc_id").cast("long")), "doc_id")

    @F.pandas_udf("boolean")
    def may(own: pd.Series) -> pd.Series:
        return pd.Series(there(own.to_numpy()))

    own = may(F.coalesce(docs["doc_id"].cast("long"), F.lit(0).cast("long")))
    return docs.where(own), docs.where(~own)


def _give_back() -> None:
    """Hands memory that a task has freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run):
    """``run`` over Arrow batches; a worker that waits for its next task then holds no more than it keeps."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _give_back()

    return go


def lean_group(run):
    """``run`` over a group (key and rows, or left and right): a worker hands back each group's memory before the next."""

    def go(first, second):
        out = run(first, second)
        _give_back()
        return out

    return go


_kept: dict[object, object] = {}


def worker_keeps(key: object, make):
    """What a worker process keeps between tasks: one thing at a time, as workers go on to the next operator's tasks."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit values (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def distinct_values(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values.  np.unique puts them into a hash table first, which for hashes takes many times as long
    as the sort."""
    x = np.sort(x)
    new = np.ones(len(x), dtype=bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        base = np.full(size, _MULTIPLIER, dtype=np.uint64)
        base[0] = 1
        back = np.full(size, np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64)), dtype=np.uint64)
        back[0] = 1
        _powers, _inverse = np.cumprod(base, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
    return _powers, _inverse


def hash_words(text: np.ndarray, bounds: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of several texts laid end to end.

    ``text``: bytes; ``bounds``: where each text starts, and the end.  Returns for each word its 64-bit hash, its
    text's number, and its first and past-the-end byte.  Without ``fold`` the case counts.
    """
    n = len(text)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none
    space = _SPACE.take(text)
    begins = ~space
    begins[1:] &= space[:-1]
    inner = bounds[1:-1]
    inner = inner[inner < n]
    begins[inner] = ~space[inner]  # a word ends with its text
    start = np.flatnonzero(begins)
    ends = ~space
    ends[:-1] &= space[1:]
    last = inner[inner > 0] - 1
    ends[last] = ~space[last]
    stop = np.flatnonzero(ends) + 1
    powers, inverse = _power_tables(n + 1)
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    (_FOLDED if fold else _PLAIN).take(text, out=sums[1:], mode="wrap")
    sums[1:] *= powers[:n]
    np.cumsum(sums[1:], out=sums[1:])
    h = mix64((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return h, np.repeat(np.arange(len(bounds) - 1), np.diff(np.searchsorted(start, bounds))), start, stop


def hash_shingles(words: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of every ``width`` words in a row of one text, with the text's number; first word first."""
    n = len(words) - width + 1
    if n <= 0:
        return words[:0], doc[:0]
    h = words[:n].copy()
    for k in range(1, width):
        h = h * np.uint64(0xFF51AFD7ED558CCD) + words[k : n + k]
    whole = doc[:n] == doc[width - 1 :]
    return mix64(h)[whole], doc[:n][whole]


def interval_hashes(values: np.ndarray):
    """A function of starts and lengths that gives the hashes of these intervals of ``values``."""
    powers, inverse = _power_tables(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers[: len(values)], out=sums[1:], dtype=np.uint64)
    return lambda start, n: mix64((sums[start + n] - sums[start]) * inverse[start] + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string column into runs of rows of about ``limit`` bytes: first row, past-the-last row, bytes, bounds.

    Null texts count as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, len(column))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def as_long(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def bucket_of(column: str, modulus: int):
    """crc32 of the id as text, modulo; the folds of the contracts."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % F.lit(modulus)


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingle hashes of each text of a column; a text of fewer words has its whole sequence as
    its only shingle, one without words has none."""
    for i, j, data, bounds in text_slices(column):
        words, doc, _, _ = hash_words(data, bounds)
        whole, owner = hash_shingles(words, doc, width)
        cut = np.searchsorted(owner, np.arange(j - i + 1))
        word_cut = np.searchsorted(doc, np.arange(j - i + 1))
        for k in range(j - i):
            if cut[k] < cut[k + 1]:
                yield i + k, np.unique(whole[cut[k] : cut[k + 1]])
            elif word_cut[k] < word_cut[k + 1]:
                own = words[word_cut[k] : word_cut[k + 1]]
                h = np.uint64(len(own))
                with np.errstate(over="ignore"):
                    for w in own:
                        h = h * np.uint64(0xFF51AFD7ED558CCD) + w
                yield i + k, mix64(np.array([h]))
            else:
                yield i + k, words[:0]
