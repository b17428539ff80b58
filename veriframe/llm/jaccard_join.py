"""N-gram Jaccard join with parity sketches.

A document is its set of distinct word shingles, each a 64-bit hash.  The tokens are dealt by hash to the symbols of a
sketch and XORed together there, so one differing token changes at most one symbol: the number of differing symbols
never exceeds the symmetric difference.  For sets with sizes up to U and the wanted similarity the symmetric difference
is at most d(U), so of d(U) + r symbols r at least are equal (pigeonhole).  Sizes are cut into bands that grow by a
quarter; a set takes part in every band in which its larger partner could be.  A symbol with its band and place is a
key.  Of the keys that it shares with any other set, a set leaves out the r - 1 that most sets have: two similar sets
have r keys in common, so they still meet under the rarest of these.  A set that shares fewer than r keys is done.  A
second sketch, of single bits, has the Hamming distance that bounds the symmetric difference from below: candidates
above the bound go, the rest are verified on the whole texts.

Equal sets are a class and take part once.  Sets that share a key are first compared with the one of them that shares
most keys (in a group of copies, the one with the fewest changes); the links found join classes to components.  Keys
whose sets are then in one component are done.  Small keys that are left give their remaining pairs.  Sets under large
ones are joined to groups over these keys, so that sets with many common keys are compared once: by their bit sketches,
in tasks of ``chunk`` by ``chunk`` sets.  Of the pairs within the bound that aren't yet connected or refuted a task
proposes all, or if there are many the nearest that span its components; these are verified, and that goes on until
nothing new is proposed.  So no pair within the similarity is left unconnected, unless two different sets have the same
64-bit fingerprint.

Defined cases: null text counts as empty; a text without words has no shingles and links with nothing; one with fewer
words than a shingle has one shingle, the whole sequence; repeated rows are equal sets; rows without doc_id take part by
their texts, and a component's smallest id is null only if none of its rows has one; where one id has several texts each
row is judged by its own; an empty table gives an empty result; only doc_id and text are read, texts whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import apart, as_long, discard, free_name, lean, materialize, mix64, release, rows_of, shingle_sets
from .graph import components

#: Sets under a key up to which its pairs are listed.
SMALL_KEY = 32
#: Bytes of bit sketches on one side of a task that compares them, about.
CHUNK_BYTES = 16 << 20
#: Low bits of a key that hold its band.
BAND_BITS = 8
#: Rows of one key that are held back to count them; keys with more count as equally frequent.
COUNTED = 1 << 20


def bands(percent: int, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Upper sizes of the bands, the number of symbols for each, and how many of its keys a set may leave out."""
    upper = [1]
    while upper[-1] < largest:
        upper.append(max(upper[-1] + 1, upper[-1] * 5 // 4))
    u = np.array(upper, dtype=np.int64)
    need = 2 * u * (100 - percent) // (100 + percent) + 1
    spare = (need + 3) // 4
    return u, need + spare, spare


def fingerprint(tokens: np.ndarray) -> np.uint64:
    """Of a sorted set; equal sets have equal ones."""
    x = np.array([np.add.reduce(tokens), np.bitwise_xor.reduce(mix64(tokens)), len(tokens)], dtype=np.uint64)
    return mix64(mix64(mix64(x[:1]) + np.uint64(0x9FB21C651E98DF25) * x[1:2]) + x[2:])[0]


def symbols(tokens: np.ndarray, owner: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of several sets laid end to end, and the set of each. ``owner``: the set of each token."""
    upper, count, _ = bands(percent, int(sizes.max(initial=1)) * 100 // percent + 1)
    keys, owners = [], []
    band = np.searchsorted(upper, sizes)  # the first whose upper size holds the set as the larger partner
    while True:
        # the smallest larger partner of this band must still be similar enough in size
        lower = np.where(band > 0, upper[np.clip(band - 1, 0, len(upper) - 1)] + 1, 1)
        use = (sizes > 0) & (band < len(upper)) & (100 * sizes >= percent * lower)
        if not use.any():
            break
        k = np.where(use, count[np.minimum(band, len(upper) - 1)], 0)
        first = np.cumsum(k) - k
        mine = use[owner]
        own, t = owner[mine], tokens[mine]
        dealt = mix64(t ^ np.uint64(0x5851F42D4C957F2D))
        at = first[own] + ((dealt >> np.uint64(32)) % k[own].astype(np.uint64)).astype(np.int64)
        sketch = np.zeros(int(k.sum()), dtype=np.uint64)
        np.bitwise_xor.at(sketch, at, mix64(t))
        who = np.repeat(np.arange(len(sizes)), k)
        place = (np.arange(len(sketch)) - first[who]).astype(np.uint64)
        of_band = band[who].astype(np.uint64)
        keys.append((mix64(sketch ^ mix64((of_band << np.uint64(40)) + place)) << np.uint64(BAND_BITS)) | of_band)
        owners.append(who)
        band = band + 1
    if not keys:
        return tokens[:0], owner[:0]
    return np.concatenate(keys), np.concatenate(owners)


def bit_sketch(tokens: np.ndarray) -> np.ndarray:
    """Parity bits, two to four for each token, in 64-bit words; the number of words is a power of two."""
    bits = 64
    while bits < 2 * len(tokens):
        bits *= 2
    at = (mix64(tokens + np.uint64(0x2545F4914F6CDD1D)) & np.uint64(bits - 1)).astype(np.int64)
    parity = np.zeros(bits, dtype=np.uint8)
    np.bitwise_xor.at(parity, at, 1)
    return np.packbits(parity, bitorder="little").view(np.uint64)


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch of the same set in fewer words (last axis)."""
    while sketch.shape[-1] > words:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def within(distance: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """Whether a symmetric difference allows the similarity, ``total`` being the sum of the sizes."""
    return distance * (100 + percent) <= total * (100 - percent)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, fp and bit sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, fp = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=np.uint64)
            sketch = [b""] * len(batch)
            for row, tokens in shingle_sets(batch.column(1), width):
                n[row] = len(tokens)
                if len(tokens):
                    fp[row] = fingerprint(tokens)
                    sketch[row] = bit_sketch(tokens).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(as_long(fp)), pa.array(sketch, pa.binary())], ["doc_id", "n", "fp", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, n long, fp long, sketch binary")


def _keys(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """key and fp, once for each distinct set of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def flush(group: list[tuple[np.uint64, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            if group:
                sizes = np.array([len(t) for _, t in group], dtype=np.int64)
                keys, who = symbols(np.concatenate([t for _, t in group]), np.repeat(np.arange(len(group)), sizes), sizes, percent)
                fps = np.array([f for f, _ in group], dtype=np.uint64)[who]
                for k in range(0, len(keys), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(as_long(keys[k : k + 200_000])), pa.array(as_long(fps[k : k + 200_000]))], ["key", "fp"])

        for batch in batches:
            group, size = [], 0
            for _, tokens in shingle_sets(batch.column(0), width):
                if len(tokens) and (f := fingerprint(tokens)) not in seen:
                    if len(seen) > 2_000_000:
                        seen.clear()
                    seen.add(f)
                    group.append((f, tokens))
                    size += len(tokens)
                    if size > 300_000:
                        yield from flush(group)
                        group, size = [], 0
            yield from flush(group)

    return docs.select("text").mapInArrow(lean(run), "key long, fp long")


def _shared_keys(keys: DataFrame) -> DataFrame:
    """key, fp and size (number of sets, at most COUNTED) for the keys that several sets have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)  # what is held back
        passed = None  # the last row of a key that goes on beyond COUNTED

        def out(rows: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(fp[rows]), pa.array(size)], ["key", "fp", "size"])

        def settle(last: bool) -> Iterator[pa.RecordBatch]:
            """Gives the whole keys of what is held back, and holds the last one back unless it is ``last``."""
            nonlocal key, fp, passed
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(starts, len(key)))
            sizes, whole, rest = np.repeat(size, size), len(key) if last else starts[-1], key[:0]
            if passed is not None and key[0] == passed[0]:
                # rows of a key whose first rows are given
                sizes[: size[0]], whole = COUNTED, max(whole, size[0])
            if not last and whole < len(key) and size[-1] >= COUNTED:
                sizes[starts[-1] :], whole = COUNTED, len(key)
            at = np.flatnonzero(sizes[:whole] > 1)
            yield from out(at, np.minimum(sizes[at], COUNTED))
            if whole == len(key) and (size[-1] >= COUNTED or sizes[-1] == COUNTED):
                passed = (key[-1], fp[-1])
            key, fp = key[whole:], fp[whole:]

        for batch in batches:
            key = np.concatenate([key, np.asarray(batch.column(0))])
            fp = np.concatenate([fp, np.asarray(batch.column(1))])
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])
            if passed is not None and len(key):
                new[0] = (key[0], fp[0]) != passed
            key, fp = key[new], fp[new]
            if len(key):
                yield from settle(False)
        if len(key):
            yield from settle(True)

    return keys.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(lean(run), "key long, fp long, size long")


def _candidates(shared: DataFrame, percent: int) -> DataFrame:
    """key, fp and hub (the set that shares most keys) for the keys under which sets must meet."""
    _, _, spare = bands(percent, 1 << 40)
    band = F.col("key").bitwiseAND((1 << BAND_BITS) - 1).cast("int")
    own = Window.partitionBy("fp", "band")
    rows = shared.withColumn("band", band).withColumn("n_keys", F.count("*").over(own)).withColumn("place", F.row_number().over(own.orderBy("size", "key")))
    may_go = F.element_at(F.array(*[F.lit(int(k)) for k in spare[: 1 << BAND_BITS]]), F.col("band") + 1)
    rows = materialize(rows.where(F.col("place") + may_go <= F.col("n_keys")).select("key", "fp", "n_keys"), "keys")
    hubs = rows.groupBy("key").agg(F.min(F.struct(-F.col("n_keys"), "fp"))["fp"].alias("hub"), F.count("*").alias("sets")).where("sets > 1")
    out = materialize(rows.join(hubs.select("key", "hub"), "key").select("key", "fp", "hub"), "keys")
    discard(rows)
    return out


def _texts(docs: DataFrame, chosen: DataFrame, width: int) -> DataFrame:
    """fp and text, one row for each set of the rows with the ids ``chosen``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[np.uint64] = set()  # repeated rows of a document come to one task
        for batch in batches:
            fp, rows = [], []
            for row, tokens in shingle_sets(batch.column(0), width):
                if len(tokens) and (f := fingerprint(tokens)) not in seen:
                    seen.add(f)
                    rows.append(row), fp.append(f)
            yield pa.RecordBatch.from_arrays([pa.array(as_long(np.array(fp, dtype=np.uint64))), batch.column(0).take(pa.array(rows, pa.int64())).cast(pa.string())], ["fp", "text"])

    # a row too many for a set (ids with several texts, tasks split for skew) only repeats links
    return rows_of(docs, chosen).select("text").mapInArrow(lean(run), "fp long, text string")


def _near(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose bit sketches allow the similarity."""
    k = known.select("fp", "n", "sketch")
    both = pairs.join(k.toDF("b", "nb", "sb"), "b").join(k.toDF("a", "na", "sa"), "a")
    both = both.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.asarray(batch.column(2)) + np.asarray(batch.column(4))
            distance = np.zeros(len(batch), dtype=np.int64)
            for i, (x, y) in enumerate(zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                p, q = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                w = min(len(p), len(q))
                distance[i] = np.bitwise_count(fold(p, w) ^ fold(q, w)).sum()
            yield batch.select(["a", "b"]).filter(pa.array(within(distance, total, percent)))

    return both.select("a", "b", "na", "sa", "nb", "sb").mapInArrow(lean(run), "a long, b long")


def _verify(candidates: DataFrame, known: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough: by their bit sketches, then from their whole texts."""
    pairs = materialize(_near(candidates, known, percent), "near")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    chosen = materialize(known.select("fp", "doc_id").join(wanted, "fp", "left_semi").select("doc_id").distinct(), "ids")
    t = _texts(docs, chosen, width)
    both = pairs.join(t.toDF("b", "tb"), "b").join(t.toDF("a", "ta"), "a").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[int, np.ndarray] | None = None
        for whole in batches:
            for s in range(0, len(whole), 500):
                batch = whole.slice(s, 500)
                a = np.asarray(batch.column(0))
                good = np.zeros(len(batch), dtype=bool)
                firsts = np.flatnonzero(np.concatenate([[kept is None or a[0] != kept[0]], a[1:] != a[:-1]]))
                left = dict(zip(firsts.tolist(), (t for _, t in shingle_sets(batch.column(2).take(pa.array(firsts, pa.int64())), width)), strict=True)) if len(firsts) else {}
                for i, y in shingle_sets(batch.column(3), width):
                    if i in left:
                        kept = (a[i], left[i])
                    x = kept[1]
                    place = np.minimum(np.searchsorted(x, y), len(x) - 1)
                    common = int((x[place] == y).sum())
                    good[i] = 100 * common >= percent * (len(x) + len(y) - common)
                yield batch.select(["a", "b"]).filter(pa.array(good))

    links = materialize(both.mapInArrow(lean(run), "a long, b long"), "links")
    discard(pairs, chosen)
    return links


def _forest(left: np.ndarray, right: np.ndarray, distance: np.ndarray, component: np.ndarray) -> list[int]:
    """Which of the pairs (of places in ``component``), nearest first, join components that no pair before has joined."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    chosen, apart = [], len(np.unique(component)) - 1
    for k in np.argsort(distance, kind="stable").tolist():
        if not apart:
            break
        x, y = find(int(component[left[k]])), find(int(component[right[k]]))
        if x != y:
            parent[x] = y
            chosen.append(k)
            apart -= 1
    return chosen


def _groups_of_large_keys(large: DataFrame, known: DataFrame, chunk: int) -> DataFrame:
    """g, fp, n, sketch, parts and own (part of the set): the sets under large keys, once each, in the groups that these
    keys join them to."""
    groups = components(large.where("fp <> hub").select("hub", "fp").distinct())
    rows = groups.toDF("fp", "g").join(known.select("fp", "n", "sketch"), "fp")
    size = groups.toDF("fp", "g").join(known.select("fp", F.octet_length("sketch").alias("bytes")), "fp")
    size = size.groupBy("g").agg(F.ceil(F.greatest(F.count("*") / chunk, F.sum("bytes") / CHUNK_BYTES)).cast("int").alias("parts"))
    rows = rows.join(size, "g").withColumn("own", F.pmod(F.xxhash64("fp"), "parts").cast("int"))
    out = materialize(rows.select("g", "fp", "n", "sketch", "parts", "own"), "members")
    discard(groups)
    return out


def _group_pairs(members: DataFrame, parts_of: DataFrame, refuted: DataFrame, percent: int) -> DataFrame:
    """g, i, j (parts) and pairs (a, b) of them that would connect components of a group, within the bound of their bit
    sketches.  ``parts_of``: node and component; ``refuted``: rows like the result's that are not to come again."""
    rows = members.join(parts_of.toDF("fp", "component"), "fp", "left").withColumn("c", F.coalesce("component", "fp"))
    several = rows.groupBy("g").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most")
    rows = rows.join(several, "g", "left_semi").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp", "c", "n", "sketch")

    def compare(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"g": [], "i": [], "j": [], "a": [], "b": []}).astype({"g": "int64", "i": "int32", "j": "int32", "a": "int64", "b": "int64"})
        if not len(pdf):
            return none
        pdf = pdf.sort_values(["n", "fp"], kind="stable")
        fp, c, n, own = (pdf[x].to_numpy() for x in ("fp", "c", "n", "own"))
        raw = [np.frombuffer(s, dtype=np.uint64) for s in pdf["sketch"]]
        words = np.array([len(x) for x in raw])  # grows with n
        folded = {w: (int(k := np.searchsorted(words, w)), np.stack([fold(x, w) for x in raw[k:]])) for w in np.unique(words).tolist()}
        same = pdf["i"].iat[0] == pdf["j"].iat[0]
        last = np.searchsorted(n, n * 100 // percent, side="right")
        xs, ys, ds = [], [], []
        for s in range(len(fp)):
            other = np.arange(s + 1, last[s])
            other = other[(c[other] != c[s]) & (same | (own[other] != own[s]))]
            first, sketches = folded[words[s]]
            d = np.bitwise_count(sketches[other - first] ^ sketches[s - first]).sum(axis=1, dtype=np.int64)
            ok = within(d, n[other] + n[s], percent)
            xs.append(np.full(int(ok.sum()), s)), ys.append(other[ok]), ds.append(d[ok])
        x, y, d = (np.concatenate(v) for v in (xs, ys, ds))
        a, b = np.minimum(fp[x], fp[y]), np.maximum(fp[x], fp[y])
        if len(told):
            gone = set(zip(told["a"].tolist(), told["b"].tolist(), strict=True))
            new = np.array([p not in gone for p in zip(a.tolist(), b.tolist(), strict=True)], dtype=bool)
            x, y, d, a, b = x[new], y[new], d[new], a[new], b[new]
        if len(x) > 2 * len(pdf):
            chosen = _forest(x, y, d, c)
            left_over = np.setdiff1d(np.arange(len(x)), chosen)
            chosen += left_over[_forest(x[left_over], y[left_over], d[left_over], c)].tolist()
            a, b = a[chosen], b[chosen]
        if not len(a):
            return none
        return pd.DataFrame({"g": pdf["g"].iat[0], "i": pdf["i"].iat[0], "j": pdf["j"].iat[0], "a": a, "b": b})

    return rows.groupBy("g", "i", "j").cogroup(refuted.groupBy("g", "i", "j")).applyInPandas(compare, "g long, i int, j int, a long, b long")


def link_classes(docs: DataFrame, width: int, percent: int, chunk: int = 4096) -> tuple[DataFrame, DataFrame]:
    """doc_id, n, fp of every row, and node (an fp), component of the classes that link with another one."""
    spark = docs.sparkSession
    sets = materialize(_sets(docs, width), "sets")
    shared = materialize(_shared_keys(_keys(docs, width, percent)), "keys")
    release(spark)
    keys = _candidates(shared, percent)
    discard(shared)
    release(spark)
    known = sets.where("n > 0").join(keys.select("fp").distinct(), "fp", "left_semi")
    known = materialize(known.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch")), "candidates")
    stars = keys.where("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct()
    links = _verify(stars, known, docs, width, percent)
    groups = components(links)
    # keys whose sets are in several components
    rows = keys.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", "hub", F.coalesce("component", "fp").alias("c"))
    several = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most")
    rest = materialize(rows.join(several.select("key", "size"), "key"), "open")
    discard(keys)
    small, large = rest.where(F.col("size") <= SMALL_KEY), rest.where(F.col("size") > SMALL_KEY)
    x, y = small.select("key", F.col("fp").alias("a"), F.col("c").alias("ca"), "hub"), small.select("key", F.col("fp").alias("b"), F.col("c").alias("cb"))
    # pairs with the hub have been compared
    pairs = x.join(y, "key").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & (F.col("a") != F.col("hub")) & (F.col("b") != F.col("hub"))).select("a", "b").distinct()
    good = _verify(pairs, known, docs, width, percent)
    members = _groups_of_large_keys(large, known, chunk)
    told: list[DataFrame] = []
    while True:
        if good.limit(1).count():
            # the stars found so far and the new links
            before, groups = groups, components(groups.union(good.select("a", "b")))
            discard(before)
        old = functools.reduce(DataFrame.union, told, spark.createDataFrame([], "g long, i int, j int, a long, b long"))
        proposed = materialize(_group_pairs(members, groups, old, percent), "near")
        if not proposed.limit(1).count():
            break
        good = _verify(proposed.select("a", "b").distinct(), known, docs, width, percent)
        told.append(proposed)
    discard(rest, members, known, links, good, proposed, *told)
    release(spark)
    return sets.select("doc_id", "n", "fp"), groups


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, chunk: int = 4096) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id of the rows with an equal set) and component_id (smallest doc_id
    that is reachable over links) of every row. Rows link when 100 * intersection >= ``percent`` * union."""
    sets, groups = link_classes(docs, width, percent, chunk)
    classes = sets.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("class_id"))
    classes = classes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = classes.groupBy("component").agg(F.min("class_id").alias("component_id"))
    classes = classes.join(smallest, "component").select("fp", "class_id", "component_id", F.lit(True).alias("linked"))
    out = sets.withColumn("linked", F.col("n") > 0).join(classes, ["fp", "linked"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document has the smallest id of its component; repeated rows of it stay together.  Rows
    without doc_id are documents each: of equal ones, and of a component without ids, one stays, and they go where their
    component has a row with an id."""
    sets, groups = link_classes(docs, width, percent)
    sets = sets.where("n > 0").select("doc_id", "fp").distinct()
    rows = sets.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("doc_id", "fp", F.coalesce("component", "fp").alias("component"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "fp")
    first = rows.groupBy("component").agg(F.min(order).alias("first"))
    rows = rows.join(first, "component").select("doc_id", "fp", order.eqNullSafe(F.col("first")).alias("stays"))
    of_id = rows.groupBy("doc_id").agg(F.bool_and("stays").alias("all"), F.bool_or("stays").alias("any"))
    of_id = materialize(of_id, "kept")
    # an id whose texts are all to go, and those that must be looked at text by text
    name = free_name(docs, "_own")
    gone = of_id.where(F.col("doc_id").isNotNull() & ~F.col("any")).select(F.col("doc_id").alias(name))
    mixed = of_id.where(F.col("doc_id").isNull() | (F.col("any") & ~F.col("all"))).select(F.col("doc_id").alias(name))
    some, others = apart(docs, gone.withColumnRenamed(name, "doc_id"))
    out = others.unionByName(some.join(gone, some["doc_id"].cast("long") == F.col(name), "left_anti"))
    if not mixed.limit(1).count():
        return out
    fp, by_fp = free_name(docs, "_fp"), rows.where("stays").select("doc_id", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: list[int | None] = [None] * len(batch)
            for row, tokens in shingle_sets(batch.column(batch.schema.get_field_index("text")), width):
                if len(tokens):
                    own[row] = int(as_long(np.array([fingerprint(tokens)]))[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], [*batch.schema.names, fp])

    same_id = docs["doc_id"].cast("long").eqNullSafe(F.col(name))
    plain = out.join(mixed, out["doc_id"].cast("long").eqNullSafe(F.col(name)), "left_anti")
    judged = docs.join(mixed, same_id, "left_semi").mapInArrow(lean(run), StructType([*docs.schema.fields, StructField(fp, LongType())]))
    kept_id, kept_fp = free_name(judged, "_kept_id"), free_name(judged, "_kept_fp")
    stays = by_fp.toDF(kept_id, kept_fp)
    kept = judged.join(stays, judged["doc_id"].cast("long").eqNullSafe(F.col(kept_id)) & (judged[fp] == F.col(kept_fp)), "left_semi")
    with_id = kept.where(F.col("doc_id").isNotNull())
    without = kept.where(F.col("doc_id").isNull()).dropDuplicates([fp])
    blank = judged.where(F.col(fp).isNull())
    return plain.unionByName(with_id.unionByName(without).unionByName(blank).drop(fp))
