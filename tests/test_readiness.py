"""Waits of whole sessions: as a table, as a stream, and against a loop over frames."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from veriframe.streaming import readiness

WANTED = {"menu": ("x", "width"), "list": ("y",)}
START = datetime.datetime(2024, 1, 1)


def plain(frames, timeout_ms, stable):
    """The loop of one wait: frames are (number, ms, {target: (count, x, y, width, height)})."""
    held, first = {t: (None, 0) for t in WANTED}, frames[0][1]
    for n, ms, seen in frames:
        for t, fields in WANTED.items():
            count, *box = seen.get(t, (0,) + (None,) * 4)
            named = dict(zip(("x", "y", "width", "height"), box, strict=True))
            sig = tuple(named[f] for f in fields) if count == 1 else None
            held[t] = (sig, held[t][1] + 1 if sig is not None and sig == held[t][0] else 0)
        if all(s is not None and h >= stable for s, h in held.values()):
            return "ready", n, None, None
        if ms - first >= timeout_ms:
            break
    return "timed-out", n, sorted(t for t, (s, _) in held.items() if s is None), sorted(t for t, (s, h) in held.items() if s is not None and h < stable)


def made(seed=1, n=60):
    rng = random.Random(seed)
    out = {}
    for k in range(n):
        ms, frames = rng.randrange(2000), []
        for i in range(rng.randrange(1, 14)):
            seen = {t: (rng.choice([1, 1, 1, 1, 0, 2]), rng.choice([5.0, 5.0, 6.0]), 3.0, 4.0, rng.random()) for t in (*WANTED, "other") if rng.random() < 0.9}
            frames.append((i, ms, seen))
            ms += rng.choice([16, 30, 100])
        out[k] = frames
    out[n] = [(i, 16 * i, {"menu": (1, float(i), 0.0, 1.0, 1.0)}) for i in range(3)]  # stops without ever standing still
    return out


def frame_rows(spark, table):
    rows = [(k, n, START + datetime.timedelta(milliseconds=ms), [(t, *v) for t, v in seen.items()]) for k, frames in table.items() for n, ms, seen in frames]
    return spark.createDataFrame(rows, readiness.SESSION_FRAMES)


def outcomes(rows):
    return {r.session_id: (r.outcome, r.frame_no, r.unresolved, r.unstable) for r in rows}


@pytest.mark.parametrize("timeout_ms", [1, 90, 250, 10_000])
def test_sessions_are_those_of_the_loop(spark, timeout_ms):
    table = made()
    rows = readiness.sessions(frame_rows(spark, table).repartition(4), WANTED, timeout_ms).collect()
    assert len(rows) == len(table)
    assert outcomes(rows) == {k: plain(f, timeout_ms, 2) for k, f in table.items()}
    gave_up = next(r for r in rows if r.session_id == max(table))
    assert gave_up.unresolved == ["list"] and gave_up.unstable == ["menu"]
    if timeout_ms > 90:
        assert [(o.target, o.match_count, o.x) for o in gave_up.last_observed] == [("list", 0, None), ("menu", 1, 2.0)]


def test_rows_of_frames(spark):
    at = START
    rows = [(1, 0, "menu", 1, 1.0, 0.0, 2.0, 0.0, at), (1, 0, "list", 1, 1.0, 0.0, 2.0, 0.0, at), (None, 0, "menu", 1, 1.0, 0.0, 2.0, 0.0, at), (2, 0, None, None, None, None, None, None, at), (3, 0, "menu", 1, 1.0, 0.0, 2.0, 0.0, None)]
    frames = readiness.as_session_frames(spark.createDataFrame(rows, readiness.FRAMES + ", at timestamp"))
    got = outcomes(readiness.sessions(frames, WANTED, 100, stable_frames=0).collect())
    assert got == {1: ("ready", 0, None, None), 2: ("timed-out", 0, ["list", "menu"], [])}
    assert readiness.sessions(frames.limit(0), WANTED, 100).count() == 0


def test_stream_with_timers_and_a_restart(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        table = made(seed=5, n=25)
        table[26] = [(0, 60_000, {})]  # only its time moves the watermark past every other deadline
        df = frame_rows(spark, table).withColumn("step", F.expr("unix_millis(at) div 200")).coalesce(1).cache()
        steps = sorted(r.step for r in df.select("step").distinct().collect())

        def arrive(*which):
            for k in which:
                df.where(F.col("step") == k).drop("step").write.mode("append").parquet(str(tmp_path / "in"))

        def run():
            stream = spark.readStream.schema(df.drop("step").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            q = readiness.sessions_stream(stream, WANTED, 250).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
            q.awaitTermination(300)

        arrive(*steps[:8])
        run()
        early = {r.session_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        arrive(*steps[8:])
        run()
        rows = [r for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.session_id != 26]
    finally:
        spark.conf.set(key, before)
    want = {k: plain(f, 250, 2) for k, f in table.items() if k != 26}
    assert len(rows) == len(want) and outcomes(rows) == want
    assert early and early < set(want)
