"""When targets of a layout, and whole sessions, have stood still.

Frames are rows (session_id, frame_no, target, match_count, x, y, width, height).  A target's signature in a frame is the
part of its rectangle that the rules need; it is null unless exactly one element matches.  A target is ready at the first
frame that ends a run of more than ``stable_frames`` frames with one signature: the run's first frame counts as 0, an
equal one adds 1, a changed or null one starts anew.  ``ready`` works over a table; ``ready_stream`` keeps the same state
over a stream.

A session is one wait for all targets at once: it is ready at its first frame in which every wanted target has held its
signature for ``stable_frames`` frames.  A frame in which a target isn't observed counts as one without a match.  The
first frame ``timeout_ms`` or more after the session's first one is its last: it may still make the session ready, as in
a loop that measures, then looks at the clock.  A session that isn't ready by then, or has no more frames, timed out: one
row names its unresolved targets (no signature in the last frame) and its unstable ones (held too short), with what was
observed last.  ``sessions`` works over a table, ``sessions_stream`` over a stream with event-time timers.  Frames have
numbers that are unique within a session and rise with time; null sessions, numbers and times are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.layout import Rule

#: What each kind of rule needs of a rectangle; all of it if not named.
NEEDS = {"width": ("width",), "height": ("height",), "sameWidth": ("width",), "sameHeight": ("height",), "sameSize": ("width", "height"), "leftOf": ("x", "width"), "rightOf": ("x", "width"), "above": ("y", "height"), "below": ("y", "height")}
BOX = ("x", "y", "width", "height")
FRAMES = "session_id long, frame_no long, target string, match_count int, x double, y double, width double, height double"
READY = "session_id long, target string, ready_frame long"
_SEEN = "struct<target: string, match_count: int, x: double, y: double, width: double, height: double>"
#: Frames of sessions: one row a frame, so that a frame is never seen in part.
SESSION_FRAMES = f"session_id long, frame_no long, at timestamp, targets array<{_SEEN}>"
OUTCOMES = f"session_id long, outcome string, frame_no long, at timestamp, unresolved array<string>, unstable array<string>, last_observed array<{_SEEN}>"


def needs(rules: Iterable[Rule]) -> dict[str, tuple[str, ...]]:
    """target -> the fields of its rectangle that some rule needs."""
    out: dict[str, set[str]] = {}
    for r in rules:
        fields = NEEDS.get(r.kind) or ({"left": ("x",), "right": ("x", "width"), "top": ("y",), "bottom": ("y", "height"), "centerX": ("x", "width"), "centerY": ("y", "height")}[r.alignment] if r.kind == "align" else BOX)
        for target in (r.subject, r.reference):
            if target:
                out.setdefault(target, set()).update(fields)
    return {t: tuple(f for f in BOX if f in fields) for t, fields in out.items()}


def signature(wanted: Mapping[str, Iterable[str]]) -> Column:
    value = F.lit(None).cast("string")
    for target, fields in wanted.items():
        value = F.when(F.col("target") == target, F.concat_ws(",", *[F.col(f).cast("string") for f in fields])).otherwise(value)
    return F.when(F.col("match_count") == 1, value)


def ready(frames: DataFrame, wanted: Mapping[str, Iterable[str]], stable_frames: int = 2) -> DataFrame:
    """session_id, target, ready_frame (null if it never stood still) of every wanted target seen."""
    by = Window.partitionBy("session_id", "target").orderBy("frame_no")
    rows = frames.where(F.col("target").isin(*wanted)).withColumn("sig", signature(wanted))
    rows = rows.withColumn("new", (~F.col("sig").eqNullSafe(F.lag("sig").over(by))).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(by))
    rows = rows.withColumn("held", F.row_number().over(Window.partitionBy("session_id", "target", "run").orderBy("frame_no")) - 1)
    still = F.col("sig").isNotNull() & (F.col("held") >= stable_frames)
    return rows.groupBy("session_id", "target").agg(F.min(F.when(still, F.col("frame_no"))).alias("ready_frame"))


def ready_stream(frames: DataFrame, wanted: Mapping[str, Iterable[str]], stable_frames: int = 2) -> DataFrame:
    """READY once for each target as it becomes ready; frames of a session come in order.  State is one signature and a
    count for each session and target."""
    rows = frames.where(F.col("target").isin(*wanted)).withColumn("sig", signature(wanted))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        sig, held, done = state.get if state.exists else (None, 0, False)
        found = []
        for pdf in batches:
            for frame, now in sorted(zip(pdf["frame_no"], pdf["sig"], strict=True)):
                now = None if pd.isna(now) else now
                held = held + 1 if now is not None and now == sig else 0
                sig = now
                if now is not None and held >= stable_frames and not done:
                    done = True
                    found.append((key[0], key[1], frame))
        state.update((sig, held, done))
        yield pd.DataFrame(found, columns=["session_id", "target", "ready_frame"])

    return rows.groupBy("session_id", "target").applyInPandasWithState(step, READY, "sig string, held int, done boolean", "append", "NoTimeout")


def unready(result: DataFrame) -> DataFrame:
    """Targets that never became ready, by session."""
    return result.where("ready_frame is null").groupBy("session_id").agg(F.array_sort(F.collect_list("target")).alias("targets"))


def as_session_frames(frames: DataFrame) -> DataFrame:
    """SESSION_FRAMES of rows like FRAMES with a time ``at``; a frame's time is that of its first row."""
    seen = F.struct("target", "match_count", "x", "y", "width", "height")
    return frames.groupBy("session_id", "frame_no").agg(F.min("at").alias("at"), F.collect_list(seen).alias("targets"))


def _observed(wanted: Mapping[str, Iterable[str]]) -> Column:
    """The wanted targets of a frame in order of name, with signature; those that aren't there have no match."""
    def of(target: str) -> Column:
        own = F.try_element_at(F.filter("targets", lambda t: t["target"] == target), F.lit(1))
        count = F.coalesce(own["match_count"], F.lit(0))
        box = [F.when(count == 1, own[c]).alias(c) for c in BOX]
        sig = F.when(count == 1, F.concat_ws(",", *[own[c].cast("string") for c in wanted[target]]))
        return F.struct(F.lit(target).alias("target"), count.alias("match_count"), *box, sig.alias("sig"))

    return F.array(*[of(t) for t in sorted(wanted)])


def _positive(timeout_ms: int) -> None:
    if timeout_ms <= 0:
        raise ValueError("timeout_ms must be positive")


def _known(frames: DataFrame, wanted: Mapping[str, Iterable[str]]) -> DataFrame:
    return frames.where("session_id is not null and frame_no is not null and at is not null").select("session_id", "frame_no", F.col("at").cast("timestamp").alias("at"), _observed(wanted).alias("seen"))


def sessions(frames: DataFrame, wanted: Mapping[str, Iterable[str]], timeout_ms: int, stable_frames: int = 2) -> DataFrame:
    """OUTCOMES of every session of SESSION_FRAMES, by gaps and islands; the lists are null for ready ones."""
    _positive(timeout_ms)
    by_session = Window.partitionBy("session_id")
    in_order = by_session.orderBy("frame_no")
    late = F.unix_millis("at") - F.unix_millis(F.min("at").over(by_session)) >= timeout_ms
    rows = _known(frames, wanted).withColumn("late", late.cast("int")).withColumn("so_far", F.sum("late").over(in_order))
    # frames after the first late one don't count
    rows = rows.where(F.col("so_far") == F.col("late")).select("session_id", "frame_no", "at", "seen", F.explode("seen").alias("s"))
    by_target = Window.partitionBy("session_id", "s.target").orderBy("frame_no")
    rows = rows.withColumn("new", (F.col("s.sig").isNull() | ~F.col("s.sig").eqNullSafe(F.lag("s.sig").over(by_target))).cast("int"))
    rows = rows.withColumn("island", F.sum("new").over(by_target))
    rows = rows.withColumn("held", F.row_number().over(Window.partitionBy("session_id", "s.target", "island").orderBy("frame_no")) - 1)
    state = F.when(F.col("s.sig").isNull(), "unresolved").when(F.col("held") < stable_frames, "unstable")
    names = lambda kind: F.array_sort(F.collect_list(F.when(F.col("state") == kind, F.col("s.target"))))
    whole = rows.withColumn("state", state).groupBy("session_id", "frame_no", "at").agg(names("unresolved").alias("unresolved"), names("unstable").alias("unstable"), F.first("seen").alias("seen"))
    is_ready = (F.size("unresolved") == 0) & (F.size("unstable") == 0)
    picked = F.struct((~is_ready).alias("open"), F.when(is_ready, F.col("frame_no")).otherwise(-F.col("frame_no")).alias("rank"), "frame_no", "at", "unresolved", "unstable", "seen")
    # the first ready frame, else the last one
    one = whole.withColumn("picked", picked).groupBy("session_id").agg(F.min_by("picked", F.struct("picked.open", "picked.rank")).alias("p"))
    gave_up = F.col("p.open")
    last = F.transform("p.seen", lambda t: F.struct(*[t[c].alias(c) for c in ("target", "match_count", *BOX)]))
    return one.select(
        F.col("session_id").cast("long").alias("session_id"), F.when(gave_up, "timed-out").otherwise("ready").alias("outcome"), F.col("p.frame_no").cast("long").alias("frame_no"), F.col("p.at").alias("at"),
        *[F.when(gave_up, F.col(f"p.{k}")).alias(k) for k in ("unresolved", "unstable")], F.when(gave_up, last).alias("last_observed"),
    )


class _Wait(StatefulProcessor):
    """One session: a value (its deadline, last frame and whether it is decided) and a list of targets' states."""

    def __init__(self, timeout_ms: int, stable_frames: int):
        self.timeout_ms, self.stable_frames = timeout_ms, stable_frames

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "deadline long, done boolean, frame_no long, at timestamp")
        self.targets = handle.getListState("targets", "target string, match_count int, x double, y double, width double, height double, sig string, held int")

    def _row(self, key: int, outcome: str, frame_no: int, at: Any, targets: list) -> Row:
        if outcome == "ready":
            return Row(session_id=key, outcome=outcome, frame_no=frame_no, at=at, unresolved=None, unstable=None, last_observed=None)
        return Row(
            session_id=key, outcome=outcome, frame_no=frame_no, at=at, unresolved=[t[0] for t in targets if t[6] is None],
            unstable=[t[0] for t in targets if t[6] is not None and t[7] < self.stable_frames], last_observed=[Row(**dict(zip(("target", "match_count", *BOX), t, strict=False))) for t in targets],
        )

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        state = self.session.get() if self.session.exists() else None
        targets = [tuple(t) for t in self.targets.get()] if self.targets.exists() else []
        deadline, done = (state[0], state[1]) if state else (None, False)
        if done:
            return
        for row in sorted(rows, key=lambda r: r["frame_no"]):
            now = row["at_ms"]
            if deadline is None:
                deadline = now + self.timeout_ms
                self.handle.registerTimer(deadline)
            held = {t[0]: (t[6], t[7]) for t in targets}
            targets = []
            for s in row["seen"]:
                before = held.get(s["target"], (None, 0))
                same = s["sig"] is not None and s["sig"] == before[0]
                targets.append((s["target"], s["match_count"], *(s[c] for c in BOX), s["sig"], before[1] + 1 if same else 0))
            frame_no, at = row["frame_no"], row["at"]
            is_ready = all(t[6] is not None and t[7] >= self.stable_frames for t in targets)
            if is_ready or now >= deadline:
                yield self._row(key[0], "ready" if is_ready else "timed-out", frame_no, at, targets)
                self.handle.deleteTimer(deadline)
                self.targets.clear()
                self.session.update((deadline, True, frame_no, at))
                return
        self.targets.put(targets)
        self.session.update((deadline, False, frame_no, at))

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        deadline, done, frame_no, at = self.session.get()
        if not done:
            yield self._row(key[0], "timed-out", frame_no, at, [tuple(t) for t in self.targets.get()])
            self.targets.clear()
            self.session.update((deadline, True, frame_no, at))

    def close(self) -> None:
        pass


def sessions_stream(frames: DataFrame, wanted: Mapping[str, Iterable[str]], timeout_ms: int, stable_frames: int = 2, delay: str = "1 second") -> DataFrame:
    """OUTCOMES once for each session of a stream of SESSION_FRAMES: as it gets ready, or as its time is up, for which no
    further frame of it need come: a timer goes off when the watermark (``delay`` behind the newest time) has passed its
    deadline.  State is a value and a list of the wanted targets for each session; of decided ones only that they are.
    Needs the state store provider RocksDB.  Frames of a session come in order."""
    _positive(timeout_ms)
    rows = _known(frames, wanted).withColumn("at_ms", F.unix_millis("at")).withWatermark("at", delay)
    return rows.groupBy("session_id").transformWithState(_Wait(timeout_ms, stable_frames), OUTCOMES, "append", "eventTime")
