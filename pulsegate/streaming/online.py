"""Structured Streaming twins: tumbling epochs, session leases, the online controller.

The controller keeps one state record per entity in the state store, so a stream of any
length holds one small record per live entity.  Where a trigger may bring any number of
reports of an entity, :func:`ordered_decisions` parks them in slices of event time, shard by
shard of entities, and folds a slice when the watermark has passed it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pulsegate import columns as C
from pulsegate.config import CandidateSpec
from pulsegate.functions.scalars import is_finite
from pulsegate.operators.fold import FoldState, SortedFold
from pulsegate.schema import TraceError
from pulsegate.session import checkpoint_dir, ship_package

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_folder(spark: SparkSession) -> str:
    """A fresh folder for one streaming run under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def read_event_stream(
    spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 1, glob: str = "*.parquet"
) -> DataFrame:
    """Parquet files of a folder as they arrive; files per trigger is the admission bound."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("pathGlobFilter", glob).parquet(folder)


def tumbling_epochs(events: DataFrame, width: str, lateness: str, at: str = "at") -> DataFrame:
    """Reports per entity and window, stamped with the right edge; empty windows do not appear.
    :func:`run_to_table` refuses reports behind the watermark."""
    w = F.window(at, width)
    out = events.withWatermark(at, lateness).groupBy(w, C.SUBJECT).agg(F.count(F.lit(1)).alias(C.SAMPLES))
    return out.select(C.SUBJECT, F.unix_seconds("window.end").alias(C.DECISION_TIME), C.SAMPLES)


def session_leases(events: DataFrame, gap: str, lateness: str, at: str = "at") -> DataFrame:
    """Entity sessions closed by silence; :func:`run_to_table` refuses reports behind the watermark."""
    w = F.session_window(at, gap)
    out = events.withWatermark(at, lateness).groupBy(w, C.SUBJECT).agg(F.count(F.lit(1)).alias("n_reports"))
    return out.select(
        C.SUBJECT,
        F.unix_micros("session_window.start").alias("start_us"),
        F.unix_micros("session_window.end").alias("end_us"),
        "n_reports",
    )


def checked_scores(df: DataFrame, score: str = C.SCORE) -> DataFrame:
    """Non-finite scores become NULL: the controller then holds its state."""
    return df.withColumn(score, F.when(is_finite(score), F.col(score)))


DECISION_SCHEMA = T.StructType(
    [
        T.StructField(C.SUBJECT, T.LongType()),
        T.StructField(C.LEASE, T.StringType()),
        T.StructField(C.DECISION_TIME, T.DoubleType()),
        T.StructField(C.CANDIDATE, T.StringType()),
        T.StructField("previous_state", T.IntegerType()),
        T.StructField("state", T.IntegerType()),
        T.StructField("evidence_score", T.DoubleType()),
        T.StructField("lifecycle_start", T.BooleanType()),
    ]
)
_STATE_FIELDS = (
    "state int, since double, evidence double, wanted int, wanted_since double, wanted_reports int, "
    "last_time double, evidence_time double, lease string"
)


class OnlineController(StatefulProcessor):
    """One controller per entity: state survives triggers, a new lease starts afresh,
    time that runs backwards within a lease fails the query."""

    def __init__(self, spec: CandidateSpec):
        self.spec = spec

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.store = handle.getValueState("controller", _STATE_FIELDS)

    def _load(self) -> tuple[FoldState | None, str | None]:
        if not self.store.exists():
            return None, None
        state, since, evidence, wanted, wanted_since, reports, last, evidence_time, lease = self.store.get()
        nan = lambda v: np.nan if v is None else v
        held = FoldState(
            state=np.array([[state]], dtype=np.int8),
            since=np.array([[since]]),
            evidence=np.array([[nan(evidence)]], dtype=float),
            wanted=np.array([[wanted]], dtype=np.int8),
            wanted_since=np.array([[wanted_since]]),
            wanted_reports=np.array([[reports]]),
            last_time=np.array([last]),
            evidence_time=np.array([nan(evidence_time)], dtype=float),
        )
        return held, lease

    def _save(self, s: FoldState, lease: str) -> None:
        blank = lambda v: None if np.isnan(v) else float(v)
        self.store.update(
            (
                int(s.state[0, 0]),
                float(s.since[0, 0]),
                blank(s.evidence[0, 0]),
                int(s.wanted[0, 0]),
                float(s.wanted_since[0, 0]),
                int(s.wanted_reports[0, 0]),
                float(s.last_time[0]),
                blank(s.evidence_time[0]),
                lease,
            )
        )

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held, lease = self._load()
        # A shuffle does not keep arrival order, so the entity's reports of this trigger are
        # put in time order first; admission control (files per trigger) bounds them.
        ordered = pd.concat(list(rows), ignore_index=True).sort_values(C.DECISION_TIME, kind="stable")
        leases, t = ordered[C.LEASE].to_numpy(), ordered[C.DECISION_TIME].to_numpy(dtype=float)
        fresh = np.r_[held is None or leases[0] != lease, leases[1:] != leases[:-1]]
        fold = SortedFold([self.spec.rule()])
        if held is not None:
            fold.resume(held)
        result = fold.run(fresh, t, ordered[C.SCORE].to_numpy(dtype=float))
        frame = pd.DataFrame(
            {
                C.SUBJECT: key[0],
                C.LEASE: leases,
                C.DECISION_TIME: t,
                C.CANDIDATE: self.spec.candidate,
                "previous_state": result.previous[:, 0].astype("int32"),
                "state": result.decision[:, 0].astype("int32"),
                "evidence_score": pd.array(result.evidence[:, 0], dtype="Float64"),
                "lifecycle_start": fresh,
            }
        )
        frame["evidence_score"] = frame["evidence_score"].mask(np.isnan(result.evidence[:, 0]))
        yield frame
        self._save(fold.open_state, leases[-1])

    def close(self) -> None:
        return None


def online_decisions(reports: DataFrame, spec: CandidateSpec) -> DataFrame:
    """Stream of decisions for reports with entity, lease, decision time and score."""
    ship_package(reports.sparkSession)
    needed = checked_scores(reports).select(C.SUBJECT, C.LEASE, C.DECISION_TIME, C.SCORE)
    return needed.groupBy(C.SUBJECT).transformWithStateInPandas(
        statefulProcessor=OnlineController(spec),
        outputStructType=DECISION_SCHEMA,
        outputMode="Append",
        timeMode="None",
    )


# Batches reach the controller as named tuples, which take no leading underscore.
MILLIS, FIRST, LAST, SHARD = "at_ms", "first_s", "last_s", "shard"
_PARKED = [C.SUBJECT, C.DECISION_TIME, C.SCORE, C.LEASE, FIRST, LAST]
# Shards of entities that the ordered controller keeps apart.
SHARDS = 256


class OrderedController(StatefulProcessor):
    """Folds the reports of a shard of entities slice by slice of event time, each when the watermark has passed it.

    Arriving Arrow batches go to the state store at once, under their slice, and a timer is set at the
    slice's end.  All entities of the shard are folded together, so a slice costs a few state calls and as
    many numpy steps as its longest lease, whatever the number of entities.  Memory follows the reports of one
    slice and shard, however many a trigger brings, and the decisions do not depend on how reports are spread
    over triggers.  With ``lease_gap_s``, leases are told by silence between reports instead of being given.
    """

    def __init__(self, spec: CandidateSpec, slice_ms: int, lease_gap_s: float | None = None):
        self.spec, self.slice_ms, self.lease_gap_s = spec, slice_ms, lease_gap_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "slice long", "n int")
        self.parked = handle.getMapState("parked", "slice long, part int", "rows binary")
        self.held = handle.getValueState("held", "entities binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for at, own in batch.groupby(batch[MILLIS].to_numpy() // self.slice_ms):
                held = self.parts.getValue((int(at),))
                part = 0 if held is None else held[0]
                if not part:
                    self.handle.registerTimer(int(at + 1) * self.slice_ms)
                self.parked.updateValue((int(at), part), (_packed(own[_PARKED]),))
                self.parts.updateValue((int(at),), (part + 1,))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs() // self.slice_ms - 1
        pieces = []
        for part in range(self.parts.getValue((at,))[0]):
            pieces.append(_unpacked(self.parked.getValue((at, part))[0]))
            self.parked.removeKey((at, part))
        self.parts.removeKey((at,))
        # Ties in time are settled by content, so that arrival does not show.
        order = [C.SUBJECT, C.DECISION_TIME, C.LEASE, C.SCORE]
        whole = pd.concat(pieces, ignore_index=True).sort_values(order, kind="stable", ignore_index=True)
        yield self._fold(whole)

    def _fold(self, whole: pd.DataFrame) -> pd.DataFrame:
        subject = whole[C.SUBJECT].to_numpy(dtype=np.int64)
        starts = np.flatnonzero(np.r_[True, subject[1:] != subject[:-1]])
        ends = np.r_[starts[1:], len(subject)] - 1
        own = subject[starts]
        stored = _unpacked(self.held.get()[0]) if self.held.exists() else None
        known, before = np.zeros(len(own), dtype=bool), None
        if stored is not None:
            names = stored[C.SUBJECT].to_numpy()
            at = np.minimum(np.searchsorted(names, own), len(names) - 1)
            known, before = names[at] == own, stored.iloc[at]
        numbers = np.zeros(len(own), dtype=np.int64)
        if self.lease_gap_s is not None:
            if before is not None:
                numbers = np.where(known, before["number"], 0)
            last = np.r_[np.nan, whole[LAST].to_numpy(dtype=float)[:-1]]
            last[starts] = np.nan if before is None else np.where(known, before["ended_s"], np.nan)
            opened = np.cumsum(whole[FIRST].to_numpy(dtype=float) - last > self.lease_gap_s)
            base = numbers - np.r_[0, opened[ends[:-1]]]
            numbered = opened + np.repeat(base, ends - starts + 1)
            whole[C.LEASE] = [f"{s}:{n}" for s, n in zip(subject.tolist(), numbered.tolist())]
            numbers = numbered[ends]
        leases = whole[C.LEASE].to_numpy(dtype=object)
        fresh = np.r_[True, leases[1:] != leases[:-1]]
        fresh[starts] = True
        fold, t = SortedFold([self.spec.rule()]), whole[C.DECISION_TIME].to_numpy(dtype=float)
        goes_on = known.copy()
        if before is not None:
            goes_on &= before[C.LEASE].to_numpy(dtype=object) == leases[starts]
            fresh[starts] = ~goes_on
        held = (starts[goes_on], _states(before.iloc[np.flatnonzero(goes_on)])) if goes_on.any() else None
        result = fold.run(fresh, t, whole[C.SCORE].to_numpy(dtype=float), held)

        opens = fresh.copy()
        opens[starts] = True
        final = fold.ended.take(np.cumsum(opens)[ends] - 1)
        ended_s = whole[LAST].to_numpy(dtype=float)[ends]
        kept = pd.DataFrame({C.SUBJECT: own, C.LEASE: leases[ends], "number": numbers, "ended_s": ended_s, **_flat(final)})
        if stored is not None:
            kept = pd.concat([stored[~np.isin(stored[C.SUBJECT].to_numpy(), own)], kept], ignore_index=True)
        self.held.update((_packed(kept.sort_values(C.SUBJECT, ignore_index=True)),))

        evidence = result.evidence[:, 0]
        return pd.DataFrame(
            {
                C.SUBJECT: subject,
                C.LEASE: leases,
                C.DECISION_TIME: t,
                C.CANDIDATE: self.spec.candidate,
                "previous_state": result.previous[:, 0].astype("int32"),
                "state": result.decision[:, 0].astype("int32"),
                "evidence_score": pd.array(evidence, dtype="Float64"),
                "lifecycle_start": fresh,
            }
        ).assign(evidence_score=lambda f: f["evidence_score"].mask(np.isnan(evidence)))

    def close(self) -> None:
        return None


def _packed(rows: pd.DataFrame) -> bytes:
    """Rows as one Arrow stream, which the state store keeps as bytes."""
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(pa.py_buffer(bytes(data))).read_all().to_pandas()


def _flat(s: FoldState) -> dict[str, np.ndarray]:
    """Columns of the state of one candidate."""
    return {f"s_{name}": v[:, 0] if v.ndim == 2 else v for name, v in s.__dict__.items()}


def _states(rows: pd.DataFrame) -> FoldState:
    column = lambda name, kind: rows[f"s_{name}"].to_numpy(dtype=kind)
    matrix = lambda name, kind: column(name, kind)[:, None]
    return FoldState(
        state=matrix("state", np.int8),
        since=matrix("since", float),
        evidence=matrix("evidence", float),
        wanted=matrix("wanted", np.int8),
        wanted_since=matrix("wanted_since", float),
        wanted_reports=matrix("wanted_reports", np.int64),
        last_time=column("last_time", float),
        evidence_time=column("evidence_time", float),
    )


def _watched(reports: DataFrame, at: str, lateness: str) -> DataFrame:
    """Scored reports under a watermark; rows without an entity only move it, as the closing marker does.

    The condition names the event time, so it is not pushed below the watermark.
    """
    known = F.col(C.SUBJECT).isNotNull() | F.col(at).isNull()
    return checked_scores(reports).withWatermark(at, lateness).where(known)


def _ordered(rows: DataFrame, spec: CandidateSpec, slice_seconds: float, lease_gap_s: float | None, shards: int) -> DataFrame:
    ship_package(rows.sparkSession)
    shard = F.pmod(F.xxhash64(C.SUBJECT), F.lit(shards)).cast("int")
    return rows.withColumn(SHARD, shard).groupBy(SHARD).transformWithStateInPandas(
        statefulProcessor=OrderedController(spec, int(slice_seconds * 1000), lease_gap_s),
        outputStructType=DECISION_SCHEMA,
        outputMode="Append",
        timeMode="EventTime",
    )


def ordered_decisions(
    reports: DataFrame, spec: CandidateSpec, slice_seconds: float, lateness: str, at: str = "at", shards: int = SHARDS
) -> DataFrame:
    """Decisions for reports with entity, lease, decision time, score and event time ``at``, which may come
    in any order within ``lateness`` and in triggers of any size.  More ``shards`` make the part of a slice
    smaller that a task holds at once.

    Undecided reports wait until the watermark passes their slice: run it with :func:`run_closed`.
    """
    nothing = F.lit(None).cast("double")
    named = (C.SUBJECT, C.LEASE, C.DECISION_TIME, C.SCORE, at)
    rows = _watched(reports, at, lateness).select(*named, F.unix_millis(at).alias(MILLIS))
    return _ordered(rows.withColumns({FIRST: nothing, LAST: nothing}), spec, slice_seconds, None, shards)


def chained_decisions(
    reports: DataFrame,
    spec: CandidateSpec,
    width: str,
    lease_gap_s: float,
    slice_seconds: float,
    lateness: str,
    at: str = "at",
    shards: int = SHARDS,
) -> DataFrame:
    """Reports (entity, score, ``at``) to epochs, leases and decisions under one watermark.

    Epochs are windows closed by the watermark and carry their last score; they flow into the controller of
    their entity, which opens a lease after more than ``lease_gap_s`` without a report.  A lease is named
    ``entity:number``.
    """
    score = F.max_by(C.SCORE, F.struct(at, C.SCORE)).alias(C.SCORE)
    seconds = lambda c: F.unix_micros(c) / F.lit(1e6)
    ends = [F.min(at).alias("__first"), F.max(at).alias("__last")]
    epochs = _watched(reports, at, lateness).groupBy(F.window(at, width), C.SUBJECT).agg(score, *ends)
    rows = epochs.select(
        C.SUBJECT,
        F.lit(None).cast("string").alias(C.LEASE),
        seconds("window.end").alias(C.DECISION_TIME),
        C.SCORE,
        F.window_time("window").alias(at),
        seconds("__first").alias(FIRST),
        seconds("__last").alias(LAST),
    )
    return _ordered(rows.withColumn(MILLIS, F.unix_millis(at)), spec, slice_seconds, lease_gap_s, shards)


def run_to_table(stream: DataFrame, folder: str, mode: str = "append", **options: str) -> DataFrame:
    """Consume everything available, write Parquet exactly once, return the table.

    Reports behind the watermark would be left out of the table: they fail the run.
    """
    spark = stream.sparkSession
    writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/state")
    for key, value in options.items():
        writer = writer.option(key, value)
    run = writer.trigger(availableNow=True).start(f"{folder}/table")
    ended = False
    while not ended:
        # Progress is kept for the last hundred batches, far more than a second holds.
        ended = run.awaitTermination(1)
        late = sum(op["numRowsDroppedByWatermark"] for p in run.recentProgress for op in p["stateOperators"])
        if late:
            run.stop()
            raise TraceError(f"{late} late groups of reports behind the watermark")
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")


# After any event; a watermark that reaches it has closed every window.
END_OF_TIME = "9000-01-01"


def run_closed(events: DataFrame, build: Callable[[DataFrame], DataFrame], folder: str, at: str = "at") -> DataFrame:
    """Run ``build(events)`` over a stream that ends: windows still open at its end are closed too.

    Once everything available is consumed, one marker row beyond all event times moves the watermark
    past every window.  Its own window never closes, so the marker never shows.  The stream is then
    over: later reports are late.
    """
    spark, marks = events.sparkSession, f"{folder}/marks"
    spark.createDataFrame([], events.schema).write.parquet(marks)
    stream = build(events.unionByName(spark.readStream.schema(events.schema).parquet(marks)))
    run_to_table(stream, folder)
    cells = [F.lit(END_OF_TIME if f.name == at else None).cast(f.dataType).alias(f.name) for f in events.schema]
    spark.range(1).select(*cells).write.mode("append").parquet(marks)
    return run_to_table(stream, folder)
