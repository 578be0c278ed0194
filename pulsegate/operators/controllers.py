"""Replay of score-to-action controllers over epochs.

Every replay partitions by ``(block, entity, lease)``.  A lease lies in one trace block,
so it holds at most ``max_block_seconds / epoch_seconds + 1`` epochs however many reports
the entity sent; :func:`oversized_leases` checks that bound on tables from elsewhere.
Epochs that come out of the lease pass are already hashed by ``(block, entity)``, which
satisfies these keys: a replay adds no exchange.  Candidates are columns of an array, so
the epochs are sorted once for all candidates and only the narrow result is exploded.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pulsegate import columns as C
from pulsegate.config import CandidateSpec, ControllerRule, SpecLock, TraceRule
from pulsegate.functions.scalars import bin_index, is_finite
from pulsegate.operators.fold import SortedFold
from pulsegate.session import ship_package

STEPS = "__steps"
TICK = "__tick"
LEASE_KEYS = (C.BLOCK, C.SUBJECT, C.LEASE)
ORDER = (C.DECISION_TIME, C.EVALUATION_ROW)


def lease_window(order: Sequence[str], keys: Sequence[str] = LEASE_KEYS):
    return Window.partitionBy(*keys).orderBy(*order)


def evaluation_order(df: DataFrame) -> list[str]:
    """Order columns of a replay: decision time, then the row id when there is one."""
    return [c for c in ORDER if c in df.columns]


def oversized_leases(df: DataFrame, rule: TraceRule, keys: Sequence[str] = LEASE_KEYS) -> DataFrame:
    """Leases with more epochs than one block can hold (empty for prepared tables).

    A rule without ``max_block_seconds`` bounds nothing and is refused.
    """
    bound = rule.lease_epoch_bound
    if bound is None:
        raise ValueError("leases are unbounded: set max_block_seconds")
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("epochs"))
    return counts.where(F.col("epochs") > bound)


def _stateless_goal(score: Column, rule: ControllerRule) -> Column:
    return F.when(score >= rule.isolate_enter, 2).when(score >= rule.restrict_enter, 1).otherwise(0)


def stateless_states(score: str, rules: Sequence[ControllerRule], window) -> Column:
    """Decisions of memoryless controllers; a non-finite score keeps the last decision."""
    decided = [F.when(is_finite(score), _stateless_goal(F.col(score), r)) for r in rules]
    held = [F.last(d, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0)) for d in decided]
    return F.array(*[F.coalesce(h, F.lit(r.initial_state)).cast("int") for h, r in zip(held, rules)])


def _zeros(n: int) -> Column:
    return F.array(*[F.lit(0)] * n)


def _arrays_stateless(df: DataFrame, rules: Sequence[ControllerRule], score: str, order: Sequence[str]) -> DataFrame:
    w = lease_window(order)
    states = df.withColumn("decision", stateless_states(score, rules, w))
    initial = F.array(*[F.lit(r.initial_state) for r in rules])
    acted = F.coalesce(F.lag("decision").over(w), _zeros(len(rules)))
    states = states.withColumns({"previous": F.coalesce(F.lag("decision").over(w), initial), "effective": acted})
    shown = F.when(is_finite(score), F.col(score))
    return states.withColumns(
        {
            "previous_effective": F.coalesce(F.lag("effective").over(w), _zeros(len(rules))),
            "evidence": F.array(*[shown] * len(rules)),
            "lifecycle_start": F.row_number().over(w) == 1,
        }
    )


def _list_column(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Matrix rows as Arrow lists; NaN becomes NULL."""
    rows, width = values.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(values.ravel(), type=kind, from_pandas=True))


def fold_batches(
    batches: Iterator[pa.RecordBatch],
    rules: Sequence[ControllerRule],
    time: str,
    score: str,
    evidence: bool = True,
):
    """Yield ``(batch, FoldResult)`` for a partition sorted by lease and time."""
    fold = SortedFold(rules, evidence)
    for batch in batches:
        if batch.num_rows:
            column = {n: batch.column(batch.schema.get_field_index(n)) for n in (TICK, time, score)}
            first = column[TICK].to_numpy(zero_copy_only=False) == 1
            t, x = (column[n].to_numpy(zero_copy_only=False).astype(float) for n in (time, score))
            yield batch, fold.run(first, t, x)


def fold_slices(
    batches: Iterator[pa.RecordBatch], rules: Sequence[ControllerRule], time: str, score: str, width: int = 128
):
    """Yield ``(batch, results)``: one ``(first candidate, FoldResult)`` per slice of ``width`` rules.

    Slices bound the matrices of a large grid; ``results`` is lazy, so one slice is held at a time.
    """
    starts = range(0, len(rules), width)
    folds = [(at, SortedFold(rules[at : at + width], False)) for at in starts]
    for batch in batches:
        if batch.num_rows:
            column = {n: batch.column(batch.schema.get_field_index(n)) for n in (TICK, time, score)}
            first = column[TICK].to_numpy(zero_copy_only=False) == 1
            t, x = (column[n].to_numpy(zero_copy_only=False).astype(float) for n in (time, score))
            yield batch, ((at, fold.run(first, t, x)) for at, fold in folds)


def in_lease_order(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Number the epochs of each lease; the window's exchange and sort also place the rows.

    A map over partitions that follows directly sees whole leases, one after another and
    in time order.  The fold checks this and fails on a partition that breaks it.
    """
    return df.withColumn(TICK, F.row_number().over(lease_window(order)))


def _arrays_folded(df: DataFrame, rules: Sequence[ControllerRule], score: str, order: Sequence[str]) -> DataFrame:
    ship_package(df.sparkSession)
    time = order[0]
    ints, doubles = T.ArrayType(T.IntegerType()), T.ArrayType(T.DoubleType())
    names = ("decision", "previous", "effective", "previous_effective")
    placed = in_lease_order(df, order)
    added = [T.StructField(n, ints) for n in names] + [T.StructField("evidence", doubles)]
    schema = T.StructType(placed.schema.fields + added)
    rules = list(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, result in fold_batches(batches, rules, time, score):
            lists = [_list_column(getattr(result, n), pa.int32()) for n in names]
            lists.append(_list_column(result.evidence, pa.float64()))
            fields = [*batch.schema.names, *names, "evidence"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=fields)

    return placed.mapInArrow(run, schema).withColumn("lifecycle_start", F.col(TICK) == 1).drop(TICK)


def replay_arrays(
    df: DataFrame,
    specs: Sequence[CandidateSpec],
    score: str = C.SCORE,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Add one array per trace column, aligned with ``specs``.

    ``decision``/``previous`` are controller states, ``effective``/``previous_effective``
    the actions in force one epoch later (a lease starts in ALLOW).  Memoryless
    controllers stay in window functions; the others fold sorted Arrow batches.
    """
    order = list(order or evaluation_order(df))
    rules = [s.rule() for s in specs]
    if all(r.memoryless for r in rules):
        return _arrays_stateless(df, rules, score, order)
    return _arrays_folded(df, rules, score, order)


def explode_candidates(df: DataFrame, specs: Sequence[CandidateSpec], digest: str | None = None) -> DataFrame:
    """Long action table: one row per epoch and candidate."""
    arrays = ("decision", "previous", "effective", "previous_effective", "evidence")
    keep = [c for c in df.columns if c not in arrays]
    long = df.select(*keep, F.posexplode(F.arrays_zip(*arrays)).alias("__at", STEPS))
    # The grid is a parameter table (one row per candidate), joined by array position.
    names = [(i, s.candidate, s.family, s.controller) for i, s in enumerate(specs)]
    kinds = f"__at int, {C.CANDIDATE} string, {C.FAMILY} string, controller_kind string"
    long = long.join(F.broadcast(df.sparkSession.createDataFrame(names, kinds)), "__at")
    step = F.col(STEPS)
    out = {
        "evidence_score": step["evidence"],
        "previous_state": step["previous"],
        "decision_state": step["decision"],
        "decision_transitioned": step["decision"] != step["previous"],
        "effective_previous_state": step["previous_effective"],
        "effective_state": step["effective"],
        "effective_transitioned": step["effective"] != step["previous_effective"],
        "effective_severity_delta": F.abs(step["effective"] - step["previous_effective"]),
    }
    if digest:
        out["candidate_lock_sha256"] = F.lit(digest)
    return long.withColumns(out).drop(STEPS, "__at")


def action_trace(
    df: DataFrame,
    specs: Sequence[CandidateSpec] | SpecLock,
    score: str = C.SCORE,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Replay candidates over epochs; extra input columns ride along."""
    lock = specs if isinstance(specs, SpecLock) else None
    chosen = lock.specs if lock else specs
    return explode_candidates(replay_arrays(df, chosen, score, order), chosen, lock.sha256 if lock else None)


def replay_inputs(df: DataFrame) -> DataFrame:
    """The columns a controller may see: no label, split or entity context leaks in."""
    wanted = (C.EVALUATION_ROW, C.BLOCK, C.DECISION_TIME, C.SUBJECT, C.LEASE, C.DURATION, C.SCORE)
    return df.select(*[c for c in wanted if c in df.columns])


# -- window-only forms of single stateful controllers ---------------------------------

# Time constants per running sum: exp of twice this is still finite.
_SEGMENT = 300.0


def ewma_evidence(df: DataFrame, tau_s: float, score: str, order: Sequence[str], name: str = "evidence") -> DataFrame:
    """Irregular-time EWMA as running sums.

    The product of ``1 - alpha`` telescopes to ``exp(-elapsed / tau)``, so the evidence is
    ``exp(-t/tau) * sum(alpha_i * x_i * exp(t_i/tau))``.  Sums restart every ``_SEGMENT`` tau, which
    keeps the exponentials finite over leases of any length; the segment before adds its whole sum,
    older ones weigh less than ``exp(-_SEGMENT)``, far below a rounding error.
    """
    w = lease_window(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    time = order[0]
    seen = F.when(is_finite(score), F.col(time))
    marked = df.withColumns(
        {
            "__t0": F.first(seen, ignorenulls=True).over(upto),
            "__tp": F.last(seen, ignorenulls=True).over(before),
        }
    )
    age = (F.col(time) - F.col("__t0")) / F.lit(float(tau_s))
    alpha = F.when(F.col("__tp").isNull(), 1.0).otherwise(-F.expm1(-(F.col(time) - F.col("__tp")) / F.lit(float(tau_s))))
    cut = marked.withColumn("__segment", F.floor(age / _SEGMENT)).withColumn("__age", age - F.col("__segment") * F.lit(_SEGMENT))
    term = F.when(is_finite(score), alpha * F.col(score) * F.exp("__age"))
    own = lease_window(order, (*LEASE_KEYS, "__segment")).rowsBetween(Window.unboundedPreceding, 0)
    last = lease_window(["__segment"]).rangeBetween(-1, -1)
    sums = cut.withColumn("__term", term).withColumns({"__own": F.sum("__term").over(own), "__last": F.sum("__term").over(last)})
    total = F.col("__own") + F.exp(F.lit(-_SEGMENT)) * F.coalesce("__last", F.lit(0.0))
    out = sums.withColumn(name, F.when(is_finite(score), F.exp(-F.col("__age")) * total))
    return out.drop("__t0", "__tp", "__segment", "__age", "__term", "__own", "__last")


def hysteresis_states(
    df: DataFrame, enter: float, leave: float, score: str, order: Sequence[str], name: str = "decision_state"
) -> DataFrame:
    """Schmitt trigger with equal RESTRICT and ISOLATE centres.

    Entering goes straight to ISOLATE and each later low report steps down once, so the
    state is ``max(0, 2 - lows since the last high)``.
    """
    w = lease_window(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    high = is_finite(score) & (F.col(score) >= enter)
    low = is_finite(score) & (F.col(score) < leave)
    lows = df.withColumn("__lows", F.sum(low.cast("int")).over(upto))
    at_high = F.last(F.when(high, F.col("__lows")), ignorenulls=True).over(upto)
    out = lows.withColumn("__mark", at_high)
    state = F.when(F.col("__mark").isNull(), 0).otherwise(F.greatest(F.lit(0), 2 - (F.col("__lows") - F.col("__mark"))))
    return out.withColumn(name, state.cast("int")).drop("__lows", "__mark")


def lagged(df: DataFrame, value: str, name: str, initial: Column, order: Sequence[str]) -> DataFrame:
    """Value of the report before in the same lease, ``initial`` on the first."""
    w = lease_window(order)
    return df.withColumn(name, F.when(F.row_number().over(w) == 1, initial).otherwise(F.lag(value).over(w)))


def check_chronology(df: DataFrame, order: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """Number of steps back in time and of overlapping epochs inside leases."""
    w = lease_window([c for c in (C.EVALUATION_ROW,) if c in df.columns] or order)
    by_time = lease_window(order)
    t = F.col(order[0])
    return df.select(
        (t < F.lag(t).over(w)).alias("back"),
        (t - F.col(C.DURATION) < F.lag(t).over(by_time) - F.lit(1e-9)).alias("overlap"),
    ).agg(
        F.count_if(F.coalesce("back", F.lit(False))).alias("time_reversals"),
        F.count_if(F.coalesce("overlap", F.lit(False))).alias("overlaps"),
    )


def epoch_rows(df: DataFrame, rule: TraceRule) -> DataFrame:
    """Add a row id that is unique per epoch and follows decision time within a lease."""
    return df.withColumn(C.EVALUATION_ROW, bin_index(C.EPOCH_START, rule.epoch_seconds))
