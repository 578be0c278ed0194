"""Fail-closed checks of derived tables, as one ``(check, violations, passed)`` table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegate import columns as C
from pulsegate.functions.scalars import is_finite
from pulsegate.operators.controllers import LEASE_KEYS, evaluation_order, lease_window
from pulsegate.operators.metrics import action_metrics
from pulsegate.schema import TraceError

EPOCH_KEY = (C.BLOCK, C.LEASE, C.SUBJECT, C.DECISION_TIME)


def _one(name: str, df: DataFrame, violations: Column) -> DataFrame:
    counted = df.agg(F.coalesce(violations, F.lit(0)).cast("long").alias("violations"))
    return counted.select(F.lit(name).alias("check"), "violations")


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def score_checks(scores: DataFrame) -> list[DataFrame]:
    """Epoch keys are unique, scores are probabilities, a block has one split."""
    spread = scores.groupBy(C.BLOCK).agg((F.min(C.SPLIT) != F.max(C.SPLIT)).alias("torn"))
    bad = ~(is_finite(C.SCORE) & F.col(C.SCORE).between(0.0, 1.0))
    return [
        _one("epoch keys are unique", repeated_keys(scores, EPOCH_KEY), F.count(F.lit(1))),
        _one("scores are finite and in [0, 1]", scores, F.count_if(bad)),
        _one("partitions share no block", spread, F.count_if("torn")),
    ]


def replay_checks(epochs: DataFrame) -> list[DataFrame]:
    """Durations, ids and time order a replay needs."""
    w = lease_window(evaluation_order(epochs))
    t, d = F.col(C.DECISION_TIME), F.col(C.DURATION)
    ordered = epochs.select((t - d < F.lag(t).over(w) - F.lit(1e-9)).alias("overlap"))
    missing = F.col(C.SUBJECT).isNull() | F.col(C.LEASE).isNull() | F.col(C.BLOCK).isNull()
    moved = epochs.groupBy(C.LEASE).agg((F.min(C.BLOCK) != F.max(C.BLOCK)).alias("moved"))
    return [
        _one("durations are finite and positive", epochs, F.count_if(~(is_finite(C.DURATION) & (d > 0)))),
        _one("entity, lease and block are known", epochs, F.count_if(missing)),
        _one("epochs of a lease do not overlap", ordered, F.count_if(F.coalesce("overlap", F.lit(False)))),
        _one("a lease lies in one block", moved, F.count_if("moved")),
    ]


def action_checks(trace: DataFrame, epochs: DataFrame, candidates: int) -> list[DataFrame]:
    """Completeness, key uniqueness, state domain and the exact one-epoch lag.

    Actions and epochs are placed by lease together, once: the lag, the counts per candidate and
    epoch and the counts per epoch all keep that place.  As in a join, an unknown key equals no other.
    """
    order = evaluation_order(trace)
    rows = trace.select(C.CANDIDATE, *dict.fromkeys([*EPOCH_KEY, *order]), "decision_state", "effective_state", F.lit(False).alias("__own"))
    own = epochs.select(*EPOCH_KEY, F.lit(True).alias("__own"))
    placed = rows.unionByName(own, allowMissingColumns=True).repartition(*LEASE_KEYS)
    w = lease_window(order, ["__own", C.CANDIDATE, *LEASE_KEYS])
    expected = F.coalesce(F.lag("decision_state").over(w), F.lit(0))
    marked = placed.withColumns(
        {"__off": expected != F.col("effective_state"), "__odd": ~F.col("effective_state").isin(0, 1, 2)}
    )
    per_candidate = marked.groupBy("__own", C.CANDIDATE, *EPOCH_KEY).agg(
        F.count(F.lit(1)).alias("copies"), F.count_if("__off").alias("off"), F.count_if("__odd").alias("odd")
    )
    per_epoch = per_candidate.groupBy(*EPOCH_KEY).agg(
        F.sum(F.when(F.col("__own"), F.col("copies")).otherwise(0)).alias("epochs"),
        F.sum(F.when(F.col("__own"), 0).otherwise(F.col("copies"))).alias("n"),
        F.count_if(~F.col("__own") & (F.col("copies") > 1)).alias("repeated"),
        F.sum("off").alias("off"),
        F.sum("odd").alias("odd"),
    )
    unknown = F.lit(False)
    for k in EPOCH_KEY:
        unknown = unknown | F.col(k).isNull()
    differs = F.col("n") != candidates
    apart = F.when(F.lit(candidates != 0), F.col("epochs")).otherwise(0) + ((F.col("n") > 0) & differs).cast("long")
    short = F.when(unknown, apart).when(differs, F.greatest("epochs", F.lit(1))).otherwise(0)
    found = per_epoch.agg(
        *[F.coalesce(F.sum(v), F.lit(0)).cast("long").alias(k) for k, v in
          {"short": short, "repeated": F.col("repeated"), "odd": F.col("odd"), "off": F.col("off")}.items()]
    )
    names = {
        "short": "every candidate acts on every epoch",
        "repeated": "candidate and epoch keys are unique",
        "odd": "actions are ALLOW, RESTRICT or ISOLATE",
        "off": "effective action is the previous decision",
    }
    listed = [F.struct(F.lit(name).alias("check"), F.col(k).alias("violations")) for k, name in names.items()]
    return [found.select(F.inline(F.array(*listed)))]


def recompute_checks(trace: DataFrame, saved: DataFrame, by: Sequence[str] = (C.CANDIDATE, C.FAMILY)) -> list[DataFrame]:
    """Saved aggregates (any additive columns of the metrics) equal aggregates recomputed from rows."""
    fresh = action_metrics(trace, by).select(*saved.columns)
    drift = fresh.exceptAll(saved).unionByName(saved.exceptAll(fresh))
    return [_one("aggregates recompute from action rows", drift, F.count(F.lit(1)))]


def episode_checks(episodes: DataFrame, candidates: int) -> list[DataFrame]:
    """Episodes come from labels: every policy has the same episode keys."""
    shared = episodes.where(F.col("attack_type") == C.ANY_ATTACK).groupBy("episode_key")
    seen = shared.agg(F.count_distinct(C.CANDIDATE).alias("n"))
    return [_one("episode keys are identical across policies", seen, F.count_if(F.col("n") != candidates))]


def alignment_violations(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of either table without an equal key in the other."""
    a, b = left.select(*keys), right.select(*keys)
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def check_table(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks).withColumn("passed", F.col("violations") == 0)


def require_all(table: DataFrame) -> list[str]:
    """Raise unless every check passed; returns the check names."""
    rows = table.collect()
    failed = [r["check"] for r in rows if not r["passed"]]
    if failed:
        raise TraceError(f"integrity checks failed: {failed}")
    return [r["check"] for r in rows]
