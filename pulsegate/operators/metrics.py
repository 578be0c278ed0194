"""Time-weighted access metrics and churn.

All measures are conditional sums over the long action table, so one pass with map-side
combine serves every candidate, stratum or block asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegate import columns as C
from pulsegate.config import ISOLATE, RESTRICT
from pulsegate.functions.ordered import generations, neighbours
from pulsegate.functions.scalars import ratio
from pulsegate.operators.controllers import LEASE_KEYS, evaluation_order, lease_window

PREVIOUS_ATTACK = "previous_is_attack"
BY_CANDIDATE = (C.CANDIDATE, C.FAMILY)


def seconds_where(condition: Column, duration: str = C.DURATION) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(duration))), F.lit(0.0))


def total_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


# -- columns that need the neighbouring report -------------------------------------------


def with_previous_attack(df: DataFrame, keys: Sequence[str] = LEASE_KEYS, order: Sequence[str] | None = None):
    """Attack flag of the epoch before in the lease (NULL on the first)."""
    w = lease_window(list(order or evaluation_order(df)), keys)
    return df.withColumn(PREVIOUS_ATTACK, F.lag(C.IS_ATTACK).over(w))


def effective_changes(df: DataFrame, state: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Previous state, transition flag and severity step of an existing state column."""
    w = lease_window(order, keys)
    before = F.lag(state).over(w)
    return df.withColumn("previous", before).withColumns(
        {
            "transitioned": F.col("previous").isNotNull() & (F.col(state) != F.col("previous")),
            "severity_delta": F.coalesce(F.abs(F.col(state) - F.col("previous")), F.lit(0)),
        }
    )


def hold_durations(
    df: DataFrame,
    subject: str = C.SUBJECT,
    lease: str = C.LEASE,
    time: str = C.TIME,
    row: str = C.ROW,
    horizon: str | None = None,
    cap_s: float | None = None,
    name: str = "duration_s",
) -> DataFrame:
    """Sample-and-hold seconds until the entity's next report of the same lease generation.

    Works on raw reports of any length per entity: neighbours come from the range
    partitioned scan.  The last report holds until ``horizon`` (a column) or for 0 s.
    Reports follow each other in source order, so a step back in time, like a horizon
    before the last report, fails the job.
    """
    nexts = {"__next_t": time, "__next_lease": lease}
    out = neighbours(df, [subject], [row], following=nexts)
    same = F.col("__next_lease") == F.col(lease)
    until = F.when(same, F.col("__next_t"))
    if horizon:
        until = F.coalesce(until, F.col(horizon))
    held = F.coalesce(until - F.col(time), F.lit(0.0))
    checked = F.when(held >= 0, held).otherwise(F.raise_error(F.lit("time runs backwards")).cast("double"))
    if cap_s is not None:
        checked = F.least(checked, F.lit(float(cap_s)))
    return out.withColumn(name, checked).drop("__next_t", "__next_lease")


def with_horizon(
    df: DataFrame,
    by_lease: DataFrame | None = None,
    by_subject: DataFrame | None = None,
    default_s: float | None = None,
    subject: str = C.SUBJECT,
    lease: str = C.LEASE,
) -> DataFrame:
    """Observation end per row: (entity, lease), else entity, else a constant."""
    out, found = df, []
    for side, keys, tag in ((by_lease, [subject, lease], "l"), (by_subject, [subject], "s")):
        if side is not None:
            out = out.join(side.select(*keys, F.col("horizon_s").alias(f"__h{tag}")), keys, "left")
            found.append(F.col(f"__h{tag}"))
    found.append(F.lit(default_s).cast("double"))
    return out.withColumn("horizon_s", F.coalesce(*found)).drop("__hl", "__hs")


def lease_generation(df: DataFrame, subject: str = C.SUBJECT, lease: str = C.LEASE, order=(C.TIME, C.ROW)):
    return generations(df, subject, lease, list(order))


def dwell_weights(
    df: DataFrame,
    keys: Sequence[str] = LEASE_KEYS,
    time: str = C.DECISION_TIME,
    max_gap: float | None = None,
    min_interval: float = 0.0,
    name: str = "dwell_weight",
) -> DataFrame:
    """Seconds to the next observation of the lease, scaled to mean one.

    The last observation takes the lease's median positive step, else the global median,
    else one second.  A lease is bounded by its block, so its median is a window.  Steps
    are whole epochs within a block: the global median counts at most
    ``max_block_seconds / epoch_seconds`` distinct values, combined map-side.
    """
    if max_gap is not None and (max_gap <= 0 or min_interval > max_gap):
        raise ValueError("max_gap must be positive and at least min_interval")
    w = Window.partitionBy(*keys)
    step = F.lead(time).over(w.orderBy(time)) - F.col(time)
    steps = df.withColumn("__step", step)
    positive = F.when(F.col("__step") > 0, F.col("__step"))
    one = steps.withColumn("__pos", positive)
    overall = one.agg(F.percentile("__pos", F.lit(0.5))).scalar()
    typical = F.percentile("__pos", F.lit(0.5)).over(w)
    raw = F.coalesce(F.col("__step"), typical, overall, F.lit(1.0))
    if max_gap is not None:
        raw = F.least(raw, F.lit(float(max_gap)))
    if min_interval:
        raw = F.greatest(raw, F.lit(float(min_interval)))
    out = one.withColumn("__raw", raw)
    mean = out.agg(F.avg("__raw")).scalar()
    return out.withColumn(name, F.col("__raw") / mean).drop("__step", "__pos", "__raw")


def effective_sample_size(df: DataFrame, weight: str) -> DataFrame:
    """Weight audit: rows, range, mean and ``(sum w)^2 / sum w^2``."""
    w = F.col(weight)
    return df.agg(
        F.count(w).alias("rows"),
        F.min(w).alias("minimum"),
        F.max(w).alias("maximum"),
        F.avg(w).alias("mean"),
        (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("effective_sample_size"),
    )


# -- aggregates ---------------------------------------------------------------------------


def action_sums(containment: int = RESTRICT, duration: str = C.DURATION) -> dict[str, Column]:
    """Additive action measures; the caller picks the grouping."""
    attack = F.col(C.IS_ATTACK)
    contained = F.col("effective_state") >= containment
    starts = contained & (F.col("effective_previous_state") < containment)
    isolated = F.col("effective_state") == ISOLATE
    return {
        "epochs": F.count(F.lit(1)),
        "observed_time_s": F.sum(duration),
        "benign_time_s": seconds_where(~attack, duration),
        "attack_time_s": seconds_where(attack, duration),
        "benign_contained_time_s": seconds_where(~attack & contained, duration),
        "benign_isolated_time_s": seconds_where(~attack & isolated, duration),
        "attack_contained_time_s": seconds_where(attack & contained, duration),
        "attack_exposed_time_s": seconds_where(attack & ~contained, duration),
        "attack_allowed_time_s": seconds_where(attack & (F.col("effective_state") == 0), duration),
        "attack_not_isolated_time_s": seconds_where(attack & ~isolated, duration),
        "effective_transitions": total_where(F.col("effective_transitioned")),
        "severity_transition_total": F.coalesce(F.sum("effective_severity_delta"), F.lit(0)).cast("long"),
        "containment_starts": total_where(starts),
        "benign_containment_starts": total_where(starts & ~attack),
    }


def action_metrics(
    trace: DataFrame, by: Sequence[str] = BY_CANDIDATE, containment: int = RESTRICT, duration: str = C.DURATION
) -> DataFrame:
    """Friction, containment, exposure and churn per candidate."""
    sums = action_sums(containment, duration)
    out = trace.groupBy(*by).agg(*[v.alias(k) for k, v in sums.items()])
    per_hour = ratio(3600.0 * F.col("effective_transitions"), "observed_time_s")
    return out.withColumns(
        {
            "benign_friction": ratio("benign_contained_time_s", "benign_time_s"),
            "attack_time_containment": ratio("attack_contained_time_s", "attack_time_s"),
            "transitions_per_lease_hour": per_hour,
            "benign_isolation": ratio("benign_isolated_time_s", "benign_time_s"),
            "malicious_allow": ratio("attack_allowed_time_s", "attack_time_s"),
            "malicious_not_isolated": ratio("attack_not_isolated_time_s", "attack_time_s"),
            "transitions_per_lease_minute": per_hour / 60.0,
        }
    ).drop("attack_allowed_time_s", "attack_not_isolated_time_s")


def stratified_metrics(trace: DataFrame, strata: dict[str, Column], named: Sequence[Column] = ()) -> DataFrame:
    """Action metrics per named stratum; a row may belong to several.

    ``strata`` has a condition per name; a column of ``named`` names a stratum itself (NULL: none).
    Stratum names are exploded per row, so all strata share one scan and one aggregate.
    Strata without both benign and attack time are left out.
    """
    conditions = [F.when(F.coalesce(cond, F.lit(False)), F.lit(n)) for n, cond in strata.items()]
    names = F.array(*conditions, *named)
    tagged = trace.withColumn("stratum", F.explode(F.filter(names, lambda x: x.isNotNull())))
    out = action_metrics(tagged, ["stratum", *BY_CANDIDATE])
    return out.where((F.col("benign_time_s") > 0) & (F.col("attack_time_s") > 0))


def novelty_strata(trace: DataFrame) -> dict[str, Column]:
    strata = {"all": F.lit(True)}
    if C.NOVELTY in trace.columns:
        strata |= {f"rnti_{n}": F.col(C.NOVELTY) == n for n in ("seen", "unseen")}
    return strata | {"exclude_mixed_labels": ~F.col("mixed_label_epoch")}


def mobility_stratum(pattern: str = "mob_pattern") -> Column:
    """Stratum of the mobility pattern, named from the data; NULL patterns have none."""
    return F.concat(F.lit("mobility_"), F.col(pattern))


def access_metrics(
    trace: DataFrame,
    by: Sequence[str] = BY_CANDIDATE,
    containment: int = RESTRICT,
    duration: str = C.DURATION,
) -> DataFrame:
    """The sixteen time-weighted measures; needs :func:`with_previous_attack`."""
    attack = F.col(C.IS_ATTACK)
    state, before = F.col("effective_state"), F.col("effective_previous_state")
    contained = state >= containment
    was_false = (before >= containment) & F.coalesce(~F.col(PREVIOUS_ATTACK), F.lit(False))
    out = trace.groupBy(*by).agg(
        F.sum(duration).alias("observed_time_s"),
        seconds_where(~attack, duration).alias("benign_time_s"),
        seconds_where(attack, duration).alias("attack_time_s"),
        seconds_where(~attack & contained, duration).alias("benign_restricted_time_s"),
        seconds_where(~attack & (state == ISOLATE), duration).alias("benign_isolated_time_s"),
        seconds_where(attack & ~contained, duration).alias("malicious_exposure_time_s"),
        seconds_where(attack & contained, duration).alias("malicious_contained_time_s"),
        total_where(state != before).alias("transitions"),
        F.coalesce(F.sum(F.abs(state - before)), F.lit(0)).cast("long").alias("severity_transitions"),
        total_where(~attack & contained & ~was_false).alias("false_restriction_episodes"),
        seconds_where(attack & (state != ISOLATE), duration).alias("__not_isolated"),
    )
    return out.withColumns(
        {
            "benign_friction": ratio("benign_restricted_time_s", "benign_time_s"),
            "benign_isolation": ratio("benign_isolated_time_s", "benign_time_s"),
            "malicious_exposure": ratio("malicious_exposure_time_s", "attack_time_s"),
            "malicious_containment": ratio("malicious_contained_time_s", "attack_time_s"),
            "malicious_not_isolated": ratio("__not_isolated", "attack_time_s"),
            "transitions_per_minute": ratio(60.0 * F.col("transitions"), "observed_time_s"),
            "severity_transitions_per_minute": ratio(60.0 * F.col("severity_transitions"), "observed_time_s"),
        }
    ).drop("__not_isolated")


def state_histogram(trace: DataFrame, state: str = "decision_state", by: Sequence[str] = BY_CANDIDATE) -> DataFrame:
    return trace.groupBy(*by, state).agg(F.count(F.lit(1)).alias("reports"))
