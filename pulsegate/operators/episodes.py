"""Attack episodes in both definitions, and their summaries.

Where an episode begins depends on labels and time only, never on a candidate.  Islands
are therefore marked on the epochs before replay; after replay an episode is a plain
aggregate over ``(candidate, lease, stream, island)`` that combines map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegate import columns as C
from pulsegate.config import RESTRICT
from pulsegate.functions.scalars import json_key, quoted, ratio
from pulsegate.operators.controllers import LEASE_KEYS, evaluation_order, lease_window
from pulsegate.operators.epochs import attack_streams
from pulsegate.operators.metrics import BY_CANDIDATE, seconds_where, total_where
from pulsegate.schema import TRACE_ONTOLOGY, Ontology

ISLAND = "__island"
STREAMS = "__streams"


# -- report flavour -----------------------------------------------------------------------


def mark_report_islands(
    df: DataFrame,
    order: Sequence[str] | None = None,
    attack_type: str | None = None,
    episode_id: str | None = None,
    keys: Sequence[str] = LEASE_KEYS,
) -> DataFrame:
    """Number runs of attack reports; a benign report, a new lease, a new type or a new id ends a run.

    Runs are cut along the entity, so a lease id that comes back after another lease starts a new run;
    numbers count per lease.
    """
    w = lease_window(list(order or evaluation_order(df)), [k for k in keys if k != C.LEASE])
    attack = F.col(C.IS_ATTACK)
    opens = ~F.coalesce(F.lag(C.IS_ATTACK).over(w), F.lit(False))
    for tag in (C.LEASE if C.LEASE in keys else None, attack_type, episode_id):
        if tag:
            opens = opens | ~F.col(tag).eqNullSafe(F.lag(tag).over(w))
    run = df.withColumn("__open", (attack & opens).cast("long"))
    upto = lease_window(list(order or evaluation_order(df)), keys).rowsBetween(Window.unboundedPreceding, 0)
    return run.withColumn(ISLAND, F.sum("__open").over(upto)).drop("__open")


def report_episodes(
    trace: DataFrame,
    time: str = C.DECISION_TIME,
    state: str = "effective_state",
    duration: str = C.DURATION,
    delay_cap_s: float | None = None,
    containment: int = RESTRICT,
    attack_type: str | None = None,
    by: Sequence[str] = BY_CANDIDATE,
    keys: Sequence[str] = LEASE_KEYS,
) -> DataFrame:
    """One row per attack run: starts at its first report, capped by its own duration."""
    hit = F.col(state) >= containment
    kind = F.coalesce(F.col(attack_type), F.lit("attack")) if attack_type else F.lit("attack")
    runs = (
        trace.where(F.col(C.IS_ATTACK))
        .withColumn("attack_type", kind)
        .groupBy(*by, *keys, ISLAND, "attack_type")
        .agg(
            F.min(time).alias("start_s"),
            F.sum(duration).alias("duration_s"),
            F.count(F.lit(1)).alias("reports"),
            F.min(F.when(hit, F.col(time))).alias("first_action_s"),
            seconds_where(hit, duration).alias("contained_time_s"),
        )
    )
    covered = F.col("first_action_s").isNotNull()
    delay = F.col("first_action_s") - F.col("start_s")
    capped = F.least(F.coalesce(delay, F.col("duration_s")), F.col("duration_s"))
    if delay_cap_s is not None:
        capped = F.least(capped, F.lit(float(delay_cap_s)))
    return runs.withColumns(
        {
            "end_s": F.col("start_s") + F.col("duration_s"),
            "covered": covered,
            "delay_s": delay,
            "censored": ~covered,
            "censor_time_s": F.col("duration_s"),
            "capped_delay_s": capped,
            "contained_fraction": ratio("contained_time_s", "duration_s"),
        }
    ).withColumnRenamed(ISLAND, "episode")


def exact_median(value: str) -> Column:
    """Median of a delay or duration of epoch-level episodes.

    Such values are whole epochs inside one block, so a group has at most
    ``max_block_seconds / epoch_seconds + 1`` distinct ones; ``percentile`` keeps a count
    per distinct value and merges these map-side, which stays that small for any group.
    """
    return F.percentile(value, F.lit(0.5))


def summarize_report_episodes(episodes: DataFrame, by: Sequence[str] = (*BY_CANDIDATE, "attack_type")) -> DataFrame:
    """Coverage, censoring and median delays per attack type."""
    out = episodes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("episodes"),
        total_where(F.col("covered")).alias("covered_episodes"),
        total_where(F.col("censored")).alias("censored_episodes"),
        F.sum("duration_s").alias("attack_time_s"),
        F.sum("contained_time_s").alias("contained_time_s"),
        exact_median("capped_delay_s").alias("median_capped_delay_s"),
        exact_median("delay_s").alias("median_detected_delay_s"),
    )
    return out.withColumns(
        {
            "episode_coverage": ratio("covered_episodes", "episodes"),
            "time_coverage": ratio("contained_time_s", "attack_time_s"),
        }
    )


# -- epoch flavour ------------------------------------------------------------------------


def mark_streams(
    df: DataFrame,
    ontology: Ontology = TRACE_ONTOLOGY,
    merge_gap_s: float | Column = 0.0,
    order: Sequence[str] | None = None,
    keys: Sequence[str] = LEASE_KEYS,
) -> DataFrame:
    """Attach, per attack stream the epoch belongs to, its episode number and onset flag.

    A stream's episode ends at an observed epoch outside the stream, or when unobserved
    time longer than ``merge_gap_s`` precedes the epoch.  ``before`` is the attack time of
    the episode up to the epoch, from which exposure before containment follows as a
    minimum.
    """
    if not isinstance(merge_gap_s, Column):
        if merge_gap_s < 0:
            raise ValueError("merge_gap_s must be non-negative")
        merge_gap_s = F.lit(float(merge_gap_s))
    order = list(order or evaluation_order(df))
    w = lease_window(order, keys)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    streams = attack_streams(ontology)
    end, length = F.col(order[0]), F.col(C.DURATION)
    silent = end - length - F.lag(order[0]).over(w) > merge_gap_s + F.lit(1e-12)
    out = df.withColumn("__silent", F.coalesce(silent, F.lit(True)))
    opens, numbers, bases, entries = {}, {}, {}, []
    for i, (name, mask) in enumerate(streams):
        inside = F.col(mask)
        opens[f"__o{i}"] = inside & (F.col("__silent") | ~F.coalesce(F.lag(mask).over(w), F.lit(False)))
        opens[f"__c{i}"] = F.coalesce(F.sum(F.when(inside, length)).over(past), F.lit(0.0))
        numbers[f"__n{i}"] = F.sum(F.col(f"__o{i}").cast("long")).over(upto) - 1
        bases[f"__b{i}"] = F.last(F.when(F.col(f"__o{i}"), F.col(f"__c{i}")), ignorenulls=True).over(upto)
        entries.append(
            F.when(
                inside,
                F.struct(
                    F.lit(name).alias("attack_type"),
                    F.col(f"__n{i}").alias("sequence"),
                    F.col(f"__o{i}").alias("onset"),
                    (F.col(f"__c{i}") - F.col(f"__b{i}")).alias("before"),
                ),
            )
        )
    out = out.withColumns(opens).withColumns(numbers | bases)
    marked = out.withColumn(STREAMS, F.filter(F.array(*entries), lambda x: x.isNotNull()))
    return marked.drop("__silent", *opens, *numbers, *bases)


def epoch_episodes(
    trace: DataFrame,
    containment: int = RESTRICT,
    delay_cap_s: float | None = None,
    time: str = C.DECISION_TIME,
    duration: str = C.DURATION,
    keys: Sequence[str] = LEASE_KEYS,
) -> DataFrame:
    """Candidate-specific episodes of every attack stream with onset strata."""
    if delay_cap_s is not None and delay_cap_s <= 0:
        raise ValueError("delay_cap_s must be positive")
    used = [C.CANDIDATE, C.FAMILY, *keys, time, duration, "effective_state", "effective_previous_state"]
    rows = trace.select(*used, "mixed_attack_epoch", F.explode(STREAMS).alias("__s")).select(
        "*",
        F.col("__s")["attack_type"].alias("attack_type"),
        F.col("__s")["sequence"].alias("episode_sequence"),
    )
    contained = F.col("effective_state") >= containment
    was = F.col("effective_previous_state") >= containment
    onset = F.col("__s")["onset"]
    start = F.col(time) - F.col(duration)

    def at_onset(flag: Column) -> Column:
        return F.max(F.when(onset, flag))

    groups = rows.groupBy(*BY_CANDIDATE, *keys, "attack_type", "episode_sequence").agg(
        F.min(start).alias("start_s"),
        F.max(time).alias("end_s"),
        F.sum(duration).alias("attack_time_s"),
        seconds_where(contained, duration).alias("contained_time_s"),
        seconds_where(~contained, duration).alias("exposed_time_s"),
        F.count(F.lit(1)).alias("attack_epochs"),
        seconds_where(F.col("mixed_attack_epoch"), duration).alias("mixed_attack_time_s"),
        at_onset(contained).alias("contained_at_onset"),
        at_onset(was).alias("pre_contained_at_onset"),
        at_onset(F.col("mixed_attack_epoch")).alias("mixed_attack_at_onset"),
        F.min(F.when(contained, start)).alias("first_containment_start_s"),
        F.min(F.when(contained, F.col("__s")["before"])).alias("__before"),
    )
    covered = F.col("first_containment_start_s").isNotNull()
    span = F.col("end_s") - F.col("start_s")
    delay = F.col("first_containment_start_s") - F.col("start_s")
    capped = F.coalesce(delay, span)
    if delay_cap_s is not None:
        capped = F.least(capped, F.lit(float(delay_cap_s)))
    pre = F.col("pre_contained_at_onset")
    jump = F.col("contained_at_onset") & ~pre
    key = json_key(F.col(C.SUBJECT), quoted(C.LEASE), quoted("attack_type"), F.col("episode_sequence"))
    return groups.withColumns(
        {
            "episode_key": key,
            "span_s": span,
            # A lease lies in one block, so an episode touches one.
            "blocks_touched": F.lit(1).cast("long"),
            "onset_transition_to_containment": jump,
            "onset_stratum": F.when(pre, "pre_contained")
            .when(jump, "contained_onset_transition")
            .otherwise("initially_exposed"),
            "covered": covered,
            "reactively_covered": covered & ~pre,
            "delay_s": delay,
            "censored": ~covered,
            "capped_delay_s": capped,
            "exposure_before_containment_s": F.coalesce(F.col("__before"), F.col("attack_time_s")),
        }
    ).withColumnsRenamed({C.BLOCK: "onset_block_id", C.SUBJECT: "subject_id", C.LEASE: "lease_id"}).drop("__before")


def _strata_sets(episodes: DataFrame) -> DataFrame:
    """Duplicate each episode under its stratum and under the all-strata label.

    Two rows per episode that combine map-side: the GROUPING SETS expansion with the
    label already in place.
    """
    both = F.explode(F.array(F.lit(C.ALL_STRATA), F.col("onset_stratum")))
    return episodes.withColumn("onset_stratum", both)


def episode_strata(episodes: DataFrame) -> DataFrame:
    """Counts, times and coverage by attack stream, overall and per onset stratum."""
    by = [*BY_CANDIDATE, "attack_type", "onset_stratum"]
    out = _strata_sets(episodes).groupBy(*by).agg(
        F.count(F.lit(1)).alias("episode_count"),
        total_where(F.col("covered")).alias("covered_episode_count"),
        total_where(F.col("reactively_covered")).alias("reactively_covered_episode_count"),
        total_where(F.col("pre_contained_at_onset")).alias("pre_contained_episode_count"),
        total_where(F.col("onset_transition_to_containment")).alias("onset_transition_episode_count"),
        F.sum("attack_time_s").alias("attack_time_s"),
        F.sum("contained_time_s").alias("contained_time_s"),
        F.sum("exposed_time_s").alias("exposed_time_s"),
        F.sum("capped_delay_s").alias("capped_delay_sum_s"),
        F.sum("exposure_before_containment_s").alias("exposure_before_containment_sum_s"),
    )
    return out.withColumns(
        {
            "episode_coverage": F.col("covered_episode_count") / F.col("episode_count"),
            "time_containment": ratio("contained_time_s", "attack_time_s"),
            "mean_capped_delay_s": F.col("capped_delay_sum_s") / F.col("episode_count"),
        }
    )


def episode_summary(episodes: DataFrame, strata: bool = True, extra: Sequence[str] = ()) -> DataFrame:
    """Means, medians and ratios by attack stream (and onset stratum)."""
    by = [*BY_CANDIDATE, *extra, "attack_type", "onset_stratum"]
    rows = _strata_sets(episodes) if strata else episodes.withColumn("onset_stratum", F.lit(C.ALL_STRATA))
    share = lambda c: F.avg(F.col(c).cast("int"))
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("episode_count"),
        total_where(F.col("covered")).alias("covered_episode_count"),
        share("covered").alias("episode_coverage"),
        share("reactively_covered").alias("reactive_coverage"),
        total_where(F.col("pre_contained_at_onset")).alias("pre_contained_episode_count"),
        F.sum("attack_time_s").alias("attack_time_s"),
        F.sum("contained_time_s").alias("contained_time_s"),
        F.sum("exposed_time_s").alias("exposed_time_s"),
        F.avg("capped_delay_s").alias("mean_capped_delay_s"),
        exact_median("capped_delay_s").alias("median_capped_delay_s"),
        exact_median("delay_s").alias("median_detected_delay_s"),
        F.avg("exposure_before_containment_s").alias("mean_exposure_before_containment_s"),
    )
    return out.withColumns(
        {
            "attack_time_containment": ratio("contained_time_s", "attack_time_s"),
            "malicious_allow": ratio("exposed_time_s", "attack_time_s"),
        }
    )


def point_summary(episodes: DataFrame) -> DataFrame:
    """Per-candidate summary of the any-attack stream."""
    wanted = (
        "episode_count episode_coverage mean_capped_delay_s median_capped_delay_s "
        "attack_time_s exposed_time_s malicious_allow"
    ).split()
    out = episode_summary(episodes.where(F.col("attack_type") == C.ANY_ATTACK), strata=False)
    return out.select(*BY_CANDIDATE, *wanted)
