"""Report tables in publication units."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegate import columns as C
from pulsegate.functions.quantiles import exact_quantiles

# Display order and label of every policy family.
FAMILY_ORDER = {
    "proposed": 0,
    "stateless_reference": 1,
    "stateless": 1,
    "ewma": 2,
    "n_report": 3,
    "symmetric_hysteresis": 4,
}
FAMILY_LABELS = {
    "proposed": "Friction-budgeted",
    "stateless_reference": "Stateless",
    "stateless": "Stateless",
    "ewma": "EWMA",
    "n_report": "Two-report",
    "symmetric_hysteresis": "Symmetric hysteresis",
}
_DELAYS = ("mean_capped_delay_s", "median_capped_delay_s")


def lookup(table: Mapping[str, object], key: str) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), F.col(key))


def pct(name: str) -> Column:
    return (100.0 * F.col(name)).alias(f"{name}_pct")


def per_thousand(transitions: str = "effective_transitions", epochs: str = "epochs") -> Column:
    return (1000.0 * F.col(transitions) / F.col(epochs)).alias("transitions_per_1000_observed_epochs")


def overall_episodes(summary: DataFrame) -> DataFrame:
    return summary.where((F.col("attack_type") == C.ANY_ATTACK) & (F.col("onset_stratum") == C.ALL_STRATA))


def heldout_table(aggregate: DataFrame, summary: DataFrame) -> DataFrame:
    """Held-out comparison of the locked policies."""
    side = overall_episodes(summary).select(C.CANDIDATE, "episode_count", "episode_coverage", *_DELAYS)
    role = (
        F.when(F.col(C.FAMILY) == "proposed", "proposed")
        .when(F.col(C.FAMILY) == "stateless_reference", "static reference")
        .otherwise("comparator")
    )
    return aggregate.join(side, C.CANDIDATE).select(
        lookup(FAMILY_ORDER, C.FAMILY).alias("policy_order"),
        lookup(FAMILY_LABELS, C.FAMILY).alias("policy"),
        role.alias("role"),
        "epochs",
        pct("benign_friction"),
        pct("benign_isolation"),
        pct("malicious_allow"),
        pct("malicious_not_isolated"),
        "effective_transitions",
        per_thousand(),
        F.col("episode_count").alias("attack_episode_count"),
        pct("episode_coverage"),
        *_DELAYS,
    )


def per_attack_table(
    summary: DataFrame,
    bounds: DataFrame,
    proposed: str,
    reference: str,
    attacks: Sequence[str],
    failing: Sequence[str] = (),
) -> DataFrame:
    """Proposal against reference per attack type with block-bootstrap bounds.

    ``bounds`` has ``attack_type, metric, estimate, ci_lower, ci_upper``; the exposure
    estimate must equal the point contrast.
    """
    rows = summary.where(F.col("onset_stratum") == C.ALL_STRATA)

    def pick(candidate: str, value: str) -> Column:
        return F.max(F.when(F.col(C.CANDIDATE) == candidate, F.col(value)))

    values = ("malicious_allow", "episode_coverage", "mean_capped_delay_s")
    points = rows.where(F.col("attack_type").isin(*attacks)).groupBy("attack_type").agg(
        pick(proposed, "episode_count").alias("episodes"),
        *[pick(c, v).alias(f"{t}_{v}") for v in values for t, c in (("p", proposed), ("r", reference))],
    )
    names = {
        "exposure": "attack_exposure_difference",
        "coverage": "episode_coverage_difference",
        "delay": "mean_capped_delay_difference_s",
    }
    ends = ("estimate", "ci_lower", "ci_upper")
    wide = bounds.groupBy("attack_type").agg(
        *[F.max(F.when(F.col("metric") == m, F.col(e))).alias(f"{k}_{e}") for k, m in names.items() for e in ends]
    )
    joined = points.join(wide, "attack_type")
    point = F.col("p_malicious_allow") - F.col("r_malicious_allow")
    off = F.abs(point - F.col("exposure_estimate")) > F.lit(1e-9)
    bad = F.raise_error(F.lit("interval estimate differs from the point contrast")).cast("double")
    order = {a: i for i, a in enumerate(attacks)}

    def points_of(tag: str, name: str, scale: float, unit: str) -> list[Column]:
        lo, hi = F.col(f"{tag}_ci_lower"), F.col(f"{tag}_ci_upper")
        return [(scale * lo).alias(f"{name}_ci_lower_{unit}"), (scale * hi).alias(f"{name}_ci_upper_{unit}")]

    return joined.select(
        lookup(order, "attack_type").alias("attack_order"),
        "attack_type",
        "episodes",
        (100.0 * F.col("p_malicious_allow")).alias("proposal_exposure_pct"),
        (100.0 * F.col("r_malicious_allow")).alias("reference_exposure_pct"),
        (100.0 * F.when(off, bad).otherwise(F.col("exposure_estimate"))).alias("exposure_difference_pp"),
        *points_of("exposure", "exposure", 100.0, "pp"),
        (100.0 * F.col("p_episode_coverage")).alias("proposal_coverage_pct"),
        (100.0 * F.col("r_episode_coverage")).alias("reference_coverage_pct"),
        (100.0 * F.col("coverage_estimate")).alias("coverage_difference_pp"),
        *points_of("coverage", "coverage", 100.0, "pp"),
        F.col("p_mean_capped_delay_s").alias("proposal_mean_capped_delay_s"),
        F.col("r_mean_capped_delay_s").alias("reference_mean_capped_delay_s"),
        F.col("delay_estimate").alias("mean_delay_difference_s"),
        *points_of("delay", "mean_delay", 1.0, "s"),
        F.col("attack_type").isin(*failing).alias("known_failure_mode"),
    )


def seen_unseen_table(strata: DataFrame) -> DataFrame:
    """Proposal and reference on seen and unseen entities, side by side."""
    order = {"rnti_seen": 0, "rnti_unseen": 1}

    def side(family: str, value: Column | str) -> Column:
        v = F.col(value) if isinstance(value, str) else value
        return F.max(F.when(F.col(C.FAMILY) == family, v))

    churn = 1000.0 * F.col("effective_transitions") / F.col("epochs")
    measures = {
        "benign_friction_pct": 100.0 * F.col("benign_friction"),
        "malicious_allow_pct": 100.0 * F.col("malicious_allow"),
        "not_isolated_pct": 100.0 * F.col("malicious_not_isolated"),
        "transitions_per_1000_epochs": churn,
    }
    pairs = (("proposal", "proposed"), ("reference", "stateless_reference"))
    wide = strata.where(F.col("stratum").isin(*order)).groupBy("stratum").agg(
        side("proposed", "epochs").alias("epochs"),
        *[side(f, v).alias(f"{t}_{n}") for n, v in measures.items() for t, f in pairs],
    )
    return wide.select(
        lookup(order, "stratum").alias("stratum_order"),
        "*",
        (F.col("proposal_benign_friction_pct") - F.col("reference_benign_friction_pct")).alias("friction_difference_pp"),
        (F.col("proposal_malicious_allow_pct") - F.col("reference_malicious_allow_pct")).alias("exposure_difference_pp"),
        F.try_divide("proposal_transitions_per_1000_epochs", "reference_transitions_per_1000_epochs").alias(
            "transition_rate_ratio"
        ),
    )


def frontier_table(selection: DataFrame, references: DataFrame) -> DataFrame:
    """Structural selections and stateless references per budget."""
    def rows(df: DataFrame, family: Column, status: Column) -> DataFrame:
        tagged = df.withColumns({"__f": family, "__s": status})
        return tagged.select(
            (100.0 * F.col("friction_budget")).alias("budget_pct"),
            lookup(FAMILY_ORDER, "__f").alias("family_order"),
            lookup(FAMILY_LABELS, "__f").alias("policy_family"),
            F.col("__s").alias("status"),
            C.CANDIDATE,
            (100.0 * F.col("benign_friction")).alias("realized_friction_pct"),
            pct("malicious_allow"),
            pct("malicious_not_isolated"),
            F.col("transitions_per_minute").alias("transitions_per_observed_rnti_minute"),
            pct("episode_coverage"),
            "median_capped_delay_s",
        )

    chosen = rows(selection, F.col(C.FAMILY), F.translate("status", "_", " "))
    return chosen.unionByName(rows(references, F.lit("stateless_reference"), F.lit("budget reference")))


def lease_timeout_table(action: DataFrame, episodes: DataFrame) -> DataFrame:
    """Lease-timeout sensitivity of proposal and reference."""
    kept = F.col(C.FAMILY).isin("proposed", "stateless_reference")
    side = episodes.where(kept).select(C.CANDIDATE, "lease_timeout_s", "episode_count", "episode_coverage", *_DELAYS)
    return (
        action.where(kept)
        .join(side, [C.CANDIDATE, "lease_timeout_s"])
        .select(
            "lease_timeout_s",
            lookup(FAMILY_ORDER, C.FAMILY).alias("family_order"),
            lookup(FAMILY_LABELS, C.FAMILY).alias("policy"),
            "epochs",
            F.col("episode_count").alias("episodes"),
            pct("benign_friction"),
            pct("malicious_allow"),
            pct("malicious_not_isolated"),
            per_thousand(),
            pct("episode_coverage"),
            *_DELAYS,
        )
    )


def timeout_contrast(table: DataFrame) -> DataFrame:
    """Proposal minus reference at every lease timeout (self-join on the timeout)."""
    values = (
        "benign_friction_pct malicious_allow_pct transitions_per_1000_observed_epochs episode_coverage_pct "
        "median_capped_delay_s"
    ).split()
    left = table.where("family_order = 0").select("lease_timeout_s", "epochs", *values)
    right = table.where("family_order = 1").select("lease_timeout_s", *[F.col(v).alias(f"{v}_reference") for v in values])
    joined = left.join(right, "lease_timeout_s")
    churn = F.try_divide("transitions_per_1000_observed_epochs", "transitions_per_1000_observed_epochs_reference")
    return joined.select(
        "lease_timeout_s",
        "epochs",
        (F.col("malicious_allow_pct") - F.col("malicious_allow_pct_reference")).alias("exposure_difference_pp"),
        (F.col("episode_coverage_pct") - F.col("episode_coverage_pct_reference")).alias("coverage_difference_pp"),
        (F.col("median_capped_delay_s") - F.col("median_capped_delay_s_reference")).alias("median_delay_difference_s"),
        churn.alias("transition_rate_ratio"),
    )


def robustness_table(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Stack contrasts of named analyses; columns an analysis lacks become NULL."""
    out: DataFrame | None = None
    for name, df in parts.items():
        tagged = df.withColumn("analysis", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no analyses given")
    return out


def timing_summary(samples: DataFrame, by: Sequence[str], value: str = "elapsed_s") -> DataFrame:
    """Median, mean, deviation, range, percentiles and CV of repeated timings.

    Quantiles are exact and come from counted values ranked over range partitions: a group's samples never
    meet in one buffer, however many there are.  A group without samples has NULL quantiles.
    """
    moments = samples.groupBy(*by).agg(
        F.count(F.lit(1)).alias("repetitions"),
        F.avg(value).alias("mean_s"),
        F.stddev_samp(value).alias("stdev_s"),
        F.min(value).alias("min_s"),
        F.max(value).alias("max_s"),
    )
    ranked = exact_quantiles(samples, by, value, (0.5, 0.05, 0.25, 0.75, 0.95)).drop("n")
    ranked = ranked.withColumnsRenamed({k: f"__of_{k}" for k in by})
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"`__of_{k}`")) for k in by]
    out = moments.join(ranked, same, "left")
    names = ("median_s", "p05_s", "p25_s", "p75_s", "p95_s")
    cols = {name: F.col("q")[i] for i, name in enumerate(names)}
    return out.withColumns(cols | {"cv": F.try_divide("stdev_s", "mean_s")}).drop("q", *[f"__of_{k}" for k in by])
