"""Budget-constrained policy selection over a candidate metrics table.

A metrics table has one row per candidate of a parameter grid; windows are per budget and
family.  References are joined by budget, never paired with every candidate.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegate import columns as C
from pulsegate.config import FRICTION_BUDGETS, TUNING_SPLIT, SelectionTolerances
from pulsegate.operators.calibration import require_split
from pulsegate.session import ship_package

BUDGET = "friction_budget"
TUNED_FAMILIES = ("ewma", "n_report", "proposed", "symmetric_hysteresis")
OBJECTIVES = ("malicious_exposure", "transitions_per_minute", "median_capped_delay_s")
_REFERENCE_VALUES = (
    "benign_friction",
    "malicious_allow",
    "malicious_not_isolated",
    "episode_coverage",
    "median_capped_delay_s",
    "transitions_per_minute",
)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each group along ``order``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def per_budget(metrics: DataFrame, budgets: Sequence[float] = FRICTION_BUDGETS) -> DataFrame:
    """Candidates repeated under every budget that covers their friction."""
    listed = F.array(*[F.lit(float(b)) for b in sorted(set(budgets))])
    return metrics.withColumn(BUDGET, F.explode(listed)).where(F.col("benign_friction") <= F.col(BUDGET))


def within_family(
    metrics: DataFrame,
    budgets: Sequence[float] = FRICTION_BUDGETS,
    security_margin: float = 0.02,
    delay_margin_s: float = 1.0,
    coverage_margin: float = 0.05,
) -> DataFrame:
    """Least-churning candidate per family and budget among the near-best.

    Each stage keeps candidates near the best exposure, then coverage, then delay of the
    stage before.
    """
    scope = Window.partitionBy(BUDGET, C.FAMILY)
    rows = per_budget(metrics, budgets)
    rows = rows.withColumn("best_family_malicious_allow", F.min("malicious_allow").over(scope))
    rows = rows.where(F.col("malicious_allow") <= F.col("best_family_malicious_allow") + F.lit(security_margin))
    rows = rows.withColumn("best_security_set_episode_coverage", F.max("episode_coverage").over(scope))
    rows = rows.where(F.col("episode_coverage") >= F.col("best_security_set_episode_coverage") - F.lit(coverage_margin))
    rows = rows.withColumn("__delay", F.min("median_capped_delay_s").over(scope))
    rows = rows.where(F.col("median_capped_delay_s") <= F.col("__delay") + F.lit(delay_margin_s)).drop("__delay")
    order = ["transitions_per_minute", "malicious_allow", "malicious_not_isolated", "benign_friction", C.CANDIDATE]
    return first_by(rows, [BUDGET, C.FAMILY], order).withColumns(
        {
            "security_margin": F.lit(security_margin),
            "coverage_margin": F.lit(coverage_margin),
            "delay_margin_s": F.lit(delay_margin_s),
        }
    )


def _with_reference(metrics: DataFrame, references: DataFrame, values: Sequence[str]) -> DataFrame:
    side = references.select(BUDGET, *[F.col(v).alias(f"ref_{v}") for v in values])
    return metrics.join(side, BUDGET)


def matched_selection(
    metrics: DataFrame,
    allow_margin: float = 0.02,
    isolation_margin: float = 0.05,
    coverage_margin: float = 0.03,
    delay_margin_s: float = 1.0,
    minimum_reduction: float = 0.25,
    split: str = TUNING_SPLIT,
) -> DataFrame:
    """Reference, tuned comparators and least-churning proposal per declared budget."""
    rows = require_split(metrics, split)
    stateless = rows.where(F.col(C.FAMILY) == "stateless")
    scope = Window.partitionBy(BUDGET)
    one = F.raise_error(F.lit("each budget needs exactly one stateless reference")).cast("string")
    single = F.when(F.count(F.lit(1)).over(scope) == 1, F.col(C.CANDIDATE)).otherwise(one)
    reference = stateless.withColumn(C.CANDIDATE, single)
    paired = _with_reference(rows, reference, _REFERENCE_VALUES)
    covered = (F.col("episode_coverage") >= F.col("ref_episode_coverage") - F.lit(coverage_margin)) & (
        F.col("median_capped_delay_s") <= F.col("ref_median_capped_delay_s") + F.lit(delay_margin_s)
    )
    rivals = paired.where(F.col(C.FAMILY).isin("n_report", "ewma", "symmetric_hysteresis")).withColumn("__ok", covered)
    anyone = F.max(F.col("__ok").cast("int")).over(Window.partitionBy(BUDGET, C.FAMILY)) == 1
    rivals = rivals.withColumn("__any", anyone).where(F.col("__ok") | ~F.col("__any")).drop("__ok", "__any")
    rivals = first_by(
        rivals,
        [BUDGET, C.FAMILY],
        ["malicious_allow", "transitions_per_minute", "malicious_not_isolated", C.CANDIDATE],
    )
    safe = (
        covered
        & (F.col("malicious_allow") <= F.col("ref_malicious_allow") + F.lit(allow_margin))
        & (F.col("malicious_not_isolated") <= F.col("ref_malicious_not_isolated") + F.lit(isolation_margin))
    )
    best = first_by(
        paired.where((F.col(C.FAMILY) == "proposed") & safe),
        [BUDGET],
        ["transitions_per_minute", "malicious_allow", "malicious_not_isolated", C.CANDIDATE],
    )
    cut = 1.0 - F.try_divide(F.col("transitions_per_minute"), F.col("ref_transitions_per_minute"))
    best = best.withColumns(
        {"churn_reduction_vs_stateless": cut, "passes_minimum_churn_reduction": cut >= F.lit(minimum_reduction)}
    )
    drop = [f"ref_{v}" for v in _REFERENCE_VALUES]
    parts = ((reference, "reference"), (rivals, "comparator"), (best, "proposed"))
    tagged = [df.drop(*drop).withColumn("selection_role", F.lit(role)) for df, role in parts]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2], allowMissingColumns=True)


STAGES = ("budget_matched", "security_noninferior", "isolation_noninferior", "coverage_noninferior", "delay_noninferior")


def cascade_selection(
    metrics: DataFrame,
    references: DataFrame,
    tolerances: SelectionTolerances = SelectionTolerances(),
    families: Sequence[str] = TUNED_FAMILIES,
    split: str = TUNING_SPLIT,
) -> DataFrame:
    """Staged selection against the stateless reference, one audit row per budget and family.

    Stages narrow each other; the status names the first empty stage, whose diagnostic
    candidate is the best of the stage before.
    """
    tol = tolerances
    eps = F.lit(tol.numeric_tolerance)
    refs = require_split(references, split)
    bad = F.raise_error(F.lit("stateless reference could not calibrate a budget")).cast("double")
    refs = refs.withColumn(BUDGET, F.when(F.col("reference_calibrated"), F.col(BUDGET)).otherwise(bad))
    declared = BUDGET in metrics.columns
    rows = require_split(metrics, split).where(F.col(C.FAMILY).isin(*families))

    ref = refs.select(
        F.col(BUDGET).alias("__b"),
        F.col(C.CANDIDATE).alias("reference_candidate"),
        F.col("friction_resolution").alias("__res"),
        *[F.col(v).alias(f"reference_{v}") for v in _REFERENCE_VALUES],
        F.round(BUDGET, 11).alias("__key"),
    )
    # Families are parameters: each reference row is repeated per family that has candidates.
    listed = ref.withColumn(C.FAMILY, F.explode(F.array(*map(F.lit, families))))
    grid = listed.join(rows.select(C.FAMILY).distinct(), C.FAMILY, "left_semi")
    own = rows.withColumn("__own", F.round(BUDGET, 11) if declared else F.lit(None).cast("double"))
    own = own.select(
        *[F.col(c) for c in (C.CANDIDATE, C.FAMILY, "__own", *_REFERENCE_VALUES, "false_restriction_episodes")]
    )
    on = [C.FAMILY]
    joined = grid.join(own.withColumnRenamed("__own", "__key"), [*on, "__key"], "left") if declared else grid.join(
        own.drop("__own"), on, "left"
    )

    budget, res = F.col("__b"), F.col("__res")
    lower = budget * F.lit(1.0 - tol.budget_undershoot_relative) - res
    upper = budget + res
    friction = F.col("benign_friction")
    near = F.col("reference_malicious_allow") + F.lit(tol.security_noninferiority_abs) + eps
    hard = F.col("reference_malicious_not_isolated") + F.lit(tol.isolation_noninferiority_abs) + eps
    least = F.col("reference_episode_coverage") - F.lit(tol.coverage_noninferiority_abs) - eps
    late = F.col("reference_median_capped_delay_s") + F.lit(tol.delay_noninferiority_s) + eps
    tests = (
        (friction >= lower - eps) & (friction <= upper + eps),
        F.col("malicious_allow") <= near,
        F.col("malicious_not_isolated") <= hard,
        F.col("episode_coverage") >= least,
        F.col("median_capped_delay_s") <= late,
    )
    passed: list[Column] = []
    for test in tests:
        here = F.coalesce(test, F.lit(False))
        passed.append(passed[-1] & here if passed else here)
    flags = {f"__{s}": p for s, p in zip(STAGES, passed)}
    scope = Window.partitionBy("__b", C.FAMILY)
    staged = joined.withColumns(flags)
    counts = {f"{s}_count": F.count_if(F.col(f"__{s}")).over(scope) for s in STAGES}
    distance = F.abs(friction - budget)
    staged = staged.withColumns(counts | {"__closest": F.min(F.when(F.col("__delay_noninferior"), distance)).over(scope)})
    closest = F.col("__delay_noninferior") & (distance <= F.col("__closest") + res + eps)
    staged = staged.withColumn("__final", F.coalesce(closest, F.lit(False)))
    staged = staged.withColumn("closest_budget_stratum_count", F.count_if(F.col("__final")).over(scope))

    reached = sum((F.when(F.col(f"{s}_count") > 0, 1).otherwise(0) for s in STAGES), F.lit(0))
    churn = F.col("transitions_per_minute")
    # Candidates still standing at the last non-empty stage, in that stage's order.
    standing = [F.col(f"__{s}") for s in STAGES[:-1]] + [F.col("__final")]
    orders = (
        ("malicious_allow", churn, F.lit(0.0)),
        ("malicious_not_isolated", churn, F.lit(0.0)),
        (-F.col("episode_coverage"), churn, F.lit(0.0)),
        ("median_capped_delay_s", churn, F.lit(0.0)),
        (churn, F.col("false_restriction_episodes").cast("double"), F.col("malicious_allow")),
    )
    alive, keys = F.lit(False), [F.lit(None).cast("double")] * 3
    for level, (flag, order) in enumerate(zip(standing, orders), start=1):
        at = reached == level
        alive = F.when(at, flag).otherwise(alive)
        keys = [F.when(at, F.col(o) if isinstance(o, str) else o).otherwise(k) for o, k in zip(order, keys)]
    ranked = staged.withColumns({"__reached": reached, "__alive": alive} | {f"__k{i}": k for i, k in enumerate(keys)})
    top = first_by(ranked, ["__b", C.FAMILY], [F.desc("__alive"), "__k0", "__k1", "__k2", C.CANDIDATE])

    has = F.col("__alive")
    ref_churn = F.col("reference_transitions_per_minute")
    reduction = F.when(has & (ref_churn > eps), 1.0 - F.try_divide(churn, ref_churn))
    enough = reduction + eps >= F.lit(tol.minimum_transition_reduction)
    status = (
        F.when(F.col("__reached") == 0, "no_budget_matched_candidate")
        .when(F.col("__reached") == 1, "security_inferior")
        .when(F.col("__reached") == 2, "isolation_inferior")
        .when(F.col("__reached") == 3, "coverage_inferior")
        .when(F.col("__reached") == 4, "delay_inferior")
        .when(ref_churn <= eps, "reference_churn_zero")
        .when(enough, "selected")
        .otherwise("insufficient_transition_reduction")
    )
    shown = (C.CANDIDATE, *_REFERENCE_VALUES)
    return top.select(
        budget.alias(BUDGET),
        C.FAMILY,
        status.alias("status"),
        *[F.when(has, F.col(c)).alias(c) for c in shown],
        F.when(has, friction / budget).alias("budget_utilization"),
        reduction.alias("transition_reduction"),
        "reference_candidate",
        *[f"reference_{v}" for v in _REFERENCE_VALUES],
        lower.alias("budget_lower_bound"),
        upper.alias("budget_upper_bound"),
        *[f"{s}_count" for s in STAGES],
        "closest_budget_stratum_count",
        F.lit(tol.budget_undershoot_relative).alias("budget_undershoot_relative"),
        F.lit(tol.security_noninferiority_abs).alias("security_margin"),
        F.lit(tol.isolation_noninferiority_abs).alias("isolation_margin"),
        F.lit(tol.coverage_noninferiority_abs).alias("coverage_margin"),
        F.lit(tol.delay_noninferiority_s).alias("delay_margin_s"),
        F.lit(tol.minimum_transition_reduction).alias("minimum_transition_reduction"),
    )


# -- Pareto frontier ----------------------------------------------------------------------


def _undominated(values: np.ndarray) -> np.ndarray:
    """Mask of rows no other row beats; equal rows stand together.

    Rows in lexicographic order can only be beaten by an earlier survivor.
    """
    order = np.lexsort(values.T[::-1])
    keep = np.zeros(len(values), dtype=bool)
    front = np.empty((0, values.shape[1]))
    for i in order:
        row = values[i]
        beaten = np.any(np.all(front <= row, axis=1) & np.any(front < row, axis=1))
        if not beaten:
            keep[i] = True
            front = np.vstack([front, row])
    return keep


def pareto_frontier(
    metrics: DataFrame,
    budgets: Sequence[float] = FRICTION_BUDGETS,
    objectives: Sequence[str] = OBJECTIVES,
    friction: str = "benign_friction",
    split: str = TUNING_SPLIT,
) -> DataFrame:
    """Nondominated candidates (all objectives minimised) within each budget.

    Every partition first reduces itself to its own frontier, in any order; only those
    survivors meet in the per-budget pass.
    """
    ship_package(metrics.sparkSession)
    objectives = list(objectives)
    listed = F.array(*[F.lit(float(b)) for b in sorted(set(budgets))])
    finite = F.lit(True)
    for name in (friction, *objectives):
        finite = finite & F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(name) < F.lit(float("inf")))
    bad = F.raise_error(F.lit("friction and objectives must be finite")).cast("double")
    rows = require_split(metrics, split).withColumn(friction, F.when(finite, F.col(friction)).otherwise(bad))
    if BUDGET in rows.columns:
        rows = rows.withColumnRenamed(BUDGET, "declared_budget")
    rows = rows.withColumn(BUDGET, F.explode(listed)).where(F.col(friction) <= F.col(BUDGET))

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby(BUDGET, sort=False):
                yield part[_undominated(part[objectives].to_numpy(float))]

    def final(part: pd.DataFrame) -> pd.DataFrame:
        return part[_undominated(part[objectives].to_numpy(float))]

    return rows.mapInPandas(local, rows.schema).groupBy(BUDGET).applyInPandas(final, rows.schema)


def frontier_pick(
    frontier: DataFrame, objectives: Sequence[str] = OBJECTIVES, friction: str = "benign_friction"
) -> DataFrame:
    """Lexicographically best frontier candidate of each budget."""
    return first_by(frontier, [BUDGET], [*objectives, friction, C.CANDIDATE]).withColumn("selected", F.lit(True))
