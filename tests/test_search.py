"""One-fold candidate metrics against the long action table."""

from __future__ import annotations

import numpy as np
import pytest

from pulsegate import columns as C
from pulsegate.config import CandidateSpec
from pulsegate.operators.calibration import METRIC_COLUMNS, broad_grid, candidate_metrics
from pulsegate.operators.controllers import action_trace
from pulsegate.operators.episodes import mark_report_islands, report_episodes, summarize_report_episodes
from pulsegate.operators.metrics import BY_CANDIDATE, access_metrics, with_previous_attack
from tests.oracle import table

SPECS = [
    *broad_grid([(0.4, 0.6), (0.5, 0.5)])[::3],
    CandidateSpec("never", "stateless", "stateless", {"restrict_threshold": 2.0, "isolate_threshold": 2.0}),
]
KINDS = (
    f"{C.BLOCK} long, {C.SUBJECT} long, {C.LEASE} string, {C.DECISION_TIME} double, {C.SCORE} double, "
    f"{C.IS_ATTACK} boolean, {C.DURATION} double"
)


def long_form(df, specs, cap):
    order = [C.DECISION_TIME]
    trace = action_trace(mark_report_islands(with_previous_attack(df, order=order), order), specs, order=order)
    time = access_metrics(trace).withColumnRenamed("malicious_exposure", "malicious_allow")
    runs = summarize_report_episodes(report_episodes(trace, delay_cap_s=cap), BY_CANDIDATE)
    runs = runs.withColumnRenamed("episodes", "attack_episodes")
    joined = time.join(runs.drop("attack_time_s", "contained_time_s"), list(BY_CANDIDATE), "left")
    return joined.fillna(0, ["attack_episodes"]).select(*BY_CANDIDATE, *METRIC_COLUMNS)


def epochs(spark, seed, n=240, leases=9):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        subject = int(rng.integers(0, 3))
        # A lease id may come back after another one; scores and labels may be missing.
        lease = f"{subject}:{int(rng.integers(0, leases)) // 3 if i % 5 else i // 40}"
        score = [None, float("nan")][int(rng.integers(0, 2))] if rng.random() < 0.1 else float(np.round(rng.random(), 2))
        attack = None if rng.random() < 0.05 else bool(rng.random() < 0.5)
        rows.append((i // 120, subject, lease, float(i), score, attack, float(rng.integers(1, 4))))
    return spark.createDataFrame(rows, KINDS)


@pytest.mark.parametrize("seed, batch", [(1, 5), (2, 64), (3, 10_000)])
def test_one_fold_equals_the_long_table(spark, seed, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        df = epochs(spark, seed)
        names = [*BY_CANDIDATE, *METRIC_COLUMNS]
        got = [tuple(r) for r in candidate_metrics(df, SPECS, delay_cap_s=6.0).select(*names).collect()]
        want = [tuple(r) for r in long_form(df, SPECS, 6.0).select(*names).collect()]
        assert table(got, names) == table(want, names)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_epochs_no_candidates(spark):
    assert candidate_metrics(spark.createDataFrame([], KINDS), SPECS).count() == 0


def test_rules_are_folded_once(spark):
    plan = candidate_metrics(epochs(spark, 4), SPECS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Generate" not in plan
