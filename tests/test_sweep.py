"""One-fold lease-timeout sweep against the long tables of every timeout."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegate import columns as C
from pulsegate.operators.calibration import timeout_metrics
from pulsegate.operators.controllers import action_trace
from pulsegate.operators.episodes import epoch_episodes, episode_summary, mark_streams
from pulsegate.operators.epochs import annotate_labels, sweep_leases
from pulsegate.operators.metrics import BY_CANDIDATE, action_metrics
from pulsegate.operators.reports import overall_episodes
from pulsegate.plans.catalogue import QUERIES
from pulsegate.plans.study import LOCKED
from pulsegate.sources.events import EVENT_ONTOLOGY
from tests.oracle import table

TIMEOUTS = (2.0, 3.5, 7.0)
KEYS = [*BY_CANDIDATE, "lease_timeout_s"]
ACTION = ["epochs", "effective_transitions", "benign_friction", "malicious_allow", "malicious_not_isolated"]
EPISODES = ["episode_count", "episode_coverage", "mean_capped_delay_s", "median_capped_delay_s"]
KINDS = (
    f"{C.BLOCK} long, {C.SUBJECT} long, {C.EPOCH_START} double, first_event_time_s double, last_event_time_s double, "
    f"{C.DECISION_TIME} double, {C.DURATION} double, {C.SCORE} double, {C.LABELS} array<string>"
)


def epochs(spark, seed, n=400):
    rng = np.random.default_rng(seed)
    rows = []
    for subject in range(4):
        for start in sorted(rng.choice(n // 2, n // 4, replace=False)):
            seen = np.sort(start + rng.random(2))
            score = None if rng.random() < 0.05 else float(np.round(rng.random(), 2))
            labels = sorted(rng.choice(["click", "error", "purchase"], int(rng.integers(1, 3)), replace=False))
            block = int(start >= n // 4)
            rows.append((block, subject, float(start), *map(float, seen), float(start) + 1.0, 1.0, score, list(map(str, labels))))
    return spark.createDataFrame(rows, KINDS)


def long_form(df, cap):
    cut = annotate_labels(sweep_leases(df, TIMEOUTS), EVENT_ONTOLOGY)
    marked = mark_streams(cut, EVENT_ONTOLOGY, F.col("lease_timeout_s"), [C.DECISION_TIME])
    trace = action_trace(marked, LOCKED, order=[C.DECISION_TIME])
    episodes = epoch_episodes(trace, delay_cap_s=cap, keys=(C.BLOCK, C.SUBJECT, C.LEASE, "lease_timeout_s"))
    summary = overall_episodes(episode_summary(episodes, strata=False, extra=["lease_timeout_s"]))
    return action_metrics(trace, KEYS).select(*KEYS, *ACTION).join(summary.select(*KEYS, *EPISODES), KEYS)


@pytest.mark.parametrize("seed, batch", [(1, 7), (2, 64), (3, 10_000)])
def test_one_fold_equals_every_timeout(spark, seed, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        df = epochs(spark, seed)
        names = [*KEYS, *ACTION, *EPISODES]
        swept = timeout_metrics(annotate_labels(df, EVENT_ONTOLOGY), LOCKED, TIMEOUTS, 5.0)
        got = [tuple(r) for r in swept.select(*names).collect()]
        want = [tuple(r) for r in long_form(df, 5.0).select(*names).collect()]
        assert len(got) == len(TIMEOUTS) * len(LOCKED) and table(got, names) == table(want, names)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_timeouts_must_be_positive(spark):
    with pytest.raises(ValueError):
        timeout_metrics(annotate_labels(epochs(spark, 1, 40), EVENT_ONTOLOGY), LOCKED, [0.0], 5.0)


@pytest.mark.parametrize("name", ["lease_table", "lease_table_self_join", "lease_timeout_sweep"])
def test_epochs_are_not_multiplied(spark, name):
    out = QUERIES[name].run(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan
