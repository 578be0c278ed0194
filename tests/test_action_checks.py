"""Action checks in one pass against their definitions, on clean and broken tables."""

from __future__ import annotations

import pytest

from pulsegate import columns as C
from pulsegate.operators.integrity import EPOCH_KEY, action_checks, check_table

KEYS = f"{C.BLOCK} long, {C.LEASE} string, {C.SUBJECT} long, {C.DECISION_TIME} double"
ACTIONS = f"{C.CANDIDATE} string, {KEYS}, decision_state int, effective_state int"
EPOCHS = [(0, "a", 1, 1.0), (0, "a", 1, 2.0), (0, "b", 2, 1.0)]
TRACE = [(c, *e, 1, int(e[3] > 1)) for c in "xy" for e in EPOCHS]
NAMES = (
    "every candidate acts on every epoch",
    "candidate and epoch keys are unique",
    "actions are ALLOW, RESTRICT or ISOLATE",
    "effective action is the previous decision",
)


@pytest.mark.parametrize(
    "trace, epochs, want",
    [
        (TRACE, EPOCHS, (0, 0, 0, 0)),
        (TRACE[1:], EPOCHS, (1, 0, 0, 1)),
        ([*TRACE, TRACE[2]], EPOCHS, (1, 1, 0, 1)),
        (TRACE, [*EPOCHS, EPOCHS[0]], (0, 0, 0, 0)),
        (TRACE[1:], [*EPOCHS, EPOCHS[0]], (2, 0, 0, 1)),
        (TRACE, EPOCHS[1:], (0, 0, 0, 0)),
        ([*TRACE, ("x", 0, "c", 3, 1.0, 0, 0)], EPOCHS, (1, 0, 0, 0)),
        ([*TRACE[:-1], (*TRACE[-1][:-1], 3)], EPOCHS, (0, 0, 1, 1)),
        ([*TRACE, *[(c, 0, None, 2, 5.0, 0, 0) for c in "xy"]], [*EPOCHS, (0, None, 2, 5.0)], (1, 0, 0, 0)),
        ([], EPOCHS, (3, 0, 0, 0)),
        ([], [], (0, 0, 0, 0)),
    ],
)
def test_violations(spark, trace, epochs, want):
    rows = check_table(action_checks(spark.createDataFrame(trace, ACTIONS), spark.createDataFrame(epochs, KEYS), 2)).collect()
    assert {r["check"]: r["violations"] for r in rows} == dict(zip(NAMES, want))


def test_actions_are_placed_once(spark):
    trace, epochs = spark.createDataFrame(TRACE, ACTIONS), spark.createDataFrame(EPOCHS, KEYS)
    for table in action_checks(trace, epochs, 2):
        rows = table._jdf.queryExecution().executedPlan().toString()
        # By lease, and the last sum of all.
        assert rows.count("Exchange ") == 2 and "Join" not in rows


def test_epoch_key():
    assert set(EPOCH_KEY) == {C.BLOCK, C.LEASE, C.SUBJECT, C.DECISION_TIME}
