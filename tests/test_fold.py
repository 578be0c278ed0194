from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsegate.config import CandidateSpec, ControllerRule
from pulsegate.operators.fold import SortedFold
from tests.walkers import walk_controller

RULES = [
    CandidateSpec("a", "f", "stateless", {"restrict_threshold": 0.5, "isolate_threshold": 0.7}).rule(),
    CandidateSpec("b", "f", "ewma", {"restrict_threshold": 0.5, "isolate_threshold": 0.7, "tau_s": 2.0}).rule(),
    CandidateSpec("c", "f", "n_report", {"restrict_threshold": 0.5, "isolate_threshold": 0.7, "entry_reports": 2}).rule(),
    CandidateSpec("d", "f", "symmetric_hysteresis", {"restrict_center": 0.5, "isolate_center": 0.6, "half_width": 0.1}).rule(),
    ControllerRule(0.5, 0.3, 0.8, 0.6, entry_reports=1, recovery_reports=2, min_restrict_hold_s=2.0, min_isolate_hold_s=3.0),
    ControllerRule(0.5, 0.3, 0.8, 0.6, entry_reports=2, recovery_reports=1, entry_duration_s=1.5, recovery_duration_s=2.0, ewma_tau_s=1.0),
    ControllerRule(0.5, 0.3, 0.8, 0.6, initial_state=1),
]
report = st.tuples(st.sampled_from([0.0, 0.5, 1.0, 2.0]), st.one_of(st.just(math.nan), st.sampled_from([0.2, 0.3, 0.45, 0.5, 0.55, 0.65, 0.7, 0.9])))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(report, min_size=1, max_size=9), min_size=1, max_size=6), st.integers(1, 7))
def test_fold_matches_walker_across_batches(leases, size):
    rows = []
    for number, steps in enumerate(leases):
        t = 10.0 * number
        for dt, score in steps:
            t += dt
            rows.append((number, t, score))
    first = np.array([i == 0 or rows[i][0] != rows[i - 1][0] for i in range(len(rows))])
    t, x = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    fold = SortedFold(RULES)
    parts = [fold.run(first[i : i + size], t[i : i + size], x[i : i + size]) for i in range(0, len(rows), size)]
    for c, rule in enumerate(RULES):
        want = walk_controller(rule, rows)
        assert np.concatenate([p.previous[:, c] for p in parts]).tolist() == [w[0] for w in want]
        assert np.concatenate([p.decision[:, c] for p in parts]).tolist() == [w[1] for w in want]
        np.testing.assert_allclose(np.concatenate([p.evidence[:, c] for p in parts]), [w[2] for w in want], atol=1e-12)
        acted = [0 if w[3] else want[i - 1][1] for i, w in enumerate(want)]
        older = [0 if w[3] else acted[i - 1] for i, w in enumerate(want)]
        assert np.concatenate([p.effective[:, c] for p in parts]).tolist() == acted
        assert np.concatenate([p.previous_effective[:, c] for p in parts]).tolist() == older


def test_worked_example():
    rule = ControllerRule(0.95, 0.90, 1.5, 1.0, recovery_reports=2)
    scores = [0.20, 0.96, 0.89, 0.96, 0.89, 0.88, 0.20]
    out = SortedFold([rule]).run(np.arange(7) == 0, np.arange(7.0), np.array(scores))
    assert out.decision[:, 0].tolist() == [0, 1, 1, 1, 1, 0, 0]
    assert out.effective[:, 0].tolist() == [0, 0, 1, 1, 1, 1, 0]


def test_time_must_not_fall_within_a_lease():
    with pytest.raises(ValueError, match="decrease"):
        SortedFold(RULES).run(np.array([True, False]), np.array([2.0, 1.0]), np.array([0.1, 0.1]))


def test_partition_must_open_with_a_lease():
    with pytest.raises(ValueError, match="open"):
        SortedFold(RULES).run(np.array([False]), np.array([2.0]), np.array([0.1]))


def test_smoothing_gain():
    rule = CandidateSpec("b", "f", "ewma", {"restrict_threshold": 0.9, "isolate_threshold": 0.95, "tau_s": 2.0}).rule()
    out = SortedFold([rule]).run(np.array([True, False]), np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    assert out.evidence[1, 0] == pytest.approx(0.3934693, abs=1e-6)


@pytest.mark.parametrize(
    "change",
    [
        {"restrict_exit": 0.6},
        {"isolate_exit": 0.9},
        {"restrict_enter": 0.9},
        {"entry_reports": 0},
        {"recovery_reports": 1.5},
        {"min_restrict_hold_s": -1.0},
        {"ewma_tau_s": 0.0},
        {"initial_state": 3},
        {"isolate_enter": math.nan},
    ],
)
def test_controller_rule_is_validated(change):
    good = {"restrict_enter": 0.5, "restrict_exit": 0.4, "isolate_enter": 0.8, "isolate_exit": 0.7}
    ControllerRule(**good)
    with pytest.raises(ValueError):
        ControllerRule(**(good | change))
