from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegate import columns as C
from pulsegate.config import CandidateSpec, TraceRule
from pulsegate.operators.controllers import (
    action_trace,
    check_chronology,
    ewma_evidence,
    hysteresis_states,
    oversized_leases,
    replay_arrays,
)
from pulsegate.operators.episodes import epoch_episodes, mark_report_islands, mark_streams, report_episodes
from pulsegate.operators.epochs import annotate_labels, attack_streams, label_mask
from pulsegate.operators.metrics import access_metrics, action_metrics, with_previous_attack
from pulsegate.schema import Ontology
from tests.walkers import walk_controller, walk_epoch_episodes, walk_report_episodes

ONT = Ontology(benign=("calm",), attacks=("scan", "flood-x"))
ORDER = [C.DECISION_TIME]
SPECS = [
    CandidateSpec("raw", "stateless_reference", "stateless", {"restrict_threshold": 0.5, "isolate_threshold": 0.8}),
    CandidateSpec("slow", "proposed", "asymmetric_sequential", dict(restrict_enter=0.5, restrict_exit=0.4, isolate_enter=0.8, isolate_exit=0.6, recovery_reports=2, min_isolate_hold_s=2.0)),
    CandidateSpec("smooth", "ewma", "ewma", {"restrict_threshold": 0.5, "isolate_threshold": 0.7, "tau_s": 1.5}),
]
SCHEMA = f"{C.BLOCK} long, {C.SUBJECT} long, {C.LEASE} string, {C.DECISION_TIME} double, {C.DURATION} double, {C.SCORE} double, {C.LABELS} array<string>"


@pytest.fixture(scope="module")
def epochs(spark):
    rng = np.random.default_rng(9)
    rows = []
    for lease in range(40):
        t = 100.0 * lease
        for _ in range(int(rng.integers(1, 25))):
            t += float(rng.choice([1.0, 1.0, 1.0, 2.0, 4.0]))
            labels = [x for x, p in (("calm", 0.5), ("scan", 0.5), ("flood-x", 0.25)) if rng.random() < p] or ["calm"]
            score = math.nan if rng.random() < 0.1 else float(np.round(rng.random(), 2))
            rows.append((lease % 3, lease % 5, f"L{lease}", t, 1.0, score, sorted(labels)))
    return annotate_labels(spark.createDataFrame(rows, SCHEMA), ONT).persist(), rows


def _by_lease(trace, candidate):
    out = {}
    for r in sorted(trace, key=lambda r: r[C.DECISION_TIME]):
        if r[C.CANDIDATE] == candidate:
            out.setdefault(r[C.LEASE], []).append(r)
    return out


@pytest.mark.parametrize("specs", [SPECS, SPECS[:1]], ids=["fold", "window"])
def test_replay_matches_walker(epochs, specs):
    df, rows = epochs
    trace = action_trace(df, specs, order=ORDER).collect()
    assert len(trace) == len(rows) * len(specs)
    for spec in specs:
        for lease, steps in _by_lease(trace, spec.candidate).items():
            want = walk_controller(spec.rule(), [(lease, r[C.DECISION_TIME], r[C.SCORE]) for r in steps])
            assert [r["previous_state"] for r in steps] == [w[0] for w in want]
            assert [r["decision_state"] for r in steps] == [w[1] for w in want]
            assert [r["effective_state"] for r in steps] == [0] + [w[1] for w in want[:-1]]
            assert [r["lifecycle_start"] for r in steps] == [w[3] for w in want]
            for r, w in zip(steps, want):
                assert (r["evidence_score"] is None) == math.isnan(w[2])
                assert math.isnan(w[2]) or r["evidence_score"] == pytest.approx(w[2], abs=1e-12)


def test_window_forms_match_walker(epochs):
    df, _ = epochs
    smooth = SPECS[2].rule()
    spec = CandidateSpec("h", "h", "symmetric_hysteresis", {"restrict_center": 0.5, "isolate_center": 0.5, "half_width": 0.1})
    out = ewma_evidence(hysteresis_states(df, 0.6, 0.4, C.SCORE, ORDER), 1.5, C.SCORE, ORDER).collect()
    leases = {}
    for r in sorted(out, key=lambda r: r[C.DECISION_TIME]):
        leases.setdefault(r[C.LEASE], []).append(r)
    for lease, steps in leases.items():
        inputs = [(lease, r[C.DECISION_TIME], r[C.SCORE]) for r in steps]
        assert [r["decision_state"] for r in steps] == [w[1] for w in walk_controller(spec.rule(), inputs)]
        for r, w in zip(steps, walk_controller(smooth, inputs)):
            assert (r["evidence"] is None) == math.isnan(w[2])
            assert math.isnan(w[2]) or r["evidence"] == pytest.approx(w[2], abs=1e-9)


@pytest.mark.parametrize("gap", [0.0, 1.0, 3.0])
def test_epoch_episodes_match_walker(epochs, gap):
    df, _ = epochs
    trace = action_trace(mark_streams(df, ONT, gap, ORDER), SPECS, order=ORDER).persist()
    got = {}
    for r in epoch_episodes(trace, delay_cap_s=6.0).collect():
        key = (r[C.CANDIDATE], r["lease_id"], r["attack_type"])
        seen = (r["start_s"], r["end_s"], r["attack_epochs"], r["covered"], r["capped_delay_s"], r["exposure_before_containment_s"], r["pre_contained_at_onset"])
        got.setdefault(key, []).append((r["episode_sequence"], seen))
        assert r["reactively_covered"] == (r["covered"] and not r["pre_contained_at_onset"])
    want = {}
    rows = trace.collect()
    for spec in SPECS:
        for lease, steps in _by_lease(rows, spec.candidate).items():
            for name, mask in attack_streams(ONT):
                walked = walk_epoch_episodes(
                    [(r[C.DECISION_TIME], r[C.DURATION], r[mask], r["effective_state"], r["effective_previous_state"]) for r in steps], gap, 6.0
                )
                if walked:
                    want[(spec.candidate, lease, name)] = list(enumerate(walked))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_report_episodes_match_walker(epochs):
    df, _ = epochs
    trace = action_trace(mark_report_islands(df, ORDER), SPECS, order=ORDER).persist()
    got = {}
    for r in report_episodes(trace, delay_cap_s=3.0).collect():
        got.setdefault((r[C.CANDIDATE], r[C.LEASE]), []).append((r["start_s"], r["duration_s"], r["reports"], r["covered"], r["capped_delay_s"]))
    rows = trace.collect()
    for spec in SPECS:
        for lease, steps in _by_lease(rows, spec.candidate).items():
            walked = walk_report_episodes([(r[C.DECISION_TIME], r[C.DURATION], r[C.IS_ATTACK], r["effective_state"]) for r in steps], 3.0)
            assert sorted(got.get((spec.candidate, lease), [])) == walked


def test_metric_example(spark):
    """100 benign seconds with one restricted; 50 attack seconds: 10 ALLOW, 20 RESTRICT, 20 ISOLATE."""
    states = [0] * 50 + [1] + [0] * 49 + [0] * 10 + [1] * 20 + [2] * 20
    rows = [("p", "proposed", 0, 1, "L", float(t), 1.0, t >= 100, s, states[t - 1] if t else 0) for t, s in enumerate(states)]
    df = spark.createDataFrame(
        rows, f"candidate string, family string, {C.BLOCK} long, {C.SUBJECT} long, {C.LEASE} string, {C.DECISION_TIME} double, {C.DURATION} double, {C.IS_ATTACK} boolean, effective_state int, effective_previous_state int"
    ).withColumns({"effective_transitioned": F.expr("effective_state <> effective_previous_state"), "effective_severity_delta": F.expr("abs(effective_state - effective_previous_state)")})
    got = action_metrics(df).first()
    assert got["benign_friction"] == pytest.approx(0.01)
    assert got["malicious_allow"] == pytest.approx(0.20)
    assert got["malicious_not_isolated"] == pytest.approx(0.60)
    assert got["effective_transitions"] == 4
    access = access_metrics(with_previous_attack(df, order=ORDER)).first()
    assert access["false_restriction_episodes"] == 1
    assert access["transitions_per_minute"] == pytest.approx(4 / 150 * 60)


def test_ratios_without_a_class_are_null(spark, epochs):
    df, _ = epochs
    trace = action_trace(df.where(~F.col(C.IS_ATTACK)), SPECS[:1], order=ORDER)
    got = action_metrics(trace).first()
    assert got["malicious_allow"] is None and got["benign_friction"] is not None


@pytest.mark.parametrize("labels", [[], ["mystery"], None, ["calm", None]])
def test_bad_labels_fail(spark, labels):
    df = spark.createDataFrame([(labels,)], f"{C.LABELS} array<string>")
    with pytest.raises(Exception, match="labels"):
        annotate_labels(df, ONT).collect()


def test_contradicting_attack_flag_fails(spark):
    df = spark.createDataFrame([(["calm"], True)], f"{C.LABELS} array<string>, {C.IS_ATTACK} boolean")
    with pytest.raises(Exception, match="labels"):
        annotate_labels(df, ONT).collect()


def test_label_masks(spark):
    df = spark.createDataFrame([("calm",), ("flood-x",), (None,)], "label string")
    assert [r[0] for r in df.select(label_mask("label", ONT)).collect()] == [1, 4, 0]
    with pytest.raises(Exception, match="unknown label"):
        spark.createDataFrame([("?",)], "label string").select(label_mask("label", ONT)).collect()


def test_bounds_and_chronology_checks(epochs, spark):
    df, _ = epochs
    assert oversized_leases(df, TraceRule(max_block_seconds=200.0)).count() == 0
    assert oversized_leases(df, TraceRule(gap_seconds=1.0, max_block_seconds=4.0)).count() > 0
    assert tuple(check_chronology(df, ORDER).first()) == (0, 0)
    twice = df.withColumn(C.DURATION, F.lit(3.0))
    assert check_chronology(twice, ORDER).first()["overlaps"] > 0


def test_decreasing_time_fails_the_replay(spark):
    rows = [(0, 1, "L", 2.0, 1.0, 0.5, ["calm"])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert replay_arrays(df, SPECS, order=ORDER).count() == 1
