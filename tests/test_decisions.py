"""Selection, calibration, bootstrap and scoring against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegate import columns as C
from pulsegate.config import CandidateSpec, SelectionTolerances, SpecLock
from pulsegate.operators import calibration as cal
from pulsegate.operators import contributions as contrib
from pulsegate.operators import resampling as boot
from pulsegate.operators import scoring
from pulsegate.operators.selection import cascade_selection, frontier_pick, pareto_frontier
from tests.walkers import walk_controller

VALUES = "benign_friction malicious_allow malicious_not_isolated episode_coverage median_capped_delay_s transitions_per_minute".split()
REFERENCE = dict(benign_friction=0.1, malicious_allow=0.3, malicious_not_isolated=0.4, episode_coverage=0.8, median_capped_delay_s=5.0, transitions_per_minute=4.0)


def _references(spark, **change):
    row = {**REFERENCE, **change}
    return spark.createDataFrame(
        [("ref", "controller_tune", 0.1, 0.001, True, *[float(row[v]) for v in VALUES])],
        "candidate string, split string, friction_budget double, friction_resolution double, reference_calibrated boolean, "
        + ", ".join(f"{v} double" for v in VALUES),
    )


def _candidates(spark, rows):
    data = []
    for i, change in enumerate(rows):
        row = {**REFERENCE, "transitions_per_minute": 2.0, **change}
        data.append((f"c{i}", "proposed", "controller_tune", 0.1, 1.0, *[float(row[v]) for v in VALUES]))
    return spark.createDataFrame(
        data,
        "candidate string, family string, split string, friction_budget double, false_restriction_episodes double, "
        + ", ".join(f"{v} double" for v in VALUES),
    )


@pytest.mark.parametrize(
    ("rows", "change", "status", "chosen"),
    [
        ([{"benign_friction": 0.01}], {}, "no_budget_matched_candidate", None),
        ([{"malicious_allow": 0.5}, {"malicious_allow": 0.4}], {}, "security_inferior", "c1"),
        ([{"malicious_not_isolated": 0.9}], {}, "isolation_inferior", "c0"),
        ([{"episode_coverage": 0.1}, {"episode_coverage": 0.6}], {}, "coverage_inferior", "c1"),
        ([{"median_capped_delay_s": 9.0}], {}, "delay_inferior", "c0"),
        ([{}, {"transitions_per_minute": 1.0}], {}, "selected", "c1"),
        ([{"transitions_per_minute": 3.9}], {}, "insufficient_transition_reduction", "c0"),
        ([{}], {"transitions_per_minute": 0.0}, "reference_churn_zero", "c0"),
        ([{"benign_friction": 0.0955, "transitions_per_minute": 1.0}, {"benign_friction": 0.1}], {}, "selected", "c1"),
    ],
)
def test_cascade_statuses(spark, rows, change, status, chosen):
    got = cascade_selection(_candidates(spark, rows), _references(spark, **change)).collect()
    assert [(r["status"], r["candidate"]) for r in got] == [(status, chosen)]


def test_cascade_refuses_uncalibrated_references_and_other_splits(spark):
    refs = _references(spark).withColumn("reference_calibrated", F.lit(False))
    with pytest.raises(Exception, match="calibrate"):
        cascade_selection(_candidates(spark, [{}]), refs).collect()
    with pytest.raises(Exception, match="tuning split"):
        cascade_selection(_candidates(spark, [{}]).withColumn("split", F.lit("test")), _references(spark)).collect()


def test_pareto_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    values = rng.integers(0, 6, (120, 4)) / 10.0
    names = ("malicious_exposure", "transitions_per_minute", "median_capped_delay_s")
    df = spark.createDataFrame(
        [(f"k{i:03d}", "f", "controller_tune", *map(float, v)) for i, v in enumerate(values)],
        "candidate string, family string, split string, benign_friction double, " + ", ".join(f"{n} double" for n in names),
    ).repartition(5)
    budgets = (0.1, 0.3, 0.5)
    front = pareto_frontier(df, budgets)
    got = {(r["friction_budget"], r["candidate"]) for r in front.collect()}
    want = set()
    for b in budgets:
        inside = [i for i in range(120) if values[i, 0] <= b]
        for i in inside:
            beaten = any((values[j, 1:] <= values[i, 1:]).all() and (values[j, 1:] < values[i, 1:]).any() for j in inside)
            if not beaten:
                want.add((b, f"k{i:03d}"))
    assert got == want
    for r in frontier_pick(front).collect():
        rows = [i for i in range(120) if (r["friction_budget"], f"k{i:03d}") in want]
        assert r["candidate"] == f"k{min(rows, key=lambda i: (*values[i, 1:], values[i, 0], i)):03d}"


@pytest.fixture(scope="module")
def tune(spark):
    rng = np.random.default_rng(8)
    rows = []
    for lease in range(60):
        for step in range(int(rng.integers(2, 15))):
            rows.append((0, lease, f"L{lease}", float(step + 1), 1.0, float(np.round(rng.beta(2, 4), 3)), bool(rng.random() < 0.3), "controller_tune"))
    kinds = f"{C.BLOCK} long, {C.SUBJECT} long, {C.LEASE} string, {C.DECISION_TIME} double, {C.DURATION} double, {C.SCORE} double, {C.IS_ATTACK} boolean, split string"
    return spark.createDataFrame(rows, kinds).persist(), rows


def _friction(rows, rule):
    held = total = 0.0
    leases = {}
    for r in rows:
        leases.setdefault(r[2], []).append(r)
    for steps in leases.values():
        want = walk_controller(rule, [(r[2], r[3], r[5]) for r in steps])
        acted = [0] + [w[1] for w in want[:-1]]
        held += sum(r[4] for r, a in zip(steps, acted) if not r[6] and a >= 1)
        total += sum(r[4] for r in steps if not r[6])
    return held / total


def test_bisection_matches_a_scalar_search(tune):
    df, rows = tune
    grid = [t for t in cal.templates({0.999: 0.9}) if t.template in {"stateless-template-000", "n_report-template-000", "symmetric_hysteresis-template-002", "proposed-template-011"}]
    found = cal.bisect_thresholds(cal.probe_table(df), grid, (0.05, 0.2), 9)
    assert len(found) == 8
    for c in found:
        low, high = c.template.bounds
        best = low
        if _friction(rows, c.template.at(low, "x").rule()) > c.friction_budget:
            best = high
            for _ in range(9):
                middle = (low + high) / 2
                if _friction(rows, c.template.at(middle, "x").rule()) <= c.friction_budget:
                    best = high = middle
                else:
                    low = middle
        assert c.calibrated_threshold == best
        assert c.calibration_friction == pytest.approx(_friction(rows, c.spec.rule()))


def test_infeasible_budget_gives_a_threshold_above_every_score(tune):
    df, rows = tune
    found = cal.stateless_thresholds(df, (1e-6,))[0]
    assert found.threshold > max(r[5] for r in rows if not r[6]) - 1e-9 or found.attainable == 0.0
    assert found.attainable == 0.0


def test_grid_sizes():
    assert len(cal.templates(dict(zip(cal.TEMPLATE_ISOLATE_QUANTILES, (0.8, 0.85, 0.9))))) == 120
    assert len(cal.broad_grid([(0.6, 0.8)])) == 1 + 1 + 3 + 4 + 3 + 32 + 27


def test_spec_lock():
    lock = SpecLock.of([CandidateSpec("a", "f", "stateless", {"restrict_threshold": 0.5, "isolate_threshold": 0.6})])
    assert SpecLock(lock.canonical_json, lock.sha256, lock.selection_partition).specs == lock.specs
    with pytest.raises(ValueError):
        SpecLock(lock.canonical_json + " ", lock.sha256, "controller_tune")
    with pytest.raises(ValueError):
        SpecLock.of(list(lock.specs), "test")


def test_generator_draws_repeat_numpy(spark):
    got = boot.generator_draws(spark, 37, 11, 1729).groupBy("replicate").agg(F.collect_list("block_idx").alias("b")).collect()
    want = np.random.default_rng(1729).integers(0, 11, size=(37, 11))
    assert {r["replicate"]: sorted(r["b"]) for r in got} == {i: sorted(w.tolist()) for i, w in enumerate(want)}
    import hashlib

    assert boot.draw_fingerprint(37, 11, 1729) == hashlib.sha256(want.tobytes()).hexdigest()


@pytest.mark.parametrize("blocks", [2, 3, 64, 1000, 3_000_000_000, (1 << 31) + 7])
def test_segments_skip_ahead_and_reject_like_numpy(blocks):
    """Ranges just above a power of two reject about half of the raw values."""
    want = np.random.default_rng(7).integers(0, blocks, size=500)
    parts = [boot.accepted_draws(7, at, 101, blocks) for at in range(0, 1515, 101)]
    assert np.concatenate(parts)[:500].tolist() == want.tolist()


@pytest.mark.parametrize("segment", [7, 64, 1 << 18])
def test_generator_draws_keep_their_replicate(spark, segment):
    got = boot.generator_draws(spark, 23, 13, 5, segment).groupBy("replicate").agg(F.collect_list("block_idx").alias("b")).collect()
    want = np.random.default_rng(5).integers(0, 13, size=(23, 13))
    assert {r["replicate"]: sorted(r["b"]) for r in got} == {i: sorted(w.tolist()) for i, w in enumerate(want)}


def test_contrast_intervals_match_numpy(spark):
    rng = np.random.default_rng(1)
    n, blocks = 300, 12
    p_num, r_num = rng.random(blocks), rng.random(blocks)
    p_den, r_den = rng.random(blocks) + (rng.random(blocks) < 0.8), rng.random(blocks) + 1
    contrast = boot.Contrast("d", "num", "den")
    rows = [(i, float(p_num[i]), float(p_den[i]), float(r_num[i]), float(r_den[i])) for i in range(blocks)]
    grid = spark.createDataFrame(rows, "block_idx int, p_num double, p_den double, r_num double, r_den double")
    draws = boot.contrast_draws(grid, boot.generator_draws(spark, n, blocks, 5), [contrast])
    got = boot.intervals(boot.contrast_estimates(grid, [contrast]), draws, n).first()
    idx = np.random.default_rng(5).integers(0, blocks, size=(n, blocks))
    values = p_num[idx].sum(1) / p_den[idx].sum(1) - r_num[idx].sum(1) / r_den[idx].sum(1)
    assert got["status"] == "ok" and got["valid_replicates"] == n
    assert got["estimate"] == pytest.approx(p_num.sum() / p_den.sum() - r_num.sum() / r_den.sum())
    np.testing.assert_allclose([got["ci_lower"], got["ci_upper"], got["one_sided_lower"], got["one_sided_upper"]], np.quantile(values, [0.025, 0.975, 0.05, 0.95]))


def test_interval_statuses(spark):
    grid = spark.createDataFrame([(0, 1.0, 0.0, 1.0, 1.0)], "block_idx int, p_num double, p_den double, r_num double, r_den double")
    contrast = boot.Contrast("d", "num", "den")
    few = spark.createDataFrame([(i, "d", 0.1 if i < 40 else None) for i in range(120)], "replicate long, metric string, value double")
    got = boot.intervals(boot.contrast_estimates(grid, [contrast]), few, 120).first()
    assert got["status"] == "undefined_zero_aggregate_denominator" and got["estimate"] is None and got["ci_lower"] is None
    full = grid.withColumn("p_den", F.lit(2.0))
    got = boot.intervals(boot.contrast_estimates(full, [contrast]), few, 120).first()
    assert got["status"] == "insufficient_valid_replicates" and got["gate_endpoint"] is None
    gates = boot.gate_decisions(boot.intervals(boot.contrast_estimates(full, [contrast]), few, 120), [boot.Gate("d", "max", 1.0)])
    assert gates.first()["status"] == "unknown"


def test_block_order_is_textual(spark):
    df = spark.createDataFrame([(b,) for b in (1, 2, 10, 11)], f"{C.BLOCK} long")
    got = boot.block_universe(df).orderBy("block_idx").collect()
    assert [r[C.BLOCK] for r in got] == [1, 10, 11, 2]


def test_unpaired_episodes_fail(spark):
    rows = [("p", "k1", 0, 1.0), ("r", "k1", 0, 2.0), ("p", "k2", 1, 1.0)]
    df = spark.createDataFrame(rows, "candidate string, episode_key string, onset_block_id long, capped_delay_s double")
    with pytest.raises(Exception, match="unpaired episode k2"):
        boot.paired_episodes(df, "p", "r").collect()


def test_negative_contributions_fail(spark):
    rows = [("p", 0, -1.0), ("r", 0, 1.0)]
    df = spark.createDataFrame(rows, f"candidate string, {C.BLOCK} long, x double")
    with pytest.raises(Exception, match="non-negative"):
        contrib.paired_grid(df, df, "p", "r", ["x"]).collect()


def test_holm(spark):
    p = [0.01, 0.04, 0.03, 0.5, 0.01]
    df = spark.createDataFrame(list(enumerate(p)), "i int, p double")
    order = np.argsort(p, kind="stable")
    ranked = np.minimum(np.maximum.accumulate((5 - np.arange(5)) * np.array(p)[order]), 1.0)
    want = np.empty(5)
    want[order] = ranked
    got = [r["p_adjusted"] for r in boot.holm(df).orderBy("i").collect()]
    np.testing.assert_allclose(got, want)


def test_logistic_matches_a_newton_solve(spark, tmp_path):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 2)) * [1.0, 3.0] + [0.0, 5.0]
    y = rng.random(400) < 1 / (1 + np.exp(-(0.5 + x[:, 0] - 0.3 * (x[:, 1] - 5))))
    rows = [(float(a), None if i % 17 == 0 else float(b), bool(t), "train" if i < 300 else "calibration") for i, ((a, b), t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, f"fa double, fb double, {C.IS_ATTACK} boolean, split string")
    model = scoring.fit_risk_model(df, ("fa", "fb"), universe=("fa", "fb"))
    z = np.array([[r[0], np.nan if r[1] is None else r[1]] for r in rows[:300]])
    z = np.where(np.isnan(z), np.nanmedian(z, axis=0), z)
    z = (z - z.mean(0)) / z.std(0)
    design, target, beta = np.c_[np.ones(300), z], y[:300].astype(float), np.zeros(3)
    ridge = np.diag([0.0, 1.0, 1.0])
    for _ in range(50):
        prob = 1 / (1 + np.exp(-design @ beta))
        beta -= np.linalg.solve(design.T * (prob * (1 - prob)) @ design + ridge, design.T @ (prob - target) + ridge @ beta)
    np.testing.assert_allclose([model.intercept, *model.coefficients], beta, atol=1e-5)
    calibrated = scoring.fit_platt(model, df)
    scoring.save_model(calibrated, str(tmp_path / "m.json"))
    again = scoring.load_model(spark, str(tmp_path / "m.json"), ("fa", "fb"))
    a = [r[C.SCORE] for r in calibrated.score(df).collect()]
    assert a == [r[C.SCORE] for r in again.score(df).collect()] and all(0 <= s <= 1 for s in a)
    with pytest.raises(scoring.LeakageError):
        scoring.fit_platt(model, df, "train")
    with pytest.raises(scoring.LeakageError):
        calibrated.with_tuning_partition("calibration")


@pytest.mark.parametrize("features", [(), ("x", "x"), ("mac_rnti",), ("attack_rate",), ("_x",), ("other",), ("gone",)])
def test_feature_firewall(features):
    columns = ["x", "mac_rnti", "attack_rate", "_x", "other"]
    with pytest.raises(scoring.FeatureError):
        scoring.check_features(columns, features, ("x", "mac_rnti", "attack_rate", "_x", "gone"))


def test_tolerances_are_validated():
    for bad in ({"budget_undershoot_relative": 1.0}, {"delay_noninferiority_s": -1.0}):
        with pytest.raises(ValueError):
            SelectionTolerances(**bad)
