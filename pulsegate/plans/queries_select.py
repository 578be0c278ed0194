"""Queries: threshold calibration, candidate grids, selection rules, lease sweep."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegate import columns as C
from pulsegate.config import CandidateSpec, SelectionTolerances, TraceRule
from pulsegate.functions.quantiles import exact_quantiles
from pulsegate.functions.quantiles import weighted_median as exact_weighted_median
from pulsegate.operators import calibration as cal
from pulsegate.operators import selection as sel
from pulsegate.operators.metrics import BY_CANDIDATE
from pulsegate.operators.reports import lease_timeout_table, per_thousand, timeout_contrast
from pulsegate.plans import sql
from pulsegate.plans.registry import query
from pulsegate.plans.sql import r6, with_recursive
from pulsegate.plans.study import DELAY_CAP_S, EPOCH, LOCKED, RULE, Study

TUNE = "split = 'controller_tune'"
# Budgets that fit the event scores: a raw 0.6 threshold contains about a fifth of benign time.
BUDGETS = (0.05, 0.1, 0.2, 0.3)


def _specs_at(level: float, tag: str) -> list[CandidateSpec]:
    """One candidate per family entered near ``level`` (two releases for the proposal)."""
    both = {"restrict_threshold": level, "isolate_threshold": level}
    release = {"restrict_enter": level, "isolate_enter": 0.85, "entry_reports": 1}
    return [
        CandidateSpec(f"stateless-{tag}", "stateless", "stateless", both),
        CandidateSpec(f"ewma-{tag}", "ewma", "ewma", {**both, "tau_s": EPOCH}),
        CandidateSpec(
            f"n_report-{tag}", "n_report", "n_report", {**both, "entry_reports": 2, "recovery_reports": 2}
        ),
        CandidateSpec(
            f"symmetric-{tag}",
            "symmetric_hysteresis",
            "symmetric_hysteresis",
            {"restrict_center": level - 0.025, "isolate_center": level - 0.025, "half_width": 0.025},
        ),
        *[
            CandidateSpec(
                f"proposed-{tag}-{i}",
                "proposed",
                "asymmetric_sequential",
                {**release, "restrict_exit": level - margin, "isolate_exit": 0.85 - margin, "recovery_reports": n},
            )
            for i, (margin, n) in enumerate(((0.005, 1), (0.025, 2)))
        ],
    ]


LEVELS = {0.05: 0.74, 0.1: 0.69, 0.2: 0.62, 0.3: 0.55}
DECLARED = [(spec, budget) for budget, level in LEVELS.items() for spec in _specs_at(level, f"B{budget:g}")]
GRID = [spec for spec, _ in DECLARED]

_METRICS = f"{sql.trace(GRID, where=TUNE)}, {sql.candidate_metrics(DELAY_CAP_S)}"
_VALUES = (
    "benign_friction malicious_allow malicious_not_isolated transitions_per_minute episode_coverage median_capped_delay_s"
).split()


def tune_metrics(s: Study) -> DataFrame:
    return cal.candidate_metrics(s.split("controller_tune"), GRID, delay_cap_s=DELAY_CAP_S)


def declared_metrics(s: Study) -> DataFrame:
    budgets = F.create_map(*[x for spec, b in DECLARED for x in (F.lit(spec.candidate), F.lit(b))])
    return tune_metrics(s).withColumn("friction_budget", F.element_at(budgets, F.col(C.CANDIDATE)))


# -- thresholds and grids -------------------------------------------------------------------

_MASS = f"""{sql.epochs()}, tn AS (SELECT *, lag(risk_score) OVER (PARTITION BY rnti_lease_id ORDER BY decision_time_s) AS acted
    FROM epochs WHERE {TUNE}),
bt AS (SELECT sum(epoch_seconds) AS total, max(epoch_seconds) AS step FROM tn WHERE NOT is_attack_epoch),
mass AS (SELECT acted AS score, sum(epoch_seconds) AS seconds FROM tn WHERE NOT is_attack_epoch AND acted IS NOT NULL GROUP BY 1),
cum AS (SELECT *, sum(seconds) OVER (ORDER BY score DESC) AS cum_s, lead(seconds) OVER (ORDER BY score DESC) AS next_s FROM mass),
budgets(b) AS (VALUES {', '.join(f'({b}::DOUBLE)' for b in BUDGETS)}),
thr AS (SELECT b, min(score) AS threshold, max(cum_s) / any_value(total) AS attainable,
          coalesce(arg_max(next_s, cum_s), 0) / any_value(total) AS next_jump, any_value(step) / any_value(total) AS resolution
        FROM budgets, cum, bt WHERE cum_s / total <= b + 1e-12 GROUP BY b)"""


@query(
    "score_mass",
    f"WITH {_MASS} SELECT {r6('score')}, seconds, cum_s FROM cum",
)
def score_mass(s: Study):
    """Benign seconds per distinct lagged score, accumulated from the top."""
    return cal.benign_score_mass(s.split("controller_tune")).select("score", "seconds", "cum_s")


@query(
    "stateless_threshold",
    f"""WITH {_MASS} SELECT b AS friction_budget, {r6('threshold')}, {r6('attainable')}, {r6('next_jump')}, {r6('resolution')} FROM thr""",
)
def stateless_threshold(s: Study):
    found = cal.stateless_thresholds(s.split("controller_tune"), BUDGETS)
    rows = [(r.friction_budget, r.threshold, r.attainable, r.next_jump, r.resolution) for r in found]
    kinds = "friction_budget double, threshold double, attainable double, next_jump double, resolution double"
    return s.spark.createDataFrame(rows, kinds)


_REFERENCE = f"""{_MASS},
rt AS (SELECT 'stateless-reference-' || CAST(CAST(b AS DECIMAL(9,2)) AS DOUBLE) AS candidate, 'stateless_reference' AS family, tn.*,
    CASE WHEN coalesce(acted >= threshold, false) THEN 2 ELSE 0 END AS effective_state,
    CASE WHEN coalesce(lag(risk_score, 2) OVER (PARTITION BY b, rnti_lease_id ORDER BY decision_time_s) >= threshold, false)
      THEN 2 ELSE 0 END AS effective_previous_state,
    lag(is_attack_epoch) OVER (PARTITION BY b, rnti_lease_id ORDER BY decision_time_s) AS prev_attack
  FROM tn, thr),
{sql.candidate_metrics(DELAY_CAP_S, "rt")},
refs AS (SELECT m.*, b AS friction_budget, threshold AS restrict_threshold, resolution AS friction_resolution,
    next_jump AS next_boundary_jump, benign_friction >= b * 0.95 - resolution - 1e-12 AS reference_calibrated
  FROM metrics m JOIN thr ON m.candidate = 'stateless-reference-' || CAST(CAST(b AS DECIMAL(9,2)) AS DOUBLE))"""


@query(
    "stateless_references",
    f"""WITH {_REFERENCE} SELECT candidate, family, transitions, false_restriction_episodes, attack_episodes, reference_calibrated,
    'controller_tune' AS split, {', '.join(r6(v) for v in _VALUES)}, {r6('severity_transitions_per_minute')},
    {r6('friction_budget')}, {r6('restrict_threshold')}, {r6('friction_resolution')}, {r6('next_boundary_jump')},
    {r6('benign_friction / friction_budget', 'budget_utilization')}, {r6('friction_budget - benign_friction', 'budget_gap')} FROM refs""",
)
def stateless_references(s: Study):
    return cal.stateless_references(s.split("controller_tune"), BUDGETS, delay_cap_s=DELAY_CAP_S)


@query(
    "benign_quantiles",
    f"""WITH {sql.epochs()} SELECT split, count(*) AS n, {', '.join(r6(f'quantile_cont(risk_score, {p})', f'q{i}')
      for i, p in enumerate((0.5, 0.9, 0.99, 0.999)))} FROM epochs WHERE NOT is_attack_epoch GROUP BY 1""",
)
def benign_quantiles(s: Study):
    """Exact benign score quantiles per split from the range-partitioned counts."""
    q = exact_quantiles(s.epochs.where(~F.col(C.IS_ATTACK)), [C.SPLIT], C.SCORE, (0.5, 0.9, 0.99, 0.999))
    return q.select(C.SPLIT, "n", *[F.col("q")[i].alias(f"q{i}") for i in range(4)])


@query(
    "weighted_median",
    f"""WITH {sql.epochs()}, x AS (SELECT split, value, unnest(range(samples_in_epoch)) AS copy FROM epochs)
    SELECT split, count(*) AS n, {r6('median(value)', 'median')} FROM x GROUP BY 1""",
)
def weighted_median(s: Study):
    """Median of epoch values weighted by their number of reports, without repeating rows."""
    return exact_weighted_median(s.epochs, [C.SPLIT], "value", C.SAMPLES)


@query(
    "threshold_pairs",
    f"""WITH {sql.epochs()}, bn AS (SELECT risk_score AS x FROM epochs WHERE {TUNE} AND NOT is_attack_epoch),
    q AS (SELECT quantile_cont(x, {list(cal.RESTRICT_QUANTILES)}) AS r, quantile_cont(x, {list(cal.ISOLATE_QUANTILES)}) AS i FROM bn),
    rr AS (SELECT unnest(r) AS r FROM q), ii AS (SELECT unnest(i) AS i FROM q)
    SELECT DISTINCT {r6('r', 'restrict_threshold')}, {r6('i', 'isolate_threshold')} FROM (
      SELECT r, i FROM rr, ii WHERE i + 1e-12 >= r UNION ALL SELECT r, r FROM rr)""",
)
def threshold_pairs(s: Study):
    pairs = cal.threshold_pairs(s.split("controller_tune"))
    rounded = sorted({(round(a, 6), round(b, 6)) for a, b in pairs})
    return s.spark.createDataFrame(rounded, "restrict_threshold double, isolate_threshold double")


_PAIRS = f"""{sql.epochs()}, bn AS (SELECT risk_score AS x FROM epochs WHERE {TUNE} AND NOT is_attack_epoch),
    q AS (SELECT quantile_cont(x, {list(cal.RESTRICT_QUANTILES)}) AS r, quantile_cont(x, {list(cal.ISOLATE_QUANTILES)}) AS i FROM bn),
    rr AS (SELECT unnest(r) AS r FROM q), ii AS (SELECT unnest(i) AS i FROM q),
    pairs AS (SELECT DISTINCT round(r, 9) AS r, round(i, 9) AS i FROM (SELECT r, i FROM rr, ii WHERE i + 1e-12 >= r UNION ALL SELECT r, r FROM rr))"""


@query(
    "broad_grid",
    f"""WITH {_PAIRS} SELECT 'stateless' AS family, 'stateless' AS controller, count(*) + 1 AS candidates FROM pairs
    UNION ALL SELECT 'n_report', 'n_report', 3 * count(*) FROM pairs UNION ALL SELECT 'ewma', 'ewma', 4 * count(*) FROM pairs
    UNION ALL SELECT 'symmetric_hysteresis', 'symmetric_hysteresis', count(*) FROM pairs, (VALUES (0.01), (0.025), (0.05)) h(h) WHERE r - 2 * h >= 0
    UNION ALL SELECT 'proposed', 'asymmetric_sequential', 59 * count(*) FROM pairs""",
)
def broad_grid(s: Study):
    """Size of every family of the broad grid over the data's own threshold pairs."""
    specs = cal.broad_grid(cal.threshold_pairs(s.split("controller_tune")), EPOCH)
    rows = [(x.candidate, x.family, x.controller) for x in specs]
    df = s.spark.createDataFrame(rows, "candidate string, family string, controller string")
    return df.groupBy(C.FAMILY, "controller").agg(F.count(F.lit(1)).alias("candidates"))


# The broad grid written out from its definition: families over pairs, numbered along the sorted pairs.
_BROAD = f"""{_PAIRS[len(sql.epochs()) + 2 :]},
    placed AS (SELECT r, i, row_number() OVER (ORDER BY r, i) - 1 AS p FROM pairs),
    made AS (
      SELECT 'stateless' AS family, 'stateless' AS controller_kind, -1 AS p, 0 AS k, 1.1 AS re, 1.1 AS rx, 1.2 AS ie, 1.2 AS ix, 1 AS en, 1 AS rn,
          0.0 AS hr, NULL::DOUBLE AS tau, false AS staged
      UNION ALL SELECT 'stateless', 'stateless', p, 0, r, r, i, i, 1, 1, 0, NULL, false FROM placed
      UNION ALL SELECT 'n_report', 'n_report', p, n, r, r, i, i, n, n, 0, NULL, true FROM placed, (VALUES (2), (3), (5)) v(n)
      UNION ALL SELECT 'ewma', 'ewma', p, k, r, r, i, i, 1, 1, 0, t * {EPOCH}, false FROM placed, (VALUES (0, 0.5), (1, 1.0), (2, 2.0), (3, 5.0)) v(k, t)
      UNION ALL SELECT 'symmetric_hysteresis', 'symmetric_hysteresis', p, k, r, r - 2 * h, i, i - 2 * h, 1, 1, 0, NULL, true
        FROM placed, (VALUES (0, 0.01), (1, 0.025), (2, 0.05)) v(k, h) WHERE r - 2 * h >= 0
      UNION ALL SELECT 'proposed', 'asymmetric_sequential', p, k, r, greatest(0, r - m), i, greatest(greatest(0, r - m), i - m), en, rn,
          hold * {EPOCH}, t * {EPOCH}, true
        FROM placed, (SELECT 0.05 AS m, row_number() OVER (ORDER BY t NULLS FIRST, en, rn, hold) AS k, en, rn, hold, t
                  FROM (VALUES (NULL::DOUBLE), (0.5), (2.0), (5.0)) a(t), (VALUES (1), (2)) b(en), (VALUES (3), (5)) c(rn), (VALUES (2.0), (5.0)) d(hold)
                  UNION ALL SELECT m, 100 + row_number() OVER (ORDER BY rn, hold, m), 1, rn, hold, NULL
                  FROM (VALUES (0.005), (0.01), (0.025)) a(m), (VALUES (1), (2), (3)) c(rn), (VALUES (0.0), (1.0), (2.0)) d(hold))),
    cand AS MATERIALIZED (SELECT family || '-' || lpad((row_number() OVER (PARTITION BY family ORDER BY p, k) - 1)::VARCHAR, 4, '0') AS candidate,
        family, controller_kind, re::DOUBLE AS re, rx::DOUBLE AS rx, ie::DOUBLE AS ie, ix::DOUBLE AS ix, en, rn, hr::DOUBLE AS hr, hr::DOUBLE AS hi,
        tau::DOUBLE AS tau, staged FROM made)"""


def _within_family(metrics: str, select: str) -> str:
    """Selection stages over ``metrics``; ``select`` reads the ranked table ``s4``."""
    return with_recursive(
        metrics,
        f""", pb AS (SELECT m.*, b AS friction_budget FROM metrics m, (VALUES {', '.join(f'({b}::DOUBLE)' for b in BUDGETS)}) t(b)
          WHERE benign_friction <= b),
        s1 AS (SELECT *, min(malicious_allow) OVER (PARTITION BY friction_budget, family) AS ba FROM pb),
        s2 AS (SELECT *, max(episode_coverage) OVER (PARTITION BY friction_budget, family) AS bc FROM s1 WHERE malicious_allow <= ba + 0.02),
        s3 AS (SELECT *, min(median_capped_delay_s) OVER (PARTITION BY friction_budget, family) AS bd FROM s2
          WHERE episode_coverage >= bc - 0.05),
        s4 AS (SELECT *, row_number() OVER (PARTITION BY friction_budget, family ORDER BY transitions_per_minute, malicious_allow,
          malicious_not_isolated, benign_friction, candidate) AS rk FROM s3 WHERE median_capped_delay_s <= bd + {EPOCH})
        {select}""",
    )


_WITHIN = f"""SELECT friction_budget, family, candidate, {', '.join(r6(v) for v in _VALUES)}, {r6('ba', 'best_family_malicious_allow')},
          {r6('bc', 'best_security_set_episode_coverage')} FROM s4 WHERE rk = 1"""


def _selected(metrics: DataFrame) -> DataFrame:
    out = sel.within_family(metrics, BUDGETS, delay_margin_s=EPOCH)
    best = ("best_family_malicious_allow", "best_security_set_episode_coverage")
    return out.select("friction_budget", C.FAMILY, C.CANDIDATE, *_VALUES, *best)


@query("broad_search", _within_family(f"{sql.trace(_BROAD, where=TUNE)}, {sql.candidate_metrics(DELAY_CAP_S)}", _WITHIN))
def broad_search(s: Study):
    """Metrics of every candidate of the broad grid over all threshold pairs, then within-family selection."""
    tune = s.split("controller_tune")
    specs = cal.broad_grid(cal.threshold_pairs(tune), EPOCH)
    return _selected(cal.candidate_metrics(tune, specs, delay_cap_s=DELAY_CAP_S))


@query("bisection_calibration")
def bisection_calibration(s: Study):
    """Calibrated threshold of every template and budget, one job per iteration."""
    tune = s.split("controller_tune")
    table = cal.probe_table(tune)
    found = cal.bisect_thresholds(table, cal.data_templates(tune, EPOCH), BUDGETS)
    rows = [
        (c.spec.candidate, c.spec.family, c.friction_budget, c.calibrated_threshold, c.calibration_friction, c.budget_slack)
        for c in found
    ]
    kinds = (
        "candidate string, family string, friction_budget double, calibrated_threshold double, "
        "calibration_friction double, budget_slack double"
    )
    return s.spark.createDataFrame(rows, kinds)


# -- selection ------------------------------------------------------------------------------


@query("within_family_selection", _within_family(_METRICS, _WITHIN))
def within_family_selection(s: Study):
    return _selected(tune_metrics(s))


_DECLARED = (
    "dm AS (SELECT m.*, d.b AS friction_budget FROM metrics m JOIN (VALUES "
    + ", ".join(f"('{x.candidate}', {b}::DOUBLE)" for x, b in DECLARED)
    + ") d(candidate, b) USING (candidate))"
)


@query(
    "matched_selection",
    with_recursive(
        f"{_METRICS}, {_DECLARED}",
        f""", rf AS (SELECT * FROM dm WHERE family = 'stateless'),
        pr AS (SELECT m.*, r.malicious_allow AS ra, r.malicious_not_isolated AS ri, r.transitions_per_minute AS rt,
            m.episode_coverage >= r.episode_coverage - 0.03 AND m.median_capped_delay_s <= r.median_capped_delay_s + {EPOCH} AS ok
          FROM dm m JOIN rf r USING (friction_budget)),
        cm AS (SELECT *, row_number() OVER (PARTITION BY friction_budget, family ORDER BY malicious_allow, transitions_per_minute,
            malicious_not_isolated, candidate) AS rk FROM (SELECT *, bool_or(ok) OVER (PARTITION BY friction_budget, family) AS anyok
            FROM pr WHERE family IN ('n_report', 'ewma', 'symmetric_hysteresis')) WHERE ok OR NOT anyok),
        pp AS (SELECT *, row_number() OVER (PARTITION BY friction_budget ORDER BY transitions_per_minute, malicious_allow,
            malicious_not_isolated, candidate) AS rk FROM pr WHERE family = 'proposed' AND ok AND malicious_allow <= ra + 0.05
            AND malicious_not_isolated <= ri + 0.3)
        SELECT friction_budget, family, candidate, 'reference' AS selection_role, {r6('transitions_per_minute')},
          NULL::DOUBLE AS churn_reduction_vs_stateless, NULL::BOOLEAN AS passes_minimum_churn_reduction FROM rf
        UNION ALL SELECT friction_budget, family, candidate, 'comparator', {r6('transitions_per_minute')}, NULL, NULL FROM cm WHERE rk = 1
        UNION ALL SELECT friction_budget, family, candidate, 'proposed', {r6('transitions_per_minute')},
          round(1 - transitions_per_minute / rt, 6) + 0.0, 1 - transitions_per_minute / rt >= 0.25 FROM pp WHERE rk = 1""",
    ),
)
def matched_selection(s: Study):
    out = sel.matched_selection(declared_metrics(s), allow_margin=0.05, isolation_margin=0.3, delay_margin_s=EPOCH)
    return out.select(
        "friction_budget",
        C.FAMILY,
        C.CANDIDATE,
        "selection_role",
        "transitions_per_minute",
        "churn_reduction_vs_stateless",
        "passes_minimum_churn_reduction",
    )


TOLERANCES = SelectionTolerances(
    budget_undershoot_relative=0.6,
    security_noninferiority_abs=0.05,
    isolation_noninferiority_abs=0.3,
    delay_noninferiority_s=EPOCH,
    minimum_transition_reduction=0.1,
)

_RENAMED_REFS = _REFERENCE[len(_MASS) :]
for _name in ("runs", "run_sums", "report_episodes", "sums", "eps", "metrics"):
    _RENAMED_REFS = re.sub(rf"\b{_name}\b", f"r_{_name}", _RENAMED_REFS)
_MASS_TAIL = _MASS[len(sql.epochs()) :]

_CASCADE = f"""{_METRICS}, {_DECLARED}{_MASS_TAIL}{_RENAMED_REFS},
grid AS (SELECT f.family, r.* EXCLUDE (family) FROM refs r, (VALUES ('ewma'), ('n_report'), ('proposed'), ('symmetric_hysteresis')) f(family)),
j AS (SELECT g.family, g.friction_budget AS b, g.friction_resolution AS res, g.candidate AS rc, g.benign_friction AS rf,
    g.malicious_allow AS ra, g.malicious_not_isolated AS ri, g.episode_coverage AS rcov, g.median_capped_delay_s AS rd,
    g.transitions_per_minute AS rt, m.candidate, m.benign_friction, m.malicious_allow, m.malicious_not_isolated, m.episode_coverage,
    m.median_capped_delay_s, m.transitions_per_minute, m.false_restriction_episodes
  FROM grid g LEFT JOIN dm m ON m.family = g.family AND abs(m.friction_budget - g.friction_budget) <= 1e-12),
c1 AS (SELECT *, coalesce(benign_friction BETWEEN b * (1 - 0.6) - res - 1e-12 AND b + res + 1e-12, false) AS w FROM j),
c2 AS (SELECT *, w AND malicious_allow <= ra + 0.05 + 1e-12 AS s FROM c1),
c3 AS (SELECT *, s AND malicious_not_isolated <= ri + 0.3 + 1e-12 AS i FROM c2),
c4 AS (SELECT *, i AND episode_coverage >= rcov - 0.05 - 1e-12 AS c FROM c3),
c5 AS (SELECT *, c AND median_capped_delay_s <= rd + {EPOCH} + 1e-12 AS d FROM c4),
c6 AS (SELECT *, min(CASE WHEN d THEN abs(benign_friction - b) END) OVER (PARTITION BY b, family) AS near FROM c5),
c7 AS (SELECT *, coalesce(d AND abs(benign_friction - b) <= near + res + 1e-12, false) AS f FROM c6),
n AS (SELECT b, family, any_value(rc) AS rc, any_value(rt) AS rt, count(*) FILTER (w) AS nw, count(*) FILTER (s) AS ns,
    count(*) FILTER (i) AS ni, count(*) FILTER (c) AS nc, count(*) FILTER (d) AS nd, count(*) FILTER (f) AS nf,
    CASE WHEN count(*) FILTER (w) = 0 THEN NULL
      WHEN count(*) FILTER (s) = 0 THEN arg_min(candidate, ROW(malicious_allow, transitions_per_minute, candidate)) FILTER (w)
      WHEN count(*) FILTER (i) = 0 THEN arg_min(candidate, ROW(malicious_not_isolated, transitions_per_minute, candidate)) FILTER (s)
      WHEN count(*) FILTER (c) = 0 THEN arg_min(candidate, ROW(-episode_coverage, transitions_per_minute, candidate)) FILTER (i)
      WHEN count(*) FILTER (d) = 0 THEN arg_min(candidate, ROW(median_capped_delay_s, transitions_per_minute, candidate)) FILTER (c)
      ELSE arg_min(candidate, ROW(transitions_per_minute, false_restriction_episodes, malicious_allow, candidate)) FILTER (f) END AS chosen
  FROM c7 GROUP BY b, family)"""


@query(
    "cascade_selection",
    with_recursive(
        _CASCADE,
        f"""SELECT n.b AS friction_budget, n.family, n.chosen AS candidate, n.rc AS reference_candidate,
        nw AS budget_matched_count, ns AS security_noninferior_count, ni AS isolation_noninferior_count,
        nc AS coverage_noninferior_count, nd AS delay_noninferior_count, nf AS closest_budget_stratum_count,
        CASE WHEN nw = 0 THEN 'no_budget_matched_candidate' WHEN ns = 0 THEN 'security_inferior' WHEN ni = 0 THEN 'isolation_inferior'
          WHEN nc = 0 THEN 'coverage_inferior' WHEN nd = 0 THEN 'delay_inferior' WHEN n.rt <= 1e-12 THEN 'reference_churn_zero'
          WHEN 1 - m.transitions_per_minute / n.rt + 1e-12 >= 0.1 THEN 'selected' ELSE 'insufficient_transition_reduction' END AS status,
        {r6('m.benign_friction', 'benign_friction')}, {r6('m.transitions_per_minute', 'transitions_per_minute')},
        {r6('1 - m.transitions_per_minute / n.rt', 'transition_reduction')}
        FROM n LEFT JOIN metrics m ON m.candidate = n.chosen""",
    ),
)
def cascade_selection(s: Study):
    refs = cal.stateless_references(s.split("controller_tune"), BUDGETS, delay_cap_s=DELAY_CAP_S)
    out = sel.cascade_selection(declared_metrics(s), refs, TOLERANCES)
    counts = [f"{x}_count" for x in sel.STAGES]
    return out.select(
        "friction_budget",
        C.FAMILY,
        C.CANDIDATE,
        "reference_candidate",
        *counts,
        "closest_budget_stratum_count",
        "status",
        "benign_friction",
        "transitions_per_minute",
        "transition_reduction",
    )


_BUDGETED = f"""bm AS (SELECT m.*, b AS friction_budget FROM metrics m, (VALUES {', '.join(f'({b}::DOUBLE)' for b in BUDGETS)}) t(b)
    WHERE benign_friction <= b),
front AS (SELECT * FROM bm x WHERE NOT EXISTS (SELECT 1 FROM bm y WHERE y.friction_budget = x.friction_budget
    AND y.malicious_allow <= x.malicious_allow AND y.transitions_per_minute <= x.transitions_per_minute
    AND y.median_capped_delay_s <= x.median_capped_delay_s AND (y.malicious_allow < x.malicious_allow
      OR y.transitions_per_minute < x.transitions_per_minute OR y.median_capped_delay_s < x.median_capped_delay_s)))"""
_FRONT_VIEW = ("friction_budget", C.CANDIDATE, C.FAMILY, "benign_friction", *sel.OBJECTIVES)
_FRONT_SQL = (
    f"friction_budget, candidate, family, {r6('benign_friction')}, {r6('malicious_allow', 'malicious_exposure')}, "
    f"{r6('transitions_per_minute')}, {r6('median_capped_delay_s')}"
)


def _frontier(s: Study) -> DataFrame:
    return sel.pareto_frontier(tune_metrics(s).withColumnRenamed("malicious_allow", "malicious_exposure"), BUDGETS)


@query("pareto_frontier", with_recursive(f"{_METRICS}, {_BUDGETED}", f"SELECT {_FRONT_SQL} FROM front"))
def pareto_frontier(s: Study):
    return _frontier(s).select(*_FRONT_VIEW)


@query(
    "frontier_pick",
    with_recursive(
        f"{_METRICS}, {_BUDGETED}",
        f"""SELECT {_FRONT_SQL}, true AS selected FROM (SELECT *, row_number() OVER (PARTITION BY friction_budget ORDER BY malicious_allow,
        transitions_per_minute, median_capped_delay_s, benign_friction, candidate) AS rk FROM front) WHERE rk = 1""",
    ),
)
def frontier_pick(s: Study):
    return sel.frontier_pick(_frontier(s)).select(*_FRONT_VIEW, "selected")


# -- lease-timeout sweep --------------------------------------------------------------------

TIMEOUTS = (43200.0, 86400.0, 129600.0, 259200.0)


def sweep(s: Study) -> tuple[DataFrame, DataFrame]:
    """Action metrics and any-attack episodes of the locked policies at every timeout.

    Both are one row per policy and timeout of the same table, which is kept as a join reads it several times.
    """
    swept = cal.timeout_metrics(s.epochs, LOCKED, TIMEOUTS, DELAY_CAP_S).persist()
    episodes = ("episode_count", "episode_coverage", "mean_capped_delay_s", "median_capped_delay_s")
    return swept.drop(*episodes), swept.where("episode_count > 0").select(*BY_CANDIDATE, "lease_timeout_s", *episodes)


def _sweep_rule(timeout: float) -> TraceRule:
    return TraceRule(
        gap_seconds=RULE.gap_seconds,
        max_block_seconds=RULE.max_block_seconds,
        lease_gap_seconds=timeout,
        epoch_seconds=RULE.epoch_seconds,
    )


_SWEEP = " UNION ALL ".join(
    "SELECT * FROM ("
    + with_recursive(
        f"{sql.trace(rule=_sweep_rule(t))}, {sql.epoch_episodes(DELAY_CAP_S, t)}",
        f"""SELECT {t}::DOUBLE AS lease_timeout_s, candidate, family, epochs, effective_transitions, benign_contained_time_s / benign_time_s AS bf,
        attack_exposed_time_s / attack_time_s AS ma, attack_not_isolated_time_s / attack_time_s AS mi, e.* EXCLUDE (candidate)
        FROM (SELECT candidate, family, {sql.ACTION_SUMS} FROM trace GROUP BY ALL)
        JOIN (SELECT candidate, count(*) AS en, avg(covered::INT) AS ec, avg(capped_delay_s) AS ed, median(capped_delay_s) AS em
              FROM episodes WHERE attack_type = '__any_attack__' GROUP BY 1) e USING (candidate)""",
    )
    + ")"
    for t in TIMEOUTS
)


@query(
    "lease_timeout_sweep",
    f"""SELECT lease_timeout_s, candidate, family, epochs, {r6('bf', 'benign_friction')}, {r6('ma', 'malicious_allow')},
    {r6('mi', 'malicious_not_isolated')}, {r6('1000.0 * effective_transitions / epochs', 'transitions_per_1000_observed_epochs')}
    FROM ({_SWEEP})""",
)
def lease_timeout_sweep(s: Study):
    action, _ = sweep(s)
    return action.select(
        "lease_timeout_s",
        *BY_CANDIDATE,
        "epochs",
        "benign_friction",
        "malicious_allow",
        "malicious_not_isolated",
        per_thousand(),
    )


_LEASE_TABLE = f"""lt AS (SELECT lease_timeout_s, CASE family WHEN 'proposed' THEN 0 ELSE 1 END AS family_order,
    CASE family WHEN 'proposed' THEN 'Friction-budgeted' ELSE 'Stateless' END AS policy, epochs, en AS episodes, 100 * bf AS f, 100 * ma AS a,
    100 * mi AS i, 1000.0 * effective_transitions / epochs AS t, 100 * ec AS c, ed, em
  FROM ({_SWEEP}) WHERE family IN ('proposed', 'stateless_reference'))"""


@query(
    "lease_table",
    f"""WITH {_LEASE_TABLE} SELECT lease_timeout_s, family_order, policy, epochs, episodes, {r6('f', 'benign_friction_pct')},
    {r6('a', 'malicious_allow_pct')}, {r6('i', 'malicious_not_isolated_pct')}, {r6('t', 'transitions_per_1000_observed_epochs')},
    {r6('c', 'episode_coverage_pct')}, {r6('ed', 'mean_capped_delay_s')}, {r6('em', 'median_capped_delay_s')} FROM lt""",
)
def lease_table(s: Study):
    return lease_timeout_table(*sweep(s))


@query(
    "lease_table_self_join",
    f"""WITH {_LEASE_TABLE} SELECT p.lease_timeout_s, p.epochs, {r6('p.a - r.a', 'exposure_difference_pp')},
    {r6('p.c - r.c', 'coverage_difference_pp')}, {r6('p.em - r.em', 'median_delay_difference_s')}, {r6('p.t / r.t', 'transition_rate_ratio')}
    FROM lt p JOIN lt r USING (lease_timeout_s) WHERE p.family_order = 0 AND r.family_order = 1""",
)
def lease_table_self_join(s: Study):
    return timeout_contrast(lease_timeout_table(*sweep(s)))

