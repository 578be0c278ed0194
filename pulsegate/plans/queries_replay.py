"""Queries: controllers, lag, durations, metrics, episodes, contributions, grouping audit."""

from __future__ import annotations

from pyspark.sql import functions as F


from pulsegate import columns as C

from pulsegate.operators import contributions as contrib
from pulsegate.operators import grouping, metrics
from pulsegate.operators.calibration import candidate_metrics
from pulsegate.operators.controllers import (
    action_trace,
    ewma_evidence,
    hysteresis_states,
    lagged,
    replay_inputs,
)
from pulsegate.operators.episodes import (
    episode_strata,
    episode_summary,
    epoch_episodes,
    mark_streams,
    point_summary,
    report_episodes,
    summarize_report_episodes,
)
from pulsegate.plans import sql
from pulsegate.plans.registry import query
from pulsegate.plans.sql import r6, with_recursive
from pulsegate.plans.study import DAILY, DELAY_CAP_S, EPOCH, LOCKED, Study, stateless_specs
from pulsegate.sources.events import EVENT_ONTOLOGY

TIME = [C.DECISION_TIME]
STEP_KEY = f"candidate, rnti_lease_id, {r6('decision_time_s')}"
BY_NAME = {s.family: s for s in LOCKED}


def _step_view(df, *more):
    return df.select(C.CANDIDATE, C.LEASE, C.DECISION_TIME, *more)


def _replay_sql(specs, columns: str) -> str:
    return with_recursive(sql.trace(specs), f"SELECT {STEP_KEY}, {columns} FROM trace")


# -- controllers ----------------------------------------------------------------------------


@query("stateless_replay", _replay_sql(stateless_specs(), "decision_state, effective_state"))
def stateless_replay(s: Study):
    return _step_view(s.trace(stateless_specs(), replay_inputs(s.epochs)), "decision_state", "effective_state")


@query("ewma_fold", _replay_sql([BY_NAME["ewma"]], f"{r6('evidence_score')}, decision_state"))
def ewma_fold(s: Study):
    return _step_view(s.trace([BY_NAME["ewma"]], replay_inputs(s.epochs)), "evidence_score", "decision_state")


@query(
    "ewma_window",
    with_recursive(
        sql.trace([BY_NAME["ewma"]]), f"SELECT rnti_lease_id, {r6('decision_time_s')}, {r6('evidence_score', 'evidence')} FROM trace"
    ),
)
def ewma_window(s: Study):
    """The EWMA as one running sum, without Python."""
    out = ewma_evidence(replay_inputs(s.epochs), 2.0 * EPOCH, C.SCORE, TIME)
    return out.select(C.LEASE, C.DECISION_TIME, "evidence")


@query("nreport_replay", _replay_sql([BY_NAME["n_report"]], "decision_state, previous_state"))
def nreport_replay(s: Study):
    return _step_view(s.trace([BY_NAME["n_report"]], replay_inputs(s.epochs)), "decision_state", "previous_state")


@query("hysteresis_replay", _replay_sql([BY_NAME["symmetric_hysteresis"]], "decision_state, previous_state"))
def hysteresis_replay(s: Study):
    trace = s.trace([BY_NAME["symmetric_hysteresis"]], replay_inputs(s.epochs))
    return _step_view(trace, "decision_state", "previous_state")


@query(
    "hysteresis_window",
    with_recursive(
        sql.trace([BY_NAME["symmetric_hysteresis"]]),
        f"SELECT rnti_lease_id, {r6('decision_time_s')}, decision_state FROM trace",
    ),
)
def hysteresis_window(s: Study):
    """The Schmitt trigger as window counts, without Python."""
    rule = BY_NAME["symmetric_hysteresis"].rule()
    out = hysteresis_states(replay_inputs(s.epochs), rule.restrict_enter, rule.restrict_exit, C.SCORE, TIME)
    return out.select(C.LEASE, C.DECISION_TIME, "decision_state")


@query("asymmetric_replay", _replay_sql([BY_NAME["proposed"]], "decision_state, previous_state"))
def asymmetric_replay(s: Study):
    return _step_view(s.trace([BY_NAME["proposed"]], replay_inputs(s.epochs)), "decision_state", "previous_state")


TRACE_VIEW = (
    "controller_kind",
    "family",
    "evidence_score",
    "previous_state",
    "decision_state",
    "decision_transitioned",
    "lifecycle_start",
    "effective_previous_state",
    "effective_state",
    "effective_transitioned",
    "effective_severity_delta",
)


@query(
    "controller_trace",
    _replay_sql(
        LOCKED,
        f"""controller_kind, family, {r6('evidence_score')}, previous_state, decision_state,
        decision_state <> previous_state AS decision_transitioned, pos = 1 AS lifecycle_start, effective_previous_state,
        effective_state, effective_state <> effective_previous_state AS effective_transitioned,
        abs(effective_state - effective_previous_state) AS effective_severity_delta""",
    ),
)
def controller_trace(s: Study):
    """Full trace of the five locked policies in one fold."""
    return _step_view(s.trace(LOCKED, replay_inputs(s.epochs)), *TRACE_VIEW)


@query(
    "candidate_cross_join",
    with_recursive(sql.trace(LOCKED), "SELECT candidate, split, count(*) AS epochs FROM trace GROUP BY ALL"),
)
def candidate_cross_join(s: Study):
    """Every candidate on every epoch, by exploding the replayed arrays."""
    return s.trace(LOCKED, s.epochs).groupBy(C.CANDIDATE, C.SPLIT).agg(F.count(F.lit(1)).alias("epochs"))


@query(
    "state_histogram",
    with_recursive(sql.trace(), "SELECT candidate, family, decision_state, count(*) AS reports FROM trace GROUP BY ALL"),
)
def state_histogram(s: Study):
    return metrics.state_histogram(s.trace(LOCKED, replay_inputs(s.epochs)))


@query(
    "action_lag",
    f"""WITH {sql.epochs()} SELECT rnti_lease_id, {r6('decision_time_s')},
    coalesce(lag(CASE WHEN risk_score >= 0.75 THEN 2 WHEN risk_score >= 0.6 THEN 1 ELSE 0 END)
      OVER (PARTITION BY rnti_lease_id ORDER BY decision_time_s), 0) AS effective_state,
    {r6('lag(risk_score) OVER (PARTITION BY rnti_lease_id ORDER BY decision_time_s)', 'previous_score')} FROM epochs""",
)
def action_lag(s: Study):
    """One-epoch actuation delay of any value, with its initial value."""
    code = F.when(F.col(C.SCORE) >= 0.75, 2).when(F.col(C.SCORE) >= 0.6, 1).otherwise(0)
    acted = lagged(s.epochs.withColumn("state", code), "state", "effective_state", F.lit(0), TIME)
    out = lagged(acted, C.SCORE, "previous_score", F.lit(None).cast("double"), TIME)
    return out.select(C.LEASE, C.DECISION_TIME, "effective_state", "previous_score")


@query(
    "effective_transitions",
    f"""WITH {sql.epochs()}, st AS (SELECT *, CASE WHEN risk_score >= 0.75 THEN 2 WHEN risk_score >= 0.6 THEN 1 ELSE 0 END AS state
    FROM epochs), l AS (SELECT *, lag(state) OVER (PARTITION BY rnti_lease_id ORDER BY decision_time_s) AS previous FROM st)
    SELECT rnti_lease_id, {r6('decision_time_s')}, state, previous, coalesce(state <> previous, false) AS transitioned,
    coalesce(abs(state - previous), 0) AS severity_delta FROM l""",
)
def effective_transitions(s: Study):
    code = F.when(F.col(C.SCORE) >= 0.75, 2).when(F.col(C.SCORE) >= 0.6, 1).otherwise(0)
    out = metrics.effective_changes(s.epochs.withColumn("state", code), "state", [C.BLOCK, C.SUBJECT, C.LEASE], TIME)
    return out.select(C.LEASE, C.DECISION_TIME, "state", "previous", "transitioned", "severity_delta")


@query(
    "hold_durations",
    f"""WITH {sql.leases()} SELECT _source_row, {r6('''least(coalesce(CASE WHEN lead(rnti_lease_id) OVER w = rnti_lease_id
      THEN lead(event_time_s) OVER w - event_time_s END, 0), 86400.0)''', 'duration_s')} FROM prepared
    WINDOW w AS (PARTITION BY mac_rnti ORDER BY event_time_s, _source_row)""",
)
def hold_durations(s: Study):
    """Sample-and-hold seconds of raw reports, capped at a day."""
    return metrics.hold_durations(s.prepared, cap_s=86400.0).select(C.ROW, "duration_s")


@query(
    "hold_until_horizon",
    f"""WITH {sql.leases()}, h AS (SELECT mac_rnti, max(event_time_s) + 60 AS hs FROM prepared GROUP BY 1)
    SELECT _source_row, {r6('''coalesce(CASE WHEN lead(rnti_lease_id) OVER w = rnti_lease_id
      THEN lead(event_time_s) OVER w END, hs) - event_time_s''', 'duration_s')} FROM prepared JOIN h USING (mac_rnti)
    WINDOW w AS (PARTITION BY mac_rnti ORDER BY event_time_s, _source_row)""",
)
def hold_until_horizon(s: Study):
    """The last report of a lease holds until the entity's observation end."""
    ends = s.prepared.groupBy(C.SUBJECT).agg((F.max(C.TIME) + 60).alias("horizon_s"))
    rows = metrics.with_horizon(s.prepared, by_subject=ends)
    return metrics.hold_durations(rows, horizon="horizon_s").select(C.ROW, "duration_s")


_DWELL = """s AS (SELECT rnti_lease_id, decision_time_s, is_attack_epoch,
      lead(decision_time_s) OVER (PARTITION BY rnti_lease_id ORDER BY decision_time_s) - decision_time_s AS step FROM epochs),
    g AS (SELECT median(step) AS gm FROM s WHERE step > 0),
    m AS (SELECT rnti_lease_id, median(step) AS lm FROM s WHERE step > 0 GROUP BY 1),
    w AS (SELECT s.*, least(coalesce(step, lm, gm, 1.0), 86400.0) AS raw FROM s LEFT JOIN m USING (rnti_lease_id), g),
    d AS (SELECT *, raw / avg(raw) OVER () AS dwell_weight FROM w)"""


@query(
    "dwell_weights",
    f"WITH {sql.epochs()}, {_DWELL} SELECT rnti_lease_id, {r6('decision_time_s')}, {r6('dwell_weight')} FROM d",
)
def dwell_weights(s: Study):
    return metrics.dwell_weights(s.epochs, max_gap=86400.0).select(C.LEASE, C.DECISION_TIME, "dwell_weight")


# -- metrics --------------------------------------------------------------------------------

_SUMS = (
    "candidate, family, epochs, observed_time_s, benign_time_s, attack_time_s, benign_contained_time_s, "
    "benign_isolated_time_s, attack_contained_time_s, attack_exposed_time_s, effective_transitions, "
    "severity_transition_total, containment_starts, benign_containment_starts"
)


def _action_sql(specs=LOCKED) -> str:
    return with_recursive(
        sql.trace(specs),
        f"SELECT {_SUMS}, {sql.ACTION_RATIOS} FROM (SELECT candidate, family, {sql.ACTION_SUMS} FROM trace GROUP BY ALL)",
    )


@query("action_metrics_stateless", _action_sql(stateless_specs()))
def action_metrics_stateless(s: Study):
    """The flagship: events to policy metrics without a Python worker."""
    return metrics.action_metrics(s.trace(stateless_specs(), s.epochs))


@query("action_metrics", _action_sql())
def action_metrics(s: Study):
    return metrics.action_metrics(s.trace(LOCKED, s.epochs))


@query(
    "isolation_metrics",
    with_recursive(
        sql.trace(),
        f"""SELECT candidate, {r6('benign_isolated_time_s / benign_time_s', 'benign_isolation')},
        {r6('attack_exposed_time_s / attack_time_s', 'malicious_allow')},
        {r6('attack_not_isolated_time_s / attack_time_s', 'malicious_not_isolated')}
        FROM (SELECT candidate, family, {sql.ACTION_SUMS} FROM trace WHERE split = 'test' GROUP BY ALL)""",
    ),
)
def isolation_metrics(s: Study):
    out = metrics.action_metrics(s.trace(LOCKED, s.split("test")))
    return out.select(C.CANDIDATE, "benign_isolation", "malicious_allow", "malicious_not_isolated")


@query(
    "access_metrics",
    with_recursive(
        sql.trace(),
        f"""SELECT candidate, family, sum(epoch_seconds) AS observed_time_s,
        sum(epoch_seconds) FILTER (NOT is_attack_epoch) AS benign_time_s, sum(epoch_seconds) FILTER (is_attack_epoch) AS attack_time_s,
        coalesce(sum(epoch_seconds) FILTER (NOT is_attack_epoch AND effective_state >= 1), 0) AS benign_restricted_time_s,
        coalesce(sum(epoch_seconds) FILTER (NOT is_attack_epoch AND effective_state = 2), 0) AS benign_isolated_time_s,
        coalesce(sum(epoch_seconds) FILTER (is_attack_epoch AND effective_state < 1), 0) AS malicious_exposure_time_s,
        coalesce(sum(epoch_seconds) FILTER (is_attack_epoch AND effective_state >= 1), 0) AS malicious_contained_time_s,
        count(*) FILTER (effective_state <> effective_previous_state) AS transitions,
        CAST(sum(abs(effective_state - effective_previous_state)) AS BIGINT) AS severity_transitions,
        count(*) FILTER (NOT is_attack_epoch AND effective_state >= 1 AND NOT (coalesce(NOT prev_attack, false)
          AND effective_previous_state >= 1)) AS false_restriction_episodes,
        {r6('benign_restricted_time_s / benign_time_s', 'benign_friction')},
        {r6('benign_isolated_time_s / benign_time_s', 'benign_isolation')},
        {r6('malicious_exposure_time_s / attack_time_s', 'malicious_exposure')},
        {r6('malicious_contained_time_s / attack_time_s', 'malicious_containment')},
        {r6('coalesce(sum(epoch_seconds) FILTER (is_attack_epoch AND effective_state < 2), 0) / attack_time_s', 'malicious_not_isolated')},
        {r6('60.0 * transitions / observed_time_s', 'transitions_per_minute')},
        {r6('60.0 * severity_transitions / observed_time_s', 'severity_transitions_per_minute')}
        FROM trace GROUP BY candidate, family""",
    ),
)
def access_metrics(s: Study):
    """The sixteen time-weighted measures of every locked policy."""
    return metrics.access_metrics(s.trace(LOCKED, metrics.with_previous_attack(s.epochs, order=TIME)))


@query(
    "transition_counts",
    with_recursive(
        sql.trace(),
        """SELECT candidate, split, count(*) FILTER (effective_state <> effective_previous_state) AS transitions,
        CAST(sum(abs(effective_state - effective_previous_state)) AS BIGINT) AS severity FROM trace GROUP BY 1, 2""",
    ),
)
def transition_counts(s: Study):
    return s.trace(LOCKED, s.epochs).groupBy(C.CANDIDATE, C.SPLIT).agg(
        F.count_if("effective_transitioned").alias("transitions"),
        F.sum("effective_severity_delta").cast("long").alias("severity"),
    )


@query(
    "false_episodes",
    with_recursive(
        sql.trace(),
        """SELECT candidate, count(*) FILTER (NOT is_attack_epoch AND effective_state >= 2 AND NOT (coalesce(NOT prev_attack, false)
        AND effective_previous_state >= 2)) AS false_isolation_episodes FROM trace GROUP BY 1""",
    ),
)
def false_episodes(s: Study):
    """Rising edges of benign isolation (the ISOLATE containment level)."""
    trace = s.trace(LOCKED, metrics.with_previous_attack(s.epochs, order=TIME))
    out = metrics.access_metrics(trace, containment=2)
    return out.select(C.CANDIDATE, F.col("false_restriction_episodes").alias("false_isolation_episodes"))


@query(
    "stratified_metrics",
    with_recursive(
        sql.trace(),
        f"""SELECT stratum, {_SUMS}, {sql.ACTION_RATIOS} FROM (
          SELECT stratum, candidate, family, {sql.ACTION_SUMS} FROM (
            SELECT *, unnest(list_filter(['all', CASE WHEN split = 'test' THEN CASE WHEN mac_rnti IN
                (SELECT mac_rnti FROM epochs WHERE split <> 'test') THEN 'rnti_seen' ELSE 'rnti_unseen' END END,
                CASE WHEN NOT mixed_label_epoch THEN 'exclude_mixed_labels' END], lambda x: x IS NOT NULL)) AS stratum FROM trace)
          GROUP BY ALL) WHERE benign_time_s > 0 AND attack_time_s > 0""",
    ),
)
def stratified_metrics(s: Study):
    """All strata in one pass over the exploded stratum names."""
    trace = action_trace(s.novelty, LOCKED, order=TIME)
    return metrics.stratified_metrics(trace, metrics.novelty_strata(trace))


@query(
    "candidate_metrics",
    with_recursive(
        f"{sql.trace()}, {sql.candidate_metrics(DELAY_CAP_S)}",
        "SELECT candidate, family, 'controller_tune' AS split, transitions, false_restriction_episodes, attack_episodes, "
        + ", ".join(
            r6(c)
            for c in (
                "benign_friction benign_isolation malicious_allow malicious_not_isolated transitions_per_minute "
                "severity_transitions_per_minute episode_coverage median_capped_delay_s"
            ).split()
        )
        + " FROM metrics",
    ),
)
def evaluate_candidates(s: Study):
    return candidate_metrics(s.epochs, LOCKED, delay_cap_s=DELAY_CAP_S)


# -- episodes -------------------------------------------------------------------------------


@query(
    "report_episodes",
    with_recursive(
        f"{sql.trace()}, {sql.report_episodes(DELAY_CAP_S)}",
        f"""SELECT candidate, mac_rnti, rnti_lease_id, episode, attack_type, reports, covered, censored, {r6('start_s')}, {r6('end_s')},
        {r6('duration_s')}, {r6('first_action_s')}, {r6('delay_s')}, {r6('censor_time_s')}, {r6('capped_delay_s')},
        {r6('contained_time_s')}, {r6('contained_fraction')} FROM report_episodes""",
    ),
)
def report_flavour(s: Study):
    out = report_episodes(s.trace(), delay_cap_s=DELAY_CAP_S)
    return out.drop(C.FAMILY, C.BLOCK)


@query(
    "episode_summary_by_type",
    with_recursive(
        f"{sql.trace()}, {sql.report_episodes(DELAY_CAP_S)}",
        f"""SELECT candidate, family, attack_type, count(*) AS episodes, count(*) FILTER (covered) AS covered_episodes,
        count(*) FILTER (censored) AS censored_episodes, {r6('avg(covered::INT)', 'episode_coverage')},
        sum(duration_s) AS attack_time_s, sum(contained_time_s) AS contained_time_s,
        {r6('sum(contained_time_s) / sum(duration_s)', 'time_coverage')}, {r6('median(delay_s)', 'median_detected_delay_s')},
        {r6('median(capped_delay_s)', 'median_capped_delay_s')} FROM report_episodes GROUP BY 1, 2, 3""".replace(
            "sum(duration_s) AS attack_time_s, sum(contained_time_s) AS contained_time_s",
            "sum(duration_s) AS attack_time_s, sum(report_episodes.contained_time_s) AS contained_time_s",
        ),
    ),
)
def episode_summary_by_type(s: Study):
    return summarize_report_episodes(report_episodes(s.trace(), delay_cap_s=DELAY_CAP_S))


_EPISODE_VIEW = (
    "candidate family episode_key subject_id lease_id attack_type episode_sequence onset_block_id attack_epochs "
    "contained_at_onset pre_contained_at_onset onset_transition_to_containment onset_stratum mixed_attack_at_onset "
    "covered reactively_covered censored"
).split()
_EPISODE_NUMBERS = (
    "start_s end_s span_s attack_time_s contained_time_s exposed_time_s mixed_attack_time_s first_containment_start_s "
    "delay_s capped_delay_s exposure_before_containment_s"
).split()


def _episode_sql(cap: float, gap: float = 0.0) -> str:
    shown = ", ".join([*_EPISODE_VIEW, *map(r6, _EPISODE_NUMBERS)])
    return with_recursive(f"{sql.trace()}, {sql.epoch_episodes(cap, gap)}", f"SELECT {shown}, 1::BIGINT AS blocks_touched FROM episodes")


@query("epoch_episodes", _episode_sql(DELAY_CAP_S))
def epoch_flavour(s: Study):
    return s.episodes.select(*_EPISODE_VIEW, *_EPISODE_NUMBERS, "blocks_touched")


@query("epoch_episodes_merged", _episode_sql(DELAY_CAP_S, EPOCH))
def epoch_flavour_merged(s: Study):
    """Episodes may bridge one unobserved epoch."""
    marked = mark_streams(s.epochs, EVENT_ONTOLOGY, EPOCH, TIME)
    out = epoch_episodes(s.trace(LOCKED, marked), delay_cap_s=DELAY_CAP_S)
    return out.select(*_EPISODE_VIEW, *_EPISODE_NUMBERS, "blocks_touched")


_STRATA_COUNTS = """count(*) AS episode_count, count(*) FILTER (covered) AS covered_episode_count,
    count(*) FILTER (pre_contained_at_onset) AS pre_contained_episode_count, sum(attack_time_s) AS attack_time_s,
    sum(e.contained_time_s) AS contained_time_s, sum(exposed_time_s) AS exposed_time_s"""


@query(
    "episode_grouping_sets",
    with_recursive(
        f"{sql.trace()}, {sql.epoch_episodes(DELAY_CAP_S)}",
        f"""SELECT candidate, family, attack_type, CASE WHEN grouping(onset_stratum) = 1 THEN '__all__' ELSE onset_stratum END
          AS onset_stratum, {_STRATA_COUNTS}, count(*) FILTER (reactively_covered) AS reactively_covered_episode_count,
        count(*) FILTER (onset_transition_to_containment) AS onset_transition_episode_count,
        {r6('sum(capped_delay_s)', 'capped_delay_sum_s')}, {r6('sum(exposure_before_containment_s)', 'exposure_before_containment_sum_s')},
        {r6('avg(covered::INT)', 'episode_coverage')}, {r6('sum(e.contained_time_s) / sum(e.attack_time_s)', 'time_containment')},
        {r6('avg(capped_delay_s)', 'mean_capped_delay_s')} FROM episodes e
        GROUP BY GROUPING SETS ((candidate, family, attack_type), (candidate, family, attack_type, onset_stratum))""",
    ),
)
def episode_grouping_sets(s: Study):
    return episode_strata(s.episodes)


_SUMMARY_TAIL = f"""{r6('avg(covered::INT)', 'episode_coverage')}, {r6('avg(reactively_covered::INT)', 'reactive_coverage')},
    {r6('avg(capped_delay_s)', 'mean_capped_delay_s')}, {r6('avg(exposure_before_containment_s)', 'mean_exposure_before_containment_s')},
    {r6('median(capped_delay_s)', 'median_capped_delay_s')}, {r6('median(delay_s)', 'median_detected_delay_s')},
    {r6('sum(e.contained_time_s) / sum(e.attack_time_s)', 'attack_time_containment')},
    {r6('sum(e.exposed_time_s) / sum(e.attack_time_s)', 'malicious_allow')}"""


@query(
    "episode_summary",
    with_recursive(
        f"{sql.trace()}, {sql.epoch_episodes(DELAY_CAP_S)}",
        f"""SELECT candidate, family, attack_type, CASE WHEN grouping(onset_stratum) = 1 THEN '__all__' ELSE onset_stratum END
        AS onset_stratum, {_STRATA_COUNTS}, {_SUMMARY_TAIL} FROM episodes e
        GROUP BY GROUPING SETS ((candidate, family, attack_type), (candidate, family, attack_type, onset_stratum))""",
    ),
)
def summary(s: Study):
    return episode_summary(s.episodes)


@query(
    "episode_point_summary",
    with_recursive(
        f"{sql.trace()}, {sql.epoch_episodes(DELAY_CAP_S)}",
        f"""SELECT candidate, family, count(*) AS episode_count, {r6('avg(covered::INT)', 'episode_coverage')},
        {r6('avg(capped_delay_s)', 'mean_capped_delay_s')}, {r6('median(capped_delay_s)', 'median_capped_delay_s')},
        sum(e.attack_time_s) AS attack_time_s, sum(e.exposed_time_s) AS exposed_time_s,
        {r6('sum(e.exposed_time_s) / sum(e.attack_time_s)', 'malicious_allow')}
        FROM episodes e WHERE attack_type = '__any_attack__' GROUP BY 1, 2""",
    ),
)
def episode_point_summary(s: Study):
    return point_summary(s.episodes)


# -- contributions --------------------------------------------------------------------------

LABELS = [(x.candidate, x.family) for x in LOCKED]
_CONTRIB = sql.ACTION_SUMS
_CONTRIB_VIEW = """observed_time_s, benign_time_s, attack_time_s, benign_contained_time_s, benign_isolated_time_s,
    attack_contained_time_s, attack_exposed_time_s, severity_transition_total, epochs AS epoch_count,
    effective_transitions AS effective_transition_count, containment_starts AS containment_start_count,
    benign_containment_starts AS benign_containment_start_count"""


@query(
    "action_block_contributions",
    with_recursive(
        sql.trace(rule=DAILY),
        f"""SELECT candidate, family, trace_block_id, {_CONTRIB_VIEW} FROM (
        SELECT candidate, family, trace_block_id, {_CONTRIB} FROM trace GROUP BY ALL)""",
    ),
    rule=DAILY,
)
def action_block_contributions(s: Study):
    return contrib.action_contributions(s.trace(LOCKED, s.epochs))


_ATTACK_BLOCKS = f"""ab AS (
  SELECT g.candidate, g.family, g.trace_block_id, g.attack_type, coalesce(t.n, 0) AS attack_epoch_count,
         coalesce(t.a, 0) AS attack_time_s, coalesce(t.c, 0) AS contained_time_s, coalesce(t.x, 0) AS exposed_time_s,
         coalesce(e.n, 0) AS episode_count, coalesce(e.cov, 0) AS covered_episode_count, coalesce(e.rc, 0) AS reactively_covered_episode_count,
         coalesce(e.pre, 0) AS pre_contained_episode_count, coalesce(e.tr, 0) AS onset_transition_episode_count,
         coalesce(e.cen, 0) AS censored_episode_count, coalesce(e.d, 0) AS capped_delay_sum_s,
         coalesce(e.b, 0) AS exposure_before_containment_sum_s
  FROM (SELECT c.candidate, c.family, b.trace_block_id, s.attack_type FROM cand c, (SELECT DISTINCT trace_block_id FROM epochs) b,
          (VALUES ('__any_attack__'), ('error'), ('purchase'), ('__mixed_attack__')) s(attack_type)) g
  LEFT JOIN (SELECT candidate, trace_block_id, attack_type, count(*) n, sum(epoch_seconds) a,
               sum(epoch_seconds) FILTER (effective_state >= 1) c, sum(epoch_seconds) FILTER (effective_state < 1) x
             FROM streams WHERE inside GROUP BY 1, 2, 3) t USING (candidate, trace_block_id, attack_type)
  LEFT JOIN (SELECT candidate, onset_block_id AS trace_block_id, attack_type, count(*) n, count(*) FILTER (covered) cov,
               count(*) FILTER (reactively_covered) rc, count(*) FILTER (pre_contained_at_onset) pre,
               count(*) FILTER (onset_transition_to_containment) tr, count(*) FILTER (censored) cen,
               sum(capped_delay_s) d, sum(exposure_before_containment_s) b
             FROM episodes GROUP BY 1, 2, 3) e USING (candidate, trace_block_id, attack_type))"""
_ATTACK_VALUES = (
    "attack_epoch_count attack_time_s contained_time_s exposed_time_s episode_count covered_episode_count "
    "reactively_covered_episode_count pre_contained_episode_count onset_transition_episode_count censored_episode_count "
    "capped_delay_sum_s exposure_before_containment_sum_s"
).split()


def _attack_ctes(rule=DAILY) -> str:
    return f"{sql.trace(rule=rule)}, {sql.epoch_episodes(DELAY_CAP_S)}, {_ATTACK_BLOCKS}"


def attack_contributions(s: Study):
    return contrib.attack_contributions(s.trace(), s.episodes, LABELS, EVENT_ONTOLOGY)


@query(
    "attack_block_contributions",
    with_recursive(_attack_ctes(), f"SELECT candidate, family, trace_block_id, attack_type, {', '.join(_ATTACK_VALUES)} FROM ab"),
    rule=DAILY,
)
def attack_block_contributions(s: Study):
    return attack_contributions(s)


@query(
    "dense_block_grid",
    f"""WITH {sql.blocks()}, n AS (SELECT trace_block_id, label AS candidate, count(*) AS c FROM blocked GROUP BY 1, 2)
    SELECT b.trace_block_id, k.candidate, 'label' AS family, coalesce(n.c, 0) AS n_rows FROM (SELECT DISTINCT trace_block_id FROM blocked) b,
    (SELECT unnest(['click', 'signup', 'view', 'error', 'purchase']) AS candidate) k LEFT JOIN n
      ON n.trace_block_id = b.trace_block_id AND n.candidate = k.candidate""",
)
def dense_block_grid(s: Study):
    """Zero-filled grid of block and label; short blocks lack labels."""
    counts = s.blocked.groupBy(C.BLOCK, F.col("label").alias(C.CANDIDATE)).agg(F.count(F.lit(1)).alias("n_rows"))
    labels = [(x, "label") for x in ("click", "signup", "view", "error", "purchase")]
    grid = contrib.candidate_grid(s.blocked, labels)
    return contrib.fill_grid(grid, counts, [C.BLOCK, C.CANDIDATE])


@query(
    "missing_blocks",
    with_recursive(
        sql.trace(stateless_specs(), DAILY),
        """, touched AS (SELECT DISTINCT candidate, trace_block_id FROM trace WHERE effective_state = 2)
        SELECT c.candidate, c.family, b.trace_block_id FROM cand c, (SELECT DISTINCT trace_block_id FROM trace) b
        WHERE NOT EXISTS (SELECT 1 FROM touched t WHERE t.candidate = c.candidate AND t.trace_block_id = b.trace_block_id)""",
    ),
    rule=DAILY,
)
def missing_blocks(s: Study):
    """Blocks in which a candidate never isolated anyone."""
    trace = s.trace(stateless_specs(), s.epochs)
    labels = [(x.candidate, x.family) for x in stateless_specs()]
    return contrib.missing_blocks(trace.where("effective_state = 2"), s.epochs, labels)


@query(
    "cluster_rollup",
    with_recursive(
        sql.trace(rule=DAILY),
        f"""SELECT candidate, trace_block_id // 3 AS cluster_group, CAST(sum(epochs) AS BIGINT) AS epoch_count,
        sum(observed_time_s) AS observed_time_s, sum(benign_contained_time_s) AS benign_contained_time_s,
        CAST(sum(effective_transitions) AS BIGINT) AS effective_transition_count FROM (
        SELECT candidate, family, trace_block_id, {_CONTRIB} FROM trace GROUP BY ALL) GROUP BY 1, 2""".replace(
            "sum(observed_time_s) AS observed_time_s, sum(benign_contained_time_s) AS benign_contained_time_s",
            "sum(q.observed_time_s) AS observed_time_s, sum(q.benign_contained_time_s) AS benign_contained_time_s",
        ).replace("GROUP BY ALL) GROUP BY 1, 2", "GROUP BY ALL) q GROUP BY 1, 2"),
    ),
    rule=DAILY,
)
def cluster_rollup(s: Study):
    """Contributions re-aggregated to three-block clusters through a map."""
    mapping = s.blocked.select(C.BLOCK).distinct().withColumn("cluster_group", F.floor(F.col(C.BLOCK) / 3))
    table = contrib.action_contributions(s.trace(LOCKED, s.epochs))
    kept = ("epoch_count", "observed_time_s", "benign_contained_time_s", "effective_transition_count")
    out = contrib.roll_up(table, mapping, "cluster_group", [C.CANDIDATE])
    return out.select(C.CANDIDATE, "cluster_group", *kept)


# -- grouping audit -------------------------------------------------------------------------

_PROFILE = f"""{sql.leases(DAILY)},
bt AS (SELECT trace_block_id, min(event_time_s) AS start_s, max(event_time_s) AS end_s, count(*) AS n_rows,
         list_sort(list(DISTINCT mac_rnti)) AS ids, count(DISTINCT rnti_lease_id) AS n_rnti_leases, min(split) AS split
       FROM prepared GROUP BY 1),
sh AS (SELECT trace_block_id, mob_pattern, count(*) / sum(count(*)) OVER (PARTITION BY trace_block_id) AS share
       FROM prepared GROUP BY 1, 2),
dom AS (SELECT trace_block_id, arg_min(mob_pattern, ROW(-share, mob_pattern)) AS dominant_mobility FROM sh GROUP BY 1),
ord AS (SELECT *, lag(trace_block_id) OVER w AS pb, lag(end_s) OVER w AS pe, lag(ids) OVER w AS pids, lag(split) OVER w AS ps,
          lag(dominant_mobility) OVER w AS pd
        FROM bt JOIN dom USING (trace_block_id) WINDOW w AS (ORDER BY start_s, trace_block_id)),
tv AS (SELECT o.trace_block_id, sum(abs(coalesce(a.share, 0) - coalesce(b.share, 0))) * 0.5 AS tv
       FROM ord o CROSS JOIN (SELECT DISTINCT mob_pattern FROM sh) m
       LEFT JOIN sh a ON a.trace_block_id = o.trace_block_id AND a.mob_pattern = m.mob_pattern
       LEFT JOIN sh b ON b.trace_block_id = o.pb AND b.mob_pattern = m.mob_pattern WHERE o.pb IS NOT NULL GROUP BY 1),
audit AS MATERIALIZED (
  SELECT o.trace_block_id, start_s, end_s, n_rows, len(ids) AS n_numeric_rntis, n_rnti_leases, split, dominant_mobility,
         end_s - start_s AS block_span_s, floor(start_s / 86400.0)::BIGINT AS utc_day_index, start_s - pe AS gap_from_previous_s,
         CASE WHEN pb IS NOT NULL THEN len(list_intersect(ids, pids)) / len(list_distinct(list_concat(ids, pids))) END
           AS rnti_jaccard_previous, tv AS mobility_tv_previous, CASE WHEN pb IS NOT NULL THEN dominant_mobility <> pd END
           AS dominant_mobility_changed, coalesce(split <> ps, false) AS split_changed
  FROM ord o LEFT JOIN tv USING (trace_block_id))"""


@query(
    "block_adjacency",
    f"""WITH {_PROFILE} SELECT trace_block_id, n_rows, n_numeric_rntis, n_rnti_leases, split, dominant_mobility, utc_day_index,
    dominant_mobility_changed, split_changed, {r6('start_s')}, {r6('end_s')}, {r6('block_span_s')}, {r6('gap_from_previous_s')},
    {r6('rnti_jaccard_previous')}, {r6('mobility_tv_previous')} FROM audit""",
    rule=DAILY,
)
def block_adjacency(s: Study):
    return grouping.summarize_blocks(s.prepared).drop("mobility_profile")


@query(
    "mobility_profile",
    f"WITH {_PROFILE} SELECT trace_block_id, mob_pattern AS pattern, {r6('share')} FROM sh",
    rule=DAILY,
)
def mobility_profile(s: Study):
    return grouping.pattern_shares(s.prepared)


@query("jaccard_adjacent", f"WITH {_PROFILE} SELECT trace_block_id, {r6('rnti_jaccard_previous')} FROM audit", rule=DAILY)
def jaccard_adjacent(s: Study):
    return grouping.summarize_blocks(s.prepared).select(C.BLOCK, "rnti_jaccard_previous")


@query("mobility_tv_adjacent", f"WITH {_PROFILE} SELECT trace_block_id, {r6('mobility_tv_previous')} FROM audit", rule=DAILY)
def mobility_tv_adjacent(s: Study):
    return grouping.summarize_blocks(s.prepared).select(C.BLOCK, "mobility_tv_previous")


def _ids(name: str, cut: str) -> str:
    return (
        f"CAST(sum(CASE WHEN first OR split_changed OR coalesce({cut}, true) THEN 1 ELSE 0 END) "
        f"OVER (ORDER BY start_s, trace_block_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - 1 AS {name}"
    )


_GROUPS = {
    "observable_block_group": "true",
    "fixed_3600s_group": "b3600 <> p3600",
    "fixed_10800s_group": "b10800 <> p10800",
    "fixed_21600s_group": "b21600 <> p21600",
    "utc_day_group": "b86400 <> p86400",
    "gap_300s_group": "gap_from_previous_s > 300",
    "gap_1800s_group": "gap_from_previous_s > 1800",
    "gap_3600s_group": "gap_from_previous_s > 3600",
    "mobility_tv_0p25_group": "mobility_tv_previous > 0.25",
    "mobility_tv_0p5_group": "mobility_tv_previous > 0.5",
    "rnti_jaccard_0p05_group": "rnti_jaccard_previous < 0.05",
    "rnti_jaccard_0p25_group": "rnti_jaccard_previous < 0.25",
    "campaign_proxy_group": "gap_from_previous_s > 1800 OR mobility_tv_previous > 0.25 OR rnti_jaccard_previous < 0.05",
}
_BINS = ", ".join(f"floor(end_s / {w}.0) AS b{w}, floor(lag(end_s) OVER w / {w}.0) AS p{w}" for w in (3600, 10800, 21600, 86400))
_GROUPED = f"""{_PROFILE}, ba AS (SELECT *, lag(trace_block_id) OVER w IS NULL AS first, {_BINS} FROM audit
    WINDOW w AS (ORDER BY start_s, trace_block_id)),
grouped AS (SELECT trace_block_id, split, start_s, end_s, n_rows, {', '.join(_ids(n, c) for n, c in _GROUPS.items())} FROM ba)"""


@query(
    "grouping_candidates",
    f"WITH {_GROUPED} SELECT trace_block_id, split, {r6('start_s')}, {r6('end_s')}, {', '.join(_GROUPS)} FROM grouped",
    rule=DAILY,
)
def grouping_candidates(s: Study):
    return grouping.cluster_mapping(grouping.grouping_candidates(grouping.summarize_blocks(s.prepared)))


@query(
    "candidate_group_summary",
    f"""WITH {_GROUPED}, lng AS (UNPIVOT grouped ON {', '.join(_GROUPS)} INTO NAME grouping VALUE group_id),
    g AS (SELECT grouping, split, group_id, count(*) AS blocks, CAST(sum(n_rows) AS BIGINT) AS rows, (max(end_s) - min(start_s)) / 3600.0 AS span
          FROM lng GROUP BY 1, 2, 3),
    m AS (SELECT grouping, min(n) AS least FROM (SELECT grouping, split, count(*) AS n FROM g GROUP BY 1, 2) GROUP BY 1)
    SELECT grouping, count(*) AS n_groups, CAST(sum(blocks) AS BIGINT) AS n_observable_blocks, CAST(sum(rows) AS BIGINT) AS n_rows,
    {r6('avg((blocks = 1)::INT)', 'singleton_group_fraction')}, {r6('quantile_cont(blocks, 0.25)', 'blocks_per_group_q25')},
    {r6('quantile_cont(blocks, 0.5)', 'blocks_per_group_median')}, {r6('quantile_cont(blocks, 0.75)', 'blocks_per_group_q75')},
    max(blocks) AS blocks_per_group_max, {r6('quantile_cont(span, 0.5)', 'group_span_hours_median')},
    {r6('quantile_cont(span, 0.9)', 'group_span_hours_p90')}, {r6('max(span)', 'group_span_hours_max')},
    count(*) >= 30 AS at_least_30_groups, any_value(least) AS minimum_groups_across_splits,
    any_value(least) >= 30 AS at_least_30_groups_in_every_split FROM g JOIN m USING (grouping) GROUP BY 1""",
    rule=DAILY,
)
def candidate_group_summary(s: Study):
    grouped = grouping.grouping_candidates(grouping.summarize_blocks(s.prepared))
    return grouping.candidate_summary(grouped).drop("interpretation")


@query(
    "quantile_map",
    f"""WITH {_PROFILE}, lng AS (SELECT 'gap_from_previous_s' AS measure, gap_from_previous_s AS x FROM audit
      UNION ALL SELECT 'rnti_jaccard_previous', rnti_jaccard_previous FROM audit
      UNION ALL SELECT 'mobility_tv_previous', mobility_tv_previous FROM audit)
    SELECT measure, {', '.join(r6(f'quantile_cont(x, {p})', f'q{round(100 * p):02d}') for p in (0, 0.25, 0.5, 0.75, 0.9, 1))}
    FROM lng WHERE x IS NOT NULL GROUP BY 1""",
    rule=DAILY,
)
def quantile_map(s: Study):
    return grouping.adjacency_quantiles(grouping.summarize_blocks(s.prepared))


@query(
    "attach_cluster",
    f"""WITH {_GROUPED} SELECT utc_day_group, p.label, count(*) AS n_rows FROM prepared p JOIN grouped USING (trace_block_id)
    GROUP BY 1, 2""",
    rule=DAILY,
)
def attach_cluster(s: Study):
    grouped = grouping.grouping_candidates(grouping.summarize_blocks(s.prepared))
    out = contrib.attach_cluster(s.prepared, grouped, "utc_day_group")
    return out.groupBy("utc_day_group", "label").agg(F.count(F.lit(1)).alias("n_rows"))



