"""Independent SQL of every stage, for engines that check the Spark plans.

Written from the definitions with plain windows and a recursive controller; nothing here
is used to compute results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pulsegate.config import CandidateSpec, TraceRule
from pulsegate.plans.study import LOCKED, RULE, SPLITS


def r6(expr: str, name: str | None = None) -> str:
    return f"round({expr}, 6) + 0.0 AS {name or expr}"


def values(specs: Sequence[CandidateSpec]) -> str:
    rows = []
    for s in specs:
        r = s.rule()
        tau = "NULL" if r.ewma_tau_s is None else repr(r.ewma_tau_s)
        numbers = (r.restrict_enter, r.restrict_exit, r.isolate_enter, r.isolate_exit)
        rest = (r.entry_reports, r.recovery_reports, r.min_restrict_hold_s, r.min_isolate_hold_s)
        cells = ", ".join(f"{x!r}::DOUBLE" for x in numbers) + ", " + ", ".join(map(repr, rest))
        rows.append(f"('{s.candidate}', '{s.family}', '{s.controller}', {cells}, {tau}::DOUBLE, {str(r.staged).lower()})")
    names = "candidate, family, controller_kind, re, rx, ie, ix, en, rn, hr, hi, tau, staged"
    return f"cand({names}) AS (VALUES {', '.join(rows)})"


def split_case(end: str) -> str:
    cases = " ".join(f"WHEN {end} <= {cut!r} THEN '{name}'" for cut, name in zip(SPLITS.cut_times_s, SPLITS.names))
    return f"CASE {cases} ELSE '{SPLITS.names[-1]}' END"


REPORTS = """reports AS (
  SELECT event_id AS _source_row, user_id AS mac_rnti, epoch_us(ts) / 1e6 AS event_time_s, event_type AS label, value,
         value / (value + 50.0) AS risk_score, CAST(json_extract_string(props, '$.k') AS BIGINT) AS id_ue,
         'm' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) // 25 AS VARCHAR) AS mob_pattern
  FROM events)"""


def blocks(rule: TraceRule = RULE) -> str:
    return f"""{REPORTS},
stepped AS (SELECT *, lag(event_time_s) OVER (ORDER BY event_time_s, _source_row) AS prev_t FROM reports),
numbered AS (
  SELECT * EXCLUDE (prev_t), CAST(SUM(CASE WHEN prev_t IS NULL OR event_time_s - prev_t > {rule.gap_seconds}
           OR floor(event_time_s / {rule.max_block_seconds}) <> floor(prev_t / {rule.max_block_seconds}) THEN 1 ELSE 0 END)
           OVER (ORDER BY event_time_s, _source_row ROWS UNBOUNDED PRECEDING) AS BIGINT) - 1 AS trace_block_id
  FROM stepped),
blocked AS (
  SELECT n.*, {split_case("max(event_time_s) OVER (PARTITION BY trace_block_id)")} AS split FROM numbered n)"""


def leases(rule: TraceRule = RULE) -> str:
    return f"""{blocks(rule)},
gaps AS (SELECT *, lag(event_time_s) OVER (PARTITION BY trace_block_id, mac_rnti ORDER BY event_time_s, _source_row) AS pl
         FROM blocked),
opened AS (
  SELECT * EXCLUDE (pl), CAST(SUM(CASE WHEN event_time_s - pl > {rule.lease_gap_seconds} THEN 1 ELSE 0 END) OVER
           (PARTITION BY trace_block_id, mac_rnti ORDER BY event_time_s, _source_row ROWS UNBOUNDED PRECEDING) AS BIGINT)
           AS rnti_lease_sequence
  FROM gaps),
prepared AS (SELECT *, trace_block_id || ':' || mac_rnti || ':' || rnti_lease_sequence AS rnti_lease_id FROM opened)"""


def epochs(rule: TraceRule = RULE) -> str:
    width = rule.epoch_seconds
    return f"""{leases(rule)},
epochs AS MATERIALIZED (
  SELECT *, n_error OR n_purchase AS is_attack_epoch, n_error AND n_purchase AS mixed_attack_epoch,
         label_type_count > 1 AS mixed_label_epoch, epoch_start_s + {width} AS decision_time_s, {width}::DOUBLE AS epoch_seconds
  FROM (SELECT trace_block_id, rnti_lease_id, mac_rnti, split, floor(event_time_s / {width}) * {width} AS epoch_start_s,
               count(*) AS samples_in_epoch, min(event_time_s) AS first_event_time_s, max(event_time_s) AS last_event_time_s,
               arg_max(value, event_time_s) AS value, arg_max(risk_score, event_time_s) AS risk_score,
               list_sort(list(DISTINCT label)) AS labels_in_epoch, bool_or(label = 'error') AS n_error,
               bool_or(label = 'purchase') AS n_purchase, CAST(count(DISTINCT label) AS INT) AS label_type_count
        FROM prepared GROUP BY ALL))"""


def trace(
    specs: Sequence[CandidateSpec] | str = LOCKED, rule: TraceRule = RULE, source: str = "epochs", where: str = "true"
) -> str:
    """Long action table from a recursive controller that walks every lease report by report.

    ``specs`` may be SQL that ends in a table ``cand`` like the one of :func:`values`.
    """
    return f"""{epochs(rule)},
{specs if isinstance(specs, str) else values(specs)},
seq AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY rnti_lease_id ORDER BY decision_time_s) AS pos,
         lag(is_attack_epoch) OVER (PARTITION BY rnti_lease_id ORDER BY decision_time_s) AS prev_attack
  FROM {source} WHERE {where}),
walk AS (
  SELECT c.candidate, s.rnti_lease_id, 0::BIGINT AS pos, 0 AS state, 0 AS previous, 0 AS older, s.decision_time_s AS since,
         NULL::DOUBLE AS ev, NULL::DOUBLE AS ev_t, -1 AS want, 0::DOUBLE AS want_t, 0 AS want_n
  FROM seq s, cand c WHERE s.pos = 1
  UNION ALL
  SELECT candidate, rnti_lease_id, pos, CASE WHEN moved THEN goal ELSE state END, state, previous,
         CASE WHEN moved THEN t ELSE since END, ev, t, CASE WHEN moved OR goal = state THEN -1 ELSE goal END, want_t,
         CASE WHEN moved THEN 0 ELSE want_n END
  FROM (SELECT *, goal <> state AND want_n >= CASE WHEN goal > state THEN en ELSE rn END
               AND (goal > state OR t - since >= CASE state WHEN 2 THEN hi ELSE hr END) AS moved
        FROM (SELECT * EXCLUDE (want_t, want_n), CASE WHEN goal = state THEN 0 WHEN goal = want THEN want_n + 1 ELSE 1 END AS want_n,
                     CASE WHEN goal = want THEN want_t ELSE t END AS want_t
              FROM (SELECT *, CASE WHEN staged AND state = 1 THEN CASE WHEN ev >= ie THEN 2 WHEN ev < rx THEN 0 ELSE 1 END
                                   WHEN staged AND state = 2 THEN CASE WHEN ev < ix THEN 1 ELSE 2 END
                                   WHEN ev >= ie THEN 2 WHEN ev >= re THEN 1 ELSE 0 END AS goal
                    FROM (SELECT w.candidate, w.rnti_lease_id, s.pos, w.state, w.previous, w.since, w.want, w.want_t, w.want_n,
                                 s.decision_time_s AS t, c.re, c.rx, c.ie, c.ix, c.en, c.rn, c.hr, c.hi, c.staged,
                                 CASE WHEN c.tau IS NULL OR w.ev IS NULL THEN s.risk_score
                                      ELSE w.ev + (1 - exp(-(s.decision_time_s - w.ev_t) / c.tau)) * (s.risk_score - w.ev) END AS ev
                          FROM walk w JOIN seq s ON s.rnti_lease_id = w.rnti_lease_id AND s.pos = w.pos + 1
                               JOIN cand c ON c.candidate = w.candidate))))),
trace AS MATERIALIZED (
  SELECT s.*, c.candidate, c.family, c.controller_kind, w.ev AS evidence_score, w.state AS decision_state,
         w.previous AS previous_state, w.previous AS effective_state, w.older AS effective_previous_state
  FROM walk w JOIN seq s USING (rnti_lease_id, pos) JOIN cand c USING (candidate))"""


ACTION_SUMS = """count(*) AS epochs, sum(epoch_seconds) AS observed_time_s,
       coalesce(sum(epoch_seconds) FILTER (NOT is_attack_epoch), 0) AS benign_time_s,
       coalesce(sum(epoch_seconds) FILTER (is_attack_epoch), 0) AS attack_time_s,
       coalesce(sum(epoch_seconds) FILTER (NOT is_attack_epoch AND effective_state >= 1), 0) AS benign_contained_time_s,
       coalesce(sum(epoch_seconds) FILTER (NOT is_attack_epoch AND effective_state = 2), 0) AS benign_isolated_time_s,
       coalesce(sum(epoch_seconds) FILTER (is_attack_epoch AND effective_state >= 1), 0) AS attack_contained_time_s,
       coalesce(sum(epoch_seconds) FILTER (is_attack_epoch AND effective_state = 0), 0) AS attack_exposed_time_s,
       coalesce(sum(epoch_seconds) FILTER (is_attack_epoch AND effective_state < 2), 0) AS attack_not_isolated_time_s,
       count(*) FILTER (effective_state <> effective_previous_state) AS effective_transitions,
       CAST(sum(abs(effective_state - effective_previous_state)) AS BIGINT) AS severity_transition_total,
       count(*) FILTER (effective_state >= 1 AND effective_previous_state < 1) AS containment_starts,
       count(*) FILTER (effective_state >= 1 AND effective_previous_state < 1 AND NOT is_attack_epoch) AS benign_containment_starts"""

ACTION_RATIOS = ", ".join(
    [
        r6("benign_contained_time_s / nullif(benign_time_s, 0)", "benign_friction"),
        r6("attack_contained_time_s / nullif(attack_time_s, 0)", "attack_time_containment"),
        r6("3600.0 * effective_transitions / observed_time_s", "transitions_per_lease_hour"),
        r6("benign_isolated_time_s / nullif(benign_time_s, 0)", "benign_isolation"),
        r6("attack_exposed_time_s / nullif(attack_time_s, 0)", "malicious_allow"),
        r6("attack_not_isolated_time_s / nullif(attack_time_s, 0)", "malicious_not_isolated"),
        r6("60.0 * effective_transitions / observed_time_s", "transitions_per_lease_minute"),
    ]
)


def with_recursive(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{select}"


STREAM_MASKS = (
    ("__any_attack__", "is_attack_epoch"),
    ("error", "n_error"),
    ("purchase", "n_purchase"),
    ("__mixed_attack__", "mixed_attack_epoch"),
)


def epoch_episodes(cap: float, merge_gap: float = 0.0, table: str = "trace") -> str:
    """Gaps and islands per candidate, lease and stream, then one row per island."""
    union = " UNION ALL ".join(
        f"SELECT *, '{name}' AS attack_type, {mask} AS inside FROM {table}" for name, mask in STREAM_MASKS
    )
    part = "PARTITION BY candidate, rnti_lease_id, attack_type"
    return f"""streams AS ({union}),
edges AS (
  SELECT *, inside AND (NOT coalesce(lag(inside) OVER w, false)
         OR decision_time_s - epoch_seconds - lag(decision_time_s) OVER w > {merge_gap} + 1e-12) AS onset
  FROM streams WINDOW w AS ({part} ORDER BY decision_time_s)),
islands AS (
  SELECT *, CAST(sum(CASE WHEN onset THEN 1 ELSE 0 END) OVER ({part} ORDER BY decision_time_s ROWS UNBOUNDED PRECEDING)
              AS BIGINT) - 1 AS episode_sequence FROM edges),
firsts AS (
  SELECT *, min(CASE WHEN effective_state >= 1 THEN decision_time_s - epoch_seconds END)
              OVER (PARTITION BY candidate, rnti_lease_id, attack_type, episode_sequence) AS first_start
  FROM islands WHERE inside),
grouped AS (
  SELECT candidate, family, mac_rnti AS subject_id, rnti_lease_id AS lease_id, attack_type, episode_sequence,
         min(trace_block_id) AS onset_block_id, min(decision_time_s - epoch_seconds) AS start_s, max(decision_time_s) AS end_s,
         sum(epoch_seconds) AS attack_time_s, count(*) AS attack_epochs,
         coalesce(sum(epoch_seconds) FILTER (effective_state >= 1), 0) AS contained_time_s,
         coalesce(sum(epoch_seconds) FILTER (effective_state < 1), 0) AS exposed_time_s,
         coalesce(sum(epoch_seconds) FILTER (mixed_attack_epoch), 0) AS mixed_attack_time_s,
         bool_or(onset AND effective_state >= 1) AS contained_at_onset,
         bool_or(onset AND effective_previous_state >= 1) AS pre_contained_at_onset,
         bool_or(onset AND mixed_attack_epoch) AS mixed_attack_at_onset,
         min(first_start) AS first_containment_start_s,
         coalesce(sum(epoch_seconds) FILTER (effective_state < 1 AND (first_start IS NULL
                  OR decision_time_s - epoch_seconds < first_start)), 0) AS exposure_before_containment_s
  FROM firsts GROUP BY ALL),
episodes AS MATERIALIZED (
  SELECT *, '[' || subject_id || ',"' || lease_id || '","' || attack_type || '",' || episode_sequence || ']' AS episode_key,
         end_s - start_s AS span_s, contained_at_onset AND NOT pre_contained_at_onset AS onset_transition_to_containment,
         CASE WHEN pre_contained_at_onset THEN 'pre_contained' WHEN contained_at_onset THEN 'contained_onset_transition'
              ELSE 'initially_exposed' END AS onset_stratum,
         first_containment_start_s IS NOT NULL AS covered,
         first_containment_start_s IS NOT NULL AND NOT pre_contained_at_onset AS reactively_covered,
         first_containment_start_s - start_s AS delay_s, first_containment_start_s IS NULL AS censored,
         least(coalesce(first_containment_start_s - start_s, end_s - start_s), {cap}) AS capped_delay_s
  FROM grouped)"""


def report_episodes(cap: float, table: str = "trace") -> str:
    part = "PARTITION BY candidate, rnti_lease_id ORDER BY decision_time_s"
    return f"""runs AS (
  SELECT *, sum(CASE WHEN is_attack_epoch AND NOT coalesce(prev_attack, false) THEN 1 ELSE 0 END)
           OVER ({part} ROWS UNBOUNDED PRECEDING) AS episode FROM {table}),
run_sums AS (
  SELECT candidate, family, trace_block_id, mac_rnti, rnti_lease_id, CAST(episode AS BIGINT) AS episode, 'attack' AS attack_type,
         min(decision_time_s) AS start_s, sum(epoch_seconds) AS duration_s, count(*) AS reports,
         min(CASE WHEN effective_state >= 1 THEN decision_time_s END) AS first_action_s,
         coalesce(sum(epoch_seconds) FILTER (effective_state >= 1), 0) AS contained_time_s
  FROM runs WHERE is_attack_epoch GROUP BY ALL),
report_episodes AS (
  SELECT *, start_s + duration_s AS end_s, first_action_s IS NOT NULL AS covered, first_action_s - start_s AS delay_s,
         first_action_s IS NULL AS censored, duration_s AS censor_time_s,
         least(coalesce(first_action_s - start_s, duration_s), duration_s, {cap}) AS capped_delay_s,
         contained_time_s / duration_s AS contained_fraction
  FROM run_sums)"""


def candidate_metrics(cap: float, table: str = "trace") -> str:
    """One metrics row per candidate, from ``trace``."""
    return f"""{report_episodes(cap, table)},
sums AS (
  SELECT candidate, family, {ACTION_SUMS},
         count(*) FILTER (NOT is_attack_epoch AND effective_state >= 1
                          AND NOT (coalesce(NOT prev_attack, false) AND effective_previous_state >= 1)) AS false_restriction_episodes
  FROM {table} GROUP BY ALL),
eps AS (
  SELECT candidate, count(*) AS attack_episodes, avg(CASE WHEN covered THEN 1.0 ELSE 0.0 END) AS episode_coverage,
         median(capped_delay_s) AS median_capped_delay_s
  FROM report_episodes GROUP BY candidate),
metrics AS MATERIALIZED (
  SELECT candidate, family, benign_contained_time_s / benign_time_s AS benign_friction,
         benign_isolated_time_s / benign_time_s AS benign_isolation, attack_exposed_time_s / attack_time_s AS malicious_allow,
         attack_not_isolated_time_s / attack_time_s AS malicious_not_isolated, effective_transitions AS transitions,
         60.0 * effective_transitions / observed_time_s AS transitions_per_minute,
         60.0 * severity_transition_total / observed_time_s AS severity_transitions_per_minute,
         false_restriction_episodes, attack_episodes, episode_coverage, median_capped_delay_s
  FROM sums JOIN eps USING (candidate))"""
