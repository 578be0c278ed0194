"""Queries: paired cluster bootstrap, gates, report tables, integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegate import columns as C
from pulsegate.operators import calibration as cal
from pulsegate.operators import contributions as contrib
from pulsegate.operators import integrity, reports, splits
from pulsegate.operators import resampling as boot
from pulsegate.operators.controllers import action_trace, replay_inputs
from pulsegate.operators.episodes import epoch_episodes, episode_summary
from pulsegate.operators.epochs import causal_epochs
from pulsegate.operators.metrics import BY_CANDIDATE, action_metrics, novelty_strata, stratified_metrics
from pulsegate.operators.selection import cascade_selection
from pulsegate.plans import sql
from pulsegate.plans.queries_replay import _attack_ctes, attack_contributions
from pulsegate.plans.queries_select import _CASCADE, BUDGETS, TOLERANCES, declared_metrics
from pulsegate.plans.registry import query
from pulsegate.plans.sql import r6, with_recursive
from pulsegate.plans.study import DAILY, DELAY_CAP_S, EPOCH, LOCKED, PROPOSED, REFERENCE, SPLITS, Study
from pulsegate.sources.events import EVENT_ONTOLOGY

REPLICATES = 5000
ATTACK_TYPES = ("error", "purchase")
SEED = boot.DEFAULT_SEED
GATES = (
    boot.Gate("attack_exposure_difference", "max", 0.02),
    boot.Gate("episode_coverage_difference", "min", -0.05),
    boot.Gate("mean_capped_delay_difference_s", "max", 3600.0),
    boot.Gate("transition_rate_ratio", "max", 0.75),
)


def universe(s: Study) -> DataFrame:
    return boot.block_universe(s.epochs)


def draws_for(s: Study, blocks: DataFrame) -> DataFrame:
    return boot.hash_draws(s.spark, REPLICATES, blocks.count(), SEED)


def primary_grid(s: Study, attack: str = C.ANY_ATTACK) -> DataFrame:
    """Both policies' action and attack values per block, with the draw index."""
    blocks = universe(s)
    action = contrib.action_contributions(s.trace())
    left = contrib.paired_grid(action, blocks, PROPOSED, REFERENCE, contrib.ACTION_VALUES)
    values = contrib.ATTACK_VALUES
    right = contrib.paired_grid(attack_contributions(s), blocks, PROPOSED, REFERENCE, values, attack)
    joined = left.drop("p_present", "r_present").join(right.drop("p_present", "r_present"), C.BLOCK)
    return joined.join(blocks, C.BLOCK)


def contrast_table(s: Study, contrasts=boot.PRIMARY_CONTRASTS) -> tuple[DataFrame, DataFrame]:
    """(intervals, draws) of the primary contrasts over one materialised block grid."""
    grid = primary_grid(s).persist()
    draws = boot.contrast_draws(grid, draws_for(s, universe(s)), contrasts)
    return boot.intervals(boot.contrast_estimates(grid, contrasts), draws, REPLICATES), draws


# -- SQL of the bootstrap -------------------------------------------------------------------

_PAIRS = ("observed_time_s", "benign_time_s", "attack_time_s", "benign_contained_time_s", "attack_exposed_time_s")


def _pick(table_values: dict[str, str]) -> str:
    cells = []
    for name, source in table_values.items():
        for tag, who in (("p", PROPOSED), ("r", REFERENCE)):
            cells.append(f"coalesce(sum({source}) FILTER (candidate = '{who}'), 0)::DOUBLE AS {tag}_{name}")
    return ", ".join(cells)


_ACTION_PICK = _pick({n: n for n in _PAIRS} | {"effective_transition_count": "effective_transitions"})
_ATTACK_PICK = _pick({n: n for n in contrib.ATTACK_VALUES})
def _draws(cluster: str = "trace_block_id", among: str = "true") -> str:
    return f"""uni AS (SELECT trace_block_id, row_number() OVER (ORDER BY CAST(trace_block_id AS VARCHAR)) - 1 AS idx
    FROM (SELECT DISTINCT {cluster} AS trace_block_id FROM epochs WHERE {among})),
nb AS (SELECT count(*) AS n FROM uni),
draws AS (SELECT r.range AS replicate, ('0x' || substr(md5('{SEED}:' || r.range || ':' || s.slot), 1, 8))::UBIGINT % n AS idx
    FROM range({REPLICATES}) r, (SELECT unnest(range(n)) AS slot, n FROM nb) s)"""


def _contrast_sql(p: str, r: str, c: boot.Contrast) -> str:
    a = f"{p}_{c.numerator} / nullif({p}_{c.denominator}, 0)"
    b = f"{r}_{c.numerator} / nullif({r}_{c.denominator}, 0)"
    return f"CASE WHEN r_{c.numerator} > 0 THEN ({a}) / ({b}) END" if c.kind == "rate_ratio" else f"({a}) - ({b})"


def _undefined_sql(c: boot.Contrast) -> str:
    empty = f"coalesce(p_{c.denominator}, 0) <= 0 OR coalesce(r_{c.denominator}, 0) <= 0"
    if c.kind != "rate_ratio":
        return f"CASE WHEN {empty} THEN 'undefined_zero_aggregate_denominator' END"
    return f"""CASE WHEN {empty} THEN 'undefined_zero_observed_time'
        WHEN r_{c.numerator} <= 0 THEN 'undefined_zero_reference_transition_rate' END"""


def status_sql(valid: str, undefined: str = "NULL") -> str:
    """Status of an interval from its counts."""
    return f"CASE WHEN {undefined} IS NOT NULL THEN {undefined} WHEN {valid} < {max(100, -(-REPLICATES // 2))} THEN 'insufficient_valid_replicates' ELSE 'ok' END"


def boot_ctes(
    contrasts=boot.PRIMARY_CONTRASTS,
    attack: str = "__any_attack__",
    cluster: str = "trace_block_id",
    among: str = "true",
    trace: str = "trace",
    before: str | None = None,
) -> str:
    """CTEs up to ``iv``, one row per contrast; blocks may be coarsened, ``trace`` and the attack tables ``before`` it replaced."""
    names = sorted({f"{t}_{v}" for c in contrasts for v in (c.numerator, c.denominator) for t in "pr"})
    sums = ", ".join(f"sum({n}) AS {n}" for n in names)
    unions = " UNION ALL ".join(
        f"SELECT replicate, '{c.metric}' AS metric, {_contrast_sql('p', 'r', c)} AS value FROM rs" for c in contrasts
    )
    points = " UNION ALL ".join(
        f"SELECT '{c.metric}' AS metric, '{c.direction}' AS gate_direction, {_contrast_sql('p', 'r', c)} AS estimate, {_undefined_sql(c)} AS undefined FROM tot"
        for c in contrasts
    )
    return f"""{before or _attack_ctes(DAILY)}, {_draws(cluster, among)},
ga AS (SELECT {cluster} AS trace_block_id, {_ACTION_PICK} FROM (SELECT candidate, family, trace_block_id, {sql.ACTION_SUMS} FROM {trace} GROUP BY ALL) q
    GROUP BY 1),
gt AS (SELECT {cluster} AS trace_block_id, {_ATTACK_PICK} FROM ab WHERE attack_type = '{attack}' GROUP BY 1),
gx AS (SELECT {cluster} AS trace_block_id, {_pick({n: n for n in ('exposed_time_s', 'attack_time_s')})} FROM ab WHERE attack_type = '{attack}' GROUP BY 1),
grid AS MATERIALIZED (SELECT * FROM uni LEFT JOIN ga USING (trace_block_id) LEFT JOIN gt USING (trace_block_id)),
xgrid AS MATERIALIZED (SELECT * FROM uni LEFT JOIN gx USING (trace_block_id)),
tgrid AS MATERIALIZED (SELECT * FROM xgrid LEFT JOIN gt USING (trace_block_id)),
rs AS (SELECT replicate, {sums} FROM draws JOIN {{grid}} USING (idx) GROUP BY 1),
tot AS (SELECT {sums} FROM {{grid}}),
dv AS MATERIALIZED ({unions}),
pt AS ({points}),
qv AS (SELECT metric, any_value(gate_direction) AS gate_direction, any_value(estimate) AS estimate, any_value(undefined) AS undefined,
    count(value) AS valid_replicates, quantile_cont(value, 0.025) AS q1, quantile_cont(value, 0.975) AS q2, quantile_cont(value, 0.05) AS q3,
    quantile_cont(value, 0.95) AS q4 FROM pt LEFT JOIN dv USING (metric) GROUP BY metric),
iv AS (SELECT metric, gate_direction, CASE WHEN undefined IS NULL THEN estimate END AS estimate, valid_replicates, status,
    CASE WHEN status = 'ok' THEN q1 END AS ci_lower, CASE WHEN status = 'ok' THEN q2 END AS ci_upper,
    CASE WHEN status = 'ok' THEN q3 END AS one_sided_lower, CASE WHEN status = 'ok' THEN q4 END AS one_sided_upper
    FROM (SELECT *, {status_sql("valid_replicates", "undefined")} AS status FROM qv))"""


_BOOT = boot_ctes().replace("{grid}", "grid")
_IV_VIEW = "metric, gate_direction, valid_replicates, status, " + ", ".join(
    r6(c) for c in ("estimate", "ci_lower", "ci_upper", "one_sided_lower", "one_sided_upper")
)
_END = "CASE gate_direction WHEN 'upper' THEN one_sided_upper ELSE one_sided_lower END"


def _interval_view(df: DataFrame) -> DataFrame:
    bounds = ("estimate", "ci_lower", "ci_upper", "one_sided_lower", "one_sided_upper")
    return df.select("metric", "gate_direction", "valid_replicates", "status", *bounds)


def _interval_query(name: str, metrics: list[str], where: str):
    chosen = tuple(c for c in boot.PRIMARY_CONTRASTS if c.metric in metrics)

    @query(name, with_recursive(_BOOT, f"SELECT {_IV_VIEW} FROM iv WHERE {where}"), rule=DAILY)
    def run(s: Study):
        return _interval_view(contrast_table(s, chosen)[0])

    return run


_interval_query(
    "boot_ratio_difference",
    ["benign_friction_difference", "attack_exposure_difference", "episode_coverage_difference"],
    "metric IN ('benign_friction_difference', 'attack_exposure_difference', 'episode_coverage_difference')",
)
_interval_query("boot_rate_ratio", ["transition_rate_ratio"], "metric = 'transition_rate_ratio'")


@query("boot_draw_values", with_recursive(_BOOT, f"SELECT replicate, metric, {r6('value')} FROM dv"), rule=DAILY)
def boot_draw_values(s: Study):
    """Every replicate's value of the five primary contrasts."""
    return contrast_table(s)[1]


@query(
    "boot_intervals",
    with_recursive(
        _BOOT,
        f"""SELECT {_IV_VIEW}, {r6(_END, 'gate_endpoint')}, {REPLICATES} - valid_replicates AS invalid_replicates,
        {REPLICATES} AS requested_replicates, (SELECT n FROM nb) AS clusters FROM iv""",
    ),
    rule=DAILY,
)
def boot_intervals(s: Study):
    return contrast_table(s)[0]


@query(
    "gate_decisions",
    with_recursive(
        _BOOT,
        f"""SELECT metric, direction, threshold, {r6(_END, 'endpoint')}, CASE direction WHEN 'max' THEN {_END} <= threshold
        ELSE {_END} >= threshold END AS passed, CASE WHEN passed THEN 'pass' ELSE 'fail' END AS status FROM iv JOIN (VALUES
        ('attack_exposure_difference', 'max', 0.02::DOUBLE), ('episode_coverage_difference', 'min', -0.05::DOUBLE),
        ('mean_capped_delay_difference_s', 'max', 3600.0::DOUBLE), ('transition_rate_ratio', 'max', 0.75::DOUBLE))
        g(metric, direction, threshold) USING (metric)""",
    ),
    rule=DAILY,
)
def gate_decisions(s: Study):
    return boot.gate_decisions(contrast_table(s)[0], GATES)


_P_VALUES = """pv AS (SELECT metric, (count(*) FILTER (CASE direction WHEN 'max' THEN value > threshold ELSE value < threshold END) + 1)
    / (count(*) + 1) AS p FROM dv JOIN (VALUES ('attack_exposure_difference', 'max', 0.02::DOUBLE),
    ('episode_coverage_difference', 'min', -0.05::DOUBLE), ('mean_capped_delay_difference_s', 'max', 3600.0::DOUBLE),
    ('transition_rate_ratio', 'max', 0.75::DOUBLE)) g(metric, direction, threshold) USING (metric) WHERE value IS NOT NULL GROUP BY 1)"""


@query(
    "holm_adjusted",
    with_recursive(
        f"{_BOOT}, {_P_VALUES}",
        f"""SELECT metric, {r6('p')}, {r6('least(max(scaled) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING), 1.0)', 'p_adjusted')}
        FROM (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p) + 1) * p AS scaled FROM pv)""",
    ),
    rule=DAILY,
)
def holm_adjusted(s: Study):
    return boot.holm(boot.tail_p_values(contrast_table(s)[1], GATES))


def single_friction(s: Study) -> DataFrame:
    blocks = universe(s)
    table = contrib.action_contributions(s.trace())
    contrast = boot.Contrast("benign_friction", "benign_contained_time_s", "benign_time_s")
    grid = boot.single_ratio_grid(table, blocks, PROPOSED, contrast.numerator, contrast.denominator)
    grid = grid.join(blocks, C.BLOCK).persist()
    draws = boot.contrast_draws(grid, draws_for(s, blocks), [contrast])
    return boot.intervals(boot.contrast_estimates(grid, [contrast]), draws, REPLICATES)


_SINGLE_SQL = with_recursive(
    _BOOT,
    f"""SELECT 'benign_friction' AS metric, 'upper' AS gate_direction, count(v) AS valid_replicates, {status_sql('count(v)')} AS status,
    {r6('(SELECT p_benign_contained_time_s / p_benign_time_s FROM tot)', 'estimate')}, {r6('quantile_cont(v, 0.025)', 'ci_lower')},
    {r6('quantile_cont(v, 0.975)', 'ci_upper')}, {r6('quantile_cont(v, 0.05)', 'one_sided_lower')},
    {r6('quantile_cont(v, 0.95)', 'one_sided_upper')} FROM (SELECT p_benign_contained_time_s / nullif(p_benign_time_s, 0) AS v FROM rs)""",
)


@query("boot_single_friction", _SINGLE_SQL, rule=DAILY)
def boot_single_friction(s: Study):
    return _interval_view(single_friction(s))


def class_exposure(s: Study, attack: str) -> DataFrame:
    blocks = universe(s)
    values = (boot.CLASS_EXPOSURE.numerator, boot.CLASS_EXPOSURE.denominator)
    grid = contrib.paired_grid(attack_contributions(s), blocks, PROPOSED, REFERENCE, values, attack)
    grid = grid.join(blocks, C.BLOCK).persist()
    draws = boot.contrast_draws(grid, draws_for(s, blocks), [boot.CLASS_EXPOSURE])
    return boot.intervals(boot.contrast_estimates(grid, [boot.CLASS_EXPOSURE]), draws, REPLICATES)


@query(
    "boot_class_exposure",
    " UNION ALL ".join(
        f"SELECT '{a}' AS attack_type, * FROM ("
        + with_recursive(boot_ctes((boot.CLASS_EXPOSURE,), a).replace("{grid}", "xgrid"), f"SELECT {_IV_VIEW} FROM iv")
        + ")"
        for a in ATTACK_TYPES
    ),
    rule=DAILY,
)
def boot_class_exposure(s: Study):
    """Exposure contrast of every attack type."""
    each = [_interval_view(class_exposure(s, a)).select(F.lit(a).alias("attack_type"), "*") for a in ATTACK_TYPES]
    return reduce(DataFrame.unionByName, each)


def median_delay(s: Study) -> tuple[DataFrame, DataFrame]:
    blocks = universe(s)
    shown = s.episodes.where(F.col("attack_type") == C.ANY_ATTACK)
    pairs = boot.paired_episodes(shown, PROPOSED, REFERENCE).persist()
    draws = boot.median_delay_draws(pairs, blocks, draws_for(s, blocks))
    return boot.median_delay_estimate(pairs), draws


_MEDIAN = f"""{sql.trace(rule=DAILY)}, {sql.epoch_episodes(DELAY_CAP_S)}, {_draws()},
e2 AS (SELECT onset_block_id AS trace_block_id, candidate, capped_delay_s AS d FROM episodes
    WHERE attack_type = '__any_attack__' AND candidate IN ('{PROPOSED}', '{REFERENCE}')),
rep AS (SELECT replicate, candidate, median(d) AS m FROM draws JOIN uni USING (idx) JOIN e2 USING (trace_block_id) GROUP BY 1, 2),
dm AS (SELECT replicate, max(m) FILTER (candidate = '{PROPOSED}') - max(m) FILTER (candidate = '{REFERENCE}') AS value FROM rep GROUP BY 1)"""


_MEDIAN_SQL = with_recursive(
    _MEDIAN,
    f"""SELECT 'median_capped_delay_difference_s' AS metric, 'upper' AS gate_direction, count(value) AS valid_replicates, {status_sql('count(value)')} AS status,
    (SELECT {r6(f"median(d) FILTER (candidate = '{PROPOSED}') - median(d) FILTER (candidate = '{REFERENCE}')", 'x')} FROM e2) AS estimate,
    {r6('quantile_cont(value, 0.025)', 'ci_lower')}, {r6('quantile_cont(value, 0.975)', 'ci_upper')},
    {r6('quantile_cont(value, 0.05)', 'one_sided_lower')}, {r6('quantile_cont(value, 0.95)', 'one_sided_upper')} FROM dm""",
)


@query("boot_median_delay", _MEDIAN_SQL, rule=DAILY)
def boot_median_delay(s: Study):
    return _interval_view(boot.intervals(*median_delay(s), REPLICATES))


@query("boot_generator_draws", rule=DAILY)
def boot_generator_draws(s: Study):
    """Primary contrasts under the PCG64 draw matrix instead of hash draws."""
    grid = primary_grid(s).persist()
    draws = boot.generator_draws(s.spark, REPLICATES, universe(s).count(), SEED)
    values = boot.contrast_draws(grid, draws)
    return _interval_view(boot.intervals(boot.contrast_estimates(grid), values, REPLICATES))


@query(
    "cluster_bootstrap_grid",
    with_recursive(
        _BOOT,
        """SELECT trace_block_id // 3 AS cluster_group, sum(p_benign_contained_time_s) AS p_benign_contained_time_s,
        sum(r_benign_contained_time_s) AS r_benign_contained_time_s FROM grid GROUP BY 1""",
    ),
    rule=DAILY,
)
def cluster_bootstrap_grid(s: Study):
    """Both policies per three-block cluster (the coarser sensitivity grid)."""
    mapping = universe(s).select(C.BLOCK, F.floor(F.col(C.BLOCK) / 3).alias("cluster_group"))
    table = contrib.action_contributions(s.trace())
    rolled = contrib.roll_up(table, mapping, "cluster_group", [C.CANDIDATE])
    value = ("benign_contained_time_s",)
    grid = contrib.paired_grid(rolled, mapping, PROPOSED, REFERENCE, value, block="cluster_group")
    return grid.drop("p_present", "r_present")


@query(
    "cluster_episodes",
    with_recursive(
        f"{sql.trace(rule=DAILY)}, {sql.epoch_episodes(DELAY_CAP_S)}",
        """SELECT candidate, attack_type, onset_block_id // 3 AS onset_block_id, count(*) AS episodes FROM episodes GROUP BY 1, 2, 3""",
    ),
    rule=DAILY,
)
def cluster_episodes(s: Study):
    mapping = universe(s).select(C.BLOCK, F.floor(F.col(C.BLOCK) / 3).alias("cluster_group"))
    out = contrib.roll_up_episodes(s.episodes, mapping, "cluster_group")
    return out.groupBy(C.CANDIDATE, "attack_type", "onset_block_id").agg(F.count(F.lit(1)).alias("episodes"))


# -- report tables --------------------------------------------------------------------------

_ORDER = "CASE family WHEN 'proposed' THEN 0 WHEN 'stateless_reference' THEN 1 WHEN 'ewma' THEN 2 WHEN 'n_report' THEN 3 ELSE 4 END"
_LABEL = """CASE family WHEN 'proposed' THEN 'Friction-budgeted' WHEN 'stateless_reference' THEN 'Stateless' WHEN 'ewma' THEN 'EWMA'
    WHEN 'n_report' THEN 'Two-report' ELSE 'Symmetric hysteresis' END"""
TEST = "split = 'test'"


@query(
    "heldout_table",
    with_recursive(
        f"{sql.trace(where=TEST)}, {sql.epoch_episodes(DELAY_CAP_S)}",
        f"""SELECT {_ORDER} AS policy_order, {_LABEL} AS policy, CASE family WHEN 'proposed' THEN 'proposed'
          WHEN 'stateless_reference' THEN 'static reference' ELSE 'comparator' END AS role, epochs,
        {r6('100 * benign_contained_time_s / benign_time_s', 'benign_friction_pct')},
        {r6('100 * benign_isolated_time_s / benign_time_s', 'benign_isolation_pct')},
        {r6('100 * attack_exposed_time_s / attack_time_s', 'malicious_allow_pct')},
        {r6('100 * attack_not_isolated_time_s / attack_time_s', 'malicious_not_isolated_pct')}, effective_transitions,
        {r6('1000.0 * effective_transitions / epochs', 'transitions_per_1000_observed_epochs')}, attack_episode_count,
        {r6('100 * ec', 'episode_coverage_pct')}, {r6('ed', 'mean_capped_delay_s')}, {r6('em', 'median_capped_delay_s')}
        FROM (SELECT candidate, family, {sql.ACTION_SUMS} FROM trace GROUP BY ALL) JOIN (
          SELECT candidate, count(*) AS attack_episode_count, avg(covered::INT) AS ec, avg(capped_delay_s) AS ed, median(capped_delay_s) AS em
          FROM episodes WHERE attack_type = '__any_attack__' GROUP BY 1) USING (candidate)""",
    ),
)
def heldout_table(s: Study):
    trace = s.trace(LOCKED, s.marked.where(F.col(C.SPLIT) == "test"))
    episodes = epoch_episodes(trace, delay_cap_s=DELAY_CAP_S)
    return reports.heldout_table(action_metrics(trace), episode_summary(episodes))


def per_attack_bounds(s: Study, attack: str) -> DataFrame:
    """Exposure, coverage and delay contrasts of one attack type."""
    blocks = universe(s)
    values = ("exposed_time_s", "attack_time_s", *contrib.ATTACK_VALUES)
    grid = contrib.paired_grid(attack_contributions(s), blocks, PROPOSED, REFERENCE, values, attack)
    grid = grid.join(blocks, C.BLOCK).persist()
    draws = boot.contrast_draws(grid, draws_for(s, blocks), PER_ATTACK)
    out = boot.intervals(boot.contrast_estimates(grid, PER_ATTACK), draws, REPLICATES)
    return out.withColumn("attack_type", F.lit(attack))


PER_ATTACK = (boot.CLASS_EXPOSURE, *(c for c in boot.PRIMARY_CONTRASTS if c.metric in ("episode_coverage_difference", "mean_capped_delay_difference_s")))


def _per_attack_sql(order: int, attack: str) -> str:
    def point(expr: str, scale: float, name: str) -> str:
        both = (("proposal", PROPOSED), ("reference", REFERENCE))
        return ", ".join(
            r6(f"(SELECT {scale} * {expr} FROM episodes WHERE attack_type = '{attack}' AND candidate = '{who}')", f"{side}_{name}")
            for side, who in both
        )

    def bounds(metric: str, scale: float, name: str, unit: str, estimate: str) -> str:
        ends = {"estimate": estimate, "ci_lower": f"{name}_ci_lower_{unit}", "ci_upper": f"{name}_ci_upper_{unit}"}
        return ", ".join(r6(f"max({scale} * {e}) FILTER (metric = '{metric}')", alias) for e, alias in ends.items())

    return "SELECT * FROM (" + with_recursive(
        boot_ctes(PER_ATTACK, attack).replace("{grid}", "tgrid"),
        f"""SELECT {order} AS attack_order, '{attack}' AS attack_type, {str(attack == "purchase").lower()} AS known_failure_mode,
        (SELECT count(*) FROM episodes WHERE attack_type = '{attack}' AND candidate = '{PROPOSED}') AS episodes,
        {point("sum(exposed_time_s) / sum(attack_time_s)", 100.0, "exposure_pct")}, {point("avg(covered::INT)", 100.0, "coverage_pct")},
        {point("avg(capped_delay_s)", 1.0, "mean_capped_delay_s")},
        {bounds("attack_exposure_difference", 100.0, "exposure", "pp", "exposure_difference_pp")},
        {bounds("episode_coverage_difference", 100.0, "coverage", "pp", "coverage_difference_pp")},
        {bounds("mean_capped_delay_difference_s", 1.0, "mean_delay", "s", "mean_delay_difference_s")} FROM iv""",
    ) + ")"


@query("per_attack_table", " UNION ALL ".join(_per_attack_sql(i, a) for i, a in enumerate(ATTACK_TYPES)), rule=DAILY)
def per_attack_table(s: Study):
    bounds = per_attack_bounds(s, "error").unionByName(per_attack_bounds(s, "purchase"))
    summary = episode_summary(s.episodes)
    return reports.per_attack_table(summary, bounds, PROPOSED, REFERENCE, ("error", "purchase"), ("purchase",))


@query(
    "seen_unseen_table",
    with_recursive(
        sql.trace(where=TEST),
        f"""SELECT CASE stratum WHEN 'rnti_seen' THEN 0 ELSE 1 END AS stratum_order, stratum, pe AS epochs,
        {r6('pf', 'proposal_benign_friction_pct')}, {r6('rf', 'reference_benign_friction_pct')},
        {r6('pa', 'proposal_malicious_allow_pct')}, {r6('ra', 'reference_malicious_allow_pct')},
        {r6('pi', 'proposal_not_isolated_pct')}, {r6('ri', 'reference_not_isolated_pct')},
        {r6('pt', 'proposal_transitions_per_1000_epochs')}, {r6('rt', 'reference_transitions_per_1000_epochs')},
        {r6('pf - rf', 'friction_difference_pp')}, {r6('pa - ra', 'exposure_difference_pp')}, {r6('pt / rt', 'transition_rate_ratio')}
        FROM (SELECT stratum, max(epochs) FILTER (p) AS pe, max(100 * benign_contained_time_s / benign_time_s) FILTER (p) AS pf,
            max(100 * benign_contained_time_s / benign_time_s) FILTER (NOT p) AS rf,
            max(100 * attack_exposed_time_s / attack_time_s) FILTER (p) AS pa, max(100 * attack_exposed_time_s / attack_time_s) FILTER (NOT p) AS ra,
            max(100 * attack_not_isolated_time_s / attack_time_s) FILTER (p) AS pi,
            max(100 * attack_not_isolated_time_s / attack_time_s) FILTER (NOT p) AS ri,
            max(1000.0 * effective_transitions / epochs) FILTER (p) AS pt, max(1000.0 * effective_transitions / epochs) FILTER (NOT p) AS rt
          FROM (SELECT CASE WHEN mac_rnti IN (SELECT mac_rnti FROM epochs WHERE split <> 'test') THEN 'rnti_seen' ELSE 'rnti_unseen' END
              AS stratum, family = 'proposed' AS p, {sql.ACTION_SUMS} FROM trace WHERE family IN ('proposed', 'stateless_reference')
              GROUP BY 1, 2) WHERE benign_time_s > 0 AND attack_time_s > 0 GROUP BY 1)""",
    ),
)
def seen_unseen_table(s: Study):
    trace = action_trace(s.novelty.where(F.col(C.SPLIT) == "test"), LOCKED, order=[C.DECISION_TIME])
    return reports.seen_unseen_table(stratified_metrics(trace, novelty_strata(trace)))


_FRONTIER_ORDER = "CASE family WHEN 'proposed' THEN 0 WHEN 'ewma' THEN 2 WHEN 'n_report' THEN 3 ELSE 4 END"
_FRONTIER_LABEL = """CASE family WHEN 'proposed' THEN 'Friction-budgeted' WHEN 'ewma' THEN 'EWMA' WHEN 'n_report' THEN 'Two-report'
    ELSE 'Symmetric hysteresis' END"""


def _frontier_values(t: str) -> str:
    pairs = {
        f"100 * {t}.benign_friction": "realized_friction_pct",
        f"100 * {t}.malicious_allow": "malicious_allow_pct",
        f"100 * {t}.malicious_not_isolated": "malicious_not_isolated_pct",
        f"{t}.transitions_per_minute": "transitions_per_observed_rnti_minute",
        f"100 * {t}.episode_coverage": "episode_coverage_pct",
        f"{t}.median_capped_delay_s": "median_capped_delay_s",
    }
    return ", ".join(r6(k, v) for k, v in pairs.items())


@query(
    "frontier_table",
    with_recursive(
        _CASCADE,
        f"""SELECT {r6('100 * n.b', 'budget_pct')}, {_FRONTIER_ORDER.replace('family', 'n.family')} AS family_order,
        {_FRONTIER_LABEL.replace('family', 'n.family')} AS policy_family,
        CASE WHEN nw = 0 THEN 'no budget matched candidate' WHEN ns = 0 THEN 'security inferior' WHEN ni = 0 THEN 'isolation inferior'
          WHEN nc = 0 THEN 'coverage inferior' WHEN nd = 0 THEN 'delay inferior' WHEN n.rt <= 1e-12 THEN 'reference churn zero'
          WHEN 1 - m.transitions_per_minute / n.rt + 1e-12 >= 0.1 THEN 'selected' ELSE 'insufficient transition reduction' END AS status,
        n.chosen AS candidate, {_frontier_values('m')} FROM n LEFT JOIN metrics m ON m.candidate = n.chosen
        UNION ALL SELECT round(100 * friction_budget, 6) + 0.0, 1, 'Stateless', 'budget reference', candidate, {_frontier_values('refs')} FROM refs""",
    ),
)
def frontier_table(s: Study):
    refs = cal.stateless_references(s.split("controller_tune"), BUDGETS, delay_cap_s=DELAY_CAP_S)
    return reports.frontier_table(cascade_selection(declared_metrics(s), refs, TOLERANCES), refs)


_PARTS_SQL = {
    "primary blocks": with_recursive(_BOOT, f"SELECT {_IV_VIEW} FROM iv"),
    "error exposure": with_recursive(
        boot_ctes((boot.CLASS_EXPOSURE,), "error").replace("{grid}", "xgrid"), f"SELECT {_IV_VIEW} FROM iv"
    ),
    "proposed friction": _SINGLE_SQL,
    "median delay": _MEDIAN_SQL,
}


@query(
    "robustness_table",
    " UNION ALL ".join(
        f"SELECT '{name}' AS analysis, metric, estimate, ci_lower, ci_upper, status FROM ({part})" for name, part in _PARTS_SQL.items()
    ),
    rule=DAILY,
)
def robustness_table(s: Study):
    """Primary, class-wise and single-policy contrasts stacked by analysis name."""
    keep = ("metric", "estimate", "ci_lower", "ci_upper", "status")
    parts = {
        "primary blocks": contrast_table(s)[0].select(*keep),
        "error exposure": class_exposure(s, "error").select(*keep),
        "proposed friction": single_friction(s).select(*keep),
        "median delay": boot.intervals(*median_delay(s), REPLICATES).select(*keep),
    }
    return reports.robustness_table(parts)


@query(
    "timing_summary",
    f"""SELECT event_type AS label, count(*) AS repetitions, {r6('median(value)', 'median_s')}, {r6('avg(value)', 'mean_s')},
    {r6('stddev_samp(value)', 'stdev_s')}, {r6('min(value)', 'min_s')}, {r6('max(value)', 'max_s')},
    {', '.join(r6(f'quantile_cont(value, {p / 100})', f'p{p:02d}_s') for p in (5, 25, 75, 95))},
    {r6('stddev_samp(value) / avg(value)', 'cv')} FROM events GROUP BY 1""",
)
def timing_summary(s: Study):
    """Summary statistics of repeated measurements (the event values per label)."""
    return reports.timing_summary(s.reports, ["label"], "value")


# -- integrity ------------------------------------------------------------------------------


@query(
    "integrity_checks",
    with_recursive(
        sql.trace(),
        """, v AS (
        SELECT 'epoch keys are unique' AS "check", (SELECT count(*) FROM (SELECT 1 FROM epochs GROUP BY rnti_lease_id, decision_time_s
          HAVING count(*) > 1)) AS violations
        UNION ALL SELECT 'scores are finite and in [0, 1]', count(*) FILTER (NOT risk_score BETWEEN 0 AND 1) FROM epochs
        UNION ALL SELECT 'partitions share no block', count(*) FROM (SELECT 1 FROM epochs GROUP BY trace_block_id HAVING count(DISTINCT split) > 1)
        UNION ALL SELECT 'durations are finite and positive', count(*) FILTER (NOT epoch_seconds > 0) FROM epochs
        UNION ALL SELECT 'entity, lease and block are known', count(*) FILTER (mac_rnti IS NULL OR rnti_lease_id IS NULL) FROM epochs
        UNION ALL SELECT 'epochs of a lease do not overlap', count(*) FROM (SELECT decision_time_s - epoch_seconds < lag(decision_time_s)
          OVER (PARTITION BY rnti_lease_id ORDER BY decision_time_s) - 1e-9 AS o FROM epochs) WHERE o
        UNION ALL SELECT 'a lease lies in one block', count(*) FROM (SELECT 1 FROM epochs GROUP BY rnti_lease_id
          HAVING count(DISTINCT trace_block_id) > 1)
        UNION ALL SELECT 'every candidate acts on every epoch', abs((SELECT count(*) FROM trace) - 5 * (SELECT count(*) FROM epochs))
        UNION ALL SELECT 'candidate and epoch keys are unique', count(*) FROM (SELECT 1 FROM trace GROUP BY candidate, rnti_lease_id,
          decision_time_s HAVING count(*) > 1)
        UNION ALL SELECT 'actions are ALLOW, RESTRICT or ISOLATE', count(*) FILTER (effective_state NOT IN (0, 1, 2)) FROM trace
        UNION ALL SELECT 'effective action is the previous decision', count(*) FROM (SELECT effective_state <> coalesce(lag(decision_state)
          OVER (PARTITION BY candidate, rnti_lease_id ORDER BY decision_time_s), 0) AS o FROM trace) WHERE o)
        SELECT "check", violations, violations = 0 AS passed FROM v""",
    ),
)
def integrity_checks(s: Study):
    # Every check reads these narrow rows; they stay placed by entity.
    epochs = s.epochs.select(C.BLOCK, C.SUBJECT, C.LEASE, C.DECISION_TIME, C.DURATION, C.SCORE, C.SPLIT).persist()
    trace = s.trace(LOCKED, replay_inputs(epochs))
    checks = [
        *integrity.score_checks(epochs),
        *integrity.replay_checks(epochs),
        *integrity.action_checks(trace, epochs, len(LOCKED)),
    ]
    return integrity.check_table(checks)


_ROLLED = "observed_time_s benign_time_s attack_time_s benign_contained_time_s attack_exposed_time_s".split()


@query(
    "integrity_recompute",
    with_recursive(
        f"{sql.trace(rule=DAILY)}, {sql.epoch_episodes(DELAY_CAP_S)}",
        f"""SELECT 'episode keys are identical across policies' AS "check", count(*) AS violations, count(*) = 0 AS passed
        FROM (SELECT 1 FROM episodes WHERE attack_type = '__any_attack__' GROUP BY episode_key HAVING count(DISTINCT candidate) <> {len(LOCKED)})
        UNION ALL SELECT 'aggregates recompute from action rows', count(*), count(*) = 0
          FROM (SELECT candidate, family, {sql.ACTION_SUMS} FROM trace GROUP BY ALL) whole
          JOIN (SELECT candidate, {', '.join(f'sum({v}) AS b_{v}' for v in _ROLLED)}
                FROM (SELECT candidate, trace_block_id, {sql.ACTION_SUMS} FROM trace GROUP BY ALL) GROUP BY 1) USING (candidate)
          WHERE {' OR '.join(f'{v} <> b_{v}' for v in _ROLLED)}""",
    ),
    rule=DAILY,
)
def integrity_recompute(s: Study):
    """Block contributions, added up, equal aggregates of the rows; episode keys agree across policies."""
    trace = s.trace()
    blocks = contrib.action_contributions(trace)
    rolled = blocks.groupBy(*BY_CANDIDATE).agg(*[F.sum(v).alias(v) for v in _ROLLED])
    checks = [
        *integrity.recompute_checks(trace, rolled),
        *integrity.episode_checks(s.episodes, len(LOCKED)),
    ]
    return integrity.check_table(checks)


@query(
    "row_alignment",
    f"""WITH {sql.epochs()}, a AS (SELECT trace_block_id, mac_rnti, rnti_lease_id, decision_time_s FROM epochs),
    b AS (SELECT DISTINCT trace_block_id, mac_rnti, trace_block_id || ':' || mac_rnti || ':' || rnti_lease_sequence AS rnti_lease_id,
        (floor(event_time_s / {EPOCH}) + 1) * {EPOCH} AS decision_time_s FROM opened)
    SELECT (SELECT count(*) FROM a) AS rows, count(*) AS misaligned
    FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a))""",
)
def row_alignment(s: Study):
    """The fused and the row-wise epoch builders agree on every key."""
    slow = causal_epochs(s.prepared, s.rule.epoch_seconds, [], (), EVENT_ONTOLOGY)
    off = integrity.alignment_violations(s.epochs, slow, integrity.EPOCH_KEY)
    counted = off.agg(F.count(F.lit(1)).alias("misaligned")).scalar()
    return s.epochs.agg(F.count(F.lit(1)).alias("rows")).withColumn("misaligned", counted)


@query(
    "block_overlaps",
    f"""WITH {sql.blocks(DAILY)}, b AS (SELECT trace_block_id, min(event_time_s) AS s, max(event_time_s) AS e FROM blocked GROUP BY 1)
    SELECT count(*) FILTER (s < pe) AS overlaps FROM (SELECT *, lag(e) OVER (ORDER BY s) AS pe FROM b)""",
    rule=DAILY,
)
def block_overlaps(s: Study):
    blocks = splits.block_summary(s.blocked.drop(C.SPLIT))
    return splits.check_blocks(splits.assign_splits(blocks, SPLITS))
