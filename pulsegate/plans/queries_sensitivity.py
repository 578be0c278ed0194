"""Queries: inference and metrics under other clusters, targets, episode gaps, entities and mobility patterns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegate import columns as C
from pulsegate.operators import contributions as contrib
from pulsegate.operators import resampling as boot
from pulsegate.operators.controllers import explode_candidates, replay_arrays
from pulsegate.operators.episodes import epoch_episodes, mark_streams, point_summary
from pulsegate.operators.epochs import annotate_labels, lease_epochs
from pulsegate.operators.metrics import mobility_stratum, stratified_metrics
from pulsegate.operators.splits import annotate_novelty
from pulsegate.plans import sql
from pulsegate.plans.queries_infer import _IV_VIEW, REPLICATES, _interval_view, boot_ctes, draws_for, universe
from pulsegate.plans.queries_replay import _ATTACK_BLOCKS, _SUMS, TIME, attack_contributions
from pulsegate.plans.registry import query
from pulsegate.plans.sql import r6, with_recursive
from pulsegate.plans.study import DAILY, DELAY_CAP_S, EPOCH, LOCKED, PROPOSED, REFERENCE, SPLITS, Study
from pulsegate.sources.events import EVENT_ONTOLOGY

CLUSTER_BLOCKS = 3


def additive_intervals(s: Study, action: DataFrame, attack: DataFrame, blocks: DataFrame) -> DataFrame:
    """Intervals of the primary contrasts from block-additive tables; ``blocks`` has the draw index."""
    left = contrib.paired_grid(action, blocks, PROPOSED, REFERENCE, contrib.ACTION_VALUES)
    right = contrib.paired_grid(attack, blocks, PROPOSED, REFERENCE, contrib.ATTACK_VALUES, C.ANY_ATTACK)
    joined = left.drop("p_present", "r_present").join(right.drop("p_present", "r_present"), C.BLOCK)
    grid = joined.join(blocks, C.BLOCK).persist()
    draws = boot.contrast_draws(grid, draws_for(s, blocks))
    return _interval_view(boot.intervals(boot.contrast_estimates(grid), draws, REPLICATES))


# -- coarser clusters -----------------------------------------------------------------------

_CLUSTER = f"trace_block_id // {CLUSTER_BLOCKS}"


@query(
    "inference_clusters",
    with_recursive(boot_ctes(cluster=_CLUSTER).replace("{grid}", "grid"), f"SELECT {_IV_VIEW} FROM iv"),
    rule=DAILY,
)
def inference_clusters(s: Study):
    """Primary contrasts when clusters of blocks are drawn instead of blocks."""
    group = "cluster_group"
    mapping = universe(s).select(C.BLOCK, F.floor(F.col(C.BLOCK) / CLUSTER_BLOCKS).alias(group))

    def rolled(table: DataFrame, keys: Sequence[str]) -> DataFrame:
        return contrib.roll_up(table, mapping, group, keys).withColumnRenamed(group, C.BLOCK)

    action = rolled(contrib.action_contributions(s.trace()), [C.CANDIDATE])
    attack = rolled(attack_contributions(s), [C.CANDIDATE, "attack_type"])
    return additive_intervals(s, action, attack, boot.block_universe(mapping.select(F.col(group).alias(C.BLOCK))))


# -- other targets and episode gaps -----------------------------------------------------------

_POINTS = f"""candidate, family, count(*) AS episode_count, {r6("avg(covered::INT)", "episode_coverage")},
    {r6("avg(capped_delay_s)", "mean_capped_delay_s")}, {r6("median(capped_delay_s)", "median_capped_delay_s")},
    sum(e.attack_time_s) AS attack_time_s, sum(e.exposed_time_s) AS exposed_time_s,
    {r6("sum(e.exposed_time_s) / sum(e.attack_time_s)", "malicious_allow")}"""


@query(
    "inference_exclusive_labels",
    with_recursive(
        f"""{sql.trace()}, xt AS (SELECT * FROM trace WHERE NOT mixed_attack_epoch), {sql.epoch_episodes(DELAY_CAP_S, table="xt")}""",
        f"""SELECT {_POINTS}, (SELECT count(*) FROM epochs WHERE mixed_attack_epoch) AS excluded_epochs
        FROM episodes e WHERE attack_type = '__any_attack__' GROUP BY 1, 2""",
    ),
)
def inference_exclusive_labels(s: Study):
    """Episodes when epochs of several attack types are no targets; the controllers still saw them."""
    single = mark_streams(s.replayed.where(~F.col("mixed_attack_epoch")), EVENT_ONTOLOGY, 0.0, TIME)
    summary = point_summary(epoch_episodes(explode_candidates(single, LOCKED), delay_cap_s=DELAY_CAP_S))
    excluded = s.epochs.where("mixed_attack_epoch").agg(F.count(F.lit(1)).alias("n"))
    return summary.withColumn("excluded_epochs", excluded.scalar())


GAPS = (0.0, EPOCH)


@query(
    "inference_zero_gap",
    " UNION ALL ".join(
        "SELECT * FROM ("
        + with_recursive(
            f"{sql.trace()}, {sql.epoch_episodes(DELAY_CAP_S, gap)}",
            f"SELECT {gap}::DOUBLE AS missing_gap_s, {_POINTS} FROM episodes e WHERE attack_type = '__any_attack__' GROUP BY ALL",
        )
        + ")"
        for gap in GAPS
    ),
)
def inference_zero_gap(s: Study):
    """Episodes that end at any unobserved time against episodes that bridge one unobserved epoch."""

    def summary(gap: float) -> DataFrame:
        marked = mark_streams(s.replayed, EVENT_ONTOLOGY, gap, TIME)
        episodes = epoch_episodes(explode_candidates(marked, LOCKED), delay_cap_s=DELAY_CAP_S)
        return point_summary(episodes).withColumn("missing_gap_s", F.lit(gap))

    return reduce(DataFrame.unionByName, map(summary, GAPS))


# -- seen and unseen entities -----------------------------------------------------------------


def _novelty_sql(novelty: str) -> str:
    inside = "IN" if novelty == "seen" else "NOT IN"
    before = f"""{sql.trace(rule=DAILY)}, xt AS (SELECT * FROM trace WHERE split = 'test'
        AND mac_rnti {inside} (SELECT mac_rnti FROM epochs WHERE split <> 'test')),
        {sql.epoch_episodes(DELAY_CAP_S, table="xt")}, {_ATTACK_BLOCKS}"""
    ctes = boot_ctes(among="split = 'test'", trace="xt", before=before).replace("{grid}", "grid")
    counts = f"""(SELECT count(DISTINCT mac_rnti) FROM xt) AS entities, (SELECT count(*) FROM xt WHERE candidate = '{PROPOSED}') AS epochs"""
    return f"SELECT * FROM ({with_recursive(ctes, f"SELECT '{novelty}' AS novelty, {counts}, {_IV_VIEW} FROM iv")})"


@query("inference_novelty", " UNION ALL ".join(map(_novelty_sql, ("seen", "unseen"))), rule=DAILY)
def inference_novelty(s: Study):
    """Primary contrasts of the held-out split on entities seen before and on new ones."""
    # A lease lies in one block and a block in one split: the held-out epochs are replayed alone, with the two policies compared.
    compared = [x for x in LOCKED if x.candidate in (PROPOSED, REFERENCE)]
    heldout = replay_arrays(s.mark(s.split(SPLITS.evaluation)), compared, order=TIME)
    rows = annotate_novelty(heldout, SPLITS, reference=s.blocked).persist()
    blocks = boot.block_universe(rows)

    def contrasts(novelty: str) -> DataFrame:
        own = rows.where(F.col(C.NOVELTY) == novelty)
        trace = explode_candidates(own, compared)
        labels = [(x.candidate, x.family) for x in compared]
        attack = contrib.attack_contributions(trace, epoch_episodes(trace, delay_cap_s=DELAY_CAP_S), labels, EVENT_ONTOLOGY)
        counts = own.agg(F.count_distinct(C.SUBJECT).alias("entities"), F.count(F.lit(1)).alias("epochs"))
        intervals = additive_intervals(s, contrib.action_contributions(trace), attack, blocks)
        # One row of counts, looked up as scalars: no join.
        return intervals.withColumns(
            {
                "novelty": F.lit(novelty),
                "entities": counts.select("entities").scalar(),
                "epochs": counts.select("epochs").scalar(),
            }
        )

    return reduce(DataFrame.unionByName, map(contrasts, ("seen", "unseen")))


# -- mobility patterns ------------------------------------------------------------------------


class MobilityStudy(Study):
    """Epochs that carry the mobility pattern of their first report, as contexts do."""

    @cached_property
    def epochs(self) -> DataFrame:
        raw = lease_epochs(self.blocked, self.rule, ["value", C.SCORE], ("mob_pattern",), EVENT_ONTOLOGY, (C.SPLIT,))
        return annotate_labels(raw, EVENT_ONTOLOGY)


@query(
    "stratified_mobility",
    with_recursive(
        f"""{sql.trace()}, patterns AS (SELECT rnti_lease_id, floor(event_time_s / {EPOCH}) * {EPOCH} AS epoch_start_s,
            arg_min(mob_pattern, event_time_s) AS mob_pattern FROM prepared GROUP BY 1, 2)""",
        f"""SELECT stratum, {_SUMS}, {sql.ACTION_RATIOS} FROM (
          SELECT 'mobility_' || mob_pattern AS stratum, candidate, family, {sql.ACTION_SUMS}
          FROM trace JOIN patterns USING (rnti_lease_id, epoch_start_s) GROUP BY ALL) WHERE benign_time_s > 0 AND attack_time_s > 0""",
    ),
)
def stratified_mobility(s: Study):
    """Action metrics per mobility pattern; the patterns are read off the rows, never listed on the driver."""
    trace = MobilityStudy(s.spark, s.sf_dir, s.rule).trace()
    return stratified_metrics(trace, {}, [mobility_stratum()])
