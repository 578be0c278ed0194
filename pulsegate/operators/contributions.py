"""Block-additive contributions, dense grids and cluster roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegate import columns as C
from pulsegate.config import RESTRICT
from pulsegate.operators.episodes import STREAMS
from pulsegate.operators.epochs import attack_streams
from pulsegate.operators.metrics import BY_CANDIDATE, action_sums, seconds_where, total_where
from pulsegate.schema import TRACE_ONTOLOGY, Ontology, TraceError

_RENAMED = {
    "epochs": "epoch_count",
    "effective_transitions": "effective_transition_count",
    "containment_starts": "containment_start_count",
    "benign_containment_starts": "benign_containment_start_count",
}
ACTION_VALUES = (
    "observed_time_s",
    "benign_time_s",
    "attack_time_s",
    "benign_contained_time_s",
    "attack_exposed_time_s",
    "effective_transition_count",
)
ATTACK_VALUES = ("episode_count", "covered_episode_count", "capped_delay_sum_s")


def action_contributions(trace: DataFrame, containment: int = RESTRICT, duration: str = C.DURATION) -> DataFrame:
    """Additive action numerators and denominators per candidate and block."""
    sums = action_sums(containment, duration)
    sums.pop("attack_allowed_time_s"), sums.pop("attack_not_isolated_time_s")
    return trace.groupBy(*BY_CANDIDATE, C.BLOCK).agg(*[v.alias(_RENAMED.get(k, k)) for k, v in sums.items()])


def candidate_grid(blocks: DataFrame, labels: Sequence[tuple[str, str]], streams: Sequence[str] = ()) -> DataFrame:
    """Every candidate (and stream) on every block, from the distinct blocks alone.

    Candidates and streams are parameters, so they are exploded from literals; the grid
    is linear in the number of blocks.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias(C.CANDIDATE), F.lit(f).alias(C.FAMILY)) for c, f in labels])
    grid = blocks.select(C.BLOCK).distinct().select(C.BLOCK, F.inline(pairs))
    return grid.withColumn("attack_type", F.explode(F.array(*map(F.lit, streams)))) if streams else grid


def fill_grid(grid: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left-join contributions onto the grid; combinations without rows become zero."""
    values = [f for f in table.schema if f.name not in {*keys, C.FAMILY}]
    joined = grid.join(table.drop(C.FAMILY), list(keys), "left")
    return joined.withColumns({f.name: F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType)) for f in values})


def attack_contributions(
    trace: DataFrame,
    episodes: DataFrame,
    labels: Sequence[tuple[str, str]],
    ontology: Ontology = TRACE_ONTOLOGY,
    containment: int = RESTRICT,
    duration: str = C.DURATION,
) -> DataFrame:
    """Class time where observed and episode counts at the onset block, zero filled."""
    contained = F.col("effective_state") >= containment
    keys = [C.CANDIDATE, C.BLOCK, "attack_type"]
    time = (
        trace.select(C.CANDIDATE, C.BLOCK, duration, "effective_state", F.explode(STREAMS).alias("__s"))
        .groupBy(C.CANDIDATE, C.BLOCK, F.col("__s")["attack_type"].alias("attack_type"))
        .agg(
            F.count(F.lit(1)).alias("attack_epoch_count"),
            F.sum(duration).alias("attack_time_s"),
            seconds_where(contained, duration).alias("contained_time_s"),
            seconds_where(~contained, duration).alias("exposed_time_s"),
        )
    )
    counts = episodes.groupBy(C.CANDIDATE, F.col("onset_block_id").alias(C.BLOCK), "attack_type").agg(
        F.count(F.lit(1)).alias("episode_count"),
        total_where(F.col("covered")).alias("covered_episode_count"),
        total_where(F.col("reactively_covered")).alias("reactively_covered_episode_count"),
        total_where(F.col("pre_contained_at_onset")).alias("pre_contained_episode_count"),
        total_where(F.col("onset_transition_to_containment")).alias("onset_transition_episode_count"),
        total_where(F.col("censored")).alias("censored_episode_count"),
        F.sum("capped_delay_s").alias("capped_delay_sum_s"),
        F.sum("exposure_before_containment_s").alias("exposure_before_containment_sum_s"),
    )
    grid = candidate_grid(trace, labels, [name for name, _ in attack_streams(ontology)])
    return fill_grid(fill_grid(grid, time, keys), counts, keys)


def paired_grid(
    contributions: DataFrame,
    blocks: DataFrame,
    proposed: str,
    reference: str,
    values: Sequence[str],
    attack_type: str | None = None,
    block: str = C.BLOCK,
) -> DataFrame:
    """Two candidates side by side on every block: ``block, p_<value>, r_<value>``.

    One conditional aggregate builds both sides; blocks a candidate never acted in count
    as zero and are flagged.  Negative or non-finite contributions fail the job.
    """
    rows = contributions.where(F.col(C.CANDIDATE).isin(proposed, reference))
    if attack_type is not None:
        rows = rows.where(F.col("attack_type") == attack_type)

    def side(tag: str, candidate: str, value: str):
        v = F.col(value).cast("double")
        ok = (v >= 0) & ~F.isnan(v) & (v < F.lit(float("inf")))
        bad = F.raise_error(F.lit(f"{value} must be finite and non-negative")).cast("double")
        return F.sum(F.when(F.col(C.CANDIDATE) == candidate, F.when(ok, v).otherwise(bad))).alias(f"{tag}_{value}")

    both = [side(t, c, v) for v in values for t, c in (("p", proposed), ("r", reference))]
    present = [
        F.max((F.col(C.CANDIDATE) == c).cast("int")).alias(f"{t}_present") for t, c in (("p", proposed), ("r", reference))
    ]
    wide = rows.groupBy(block).agg(*both, *present)
    grid = blocks.select(block).distinct().join(wide, block, "left")
    filled = {f"{t}_{v}": F.coalesce(F.col(f"{t}_{v}"), F.lit(0.0)) for v in values for t in "pr"}
    filled |= {f"{t}_present": F.coalesce(F.col(f"{t}_present"), F.lit(0)) for t in "pr"}
    return grid.withColumns(filled)


def missing_blocks(contributions: DataFrame, blocks: DataFrame, labels: Sequence[tuple[str, str]]) -> DataFrame:
    """(candidate, block) pairs of the grid without any contribution."""
    have = contributions.select(C.CANDIDATE, C.BLOCK).distinct()
    return candidate_grid(blocks, labels).join(have, [C.CANDIDATE, C.BLOCK], "left_anti")


def _mapped_once(df: DataFrame, mapping: DataFrame, cluster: str, block: str) -> tuple[DataFrame, Column]:
    """``df`` joined to its clusters, and the cluster column, which fails on a block that is mapped twice or not at all."""
    once = mapping.groupBy(F.col(C.BLOCK).alias(block)).agg(
        F.max(cluster).alias("__cluster"), F.count(F.lit(1)).alias("__copies")
    )
    ok = (F.col("__copies") == 1) & F.col("__cluster").isNotNull()
    kind = mapping.schema[cluster].dataType
    refused = F.raise_error(F.lit("block is not mapped to exactly one cluster")).cast(kind)
    return df.join(once, block, "left"), F.when(ok, F.col("__cluster")).otherwise(refused)


def roll_up(contributions: DataFrame, mapping: DataFrame, cluster: str, keys: Sequence[str]) -> DataFrame:
    """Re-aggregate contributions from blocks to clusters (``m:1``, every block mapped once).

    The map has one row per block; contributions are pre-aggregated per block already.
    """
    joined, mapped = _mapped_once(contributions, mapping, cluster, C.BLOCK)
    numeric = [
        f.name
        for f in contributions.schema
        if isinstance(f.dataType, T.NumericType) and f.name not in {C.BLOCK, *keys}
    ]
    return (
        joined.withColumn(cluster, mapped)
        .groupBy(*keys, cluster)
        .agg(*[F.sum(c).cast(contributions.schema[c].dataType).alias(c) for c in numeric])
    )


def roll_up_episodes(episodes: DataFrame, mapping: DataFrame, cluster: str) -> DataFrame:
    """Replace the onset block of each episode by its cluster."""
    joined, mapped = _mapped_once(episodes, mapping, cluster, "onset_block_id")
    return joined.withColumn("onset_block_id", mapped).drop("__cluster", "__copies")


def attach_cluster(df: DataFrame, mapping: DataFrame, cluster: str) -> DataFrame:
    """Cluster column for any table with a block id; a block mapped twice fails, an unmapped one has none."""
    if cluster not in mapping.columns:
        raise TraceError(f"unknown grouping candidate: {cluster}")
    joined, mapped = _mapped_once(df, mapping, cluster, C.BLOCK)
    return joined.withColumn(cluster, F.when(F.col("__copies").isNotNull(), mapped)).drop("__cluster", "__copies")
