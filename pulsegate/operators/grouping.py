"""Label-blind block audit: adjacency features and grouping candidates.

Adjacent-block overlap and composition distance are computed in long form (one row per
block and entity, or per block and pattern), never by collecting a block's entity set.
Ordered passes run over the block table, whose size follows the timeline.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegate import columns as C
from pulsegate.config import GroupingRule
from pulsegate.functions.scalars import bin_index
from pulsegate.schema import TraceError

APPROVED_COLUMNS = frozenset({C.BLOCK, C.TIME, C.DECISION_TIME, C.SUBJECT, "mob_pattern", C.LEASE})
DAY = 86_400.0
_SEQ = "__seq"


def require_label_blind(*columns: str) -> None:
    """Grouping may look at time, entities, leases and mobility, at nothing else."""
    refused = sorted(set(columns) - APPROVED_COLUMNS)
    if refused:
        raise TraceError(f"columns not approved for block grouping: {refused}")


def timeline() -> Window:
    return Window.partitionBy(F.lit(0)).orderBy("start_s", C.BLOCK)


def block_table(df: DataFrame, subject: str = C.SUBJECT, lease: str = C.LEASE, time: str = C.TIME) -> DataFrame:
    """Span, rows, entities, leases and split of every block, in order."""
    aggs = [
        F.min(time).alias("start_s"),
        F.max(time).alias("end_s"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(subject).alias("n_numeric_rntis"),
        F.count_distinct(lease).alias("n_rnti_leases"),
    ]
    if C.SPLIT in df.columns:
        aggs += [F.min(C.SPLIT).alias("__s0"), F.max(C.SPLIT).alias("__s1")]
    out = df.groupBy(C.BLOCK).agg(*aggs)
    if C.SPLIT in df.columns:
        torn = F.raise_error(F.lit("an observable block spans multiple splits")).cast("string")
        out = out.withColumn(C.SPLIT, F.when(F.col("__s0").eqNullSafe(F.col("__s1")), F.col("__s0")).otherwise(torn))
        out = out.drop("__s0", "__s1")
    return out.withColumn(_SEQ, F.row_number().over(timeline()))


def overlap_counts(df: DataFrame, order: DataFrame, subject: str = C.SUBJECT) -> DataFrame:
    """Entities a block shares with the block before.

    One row per block and entity; an entity's rows are at most one per block.
    """
    present = df.where(F.col(subject).isNotNull()).select(C.BLOCK, subject).distinct().join(order, C.BLOCK)
    before = F.lag(_SEQ).over(Window.partitionBy(subject).orderBy(_SEQ))
    kept = present.withColumn("__stay", (before == F.col(_SEQ) - 1).cast("long"))
    return kept.groupBy(_SEQ).agg(F.coalesce(F.sum("__stay"), F.lit(0)).alias("shared"))


def pattern_shares(df: DataFrame, pattern: str = "mob_pattern") -> DataFrame:
    """Share of each mobility pattern among a block's rows."""
    counts = df.where(F.col(pattern).isNotNull()).groupBy(C.BLOCK, pattern).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(C.BLOCK))
    return counts.select(C.BLOCK, F.col(pattern).alias("pattern"), (F.col("n") / total).alias("share"))


def composition_distance(shares: DataFrame, order: DataFrame) -> DataFrame:
    """Total variation between adjacent blocks: each share is met by its successor's."""
    placed = shares.join(order, C.BLOCK)
    signed = F.inline(
        F.array(
            F.struct(F.col(_SEQ).alias("at"), F.col("share").alias("d")),
            F.struct((F.col(_SEQ) + 1).alias("at"), (-F.col("share")).alias("d")),
        )
    )
    steps = placed.select("pattern", signed).groupBy("at", "pattern").agg(F.sum("d").alias("d"))
    return steps.groupBy(F.col("at").alias(_SEQ)).agg((F.sum(F.abs("d")) * 0.5).alias("tv"))


def profiles(shares: DataFrame) -> DataFrame:
    """Dominant pattern (ties alphabetical) and the share map of each block."""
    entry = F.struct(F.col("pattern"), F.col("share"))
    return shares.groupBy(C.BLOCK).agg(
        F.min_by("pattern", F.struct((-F.col("share")).alias("s"), F.col("pattern"))).alias("dominant_mobility"),
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("mobility_profile"),
    )


def summarize_blocks(
    df: DataFrame, subject: str = C.SUBJECT, pattern: str = "mob_pattern", lease: str = C.LEASE, time: str = C.TIME
) -> DataFrame:
    """The block audit table with gap, overlap and composition against the block before."""
    require_label_blind(C.BLOCK, subject, pattern, lease, time)
    blocks = block_table(df, subject, lease, time)
    order = blocks.select(C.BLOCK, _SEQ)
    shares = pattern_shares(df, pattern)
    joined = (
        blocks.join(overlap_counts(df, order, subject), _SEQ, "left")
        .join(composition_distance(shares, order), _SEQ, "left")
        .join(profiles(shares), C.BLOCK, "left")
    )
    w = timeline()
    first = F.col(_SEQ) == 1
    union = F.col("n_numeric_rntis") + F.lag("n_numeric_rntis").over(w) - F.coalesce("shared", F.lit(0))
    overlap = F.when(union == 0, 1.0).otherwise(F.coalesce("shared", F.lit(0)) / union)
    gap = F.col("start_s") - F.lag("end_s").over(w)
    bad = F.raise_error(F.lit("observable block time intervals overlap")).cast("double")
    before = F.lag("dominant_mobility").over(w)
    changed = F.lit(False)
    if C.SPLIT in blocks.columns:
        changed = F.coalesce(F.col(C.SPLIT) != F.lag(C.SPLIT).over(w), F.lit(False))
    return joined.withColumns(
        {
            "block_span_s": F.col("end_s") - F.col("start_s"),
            "utc_day_index": bin_index("start_s", DAY),
            "gap_from_previous_s": F.when(gap.isNull() | (gap >= 0), gap).otherwise(bad),
            "rnti_jaccard_previous": F.when(~first, overlap),
            "mobility_tv_previous": F.when(~first, F.coalesce("tv", F.lit(0.0))),
            "dominant_mobility_changed": F.when(~first, ~F.col("dominant_mobility").eqNullSafe(before)),
            "split_changed": changed,
        }
    ).drop(_SEQ, "shared", "tv")


def token(value: float) -> str:
    return str(int(value)) if float(value).is_integer() else f"{value:g}".replace(".", "p")


def grouping_boundaries(rule: GroupingRule) -> dict[str, Column]:
    """Boundary condition of every grouping candidate, in block order."""
    w = timeline()
    base = F.lag(C.BLOCK).over(w).isNull() | F.coalesce("split_changed", F.lit(False))

    def bins(seconds: float) -> Column:
        at = bin_index("end_s", seconds)
        return at != F.lag(at).over(w)

    gap, tv, shared = (F.col(c) for c in ("gap_from_previous_s", "mobility_tv_previous", "rnti_jaccard_previous"))

    def past(value: Column, limit: float) -> Column:
        return value.isNull() | (value > limit)

    def below(value: Column, limit: float) -> Column:
        return value.isNull() | (value < limit)

    out = {"observable_block_group": F.lit(True)}
    out |= {f"fixed_{token(s)}s_group": bins(s) for s in rule.fixed_window_seconds}
    out["utc_day_group"] = bins(DAY)
    out |= {f"gap_{token(s)}s_group": past(gap, s) for s in rule.gap_threshold_seconds}
    out |= {f"mobility_tv_{token(v)}_group": past(tv, v) for v in rule.mobility_tv_thresholds}
    out |= {f"rnti_jaccard_{token(v)}_group": below(shared, v) for v in rule.rnti_jaccard_thresholds}
    out["campaign_proxy_group"] = (
        past(gap, rule.campaign_gap_seconds)
        | past(tv, rule.campaign_mobility_tv)
        | below(shared, rule.campaign_min_rnti_jaccard)
    )
    return {name: base | F.coalesce(cut, F.lit(False)) for name, cut in out.items()}


def grouping_candidates(blocks: DataFrame, rule: GroupingRule = GroupingRule()) -> DataFrame:
    """Add a sequential group id per candidate; split changes always start a group."""
    cuts = {f"__{n}": b.cast("long") for n, b in grouping_boundaries(rule).items()}
    upto = timeline().rowsBetween(Window.unboundedPreceding, 0)
    ids = {n[2:]: F.sum(n).over(upto) - 1 for n in cuts}
    return blocks.withColumns(cuts).withColumns(ids).drop(*cuts)


def group_columns(blocks: DataFrame) -> list[str]:
    return [c for c in blocks.columns if c.endswith("_group")]


_MEANINGS = (
    ("observable_block", "existing observable block"),
    ("fixed_", "UTC-aligned fixed window"),
    ("utc_day", "UTC day; few groups"),
    ("gap_", "gap heuristic"),
    ("mobility_tv_", "run of similar mobility composition"),
    ("rnti_jaccard_", "run of similar entity population"),
    ("campaign_", "composite gap, mobility and population heuristic"),
)


def candidate_summary(grouped: DataFrame, candidates: Sequence[str] | None = None) -> DataFrame:
    """Sizes and spans of the groups of every candidate."""
    names = list(candidates or group_columns(grouped))
    unpivot = F.inline(F.array(*[F.struct(F.lit(n).alias("grouping"), F.col(n).alias("group_id")) for n in names]))
    has_split = C.SPLIT in grouped.columns
    keep = [C.SPLIT] if has_split else []
    long = grouped.select("n_rows", "start_s", "end_s", *keep, unpivot)
    groups = long.groupBy("grouping", *keep, "group_id").agg(
        F.count(F.lit(1)).alias("blocks"),
        F.sum("n_rows").alias("n_rows"),
        ((F.max("end_s") - F.min("start_s")) / 3600.0).alias("span_h"),
    )
    # One row per group of blocks: exact percentiles over a timeline-sized table.
    sizes = F.percentile("blocks", F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    spans = F.percentile("span_h", F.array(*map(F.lit, (0.5, 0.9))))
    out = groups.groupBy("grouping").agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.sum("blocks").alias("n_observable_blocks"),
        F.sum("n_rows").alias("n_rows"),
        F.avg((F.col("blocks") == 1).cast("int")).alias("singleton_group_fraction"),
        sizes.alias("__q"),
        F.max("blocks").alias("blocks_per_group_max"),
        spans.alias("__h"),
        F.max("span_h").alias("group_span_hours_max"),
    )
    meaning = F.lit("unclassified grouping")
    for prefix, text in reversed(_MEANINGS):
        meaning = F.when(F.col("grouping").startswith(prefix), text).otherwise(meaning)
    out = out.withColumns(
        {
            "blocks_per_group_q25": F.col("__q")[0],
            "blocks_per_group_median": F.col("__q")[1],
            "blocks_per_group_q75": F.col("__q")[2],
            "group_span_hours_median": F.col("__h")[0],
            "group_span_hours_p90": F.col("__h")[1],
            "at_least_30_groups": F.col("n_groups") >= 30,
            "interpretation": meaning,
        }
    ).drop("__q", "__h")
    if has_split:
        least = groups.groupBy("grouping", C.SPLIT).agg(F.count(F.lit(1)).alias("n"))
        least = least.groupBy("grouping").agg(F.min("n").alias("minimum_groups_across_splits"))
        out = out.join(least, "grouping", "left").withColumn(
            "at_least_30_groups_in_every_split", F.col("minimum_groups_across_splits") >= 30
        )
    return out


def adjacency_quantiles(blocks: DataFrame, probabilities: Sequence[float] = (0, 0.25, 0.5, 0.75, 0.9, 1)) -> DataFrame:
    """Quantiles of gap, overlap and distance over the blocks that have a predecessor."""
    measures = ("gap_from_previous_s", "rnti_jaccard_previous", "mobility_tv_previous")
    long = blocks.select(
        F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("x")) for m in measures]))
    ).where(F.col("x").isNotNull())
    q = long.groupBy("measure").agg(F.percentile("x", F.array(*[F.lit(float(p)) for p in probabilities])).alias("q"))
    cols = [F.col("q")[i].alias(f"q{round(100 * p):02d}") for i, p in enumerate(probabilities)]
    return q.select("measure", *cols)


def cluster_mapping(grouped: DataFrame) -> DataFrame:
    """The minimal block-to-cluster map."""
    keep = [C.BLOCK, "start_s", "end_s", *([C.SPLIT] if C.SPLIT in grouped.columns else [])]
    return grouped.select(*keep, *group_columns(grouped)).orderBy("start_s", C.BLOCK)
