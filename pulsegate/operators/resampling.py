"""Paired cluster bootstrap: draws, ratio contrasts, medians, intervals, gates, Holm.

A draw is a row ``(replicate, block_idx)``.  Replicates are split over tasks by
``spark.range``; block sums are a broadcast of the block grid, whose size follows the
timeline; sums per replicate combine map-side because a replicate's draws share a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegate import columns as C
from pulsegate.functions.scalars import ratio
from pulsegate.session import ship_package

INDEX = "block_idx"
DEFAULT_SEED = 1729
# Raw generator values a task draws at once.
SEGMENT = 1 << 18


def block_universe(blocks: DataFrame, block: str = C.BLOCK) -> DataFrame:
    """Distinct blocks with their draw index; text order, so '10' precedes '2'."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.col(block).cast("string"))
    return blocks.select(block).distinct().withColumn(INDEX, F.row_number().over(order) - 1)


def _task_count(spark: SparkSession, replicates: int) -> int:
    return max(1, min(replicates, spark.sparkContext.defaultParallelism * 2))


def hash_draws(spark: SparkSession, replicates: int, blocks: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """Reproducible draws any SQL engine can repeat: ``md5(seed:replicate:slot) mod blocks``."""
    if blocks < 2:
        raise ValueError("the block bootstrap needs at least two blocks")
    ids = spark.range(0, replicates, 1, _task_count(spark, replicates)).withColumnRenamed("id", "replicate")
    slots = ids.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    text = F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("slot").cast("string"))
    number = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return slots.select("replicate", F.pmod(number, F.lit(blocks)).cast("int").alias(INDEX))


def raw_halves(seed: int, start: int, count: int) -> np.ndarray:
    """``count`` 32-bit values of the seeded generator from place ``start`` on: it skips ahead, nothing before is drawn."""
    source = np.random.PCG64(int(seed))
    source.advance(start // 2)
    words = source.random_raw((start % 2 + count + 1) // 2)
    halves = np.empty(2 * len(words), dtype=np.uint64)
    # The lower half of a word is used first.
    halves[0::2], halves[1::2] = words & np.uint64(0xFFFFFFFF), words >> np.uint64(32)
    return halves[start % 2 : start % 2 + count]


def accepted_draws(seed: int, start: int, count: int, blocks: int) -> np.ndarray:
    """Indices below ``blocks`` that the raw values of a segment give.

    Scaling to the range rejects a raw value by itself, whatever came before, so segments can be told apart.
    """
    scaled = raw_halves(seed, start, count) * np.uint64(blocks)
    fair = (scaled & np.uint64(0xFFFFFFFF)) >= np.uint64((1 << 32) % blocks)
    return (scaled[fair] >> np.uint64(32)).astype(np.int64)


def generator_draws(spark: SparkSession, replicates: int, blocks: int, seed: int = DEFAULT_SEED, segment: int = SEGMENT) -> DataFrame:
    """The draws of ``default_rng(seed).integers(0, blocks, (replicates, blocks))``.

    The raw values of the generator are cut into segments.  A first pass counts the accepted values of each segment, their
    prefix sum says which draws a segment holds, and tasks skip ahead to their segments: work is linear in the draws.
    One number per segment reaches the driver.
    """
    if not 2 <= blocks < 1 << 32:
        raise ValueError("the block bootstrap needs at least two blocks, fewer than 2 ** 32")
    ship_package(spark)
    total = replicates * blocks
    rejected = (1 << 32) % blocks / (1 << 32)
    wanted = total / (1.0 - rejected) + 8.0 * (total * rejected) ** 0.5 + 64

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = [len(accepted_draws(seed, k * segment, segment, blocks)) for k in batch["id"].tolist()]
            yield pd.DataFrame({"id": batch["id"], "n": np.array(sizes, dtype=np.int64)})

    before, at, done = [], 0, 0
    while at < total:
        more = max(1, int(-(-wanted // segment)) - done)
        ids = spark.range(done, done + more, 1, _task_count(spark, more))
        sizes = {r["id"]: r["n"] for r in ids.mapInPandas(count, "id long, n long").collect()}
        for k in range(done, done + more):
            before.append((k, at))
            at += sizes[k]
        done += more

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, first in zip(batch["id"].tolist(), batch["first"].tolist()):
                drawn = accepted_draws(seed, k * segment, segment, blocks)[: max(0, total - first)]
                place = first + np.arange(len(drawn), dtype=np.int64)
                yield pd.DataFrame({"replicate": place // blocks, INDEX: drawn.astype(np.int32)})

    segments = spark.createDataFrame(before or [(0, total)], "id long, first long").repartition(_task_count(spark, max(1, len(before))), "id")
    return segments.mapInPandas(draw, f"replicate long, {INDEX} int")


def draw_fingerprint(replicates: int, blocks: int, seed: int = DEFAULT_SEED) -> str:
    """SHA-256 of the generator's draw matrix, streamed row by row."""
    rng, digest = np.random.default_rng(int(seed)), hashlib.sha256()
    for _ in range(replicates):
        digest.update(rng.integers(0, blocks, size=blocks).tobytes())
    return digest.hexdigest()


@dataclass(frozen=True)
class Contrast:
    """``p_num/p_den - r_num/r_den`` or, for ``kind='rate_ratio'``, their quotient."""

    metric: str
    numerator: str
    denominator: str
    direction: str = "upper"
    kind: str = "difference"


PRIMARY_CONTRASTS = (
    Contrast("benign_friction_difference", "benign_contained_time_s", "benign_time_s"),
    Contrast("attack_exposure_difference", "attack_exposed_time_s", "attack_time_s"),
    Contrast("episode_coverage_difference", "covered_episode_count", "episode_count", "lower"),
    Contrast("mean_capped_delay_difference_s", "capped_delay_sum_s", "episode_count"),
    Contrast(
        "transition_rate_ratio", "effective_transition_count", "observed_time_s", kind="rate_ratio"
    ),
)
CLASS_EXPOSURE = Contrast("attack_exposure_difference", "exposed_time_s", "attack_time_s")


def _contrast(c: Contrast) -> Column:
    p = ratio(f"p_{c.numerator}", f"p_{c.denominator}")
    r = ratio(f"r_{c.numerator}", f"r_{c.denominator}")
    if c.kind == "rate_ratio":
        return F.when(F.col(f"r_{c.numerator}") > 0, p / r)
    return p - r


def _undefined(c: Contrast) -> Column:
    empty = (F.col(f"p_{c.denominator}") <= 0) | (F.col(f"r_{c.denominator}") <= 0)
    if c.kind != "rate_ratio":
        return F.when(empty, F.lit("undefined_zero_aggregate_denominator"))
    still = F.col(f"r_{c.numerator}") <= 0
    return F.when(empty, F.lit("undefined_zero_observed_time")).when(
        still, F.lit("undefined_zero_reference_transition_rate")
    )


def _long(df: DataFrame, contrasts: Sequence[Contrast], keep: Sequence[str]) -> DataFrame:
    rows = [
        F.struct(
            F.lit(c.metric).alias("metric"),
            _contrast(c).alias("value"),
            _undefined(c).alias("undefined"),
            F.lit(c.direction).alias("gate_direction"),
        )
        for c in contrasts
    ]
    return df.select(*keep, F.inline(F.array(*rows)))


def replicate_sums(grid: DataFrame, draws: DataFrame, values: Sequence[str]) -> DataFrame:
    """Sum the drawn blocks' values per replicate; ``grid`` has one row per block."""
    return draws.join(grid.select(INDEX, *values), INDEX).groupBy("replicate").agg(*[F.sum(v).alias(v) for v in values])


def contrast_draws(grid: DataFrame, draws: DataFrame, contrasts: Sequence[Contrast] = PRIMARY_CONTRASTS) -> DataFrame:
    """``replicate, metric, value`` for every contrast."""
    values = sorted({f"{t}_{v}" for c in contrasts for v in (c.numerator, c.denominator) for t in "pr"})
    return _long(replicate_sums(grid, draws, values), contrasts, ["replicate"]).select("replicate", "metric", "value")


def contrast_estimates(grid: DataFrame, contrasts: Sequence[Contrast] = PRIMARY_CONTRASTS) -> DataFrame:
    """Point estimate of every contrast from the full grid."""
    values = sorted({f"{t}_{v}" for c in contrasts for v in (c.numerator, c.denominator) for t in "pr"})
    total = grid.agg(*[F.sum(v).alias(v) for v in values], F.count(F.lit(1)).alias("clusters"))
    out = _long(total, contrasts, ["clusters"])
    return out.select("metric", F.col("value").alias("estimate"), "undefined", "gate_direction", "clusters")


def intervals(
    estimates: DataFrame,
    draws: DataFrame,
    replicates: int,
    confidence: float = 0.95,
    one_sided_confidence: float = 0.95,
) -> DataFrame:
    """Percentile intervals; undefined estimates and too few valid draws give NULL bounds.

    A metric has at most ``replicates`` draws, so exact percentiles stay small.
    """
    least = max(100, -(-replicates // 2))
    a, b = 1.0 - confidence, 1.0 - one_sided_confidence
    at = (a / 2, 1 - a / 2, b, 1 - b)
    valid = F.when(F.col("value").isNotNull() & ~F.isnan("value"), F.col("value"))
    per_metric = draws.groupBy("metric").agg(
        F.count(valid).alias("valid_replicates"), F.percentile(valid, F.array(*map(F.lit, at))).alias("__q")
    )
    joined = estimates.join(per_metric, "metric", "left").withColumn(
        "valid_replicates", F.coalesce("valid_replicates", F.lit(0))
    )
    status = (
        F.when(F.col("undefined").isNotNull(), F.col("undefined"))
        .when(F.col("valid_replicates") < least, "insufficient_valid_replicates")
        .otherwise("ok")
    )
    out = joined.withColumn("status", status)
    names = ("ci_lower", "ci_upper", "one_sided_lower", "one_sided_upper")
    out = out.withColumns({n: F.when(F.col("status") == "ok", F.col("__q")[i]) for i, n in enumerate(names)})
    return out.withColumns(
        {
            "estimate": F.when(F.col("undefined").isNull(), F.col("estimate")),
            "gate_endpoint": F.when(F.col("gate_direction") == "upper", F.col("one_sided_upper")).otherwise(
                F.col("one_sided_lower")
            ),
            "invalid_replicates": F.lit(replicates) - F.col("valid_replicates"),
            "requested_replicates": F.lit(replicates),
        }
    ).drop("__q", "undefined")


def single_ratio_grid(contributions: DataFrame, blocks: DataFrame, candidate: str, numerator: str, denominator: str):
    """Blocks of one policy as a degenerate pair whose reference ratio is zero."""
    rows = contributions.where(F.col(C.CANDIDATE) == candidate).groupBy(C.BLOCK)
    sums = rows.agg(F.sum(numerator).alias(f"p_{numerator}"), F.sum(denominator).alias(f"p_{denominator}"))
    grid = blocks.select(C.BLOCK).distinct().join(sums, C.BLOCK, "left")
    filled = {f"p_{v}": F.coalesce(F.col(f"p_{v}").cast("double"), F.lit(0.0)) for v in (numerator, denominator)}
    return grid.withColumns(filled | {f"r_{numerator}": F.lit(0.0), f"r_{denominator}": F.lit(1.0)})


def paired_episodes(episodes: DataFrame, proposed: str, reference: str) -> DataFrame:
    """Pair both policies' episodes by key; a one-sided key or a moved onset fails the job."""
    def side(tag: str, candidate: str) -> DataFrame:
        rows = episodes.where(F.col(C.CANDIDATE) == candidate)
        return rows.select(
            "episode_key", F.col("onset_block_id").alias(f"{tag}_block"), F.col("capped_delay_s").alias(f"{tag}_delay")
        )

    pairs = side("p", proposed).join(side("r", reference), "episode_key", "full")
    same = F.col("p_block").eqNullSafe(F.col("r_block")) & F.col("p_delay").isNotNull() & F.col("r_delay").isNotNull()
    bad = F.raise_error(F.concat(F.lit("unpaired episode "), F.col("episode_key"))).cast("long")
    return pairs.select(
        "episode_key", F.when(same, F.col("p_block")).otherwise(bad).alias(C.BLOCK), "p_delay", "r_delay"
    )


def median_delay_draws(pairs: DataFrame, universe: DataFrame, draws: DataFrame) -> DataFrame:
    """Difference of weighted median capped delays per replicate.

    Episodes are reduced to ``(block, policy, delay) -> count`` before they meet the
    draws; a replicate then weights each distinct delay by how often its block was drawn.
    """
    sides = F.inline(
        F.array(
            F.struct(F.lit("p").alias("policy"), F.col("p_delay").alias("delay")),
            F.struct(F.lit("r").alias("policy"), F.col("r_delay").alias("delay")),
        )
    )
    counts = pairs.select(C.BLOCK, sides).groupBy(C.BLOCK, "policy", "delay").agg(F.count(F.lit(1)).alias("n"))
    drawn = draws.groupBy("replicate", INDEX).agg(F.count(F.lit(1)).alias("times"))
    weighted = (
        drawn.join(universe, INDEX)
        .join(counts, C.BLOCK)
        .groupBy("replicate", "policy", "delay")
        .agg(F.sum(F.col("n") * F.col("times")).alias("w"))
    )
    return _median_difference(weighted, ["replicate"]).withColumn("metric", F.lit("median_capped_delay_difference_s"))


def _median_difference(weighted: DataFrame, keys: Sequence[str]) -> DataFrame:
    scope = Window.partitionBy(*keys, "policy")
    ordered = weighted.withColumns(
        {
            "cum": F.sum("w").over(scope.orderBy("delay").rowsBetween(Window.unboundedPreceding, 0)),
            "total": F.sum("w").over(scope),
        }
    )
    low = F.min(F.when(F.col("cum") > F.floor((F.col("total") - 1) / 2), F.col("delay")))
    high = F.min(F.when(F.col("cum") > F.floor(F.col("total") / 2), F.col("delay")))
    medians = ordered.groupBy(*keys, "policy").agg(((low + high) / 2.0).alias("m"))
    pick = {t: F.max(F.when(F.col("policy") == t, F.col("m"))) for t in "pr"}
    return medians.groupBy(*keys).agg((pick["p"] - pick["r"]).alias("value"))


def median_delay_estimate(pairs: DataFrame) -> DataFrame:
    sides = F.inline(
        F.array(
            F.struct(F.lit("p").alias("policy"), F.col("p_delay").alias("delay")),
            F.struct(F.lit("r").alias("policy"), F.col("r_delay").alias("delay")),
        )
    )
    counts = pairs.select(F.lit(0).alias("all"), sides).groupBy("all", "policy", "delay").agg(F.count(F.lit(1)).alias("w"))
    # A global aggregate: without any episode there is one row, with an undefined estimate.
    return _median_difference(counts, ["all"]).agg(F.max("value").alias("value")).select(
        F.lit("median_capped_delay_difference_s").alias("metric"),
        F.col("value").alias("estimate"),
        F.when(F.col("value").isNull(), F.lit("undefined_no_episodes")).alias("undefined"),
        F.lit("upper").alias("gate_direction"),
    )


@dataclass(frozen=True)
class Gate:
    metric: str
    direction: str
    threshold: float

    def __post_init__(self) -> None:
        if self.direction not in ("max", "min"):
            raise ValueError("gate direction must be 'max' or 'min'")


PRIMARY_GATES = (
    Gate("attack_exposure_difference", "max", 0.02),
    Gate("episode_coverage_difference", "min", -0.05),
    Gate("median_capped_delay_difference_s", "max", 1.0),
    Gate("mean_capped_delay_difference_s", "max", 1.0),
    Gate("transition_rate_ratio", "max", 0.75),
)


def gate_decisions(table: DataFrame, gates: Sequence[Gate] = PRIMARY_GATES) -> DataFrame:
    """Compare each gate's endpoint with its threshold; no endpoint means unknown."""
    rules = F.array(
        *[
            F.struct(
                F.lit(g.metric).alias("gate_metric"),
                F.lit(g.direction).alias("direction"),
                F.lit(float(g.threshold)).alias("threshold"),
            )
            for g in gates
        ]
    )
    rows = table.select("metric", "gate_endpoint", F.inline(rules)).where("metric = gate_metric")
    end = F.col("gate_endpoint")
    passed = F.when(F.col("direction") == "max", end <= F.col("threshold")).otherwise(end >= F.col("threshold"))
    return rows.withColumn("passed", passed).select(
        "metric",
        "direction",
        "threshold",
        end.alias("endpoint"),
        "passed",
        F.when(end.isNull(), "unknown").when(F.col("passed"), "pass").otherwise("fail").alias("status"),
    )


def tail_p_values(draws: DataFrame, gates: Sequence[Gate] = PRIMARY_GATES) -> DataFrame:
    """One-sided bootstrap p-value of each gate: share of draws on the wrong side."""
    limits = F.create_map(*[x for g in gates for x in (F.lit(g.metric), F.lit(float(g.threshold)))])
    sides = F.create_map(*[x for g in gates for x in (F.lit(g.metric), F.lit(g.direction))])
    limit, side = F.element_at(limits, F.col("metric")), F.element_at(sides, F.col("metric"))
    wrong = F.when(side == "max", F.col("value") > limit).otherwise(F.col("value") < limit)
    rows = draws.where(limit.isNotNull() & F.col("value").isNotNull())
    return rows.groupBy("metric").agg(
        ((F.count_if(wrong) + 1) / (F.count(F.lit(1)) + 1)).alias("p")
    )


def holm(df: DataFrame, p: str = "p", keys: Sequence[str] = (), name: str = "p_adjusted") -> DataFrame:
    """Step-down family-wise adjustment of a table of p-values (one row per test)."""
    family = Window.partitionBy(*(keys or [F.lit(0)]))
    order = family.orderBy(p)
    bad = F.raise_error(F.lit("p-values must be finite and in [0, 1]")).cast("double")
    checked = F.when(F.col(p).between(0.0, 1.0), F.col(p)).otherwise(bad)
    scaled = (F.count(F.lit(1)).over(family) - F.row_number().over(order) + 1) * checked
    out = df.withColumn("__scaled", scaled)
    climb = F.max("__scaled").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn(name, F.least(climb, F.lit(1.0))).drop("__scaled")
