"""Exact quantiles whose work is spread over partitions, also for one heavy group."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegate.functions.ordered import running_totals

_ONE = "__one"


def value_counts(df: DataFrame, keys: Sequence[str], value: str, weight: Column | None = None) -> DataFrame:
    """Multiplicity of each non-null value per key, combined map-side before the shuffle."""
    w = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(w.cast("long").alias("weight"))


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    weight: Column | None = None,
) -> DataFrame:
    """Linear-interpolation quantiles of ``value`` per key: ``keys, n, q: array<double>``.

    Values are first reduced to ``(value, multiplicity)``; running multiplicities come
    from :func:`running_totals`, so no task holds all values of a group.  ``weight``
    gives integer multiplicities of the input rows.
    """
    keys = list(keys) or [_ONE]
    source = df.withColumn(_ONE, F.lit(0)) if keys == [_ONE] else df
    counts = value_counts(source, keys, value, weight).where("weight > 0")
    ranked = running_totals(counts, keys, [value], {"cum": F.col("weight")})
    sizes = ranked.groupBy(*keys).agg(F.sum("weight").alias("n"))
    named = sizes.withColumnsRenamed({k: f"__size_key_{k}" for k in keys})
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"`__size_key_{k}`")) for k in keys]
    placed = ranked.join(named, same).drop(*[f"__size_key_{k}" for k in keys])

    bounds, answers = [], []
    for i, p in enumerate(probabilities):
        if not 0.0 <= p <= 1.0 or math.isnan(p):
            raise ValueError("probabilities must lie in [0, 1]")
        at = F.lit(float(p)) * (F.col("n") - 1)
        low = F.floor(at)
        bounds.append(F.min(F.when(F.col("cum") > low, F.col(value))).alias(f"__lo{i}"))
        bounds.append(
            F.min(F.when(F.col("cum") > F.least(low + 1, F.col("n") - 1), F.col(value))).alias(f"__hi{i}")
        )
        fraction = at - F.floor(at)
        answers.append(F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * fraction)
    found = placed.groupBy(*keys, "n").agg(*bounds)
    result = found.select(*keys, "n", F.array(*answers).alias("q"))
    return result.drop(_ONE) if keys == [_ONE] else result


def weighted_median(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """Exact median of integer-weighted values: ``keys, n, median``.

    The values at positions ``(n-1)//2`` and ``n//2`` are averaged; repeats are never built.
    """
    q = exact_quantiles(df, keys, value, [0.5], F.col(weight))
    return q.select(*keys, "n", F.col("q")[0].alias("median"))
