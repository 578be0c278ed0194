"""Exact order-dependent columns over groups of any size.

``Window.partitionBy(key).orderBy(t)`` puts a whole key in one task, so a key that
owns a third of the table is a third of the work in one place.  Here rows are range
partitioned by ``keys + order`` (Spark samples the bounds, a heavy key is split over
many partitions), windows run inside ``(partition, key)``, and what must cross a
partition edge is carried by a table with at most one row per partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegate.session import durable

PART = "__part"


def ranged(df: DataFrame, order: Sequence[str | Column], partitions: int | None = None) -> DataFrame:
    """Range-partition by ``order`` and persist each row's partition as ``__part``.

    The result is written to the checkpoint folder: a recomputed range shuffle may
    sample other bounds, and carries are only valid for one assignment.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    moved = df.repartitionByRange(n, *order)
    return durable(moved.withColumn(PART, F.spark_partition_id()))


def _same(a: str, keys: Sequence[str]) -> list[str]:
    return [a, *keys]


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    measures: Mapping[str, Column],
    partitions: int | None = None,
) -> DataFrame:
    """Add inclusive running sums of ``measures`` within ``keys`` along ``order``.

    ``order`` must identify a row within its key.
    """
    names = list(measures)
    inputs = {f"__in_{name}": value for name, value in measures.items()}
    placed = ranged(df.withColumns(inputs), [*keys, *order], partitions)
    local = Window.partitionBy(*_same(PART, keys)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = _key_window(keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)

    sums = placed.groupBy(*_same(PART, keys)).agg(*[F.sum(f"__in_{n}").alias(f"__sum_{n}") for n in names])
    carry = sums.select(
        *_same(PART, keys), *[F.sum(f"__sum_{n}").over(earlier).alias(f"__carry_{n}") for n in names]
    ).where(F.coalesce(*[F.col(f"__carry_{n}") for n in names]).isNotNull())
    # A partition continues at most one key, so ``carry`` has at most one row per partition.
    joined = _join_carry(placed, carry, _same(PART, keys))
    totals = {
        n: F.coalesce(F.sum(f"__in_{n}").over(local), F.lit(0)) + F.coalesce(F.col(f"__carry_{n}"), F.lit(0))
        for n in names
    }
    return joined.withColumns(totals).drop(PART, *inputs, *[f"__carry_{n}" for n in names])


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    previous: Mapping[str, str] | None = None,
    following: Mapping[str, str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Add ``{new: old}`` columns holding the previous / following row of the same key."""
    previous, following = dict(previous or {}), dict(following or {})
    placed = ranged(df, [*keys, *order], partitions)
    scope = _same(PART, keys)
    local = Window.partitionBy(*scope).orderBy(*order)
    across = _key_window(keys).orderBy(PART)
    out = placed
    position = F.struct(*order)
    edges: list[str] = []
    for tag, wanted, shift, pick in (
        ("prev", previous, F.lag, F.max_by),
        ("next", following, F.lead, F.min_by),
    ):
        if not wanted:
            continue
        here, edge = f"__{tag}", f"__{tag}_edge"
        record = F.struct(*[F.col(old).alias(new) for new, old in wanted.items()])
        ends = placed.groupBy(*scope).agg(pick(record, position).alias("__end"))
        carried = ends.select(*scope, shift("__end").over(across).alias(edge)).where(F.col(edge).isNotNull())
        out = _join_carry(out.withColumn(here, shift(record).over(local)), carried, scope)
        for new in wanted:
            out = out.withColumn(
                new,
                F.when(F.col(here).isNotNull(), F.col(here)[new]).otherwise(F.col(edge)[new]),
            )
        edges += [here, edge]
    return out.drop(PART, *edges)


def _join_carry(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of at most one row per partition; a NULL key is a key like any other."""
    own = carry.withColumnsRenamed({k: f"__carry_key_{k}" for k in keys})
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"`__carry_key_{k}`")) for k in keys]
    return rows.join(F.broadcast(own), same, "left").drop(*[f"__carry_key_{k}" for k in keys])


def _key_window(keys: Sequence[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def row_index(df: DataFrame, order: Sequence[str], name: str, partitions: int | None = None) -> DataFrame:
    """Dense zero-based position of every row along a unique ``order``."""
    counted = running_totals(df, [], order, {name: F.lit(1).cast("long")}, partitions)
    return counted.withColumn(name, F.col(name) - 1)


def generations(
    df: DataFrame,
    subject: str,
    lease: str,
    order: Sequence[str],
    name: str = "lease_generation",
    partitions: int | None = None,
) -> DataFrame:
    """Number the lease changes of each subject, so a reused lease id starts anew."""
    seen = neighbours(df, [subject], order, previous={"__prev_lease": lease}, partitions=partitions)
    changed = F.col("__prev_lease").isNotNull() & (F.col(lease) != F.col("__prev_lease"))
    out = running_totals(seen, [subject], order, {name: changed.cast("long")}, partitions)
    return out.drop("__prev_lease")
