"""Chronology, trace blocks and leases.

Boundaries are found on *cells*, not on rows: a cell is half a gap threshold wide, so
two neighbouring events further apart than the threshold never share one.  The first and
last event time per cell (a map-side combined aggregate) therefore decide every
boundary, and rows only look their cell up.  Windows run over cells, whose number
depends on the length of the timeline and not on how many reports fall into it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegate import columns as C
from pulsegate.config import SplitRule, TraceRule
from pulsegate.functions.scalars import bin_index, colon_key, is_finite
from pulsegate.operators.splits import split_name
from pulsegate.schema import TRACE_ONTOLOGY, Ontology

_BIN, _CELL = "__bin", "__cell"


def correct_chronology(df: DataFrame, rule: TraceRule = TraceRule(), raw: str = "timestamp") -> DataFrame:
    """Add event seconds; a missing or non-finite raw time fails the job.

    Order is carried by ``(event_time_s, _source_row)`` in every later stage, so the
    table itself is not sorted.
    """
    t = F.col(raw).cast("double") / F.lit(float(rule.timestamp_scale))
    invalid = F.raise_error(F.lit("corrected timestamp is missing or not finite")).cast("double")
    return df.withColumn(C.TIME, F.when(is_finite(t), t).otherwise(invalid))


def _cell_columns(rule: TraceRule, time: str) -> dict[str, Column]:
    bins = bin_index(time, rule.max_block_seconds) if rule.max_block_seconds is not None else F.lit(0).cast("long")
    cell = bin_index(time, rule.gap_seconds / 2) if rule.gap_seconds is not None else F.lit(0).cast("long")
    return {_BIN: bins, _CELL: cell}


def block_index(df: DataFrame, rule: TraceRule, splits: SplitRule | None = None, time: str = C.TIME) -> DataFrame:
    """One row per occupied cell: ``bin, cell, trace_block_id, t0, t1`` (and the split).

    The ordered pass sees cells only: at most two per gap threshold (one per block bin
    without a gap rule) and timeline, so a year at the default 300 s is 210,000 rows
    whatever the number of reports.
    """
    cells = (
        df.select(time)
        .withColumns(_cell_columns(rule, time))
        .groupBy(_BIN, _CELL)
        .agg(F.min(time).alias("t0"), F.max(time).alias("t1"))
    )
    timeline = Window.partitionBy(F.lit(0)).orderBy("t0")
    opens = F.lag("t1").over(timeline).isNull() | (F.col(_BIN) != F.lag(_BIN).over(timeline))
    if rule.gap_seconds is not None:
        opens = opens | (F.col("t0") - F.lag("t1").over(timeline) > F.lit(float(rule.gap_seconds)))
    upto = timeline.rowsBetween(Window.unboundedPreceding, 0)
    index = cells.withColumn("__opens", opens.cast("long"))
    index = index.withColumn(C.BLOCK, F.sum("__opens").over(upto) - 1).drop("__opens")
    if splits is not None:
        block_end = F.max("t1").over(Window.partitionBy(C.BLOCK))
        index = index.withColumn(C.SPLIT, split_name(block_end, splits))
    return index


def segment_blocks(
    df: DataFrame, rule: TraceRule = TraceRule(), splits: SplitRule | None = None, time: str = C.TIME
) -> DataFrame:
    """Add ``trace_block_id`` (and ``split``).

    A block opens at the first event, after a gap longer than ``gap_seconds`` and at
    every wall-clock bin of ``max_block_seconds``.
    """
    # Shared by the row and the lease branch; a few rows per gap threshold and timeline.
    index = block_index(df, rule, splits, time).drop("t0", "t1").persist()
    return df.withColumns(_cell_columns(rule, time)).join(index, [_BIN, _CELL], "left").drop(_BIN, _CELL)


def lease_index(
    df: DataFrame, lease_gap_seconds: float, subject: str = C.SUBJECT, time: str = C.TIME, block: str = C.BLOCK
) -> DataFrame:
    """Lease sequence per occupied ``(block, subject, cell)``."""
    cells = (
        df.select(block, subject, time, bin_index(time, lease_gap_seconds / 2).alias(_CELL))
        .groupBy(block, subject, _CELL)
        .agg(F.min(time).alias("t0"), F.max(time).alias("t1"))
    )
    inside = Window.partitionBy(block, subject).orderBy(_CELL)
    opens = F.coalesce(F.col("t0") - F.lag("t1").over(inside) > F.lit(float(lease_gap_seconds)), F.lit(False))
    return cells.withColumn("__open", opens.cast("long")).select(
        block,
        subject,
        _CELL,
        F.sum("__open").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias(C.LEASE_SEQUENCE),
    )


def segment_leases(
    df: DataFrame, lease_gap_seconds: float = 30.0, subject: str = C.SUBJECT, time: str = C.TIME, block: str = C.BLOCK
) -> DataFrame:
    """Add the lease sequence and the ``block:subject:sequence`` lease id."""
    known = df.withColumn(
        subject,
        F.when(F.col(subject).isNotNull(), F.col(subject)).otherwise(
            F.raise_error(F.lit("entity id cannot be NULL")).cast(df.schema[subject].dataType)
        ),
    ).withColumn(_CELL, bin_index(time, lease_gap_seconds / 2))
    index = lease_index(df.where(F.col(subject).isNotNull()), lease_gap_seconds, subject, time, block)
    joined = known.join(index, [block, subject, _CELL], "left").drop(_CELL)
    return joined.withColumn(C.LEASE, colon_key(block, subject, C.LEASE_SEQUENCE))


def session_table(df: DataFrame, gap_seconds: float, subject: str = C.SUBJECT, time: str = C.TIME) -> DataFrame:
    """Sessions per entity: silence longer than the gap starts a new one.

    Cells are counted map-side and numbered per entity; an entity has at most two cells
    per gap and timeline, whatever its number of reports.
    """
    cells = df.groupBy(subject, bin_index(time, gap_seconds / 2).alias(_CELL)).agg(
        F.min(time).alias("t0"), F.max(time).alias("t1"), F.count(F.lit(1)).alias("n")
    )
    inside = Window.partitionBy(subject).orderBy(_CELL)
    opens = F.coalesce(F.col("t0") - F.lag("t1").over(inside) > F.lit(float(gap_seconds)), F.lit(False))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    numbered = cells.withColumn("__o", opens.cast("long")).withColumn("session", F.sum("__o").over(upto))
    return numbered.groupBy(subject, "session").agg(
        F.min("t0").alias("start_s"), F.max("t1").alias("end_s"), F.sum("n").alias("n_reports")
    )


def add_targets(df: DataFrame, ontology: Ontology = TRACE_ONTOLOGY, label: str = "label") -> DataFrame:
    """Map labels to ids; a NULL or unknown label fails the job."""
    ids = F.create_map(*[x for i, name in enumerate(ontology.labels) for x in (F.lit(name), F.lit(i))])
    known = F.element_at(ids, F.col(label))
    bad = F.raise_error(F.concat(F.lit("unknown label "), F.coalesce(F.col(label), F.lit("NULL")))).cast("int")
    return df.withColumns(
        {
            "label_id": F.when(known.isNotNull(), known).otherwise(bad),
            "is_attack": F.col(label).isin(*ontology.attacks),
        }
    )


def prepare(
    df: DataFrame,
    rule: TraceRule = TraceRule(),
    splits: SplitRule | None = None,
    ontology: Ontology | None = TRACE_ONTOLOGY,
    raw_time: str | None = "timestamp",
) -> DataFrame:
    """Chronology, blocks, leases and targets in one plan."""
    timed = correct_chronology(df, rule, raw_time) if raw_time else df
    out = segment_leases(segment_blocks(timed, rule, splits), rule.lease_gap_seconds)
    return add_targets(out, ontology) if ontology else out
