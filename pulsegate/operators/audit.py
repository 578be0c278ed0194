"""Trace audit and fail-closed validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pulsegate import columns as C
from pulsegate.functions.scalars import is_finite
from pulsegate.schema import CONSTANT_COLUMNS, TRACE_COLUMNS, TRACE_ONTOLOGY, Ontology, TraceError


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def mismatch(left: str, right: str) -> Column:
    """Identifiers disagree: one is NULL and the other not, or both differ."""
    a, b = F.col(left), F.col(right)
    return (a.isNull() != b.isNull()) | F.coalesce(a != b, F.lit(False))


def column_audit(
    df: DataFrame,
    time: str,
    label: str = "label",
    ontology: Ontology = TRACE_ONTOLOGY,
    identifiers: tuple[str, str] | None = None,
    constants: Mapping[str, float] | None = None,
) -> DataFrame:
    """Row, NULL, non-finite, unknown-label, identifier and constant counts in one pass."""
    t = F.col(time).try_cast("double")
    aggs = [
        F.count(F.lit(1)).alias("n_rows"),
        _count(F.col(label).isNull()).alias("null_label_rows"),
        _count(~F.col(label).isin(*ontology.labels)).alias("unknown_label_rows"),
        _count(F.col(time).isNull()).alias("timestamp_null_rows"),
        _count(F.col(time).isNotNull() & ~is_finite(t)).alias("timestamp_nonfinite_rows"),
    ]
    if identifiers:
        aggs.append(_count(mismatch(*identifiers)).alias("identifier_mismatch_rows"))
    for name, value in (constants or {}).items():
        aggs.append(_count(F.col(name).isNull() | (F.col(name) != F.lit(value))).alias(f"constant__{name}"))
    return df.agg(*aggs)


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))


def unknown_labels(df: DataFrame, label: str = "label", ontology: Ontology = TRACE_ONTOLOGY) -> DataFrame:
    """Labels outside the ontology with their row counts."""
    return label_counts(df.where(~F.col(label).isin(*ontology.labels)), label)


def duplicate_members(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that belong to a group of identical rows (every member counts).

    Rows are reduced to a count per distinct row map-side, so copies of one heavy row
    collapse before the shuffle.
    """
    copies = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return copies.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).cast("long").alias("duplicate_members"),
        F.count(F.lit(1)).alias("duplicate_groups"),
    )


def time_reversals(df: DataFrame, time: str, row: str = C.ROW, chunk_rows: int = 1 << 20) -> DataFrame:
    """Steps back in time along the source order.

    Source rows are cut into chunks of ``chunk_rows`` consecutive ids (of a file split, where the row is
    a source position); each chunk is one window group, and only chunk edges meet in a second,
    chunk-count-sized window.
    """
    kind = df.schema[row].dataType
    *outer, inner = [f"{row}.{f}" for f in kind.names] if isinstance(kind, T.StructType) else [row]
    chunk = F.struct(*map(F.col, outer), F.floor(F.col(inner) / F.lit(chunk_rows)).alias("number")).alias("__chunk")
    rows = df.select(chunk, F.col(row).alias("__row"), F.col(time).try_cast("double").alias("__t"))
    inside = Window.partitionBy("__chunk").orderBy("__row")
    steps = rows.withColumn("__prev", F.lag("__t").over(inside))
    per_chunk = steps.groupBy("__chunk").agg(
        _count(F.col("__t") < F.col("__prev")).alias("inner"),
        F.min_by("__t", "__row").alias("first_t"),
        F.max_by("__t", "__row").alias("last_t"),
    )
    edge = F.lag("last_t").over(Window.partitionBy(F.lit(0)).orderBy("__chunk"))
    joined = per_chunk.withColumn("edge", F.coalesce((F.col("first_t") < edge), F.lit(False)).cast("long"))
    return joined.agg(F.coalesce(F.sum(F.col("inner") + F.col("edge")), F.lit(0)).cast("long").alias("time_reversals"))


def audit_trace(df: DataFrame, ontology: Ontology = TRACE_ONTOLOGY) -> dict[str, Any]:
    """Every audit figure of a raw trace as one small record."""
    source = [c for c in df.columns if c != C.ROW]
    report: dict[str, Any] = {
        "source_columns": source,
        "missing_columns": [c for c in TRACE_COLUMNS if c not in source],
        "unexpected_columns": [c for c in source if c not in TRACE_COLUMNS],
        "column_order_matches": source == list(TRACE_COLUMNS),
    }
    if report["missing_columns"]:
        return report
    counts = column_audit(df, "timestamp", "label", ontology, ("mac_rnti", "ue_ident"), CONSTANT_COLUMNS)
    report |= counts.first().asDict()
    report |= duplicate_members(df, source).first().asDict()
    report |= time_reversals(df, "timestamp").first().asDict()
    return report


def validate_trace(df: DataFrame, ontology: Ontology = TRACE_ONTOLOGY) -> dict[str, Any]:
    """Raise with every violation; steps back in time are reported, not refused."""
    report = audit_trace(df, ontology)
    problems = [f"{k}={report[k]}" for k in ("missing_columns", "unexpected_columns") if report[k]]
    if not report["column_order_matches"]:
        problems.append("columns are out of order")
    watched = [
        "null_label_rows",
        "unknown_label_rows",
        "timestamp_null_rows",
        "timestamp_nonfinite_rows",
        "identifier_mismatch_rows",
        "duplicate_members",
        *(k for k in report if k.startswith("constant__")),
    ]
    problems += [f"{k}={report[k]}" for k in watched if report.get(k)]
    if problems:
        raise TraceError("; ".join(problems))
    return report
