"""The ``;``-separated raw trace."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegate.columns import ROW
from pulsegate.functions.ordered import row_index
from pulsegate.schema import CSV_SEPARATOR, TRACE_COLUMNS, TraceError, trace_schema


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of the first line of the trace."""
    line = spark.read.text(path).first()
    if line is None:
        raise TraceError(f"empty trace: {path}")
    return line[0].split(CSV_SEPARATOR)


def scan_trace(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    schema_columns: Sequence[str] = TRACE_COLUMNS,
) -> DataFrame:
    """Lazy, schema-checked scan; ragged or mistyped lines fail the job.

    ``_source_row`` is the source position ``(file, split offset, position in split)``, a struct that
    orders rows as the files do by path, however Spark packs them into tasks.  Stages need no more than
    this order; :func:`with_source_row` turns it into a dense index.
    """
    reader = (
        spark.read.schema(trace_schema(schema_columns))
        .option("sep", CSV_SEPARATOR)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
    )
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("offset"),
        F.monotonically_increasing_id().alias("local"),
    )
    df = reader.csv(path).withColumn(ROW, place)
    return df.select(*columns, ROW) if columns else df


def with_source_row(df: DataFrame) -> DataFrame:
    """Replace ``_source_row`` by a dense zero-based index in source order."""
    return row_index(df.withColumnRenamed(ROW, "__place"), ["__place"], ROW).drop("__place")
