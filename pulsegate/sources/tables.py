"""Table sources and sinks, digests and small JSON documents."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Sequence
from dataclasses import asdict, is_dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegate import columns as C
from pulsegate.functions.scalars import canonical_digest, is_finite
from pulsegate.schema import CSV_SEPARATOR, TraceError


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: str | None = None):
    """Parquet scan; the filter and projection reach the file reader."""
    df = spark.read.parquet(path)
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return path


def check_scores(df: DataFrame, score: str = C.SCORE, raw: str | None = C.RAW_SCORE) -> DataFrame:
    """Fail the job on scores that are not finite or leave [0, 1]."""
    good = is_finite(score) & F.col(score).between(0.0, 1.0)
    if raw and raw in df.columns:
        good = good & is_finite(raw)
    checked = F.when(good, F.col(score)).otherwise(F.raise_error(F.lit("invalid risk score")).cast("double"))
    return df.withColumn(score, checked)


def write_scores(df: DataFrame, path: str) -> str:
    """Score table sink; the suffix picks CSV or Parquet, the commit protocol keeps it atomic."""
    checked = check_scores(df)
    if path.endswith(".csv"):
        checked.write.mode("overwrite").option("header", True).csv(path)
    elif path.endswith(".parquet"):
        write_parquet(checked, path)
    else:
        raise ValueError("score tables are stored as .parquet or .csv")
    return path


def read_scores(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    if path.endswith(".csv"):
        reader = spark.read.option("header", True)
        df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    else:
        df = spark.read.parquet(path)
    return check_scores(df)


def rounded_for_report(df: DataFrame, digits: int = 6) -> DataFrame:
    """Report view of a table: NaN becomes NULL, doubles keep ``digits`` places."""
    fixed = {
        f.name: F.when(~F.isnan(f.name), F.round(f.name, digits))
        for f in df.schema
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(fixed) if fixed else df


def write_report_csv(df: DataFrame, path: str, sep: str = ",") -> str:
    rounded_for_report(df).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
    return path


def write_cluster_map(mapping: DataFrame, path: str, source_path: str | None = None) -> str:
    refuse_overwrite(path, source_path)
    mapping.write.mode("overwrite").option("header", True).option("sep", CSV_SEPARATOR).csv(path)
    return path


def read_cluster_map(spark: SparkSession, path: str) -> DataFrame:
    """Block-to-cluster map; every ``*_group`` column is LONG."""
    df = spark.read.option("header", True).option("sep", CSV_SEPARATOR).csv(path)
    longs = {c: F.col(c).cast("long") for c in df.columns if c == C.BLOCK or c.endswith("_group")}
    return df.withColumns(longs | {c: F.col(c).cast("double") for c in ("start_s", "end_s") if c in df.columns})


def refuse_overwrite(path: str, source_path: str | None) -> None:
    if source_path is not None and os.path.realpath(path) == os.path.realpath(source_path):
        raise ValueError("refusing to overwrite the source")


def latex_escape(value: Any) -> str:
    special = {"\\": r"\textbackslash{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}
    special |= {ch: "\\" + ch for ch in "&%$#_{}"}
    return "".join(special.get(ch, ch) for ch in str(value))


def latex_rows(rows: Iterable[Sequence[Any]]) -> str:
    return "\n".join(" & ".join(latex_escape(v) for v in row) + r" \\" for row in rows)


def json_ready(value: Any) -> Any:
    """JSON-safe copy: NaN and infinities become null, records become objects."""
    if is_dataclass(value) and not isinstance(value, type):
        return json_ready(asdict(value))
    if isinstance(value, dict):
        return {str(k): json_ready(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [json_ready(v) for v in value]
    if isinstance(value, float) and not (value - value == 0):
        return None
    if isinstance(value, Decimal):
        return str(value)
    return value.item() if hasattr(value, "item") else value


def write_json(path: str, payload: Any) -> str:
    """Small document as a one-row text table, on whatever store Spark writes to."""
    text = json.dumps(json_ready(payload), indent=2, sort_keys=True, allow_nan=False)
    row = SparkSession.active().createDataFrame([(text,)], "value string")
    row.coalesce(1).write.mode("overwrite").text(path)
    return path


def read_json(path: str) -> dict[str, Any]:
    """A document of :func:`write_json`, or a plain JSON file; a missing one fails."""
    parts = SparkSession.active().read.text(path, wholetext=True).collect()
    payload = json.loads(parts[0][0]) if len(parts) == 1 else None
    if not isinstance(payload, dict):
        raise TraceError(f"expected a JSON object: {path}")
    return payload


def source_fingerprint(spark: SparkSession, path: str) -> str:
    """Fingerprint of all lines of a file or folder, computed where the data is."""
    found = table_digest(spark.read.text(path)).first()
    return hashlib.sha256(":".join(str(v) for v in found).encode()).hexdigest()


def table_digest(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Order-free fingerprint of a table: row count and the sum of row-hash halves.

    Sums of independent row hashes combine map-side, so no ordered concatenation of
    the table is ever needed.
    """
    row = canonical_digest(*(columns or df.columns))
    part = F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(38,0)")
    rest = F.conv(F.substring(row, 13, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(part).alias("sum_high"), F.sum(rest).alias("sum_low"))


def as_table(spark: SparkSession, records: Any) -> DataFrame:
    """Accept a DataFrame, pandas-like frame, dict of columns or list of records."""
    if isinstance(records, DataFrame):
        return records
    if hasattr(records, "to_pandas"):
        return spark.createDataFrame(records.to_pandas())
    if isinstance(records, dict):
        names = list(records)
        return spark.createDataFrame(list(zip(*records.values())), names)
    return spark.createDataFrame(records)
