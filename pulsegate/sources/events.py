"""Adapter from a generic event table to the report contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegate import columns as C
from pulsegate.functions.scalars import col, epoch_seconds
from pulsegate.schema import Ontology

EVENT_ONTOLOGY = Ontology(benign=("click", "signup", "view"), attacks=("error", "purchase"))
HALF_SCORE_VALUE = 50.0


def saturating_score(value: Column | str, half: float = HALF_SCORE_VALUE) -> Column:
    """``v / (v + half)``: a score in [0, 1) for non-negative values."""
    return col(value) / (col(value) + F.lit(float(half)))


def read_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report per event: row id, entity, time, label, value, score and context."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(
        F.col("event_id").alias(C.ROW),
        F.col("user_id").alias(C.SUBJECT),
        epoch_seconds("ts").alias(C.TIME),
        F.col("event_type").alias("label"),
        "value",
        saturating_score("value").alias(C.SCORE),
        F.get_json_object("props", "$.k").cast("long").alias("id_ue"),
    )
