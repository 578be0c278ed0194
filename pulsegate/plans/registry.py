"""Named queries and, where SQL can express them, their independent SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegate.plans.study import Study

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles so that the order of a float sum does not show."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in doubles}) if doubles else df


def query(name: str, sql: str | None = None, **study):
    """Register ``fn(study) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Study], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = Query(lambda spark, sf_dir: tidy(fn(Study(spark, sf_dir, **study))), sql)
        return fn

    return register
