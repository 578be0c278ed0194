from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pulsegate import columns as C
from pulsegate.functions import scalars as sc
from pulsegate.operators.calibration import hard_states
from pulsegate.sources import tables


def test_set_and_share_distances(spark):
    df = spark.createDataFrame(
        [([1, 2, 3], [2, 3, 4], {"a": 0.5, "b": 0.5}, {"b": 1.0}), ([], [], {"a": 1.0}, {"a": 1.0})],
        "x array<int>, y array<int>, p map<string,double>, q map<string,double>",
    )
    got = df.select(sc.jaccard("x", "y").alias("j"), sc.total_variation("p", "q").alias("d")).collect()
    assert [(r["j"], r["d"]) for r in got] == [(0.5, 0.5), (1.0, 0.0)]


@pytest.mark.parametrize("text", ["2024-01-13T00:00:00Z", "2024-01-13T02:00:00+02:00", "2024-01-13 00:00:00"])
def test_utc_seconds(spark, text):
    assert spark.range(1).select(sc.utc_seconds(text)).first()[0] == 1705104000.0


def test_naive_timestamps_are_utc(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 13, 0, 0, 0, 250000),)], "ts timestamp_ntz")
    assert df.select(sc.epoch_seconds("ts")).first()[0] == 1705104000.25


def test_state_names_and_codes(spark):
    df = spark.createDataFrame([(" allow ",), ("Isolate",)], "s string")
    assert [r[0] for r in df.select(sc.state_code("s")).collect()] == [0, 2]
    with pytest.raises(Exception, match="unknown state"):
        spark.createDataFrame([("open",)], "s string").select(sc.state_code("s")).collect()


def test_hard_states_act_one_epoch_later(spark):
    rows = [(0, 1, "L", float(t), s) for t, s in enumerate([0.9, 0.1, 0.9])]
    df = spark.createDataFrame(rows, f"{C.BLOCK} long, {C.SUBJECT} long, {C.LEASE} string, {C.DECISION_TIME} double, {C.SCORE} double")
    got = hard_states(df, 0.5).orderBy(C.DECISION_TIME).collect()
    assert [r["effective_state"] for r in got] == [0, 2, 0]


def test_small_tables_and_rendering(spark, tmp_path):
    assert tables.as_table(spark, {"a": [1, 2], "b": ["x", "y"]}).count() == 2
    assert tables.latex_rows([("50 %", "a_b")]) == r"50 \% & a\_b \\"
    df = spark.createDataFrame([(1, float("nan"), 1.23456789), (2, 2.0, None)], "i int, x double, y double")
    path = tables.write_report_csv(df, str(tmp_path / "t.csv"))
    got = spark.read.option("header", True).csv(path).orderBy("i").collect()
    assert [(r["x"], r["y"]) for r in got] == [(None, "1.234568"), ("2.0", None)]
    with pytest.raises(ValueError, match="overwrite"):
        tables.refuse_overwrite(path, path)


def test_score_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.25, -1.1)], f"i int, {C.SCORE} double, {C.RAW_SCORE} double")
    for name in ("s.parquet", "s.csv"):
        path = tables.write_scores(df, str(tmp_path / name))
        assert tables.read_scores(spark, path).first()[C.SCORE] == 0.25
    with pytest.raises(Exception, match="invalid risk score"):
        tables.check_scores(df.withColumn(C.SCORE, F.lit(1.5))).collect()
