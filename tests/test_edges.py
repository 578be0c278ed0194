"""NULL keys, lease ids that come back, unbounded leases, maps that are not m:1, steps back in time."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegate import columns as C
from pulsegate.config import TraceRule
from pulsegate.functions.ordered import neighbours, running_totals
from pulsegate.functions.quantiles import exact_quantiles
from pulsegate.operators.audit import time_reversals
from pulsegate.operators.contributions import attach_cluster, roll_up_episodes
from pulsegate.operators.controllers import ewma_evidence, oversized_leases
from pulsegate.operators.episodes import ISLAND, mark_report_islands
from pulsegate.operators.metrics import hold_durations
from pulsegate.operators.epochs import sweep_leases
from pulsegate.sources.trace_csv import scan_trace, with_source_row


def null_keys(spark):
    return spark.createDataFrame([(None if i % 4 else "k", i) for i in range(400)], "k string, t long").repartition(7)


def test_running_totals_carry_null_keys(spark):
    got = running_totals(null_keys(spark), ["k"], ["t"], {"n": F.lit(1).cast("long")}, 5)
    top = {r["k"]: r["n"] for r in got.groupBy("k").agg(F.max("n").alias("n")).collect()}
    assert top == {None: 300, "k": 100}


def test_neighbours_of_null_keys(spark):
    got = neighbours(null_keys(spark), ["k"], ["t"], previous={"p": "t"}, partitions=5).collect()
    assert sum(r["p"] is None for r in got) == 2


def test_quantiles_of_null_keys(spark):
    got = {r["k"]: (r["n"], r["q"][0]) for r in exact_quantiles(null_keys(spark), ["k"], "t", [0.5]).collect()}
    assert got == {"k": (100, 198.0), None: (300, 200.0)}


def test_returning_lease_starts_a_new_run(spark):
    rows = [(1, 7, lease, float(t), True) for t, lease in enumerate("AABBA")]
    df = spark.createDataFrame(rows, f"{C.BLOCK} long, {C.SUBJECT} long, {C.LEASE} string, {C.DECISION_TIME} double, {C.IS_ATTACK} boolean")
    got = {(r[C.LEASE], r[ISLAND]) for r in mark_report_islands(df).collect()}
    assert got == {("A", 1), ("B", 1), ("A", 2)}


def test_unbounded_leases_are_refused(spark):
    with pytest.raises(ValueError):
        oversized_leases(spark.range(1), TraceRule(max_block_seconds=None))


def test_maps_must_be_many_to_one(spark):
    doubled = spark.createDataFrame([(1, 5), (1, 6)], f"{C.BLOCK} long, g long")
    with pytest.raises(Exception, match="exactly one cluster"):
        roll_up_episodes(spark.createDataFrame([(1,)], "onset_block_id long"), doubled, "g").collect()
    with pytest.raises(Exception, match="exactly one cluster"):
        attach_cluster(spark.createDataFrame([(1,)], f"{C.BLOCK} long"), doubled, "g").collect()
    single = spark.createDataFrame([(1, 5)], f"{C.BLOCK} long, g long")
    got = attach_cluster(spark.createDataFrame([(1,), (2,)], f"{C.BLOCK} long"), single, "g").collect()
    assert {tuple(r) for r in got} == {(1, 5), (2, None)}


def test_steps_back_in_time_fail(spark):
    rows = [(0, 10.0), (1, 5.0), (2, 20.0)]
    df = spark.createDataFrame([(i, t, 1, "L") for i, t in rows], f"{C.ROW} long, {C.TIME} double, {C.SUBJECT} long, {C.LEASE} string")
    with pytest.raises(Exception, match="time runs backwards"):
        hold_durations(df).collect()


def test_sweep_ids_keep_fractions(spark):
    kinds = f"{C.BLOCK} long, {C.SUBJECT} long, {C.EPOCH_START} double, {C.DECISION_TIME} double, first_event_time_s double, last_event_time_s double"
    df = spark.createDataFrame([(1, 1, 0.0, 1.0, 0.0, 0.5)], kinds)
    assert len({r[C.LEASE] for r in sweep_leases(df, [1.2, 1.5]).collect()}) == 2


def test_source_order_follows_paths_not_task_packing(spark, tmp_path):
    # Later files are larger: Spark packs those first.
    at = 0
    for number, size in enumerate((2, 40, 900)):
        lines = ["mac_rnti;timestamp"]
        for _ in range(size):
            lines.append(f"7;{at}.0")
            at += 1
        (tmp_path / f"part-{number}.csv").write_text("\n".join(lines) + "\n")
    rows = scan_trace(spark, str(tmp_path), schema_columns=["mac_rnti", "timestamp"])
    timed = rows.withColumn("t", F.col("timestamp").cast("double"))
    assert time_reversals(timed, "t").first()[0] == 0
    assert time_reversals(timed.withColumn("t", -F.col("t")), "t", chunk_rows=7).first()[0] == at - 1
    numbered = with_source_row(timed).orderBy(C.ROW).select("t").collect()
    assert [r["t"] for r in numbered] == sorted(r["t"] for r in numbered) and len(numbered) == at


def test_ewma_window_over_many_time_constants(spark):
    rng = np.random.default_rng(3)
    steps = np.where(rng.random(900) < 0.01, 400.0, 1.0)
    rows = [(0, 1, "L", float(t), None if i % 17 == 5 else float(rng.random())) for i, t in enumerate(np.cumsum(steps))]
    df = spark.createDataFrame(rows, f"{C.BLOCK} long, {C.SUBJECT} long, {C.LEASE} string, {C.DECISION_TIME} double, {C.SCORE} double")
    got = {r[C.DECISION_TIME]: r["evidence"] for r in ewma_evidence(df, 0.5, C.SCORE, [C.DECISION_TIME]).collect()}
    held, last = None, None
    for _, _, _, t, x in rows:
        if x is None:
            assert got[t] is None
            continue
        held, last = (x if held is None else held + -np.expm1(-(t - last) / 0.5) * (x - held)), t
        assert got[t] == pytest.approx(held, rel=1e-9)
