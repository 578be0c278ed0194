from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegate import columns as C
from pulsegate.config import SplitRule, TraceRule
from pulsegate.functions.ordered import neighbours, row_index, running_totals
from pulsegate.functions.quantiles import exact_quantiles, weighted_median
from pulsegate.operators.audit import duplicate_members, time_reversals
from pulsegate.operators.metrics import hold_durations, lease_generation
from pulsegate.operators.segmentation import segment_blocks, segment_leases, session_table
from pulsegate.operators.splits import split_name
from tests.walkers import walk_blocks, walk_durations


@pytest.fixture(scope="module")
def hot(spark):
    """3,000 rows of which one key owns over a third."""
    rng = np.random.default_rng(3)
    key = np.where(rng.random(3000) < 0.4, 0, rng.integers(1, 30, 3000))
    pdf = pd.DataFrame({"key": key, "t": rng.permutation(3000), "x": rng.integers(0, 50, 3000) / 8.0})
    return spark.createDataFrame(pdf), pdf


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_running_totals_split_a_heavy_key(hot, partitions):
    df, pdf = hot
    got = running_totals(df, ["key"], ["t"], {"sum": F.col("x"), "n": F.lit(1)}, partitions).toPandas()
    want = pdf.sort_values("t").assign(sum=lambda d: d.groupby("key")["x"].cumsum(), n=lambda d: d.groupby("key").cumcount() + 1)
    merged = got.merge(want, on=["key", "t"], suffixes=("", "_want"))
    assert (merged["sum"] == merged["sum_want"]).all() and (merged["n"] == merged["n_want"]).all()


def test_running_totals_descending(hot):
    df, pdf = hot
    got = running_totals(df, [], [F.desc("t")], {"n": F.lit(1)}, 7).toPandas().sort_values("t", ascending=False)
    assert got["n"].tolist() == list(range(1, 3001))


def test_neighbours_cross_partitions_and_keep_nulls(spark):
    rows = [(k, t, None if (k + t) % 3 == 0 else float(t)) for k in range(3) for t in range(200)]
    df = spark.createDataFrame(rows, "key long, t long, x double")
    got = neighbours(df, ["key"], ["t"], {"before": "x"}, {"after": "x"}, 11).collect()
    values = {(k, t): x for k, t, x in rows}
    assert len(got) == len(rows)
    for r in got:
        assert r["before"] == values.get((r["key"], r["t"] - 1))
        assert r["after"] == values.get((r["key"], r["t"] + 1))


def test_row_index_is_dense(hot):
    df, _ = hot
    got = row_index(df, ["x", "t"], "position", 9).orderBy("x", "t").toPandas()
    assert got["position"].tolist() == list(range(3000))


def test_exact_quantiles_match_linear_interpolation(hot):
    df, pdf = hot
    probs = [0.0, 0.1, 0.5, 0.901, 1.0]
    for row in exact_quantiles(df, ["key"], "x", probs).collect():
        np.testing.assert_allclose(row["q"], np.quantile(pdf.loc[pdf["key"] == row["key"], "x"], probs), atol=1e-12)
    whole = exact_quantiles(df, [], "x", [0.333]).first()
    assert whole["n"] == 3000 and whole["q"][0] == pytest.approx(np.quantile(pdf["x"], 0.333))


def test_weighted_median(spark):
    rows = [(v, w) for v, w in zip([5.0, 1.0, 3.0, 9.0], [2, 1, 0, 3])]
    got = weighted_median(spark.createDataFrame(rows, "v double, w long"), [], "v", "w").first()
    assert got["median"] == np.median(np.repeat([5.0, 1.0, 3.0, 9.0], [2, 1, 0, 3]))


def test_time_reversals_cross_chunks(spark):
    t = [5.0, 4.0, 6.0, None, 3.0, 7.0, 6.5, 6.4]
    df = spark.createDataFrame(list(enumerate(t)), f"{C.ROW} long, t double")
    for chunk in (2, 3, 100):
        assert time_reversals(df, "t", chunk_rows=chunk).first()[0] == 3


def test_duplicate_members(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c"), (None, "c")], "x int, y string")
    assert tuple(duplicate_members(df, ["x", "y"]).first()) == (4, 2)


@pytest.mark.parametrize(("gap", "width"), [(3.0, 20.0), (3.0, None), (None, 20.0), (0.5, 7.0)])
def test_blocks_match_walker(spark, gap, width):
    rng = np.random.default_rng(11)
    for trial in range(4):
        steps = rng.choice([0.0, 0.25, 1.0, 3.0, 3.0000001, 2.9999, 8.0], 120)
        times = (1000.0 + np.cumsum(steps)).tolist()
        df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], f"{C.ROW} long, {C.TIME} double")
        rule = TraceRule(gap_seconds=gap, max_block_seconds=width)
        got = segment_blocks(df, rule).orderBy(C.ROW).toPandas()
        assert got[C.BLOCK].tolist() == walk_blocks(times, gap, width), trial


def test_leases_open_strictly_after_the_gap(spark):
    rows = [(0, 7, 0.0, 0), (1, 7, 30.0, 0), (2, 7, 60.0001, 0), (3, 8, 60.0, 0), (4, 7, 61.0, 1)]
    df = spark.createDataFrame(rows, f"{C.ROW} long, {C.SUBJECT} long, {C.TIME} double, {C.BLOCK} long")
    got = {r[C.ROW]: r[C.LEASE] for r in segment_leases(df, 30.0).collect()}
    assert got == {0: "0:7:0", 1: "0:7:0", 2: "0:7:1", 3: "0:8:0", 4: "1:7:0"}


def test_lease_needs_an_entity(spark):
    df = spark.createDataFrame([(0, None, 0.0, 0)], f"{C.ROW} long, {C.SUBJECT} long, {C.TIME} double, {C.BLOCK} long")
    with pytest.raises(Exception, match="NULL"):
        segment_leases(df).collect()


def test_sessions(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 10.0), (1, 21.0), (2, 5.0)], f"{C.SUBJECT} long, {C.TIME} double")
    got = {(r[0], r["session"]): (r["start_s"], r["end_s"], r["n_reports"]) for r in session_table(df, 10.0).collect()}
    assert got == {(1, 0): (0.0, 10.0, 2), (1, 1): (21.0, 21.0, 1), (2, 0): (5.0, 5.0, 1)}


def test_split_at_a_cut_stays_earlier(spark):
    rule = SplitRule(names=("a", "b", "c"), cut_times_s=(10.0, 20.0))
    df = spark.createDataFrame([(9.0,), (10.0,), (10.5,), (20.0,), (21.0,)], "end double")
    assert [r[0] for r in df.select(split_name("end", rule)).collect()] == ["a", "a", "b", "b", "c"]


def test_durations_and_generations_with_reused_leases(spark):
    rng = np.random.default_rng(2)
    rows, t = [], 0.0
    for i in range(400):
        t += float(rng.choice([0.0, 1.0, 5.0]))
        rows.append((i, int(rng.choice([1, 1, 1, 2, 3])), str(rng.choice(["A", "B"], p=[0.8, 0.2])), t))
    df = spark.createDataFrame(rows, f"{C.ROW} long, {C.SUBJECT} long, {C.LEASE} string, {C.TIME} double")
    got = {r[C.ROW]: r["duration_s"] for r in hold_durations(df, cap_s=4.0).collect()}
    assert got == walk_durations(rows, 4.0)
    numbers = {r[C.ROW]: r["lease_generation"] for r in lease_generation(df).collect()}
    for subject in (1, 2, 3):
        own = [(r[0], r[2]) for r in rows if r[1] == subject]
        changes = np.cumsum([0] + [int(a[1] != b[1]) for a, b in zip(own, own[1:])])
        assert [numbers[r] for r, _ in own] == changes.tolist()


def test_rules_are_validated():
    for bad in ({"gap_seconds": 0.0}, {"lease_gap_seconds": math.inf}, {"gap_seconds": None, "max_block_seconds": None}):
        with pytest.raises(ValueError):
            TraceRule(**bad)
    with pytest.raises(ValueError):
        SplitRule(cut_times_s=(3.0, 2.0, 5.0))
