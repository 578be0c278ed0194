"""All rounds of the registered booster, and its passes over packed blocks."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegate import columns as C
from pulsegate.operators import boosting as B
from pulsegate.operators import scoring
from pulsegate.plans import queries_model

ROOT = ((-1, 0, 0, 0.0),)


def test_registered_query_fits_every_round(spark, monkeypatch):
    class Fitted(Exception):
        pass

    def fit(df, columns, target, weight, growth, *rest):
        raise Fitted(growth)

    monkeypatch.setattr(scoring, "fit_boosted", fit)
    epochs = spark.range(60).selectExpr(
        "CAST(id AS double) AS value", f"id / 60D AS {C.SCORE}", f"id % 4 AS {C.SAMPLES}", f"id % 3 = 0 AS {C.IS_ATTACK}", f"'train' AS {C.SPLIT}"
    )
    with pytest.raises(Fitted) as found:
        queries_model.boosted_score(SimpleNamespace(spark=spark, epochs=epochs))
    (growth,) = found.value.args
    assert growth == B.Growth() and growth.max_iter == 150


def some_tree(rng) -> B.Tree:
    """A tree of at most three levels; some of its listed nodes are out of reach, as those that growing did not take."""
    out = [(-1, 0, 0, rng.normal())]
    level = [0]
    for _ in range(3):
        following = []
        for node in level:
            if rng.random() < 0.8:
                out[node] = (int(rng.integers(3)), int(rng.integers(0, 255)), len(out), 0.0)
                following += [len(out), len(out) + 1]
                out += [(-1, 0, 0, rng.normal()), (-1, 0, 0, rng.normal())]
        level = following
    return tuple(out)


def walked(tree: B.Tree, row: np.ndarray) -> int:
    at = 0
    while tree[at][0] >= 0:
        feature, cut, left, _ = tree[at]
        at = left if row[feature] <= cut else left + 1
    return at


def test_leaves_by_open_bits_are_those_of_a_walk():
    rng = np.random.default_rng(11)
    for _ in range(40):
        tree, bins = some_tree(rng), rng.integers(0, 256, (200, 3)).astype(np.uint8)
        want = [walked(tree, row) for row in bins]
        assert B.node_of(tree, bins).tolist() == want
        assert B.leaf_values(tree, bins).tolist() == [tree[k][3] for k in want]


def counted(spark, n: int, features: int = 2):
    """``n`` rows as :func:`boosting.binned` leaves them."""
    bins = F.concat(*[F.unhex(F.lpad(F.hex((F.col("id") * k) % 256), 2, "0")) for k in range(1, features + 1)])
    rows = spark.range(n).select(
        bins.alias("bins"), (F.col("id") % 2).cast("double").alias("y"), (1 + F.col("id") % 5).cast("double").alias("w"),
        (F.col("id") % 7 / 10).alias("raw"), (1 + F.col("id") % 3).alias("n"),
    )
    return rows


def test_blocks_hold_every_row_once_and_in_order(spark):
    n = 2 * B.BLOCK_ROWS + 10_001
    rows = counted(spark, n).coalesce(1)
    blocks = B.packed(rows).collect()
    sizes = [len(b["n"]) // 8 for b in blocks]
    assert sum(sizes) == n and max(sizes) <= B.BLOCK_ROWS and len(sizes) >= 3
    assert np.concatenate([np.frombuffer(b["n"], dtype=np.int64) for b in blocks]).tolist() == [1 + i % 3 for i in range(n)]
    bins = np.frombuffer(b"".join(b["bins"] for b in blocks), dtype=np.uint8).reshape(-1, 2)
    assert (bins[:, 1] == 2 * np.arange(n) % 256).all()


@pytest.mark.parametrize("direct", [1, 64])
def test_level_sums_are_those_of_the_table(spark, monkeypatch, direct):
    monkeypatch.setattr(B, "DIRECT_TASKS", direct)
    rows = counted(spark, 3000).repartition(9)
    trees = [((0, 99, 1, 0.0), (-1, 0, 0, 0.25), (-1, 0, 0, -0.5))] * 2
    grown = ((1, 60, 1, 0.0), (-1, 0, 0, 0.0), (0, 200, 3, 0.0), (-1, 0, 0, 0.0), (-1, 0, 0, 0.0))
    want = B._collected(B.histogram(rows, trees, grown, [1, 4], 2), [1, 4], 2)
    kept = B.level_sums(B.gradients(B.packed(rows), trees, 2), grown, [1, 4], 2)
    moved = B.level_sums(B.gradients(B._advanced(B.packed(rows), trees, 2), (), 2), grown, [1, 4], 2)
    for node, sums in want.items():
        for a, b, c in zip(sums, kept[node], moved[node]):
            assert a.any() and (a == b).all() and (a == c).all()


def test_sums_of_many_tasks_pass_63_bits(spark):
    n = (1 << 31) - 1
    rows = spark.range(0, 8, 1, 8).selectExpr("X'00' AS bins", "0D AS y", "1D AS w", "0D AS raw", f"{n}L AS n")
    ((count, g, h),) = B.level_sums(B.gradients(B.packed(rows), (), 1), ROOT, [0], 1).values()
    assert count[0, 0] == 8 * n and g[0, 0] == 8 * n / 2 and h[0, 0] == 8 * n / 4
