"""Histogram gradient boosting for a binary target: shallow trees grown leaf by leaf on binned features.

* Bins: a feature of at most ``max_bins`` distinct values is cut half-way between neighbours, another one at its
  ``max_bins`` quantiles (mean of the two values around each position).  Both come from value counts with exact
  running totals, so no task holds a feature.
* A level of a tree is one pass: tasks add up count, gradient and hessian per (node, feature, bin) in numpy, and their
  sums are added.  The driver sees nodes x features x bins sums, a number that parameters bound, of a few tasks.
* Gradients are summed as integers of ``SCALE`` parts, so that trees do not depend on partitions or task order.
* All nodes down to the last level get their best split; the tree then takes splits by gain, largest first,
  until it has ``max_leaf_nodes`` leaves.  Leaf values are Newton steps.
* Rows of equal bins, target and weight are one row with a count ``n``: their gradients are equal integers.
* Rows are binned once into a scratch table of packed blocks and written anew with their raw score every ``KEEP``
  trees, so few trees are evaluated and lineage stays short.  The gradients of a tree are kept for its levels.

Ties go to the first feature, then to the lowest bin, then to the node found first.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegate.functions.ordered import running_totals
from pulsegate.functions.quantiles import value_counts
from pulsegate.session import Scratch, ship_package

MAX_BINS = 255
MIN_HESSIAN = 1e-3
SCALE = 1 << 32
KEEP = 10
# Rows of a packed block, and the number of tasks whose sums the driver adds up alone.
BLOCK_ROWS = 1 << 16
DIRECT_TASKS = 64

# feature < 0: a leaf of ``value``; else rows of bin <= ``cut`` go to ``left``, the others to ``left + 1``.
Node = tuple[int, int, int, float]
Tree = tuple[Node, ...]


@dataclass(frozen=True)
class Boosted:
    """Thresholds per feature, the log-odds trees start from, and the trees."""

    thresholds: tuple[tuple[float, ...], ...]
    baseline: float
    trees: tuple[Tree, ...] = ()

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.baseline)
        for tree in self.trees:
            out += leaf_values(tree, bins)
        return out

    def bins(self, matrix: np.ndarray) -> np.ndarray:
        """Bin of each value: the number of thresholds below it."""
        return np.stack([np.searchsorted(np.array(t), matrix[:, i], side="left") for i, t in enumerate(self.thresholds)], axis=1).astype(np.uint8)


# Lowest set bit of a byte.
LOWEST = np.array([0] + [(i & -i).bit_length() - 1 for i in range(1, 256)])


@lru_cache(maxsize=1024)
def _routes(tree: Tree) -> tuple[dict[int, np.ndarray], np.ndarray, np.ndarray]:
    """Per feature the leaves (a bit each, from the left) that a bin leaves open; node and value of the leaf by open leaves.

    A row falls into the leftmost leaf that is open to all its bins.  Trees of three levels have eight leaves at most.
    """
    cells: dict[int, np.ndarray] = {}
    leaves: list[int] = []

    def walk(node: int) -> int:
        feature, cut, left, _ = tree[node]
        if feature < 0:
            leaves.append(node)
            return 1 << len(leaves) - 1
        below = walk(left)
        cells.setdefault(feature, np.full(256, 255, dtype=np.uint8))[cut + 1 :] &= np.uint8(255 ^ below)
        return below | walk(left + 1)

    walk(0)
    nodes = np.array(leaves + [0] * (8 - len(leaves)))[LOWEST]
    return cells, nodes, np.array([n[3] for n in tree])[nodes]


def _open_leaves(cells: dict[int, np.ndarray], bins: np.ndarray) -> np.ndarray:
    out = np.full(len(bins), 255, dtype=np.uint8)
    for feature, by_bin in cells.items():
        out &= by_bin[bins[:, feature]]
    return out


def node_of(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """Index of the leaf each row falls into."""
    cells, nodes, _ = _routes(tree)
    return nodes[_open_leaves(cells, bins)]


def leaf_values(tree: Tree, bins: np.ndarray) -> np.ndarray:
    cells, _, values = _routes(tree)
    return values[_open_leaves(cells, bins)]


def bin_thresholds(df: DataFrame, columns: Sequence[Column], max_bins: int = MAX_BINS) -> tuple[tuple[float, ...], ...]:
    """Increasing cuts of each column; what reaches the driver is at most ``max_bins`` rows per column."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("feature"), c.alias("x")) for i, c in enumerate(columns)])))
    counts = value_counts(long, ["feature"], "x")
    sizes = counts.groupBy("feature").agg(F.sum("weight").alias("n"), F.count(F.lit(1)).alias("distinct"))
    with Scratch(df.sparkSession) as write:
        ranked = write(running_totals(counts, ["feature"], ["x"], {"cum": F.col("weight"), "place": F.lit(1)}))
        placed = ranked.join(F.broadcast(sizes), "feature").withColumn("start", F.col("cum") - F.col("weight"))
        few = placed.where(F.col("distinct") <= max_bins)
        # Half-way points: the value at one place and the next one.
        ends = few.select("feature", F.explode(F.array("place", F.col("place") - 1)).alias("k"), "x", "distinct")
        halves = ends.where("k > 0 AND k < distinct").groupBy("feature", "k").agg(F.avg("x").alias("cut"))
        # Position k (n - 1) / bins lies between its floor and its ceiling; each value says which k it serves.
        many = placed.where(F.col("distinct") > max_bins).withColumn("m", F.col("n") - 1)
        low = F.sequence(F.expr(f"(start * {max_bins} + m - 1) div m"), F.expr(f"(cum * {max_bins} + m - 1) div m - 1"))
        high = F.sequence(F.expr(f"CASE WHEN start = 0 THEN 0L ELSE ((start - 1) * {max_bins}) div m + 1 END"), F.expr(f"((cum - 1) * {max_bins}) div m"))
        fits = F.expr(f"(cum * {max_bins} + m - 1) div m > (start * {max_bins} + m - 1) div m")
        fits_high = F.expr(f"((cum - 1) * {max_bins}) div m >= CASE WHEN start = 0 THEN 0L ELSE ((start - 1) * {max_bins}) div m + 1 END")
        served = many.where(fits).select("feature", F.explode(low).alias("k"), "x").union(many.where(fits_high).select("feature", F.explode(high).alias("k"), "x"))
        cuts = served.where(f"k > 0 AND k < {max_bins}").groupBy("feature", "k").agg(F.avg("x").alias("cut"))
        found = halves.select("feature", "cut").union(cuts.select("feature", "cut")).distinct().collect()
    out: list[list[float]] = [[] for _ in columns]
    for r in found:
        out[r["feature"]].append(r["cut"])
    return tuple(tuple(sorted(c)) for c in out)


def binned(df: DataFrame, columns: Sequence[Column], model: Boosted, target: Column, weight: Column) -> DataFrame:
    """``bins`` (one byte per feature), ``y``, ``w``, ``raw`` and the number ``n`` of rows that share them."""
    ship_package(df.sparkSession)
    source = df.select(F.array(*[c.cast("double") for c in columns]).alias("x"), target.cast("double").alias("y"), weight.cast("double").alias("w"))
    width, names = len(columns), ["bins", "y", "w", "raw"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            matrix = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            bins = pa.array([row.tobytes() for row in model.bins(matrix)], pa.binary())
            yield pa.RecordBatch.from_arrays([bins, b.column(1), b.column(2), pa.array(np.full(len(matrix), model.baseline))], names=names)

    single = source.mapInArrow(run, "bins binary, y double, w double, raw double")
    return single.groupBy("bins", "y", "w").agg(F.any_value("raw").alias("raw"), F.count(F.lit(1)).alias("n"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def packed(rows: DataFrame) -> DataFrame:
    """The columns of :func:`binned` as byte strings, one row per block of at most ``BLOCK_ROWS`` rows."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            bins = b"".join(x for b in held for x in b.column(0).to_pylist())
            others = [np.concatenate([b.column(i).to_numpy() for b in held]).tobytes() for i in range(1, len(names))]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (bins, *others)], names=names)

        held, size = [], 0
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK_ROWS):
                b = whole.slice(start, BLOCK_ROWS)
                if size + b.num_rows > BLOCK_ROWS:
                    yield block(held)
                    held, size = [], 0
                held.append(b)
                size += b.num_rows
        if held:
            yield block(held)

    return rows.mapInArrow(run, ", ".join(f"{c} binary" for c in names))


def _advanced(blocks: DataFrame, trees: Sequence[Tree], width: int) -> DataFrame:
    """``blocks`` with the values of ``trees`` added to ``raw``."""
    names = blocks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = [_raw(bins, raw, trees, width).tobytes() for bins, raw in zip(b.column(0).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(raws, pa.binary()), b.column(4)], names=names)

    return blocks.mapInArrow(run, blocks.schema)


def _raw(bins: bytes, raw: bytes, trees: Sequence[Tree], width: int) -> np.ndarray:
    matrix, out = np.frombuffer(bins, dtype=np.uint8).reshape(-1, width), np.frombuffer(raw).copy()
    for tree in trees:
        out += leaf_values(tree, matrix)
    return out


def _parts(y: np.ndarray, w: np.ndarray, raw: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Count, gradient and hessian of counted rows, the latter two in parts of ``SCALE``."""
    p = 1.0 / (1.0 + np.exp(-raw))
    # A count times a gradient passes 53 bits: sums are of integers.
    return n, *(n * np.rint(x * SCALE).astype(np.int64) for x in (w * (p - y), w * p * (1.0 - p)))


class _Cells:
    """Sums of one task by count, gradient or hessian, feature, node and bin."""

    def __init__(self, grown: Tree, nodes: Sequence[int], width: int):
        self.grown, self.slots, self.sums = grown, np.full(len(grown), -1), np.zeros((3, width, len(nodes), 256), dtype=np.int64)
        self.slots[list(nodes)] = np.arange(len(nodes))

    def add(self, bins: np.ndarray, parts: Sequence[np.ndarray]) -> None:
        own = self.slots[node_of(self.grown, bins)]
        inside = own >= 0
        if not inside.all():
            own, bins, parts = own[inside], bins[inside], [x[inside] for x in parts]
        for f in range(bins.shape[1]):
            cell = own * 256 + bins[:, f]
            for k, part in enumerate(parts):
                np.add.at(self.sums[k, f].reshape(-1), cell, part)


def histogram(rows: DataFrame, trees: Sequence[Tree], grown: Tree, nodes: Sequence[int], width: int) -> DataFrame:
    """``node, feature, bin, n, g, h`` of the ``nodes`` of the tree ``grown``; gradients after ``trees``, in parts of ``SCALE``."""
    ship_package(rows.sparkSession)
    schema = "node int, feature int, bin int, n bigint, g bigint, h bigint"
    names = ["node", "feature", "bin", "n", "g", "h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = _Cells(grown, nodes, width)
        for b in batches:
            bins, (y, w, raw, n) = _matrix(b.column(0), width), (b.column(i).to_numpy() for i in (1, 2, 3, 4))
            raw = raw + sum((leaf_values(t, bins) for t in trees), np.zeros(len(raw)))
            cells.add(bins, _parts(y, w, raw, n))
        f, i, c = np.nonzero(cells.sums[0])
        columns = [np.array(nodes)[i].astype(np.int32), f.astype(np.int32), c.astype(np.int32), *(s[f, i, c] for s in cells.sums)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    partial = rows.mapInArrow(run, schema)
    return partial.groupBy("node", "feature", "bin").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(25,0)")).alias(c) for c in ("g", "h")])


def gradients(blocks: DataFrame, trees: Sequence[Tree], width: int) -> RDD:
    """``bins`` and :func:`_parts` of each block after ``trees``."""
    ship_package(blocks.sparkSession)

    def run(block) -> tuple:
        raw = _raw(block["bins"], block["raw"], trees, width)
        y, w, n = np.frombuffer(block["y"]), np.frombuffer(block["w"]), np.frombuffer(block["n"], dtype=np.int64)
        return np.frombuffer(block["bins"], dtype=np.uint8).reshape(-1, width), _parts(y, w, raw, n)

    return blocks.rdd.map(run)


def level_sums(blocks: RDD, grown: Tree, nodes: Sequence[int], width: int) -> dict[int, tuple[np.ndarray, ...]]:
    """What :func:`histogram` finds, from :func:`gradients`: count, gradient and hessian by node, each by feature and bin."""

    def run(own: Iterator[tuple]) -> Iterator[np.ndarray]:
        cells = _Cells(grown, nodes, width)
        for bins, parts in own:
            cells.add(bins, parts)
        # Sums of many tasks pass 63 bits: whole numbers and parts of SCALE are added apart.
        whole, part = cells.sums.copy(), np.zeros_like(cells.sums)
        whole[1:], part[1:] = np.divmod(cells.sums[1:], SCALE)
        yield np.stack([whole, part])

    whole, part = blocks.mapPartitions(run).treeReduce(np.add, 1 if blocks.getNumPartitions() <= DIRECT_TASKS else 2)
    sums = whole + part / SCALE
    return {node: tuple(x[:, i] for x in sums) for i, node in enumerate(nodes)}


@dataclass(frozen=True)
class Growth:
    """Shape limits and regularisation of the trees."""

    max_iter: int = 150
    learning_rate: float = 0.05
    max_depth: int = 3
    max_leaf_nodes: int = 7
    min_samples_leaf: int = 20
    l2: float = 1.0

    def __post_init__(self) -> None:
        if not 1 <= self.max_depth <= 3 or not 2 <= self.max_leaf_nodes <= 15:
            raise ValueError("trees have 1 to 3 levels and 2 to 15 leaves")
        if self.max_iter < 1 or not 0 < self.learning_rate < float("inf") or not 0 <= self.l2 < float("inf") or self.min_samples_leaf < 1:
            raise ValueError("max_iter, learning_rate, l2 and min_samples_leaf must be positive and finite")

    def power(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """How much a node lowers the loss."""
        return g * g / (h + self.l2)

    def best_split(self, n: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, int] | None:
        """(gain, feature, cut) of histograms by feature and bin."""
        nl, gl, hl = (np.cumsum(a, axis=1) for a in (n, g, h))
        n_all, g_all, h_all = (a[:, -1:] for a in (nl, gl, hl))
        right = n_all - nl, g_all - gl, h_all - hl
        fits = (nl >= self.min_samples_leaf) & (right[0] >= self.min_samples_leaf) & (hl >= MIN_HESSIAN) & (right[2] >= MIN_HESSIAN)
        if not fits.any():
            return None
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = self.power(gl, hl) + self.power(right[1], right[2]) - self.power(g_all, h_all)
        gain = np.where(fits, gain, -np.inf)
        feature, cut = np.unravel_index(int(np.argmax(gain)), gain.shape)
        return (float(gain[feature, cut]), int(feature), int(cut)) if gain[feature, cut] > 0 else None


def split_gains(hist: DataFrame, growth: Growth = Growth()) -> DataFrame:
    """``node, feature, bin, n_left, gain`` of every split of a :func:`histogram` that the limits allow, as a table."""
    to = Window.partitionBy("node", "feature").orderBy("bin")
    whole = Window.partitionBy("node", "feature")
    cells = hist.select("node", "feature", "bin", "n", *[(F.col(c).cast("double") / SCALE).alias(c) for c in ("g", "h")])
    both = cells.select("node", "feature", "bin", *[F.sum(c).over(to).alias(f"{c}_left") for c in "ngh"], *[F.sum(c).over(whole).alias(f"{c}_all") for c in "ngh"])
    both = both.withColumns({f"{c}_right": F.col(f"{c}_all") - F.col(f"{c}_left") for c in "ngh"})
    power = lambda side: F.col(f"g_{side}") * F.col(f"g_{side}") / (F.col(f"h_{side}") + growth.l2)
    fits = (F.least("n_left", "n_right") >= growth.min_samples_leaf) & (F.least("h_left", "h_right") >= MIN_HESSIAN)
    return both.where(fits).select("node", "feature", "bin", "n_left", (power("left") + power("right") - power("all")).alias("gain"))


def _collected(hist: DataFrame, nodes: Sequence[int], width: int) -> dict[int, tuple[np.ndarray, ...]]:
    out = {node: tuple(np.zeros((width, 256)) for _ in range(3)) for node in nodes}
    for r in hist.collect():
        for k, c in enumerate(("n", "g", "h")):
            out[r["node"]][k][r["feature"], r["bin"]] = float(r[c]) / (SCALE if k else 1)
    return out


def grow(blocks: DataFrame, trees: Sequence[Tree], growth: Growth, width: int) -> Tree:
    """The next tree after ``trees``."""
    # Its levels read the same gradients.
    held = gradients(blocks, tuple(trees), width).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _grown(held, growth, width)
    finally:
        held.unpersist()


def _grown(held: RDD, growth: Growth, width: int) -> Tree:
    full: list[Node] = [(-1, 0, 0, 0.0)]
    best: dict[int, tuple[float, int, int]] = {}
    sums: dict[int, tuple[float, float]] = {}
    level = [0]
    for depth in range(growth.max_depth + 1):
        last = depth == growth.max_depth
        if not last:
            found = level_sums(held, tuple(full), level, width)
        following = []
        for node in level:
            if last:
                continue
            n, g, h = found[node]
            sums.setdefault(node, (float(g[0].sum()), float(h[0].sum())))
            split = growth.best_split(n, g, h)
            if split is None:
                continue
            best[node] = split
            _, f, cut = split
            gl, hl = float(g[f, : cut + 1].sum()), float(h[f, : cut + 1].sum())
            left = len(full)
            full[node] = (f, cut, left, 0.0)
            full += [(-1, 0, 0, 0.0)] * 2
            sums[left], sums[left + 1] = (gl, hl), (sums[node][0] - gl, sums[node][1] - hl)
            following += [left, left + 1]
        level = following
        if not level:
            break
    taken, open_, leaves = set(), [], 1
    if 0 in best:
        heapq.heappush(open_, (-best[0][0], 0))
    while open_ and leaves < growth.max_leaf_nodes:
        _, node = heapq.heappop(open_)
        taken.add(node)
        leaves += 1
        for child in (full[node][2], full[node][2] + 1):
            if child in best:
                heapq.heappush(open_, (-best[child][0], child))
    out = []
    for node, (f, cut, left, _) in enumerate(full):
        g, h = sums[node]
        value = -growth.learning_rate * g / (h + growth.l2) if h + growth.l2 > 0 else 0.0
        out.append((f, cut, left, 0.0) if node in taken else (-1, 0, 0, value))
    return tuple(out)


def fit_boosted(
    df: DataFrame, columns: Sequence[Column], target: str, weight: str, growth: Growth = Growth(), max_bins: int = MAX_BINS
) -> Boosted:
    """Boosted trees of ``columns``, which hold no NULLs; ``target`` is 0 or 1."""
    if not 2 <= max_bins <= MAX_BINS:
        raise ValueError("2 to 255 bins")
    y, w = F.col(target).cast("double"), F.col(weight).cast("double")
    sums = df.agg(F.sum(w * y).alias("p"), F.sum(w * (1.0 - y)).alias("q")).first()
    if not sums["p"] or not sums["q"]:
        raise ValueError("boosting needs both classes")
    model = Boosted(bin_thresholds(df, columns, max_bins), float(np.log(sums["p"] / sums["q"])))
    width, trees, pending = len(columns), [], []
    held = Scratch(df.sparkSession)
    try:
        blocks = held(packed(binned(df, columns, model, y, w)))
        for _ in range(growth.max_iter):
            pending.append(grow(blocks, pending, growth, width))
            trees.append(pending[-1])
            if len(pending) == KEEP and len(trees) < growth.max_iter:
                following = Scratch(df.sparkSession)
                blocks = following(_advanced(blocks, pending, width))
                held.close()
                held, pending = following, []
    finally:
        held.close()
    return Boosted(model.thresholds, model.baseline, tuple(trees))


def score_boosted(df: DataFrame, columns: Sequence[Column], model: Boosted, name: str) -> DataFrame:
    """``df`` plus the raw score ``name``, in Arrow batches; other columns pass through as they are."""
    ship_package(df.sparkSession)
    kept = df.drop(name)
    width = len(columns)
    source = kept.select("*", F.array(*[c.cast("double") for c in columns]).alias("__x"))
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            matrix = b.column(b.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            raw = model.raw(model.bins(matrix)) if len(matrix) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(raw)], names=schema.names)

    return source.mapInArrow(run, schema)
