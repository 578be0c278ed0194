"""Leakage-guarded risk model: preparation, fit, calibration, scoring, diagnostics.

A fitted logistic model is a few dozen numbers, so scoring is one JVM expression over the
feature columns: no Python worker and no vector column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegate import columns as C
from pulsegate.functions.ordered import running_totals
from pulsegate.functions.quantiles import exact_quantiles
from pulsegate.functions.scalars import logit, ratio, sigmoid
from pulsegate.operators.boosting import Boosted, Growth, fit_boosted, score_boosted
from pulsegate.operators.metrics import dwell_weights
from pulsegate.schema import FORBIDDEN_FEATURE_PATTERN, FORBIDDEN_FEATURES, KPI_FEATURES
from pulsegate.session import Scratch
from pulsegate.sources.tables import read_json, write_json

FORMAT_VERSION = 1
WEIGHT = "__weight"
TARGET = "__target"
# Training rows per task of a tree ensemble.
TREE_ROWS = 100_000


class FeatureError(ValueError):
    """A feature could carry identity, time or target information."""


class LeakageError(ValueError):
    """Two stages would share a partition."""


def check_features(columns: Sequence[str], features: Sequence[str], universe: Sequence[str] = KPI_FEATURES) -> tuple:
    """Allowlist firewall: features must be allowed, present, unique and safely named."""
    features = tuple(features)
    unsafe = [
        f
        for f in features
        if f in FORBIDDEN_FEATURES or f.startswith("_") or FORBIDDEN_FEATURE_PATTERN.search(f)
    ]
    problems = {
        "empty": not features,
        "repeated": len(set(features)) != len(features),
        "not allowed": sorted(set(features) - set(universe)),
        "missing": sorted(set(features) - set(columns)),
        "unsafe": unsafe,
    }
    found = {k: v for k, v in problems.items() if v}
    if found:
        raise FeatureError(f"feature list rejected: {found}")
    return features


@dataclass(frozen=True)
class Preprocessor:
    """Median imputation and standardisation fitted on one partition."""

    features: tuple[str, ...]
    medians: tuple[float, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    partition: str
    rows: int

    def columns(self) -> list[Column]:
        bad = F.raise_error(F.lit("feature is infinite")).cast("double")
        out = []
        for name, median, mean, scale in zip(self.features, self.medians, self.means, self.scales):
            x = F.col(name).cast("double")
            x = F.when(F.abs(x) == F.lit(float("inf")), bad).when(x.isNull() | F.isnan(x), F.lit(median)).otherwise(x)
            out.append((x - F.lit(mean)) / F.lit(scale))
        return out


def fit_preprocessor(df: DataFrame, features: Sequence[str], partition: str) -> Preprocessor:
    """Exact medians, then mean and population deviation of the imputed columns."""
    pairs = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("double").alias("x")) for f in features])
    long = df.select(F.inline(pairs)).where(F.col("x").isNotNull() & ~F.isnan("x"))
    found = {r["f"]: r["q"][0] for r in exact_quantiles(long, ["f"], "x", [0.5]).collect()}
    medians = [float(found.get(f, 0.0)) for f in features]
    raw = Preprocessor(tuple(features), tuple(medians), (0.0,) * len(features), (1.0,) * len(features), partition, 0)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, x in enumerate(raw.columns()):
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    k = range(len(features))
    means = tuple(row[f"m{i}"] for i in k)
    return replace(raw, means=means, scales=tuple(row[f"s{i}"] or 1.0 for i in k), rows=row["n"])


def compose_weights(
    df: DataFrame,
    target: str = C.IS_ATTACK,
    sample_weight: str | None = None,
    dwell: bool = False,
    balance_classes: bool = False,
    max_gap: float | None = None,
    min_interval: float = 0.0,
    name: str = WEIGHT,
) -> DataFrame:
    """Caller weight x dwell time x class balance, scaled to mean one."""
    out, w = df, F.lit(1.0)
    if sample_weight:
        bad = F.raise_error(F.lit("sample weights must be non-negative")).cast("double")
        w = F.when(F.col(sample_weight) >= 0, F.col(sample_weight).cast("double")).otherwise(bad)
    if dwell:
        out = dwell_weights(out, max_gap=max_gap, min_interval=min_interval, name="__dwell")
        w = w * F.col("__dwell")
    out = out.withColumn("__w", w)
    positive = F.col(target).cast("boolean")
    sums = out.agg(
        F.sum("__w").alias("all"),
        F.sum(F.when(positive, F.col("__w"))).alias("pos"),
        F.sum(F.when(~positive, F.col("__w"))).alias("neg"),
        F.count(F.lit(1)).alias("n"),
    ).first()
    if not sums["all"]:
        raise ValueError("weights need positive mass")
    scale = F.lit(sums["n"] / sums["all"])
    if balance_classes:
        if not sums["pos"] or not sums["neg"]:
            raise ValueError("class balancing needs both classes")
        half = sums["n"] / 2.0
        scale = F.when(positive, F.lit(half / sums["pos"])).otherwise(F.lit(half / sums["neg"]))
    return out.withColumn(name, F.col("__w") * scale).drop("__w", "__dwell")


@dataclass(frozen=True)
class RiskModel:
    """Everything a score needs, as plain numbers (logistic) or a stored pipeline (trees)."""

    kind: str
    preprocessor: Preprocessor
    training_partition: str
    coefficients: tuple[float, ...] = ()
    intercept: float = 0.0
    seed: int = 1729
    calibration: tuple[float, float] | None = None
    calibration_partition: str | None = None
    tuning_partition: str | None = None
    format_version: int = FORMAT_VERSION
    trees: Any = field(default=None, compare=False, repr=False)
    boosted: Boosted | None = field(default=None, repr=False)

    def raw_score(self, df: DataFrame, name: str = C.RAW_SCORE) -> DataFrame:
        """Decision value: linear predictor, or the log-odds of the tree ensemble."""
        if self.kind == "logistic":
            terms = zip(self.coefficients, self.preprocessor.columns())
            return df.withColumn(name, sum((F.lit(c) * x for c, x in terms), F.lit(self.intercept)))
        if self.boosted is not None:
            return score_boosted(df, self.preprocessor.columns(), self.boosted, name)
        scored = self.trees.transform(_assemble(df, self.preprocessor))
        p = vector_to_array("probability")[1]
        return scored.withColumn(name, logit(p)).drop("__features", "rawPrediction", "probability", "prediction")

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``risk_raw`` and ``risk_score``."""
        if self.calibration is None:
            raise ValueError("calibrate the model before scoring")
        intercept, slope = self.calibration
        raw = self.raw_score(df)
        return raw.withColumn(C.SCORE, sigmoid(F.lit(intercept) + F.lit(slope) * F.col(C.RAW_SCORE)))

    def with_tuning_partition(self, partition: str) -> RiskModel:
        if partition in (self.training_partition, self.calibration_partition):
            raise LeakageError("controllers cannot be tuned on a partition the model was fitted on")
        return replace(self, tuning_partition=partition)


def _assemble(df: DataFrame, prep: Preprocessor) -> DataFrame:
    names = [f"__f{i}" for i in range(len(prep.features))]
    wide = df.withColumns(dict(zip(names, prep.columns())))
    return VectorAssembler(inputCols=names, outputCol="__features").transform(wide).drop(*names)


def fit_risk_model(
    df: DataFrame,
    features: Sequence[str],
    partition: str = "train",
    universe: Sequence[str] = KPI_FEATURES,
    kind: str = "logistic",
    target: str = C.IS_ATTACK,
    regularization_c: float = 1.0,
    seed: int = 1729,
    max_depth: int = 3,
    learning_rate: float = 0.05,
    max_iter: int = 150,
    **weights: Any,
) -> RiskModel:
    """Fit on the rows of one partition only.

    The L2 objective is ``C * sum(w * loss) + |b|^2 / 2`` with weights summing to the row
    count, hence ``regParam = 1 / (C * n)`` and no internal standardisation.
    """
    features = check_features(df.columns, features, universe)
    rows = df.where(F.col(C.SPLIT) == partition) if C.SPLIT in df.columns else df
    # Medians, moments, weights and the optimiser each read the training rows.
    rows = rows.persist()
    try:
        return _fit(rows, features, partition, kind, target, regularization_c, seed, max_depth, learning_rate, max_iter, weights)
    finally:
        rows.unpersist()


def _fit(
    rows: DataFrame,
    features: Sequence[str],
    partition: str,
    kind: str,
    target: str,
    regularization_c: float,
    seed: int,
    max_depth: int,
    learning_rate: float,
    max_iter: int,
    weights: dict[str, Any],
) -> RiskModel:
    prep = fit_preprocessor(rows, features, partition)
    weighted = compose_weights(rows, target, **weights)
    if kind == "hist_gradient_boosting":
        growth = Growth(max_iter=max_iter, learning_rate=learning_rate, max_depth=max_depth)
        boosted = fit_boosted(weighted.withColumn(TARGET, F.col(target).cast("double")), prep.columns(), TARGET, WEIGHT, growth)
        return RiskModel(kind, prep, partition, seed=seed, boosted=boosted)
    training = _assemble(weighted, prep).select(
        "__features", F.col(target).cast("double").alias(TARGET), F.col(WEIGHT)
    )
    common = {"featuresCol": "__features", "labelCol": TARGET, "weightCol": WEIGHT}
    if kind == "logistic":
        fit = LogisticRegression(
            regParam=1.0 / (regularization_c * prep.rows),
            elasticNetParam=0.0,
            standardization=False,
            tol=1e-8,
            maxIter=2000,
            **common,
        ).fit(training)
        return RiskModel(kind, prep, partition, tuple(map(float, fit.coefficients)), float(fit.intercept), seed)
    if kind != "gradient_boosted_trees":
        raise ValueError(f"unknown model kind: {kind}")
    with Scratch(rows.sparkSession) as write:
        held = write(_sized(weighted, prep, target))
        names = [f"__f{i}" for i in range(len(prep.features))]
        training = VectorAssembler(inputCols=names, outputCol="__features").transform(held).select("__features", TARGET, WEIGHT)
        trees = GBTClassifier(maxDepth=max_depth, maxIter=max_iter, stepSize=learning_rate, seed=seed, **common).fit(training)
    return RiskModel(kind, prep, partition, seed=seed, trees=trees)


def _sized(weighted: DataFrame, prep: Preprocessor, target: str) -> DataFrame:
    """Narrow training rows in partitions of ``TREE_ROWS``: an ensemble runs some jobs per tree, each with a task per partition."""
    columns = [c.alias(f"__f{i}") for i, c in enumerate(prep.columns())]
    narrow = weighted.select(*columns, F.col(target).cast("double").alias(TARGET), WEIGHT)
    return narrow.repartition(max(1, -(-prep.rows // TREE_ROWS)))


def fit_platt(
    model: RiskModel, df: DataFrame, partition: str = "calibration", target: str = C.IS_ATTACK, **weights: Any
) -> RiskModel:
    """One-dimensional logistic calibration on a partition the model has not seen."""
    if partition == model.training_partition or partition == model.tuning_partition:
        raise LeakageError("calibration needs a partition of its own")
    rows = df.where(F.col(C.SPLIT) == partition) if C.SPLIT in df.columns else df
    raw = compose_weights(model.raw_score(rows), target, **weights)
    table = VectorAssembler(inputCols=[C.RAW_SCORE], outputCol="__features").transform(raw)
    table = table.select("__features", F.col(target).cast("double").alias(TARGET), F.col(WEIGHT)).persist()
    n = table.count()
    fit = LogisticRegression(
        featuresCol="__features",
        labelCol=TARGET,
        weightCol=WEIGHT,
        regParam=1.0 / (1e6 * n),
        standardization=False,
        tol=1e-8,
        maxIter=2000,
    ).fit(table)
    table.unpersist()
    found = (float(fit.intercept), float(fit.coefficients[0]))
    return replace(model, calibration=found, calibration_partition=partition)


def score_frame(model: RiskModel, df: DataFrame, passthrough: Sequence[str] = ()) -> DataFrame:
    return model.score(df).select(*passthrough, C.RAW_SCORE, C.SCORE)


def save_model(model: RiskModel, path: str) -> str:
    """JSON record; tree ensembles are stored next to it by Spark ML."""
    if model.trees is not None:
        PipelineModel([model.trees]).write().overwrite().save(f"{path}.trees")
    return write_json(path, {k: v for k, v in asdict(replace(model, trees=None)).items() if k != "trees"})


def load_model(spark: SparkSession, path: str, universe: Sequence[str] = KPI_FEATURES) -> RiskModel:
    raw = read_json(path)
    if raw.get("format_version") != FORMAT_VERSION:
        raise ValueError(f"unsupported model format: {raw.get('format_version')}")
    prep = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.pop("preprocessor").items()}
    check_features(prep["features"], prep["features"], universe)
    boosted = raw.pop("boosted", None)
    fields = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()}
    model = RiskModel(preprocessor=Preprocessor(**prep), **fields)
    if boosted:
        trees = tuple(tuple(tuple(n) for n in t) for t in boosted["trees"])
        return replace(model, boosted=Boosted(tuple(map(tuple, boosted["thresholds"])), boosted["baseline"], trees))
    if model.kind == "logistic":
        return model
    return replace(model, trees=PipelineModel.load(f"{path}.trees").stages[0])


def risk_diagnostics(
    df: DataFrame,
    keys: Sequence[str] = (),
    target: str = C.IS_ATTACK,
    score: str = C.SCORE,
    weight: str | None = None,
) -> DataFrame:
    """Rows, prevalence, Brier, AUROC and average precision per stratum.

    Scores are reduced to class mass per distinct score; the running masses from the top
    come from the range-partitioned scan, so ties and heavy strata are exact and spread.
    AUROC and average precision are NULL when a class is missing.
    """
    keys = list(keys) or ["__all"]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    y = F.col(target).cast("double")
    rows = df.withColumn("__all", F.lit(0)) if keys == ["__all"] else df
    mass = rows.groupBy(*keys, F.col(score).alias("__x")).agg(
        F.count(F.lit(1)).alias("__n"),
        F.sum(w * y).alias("__pos"),
        F.sum(w * (1.0 - y)).alias("__neg"),
        F.sum(w * (F.col(score) - y) * (F.col(score) - y)).alias("__sq"),
    )
    sums = {"__cp": F.col("__pos"), "__cn": F.col("__neg")}
    ranked = running_totals(mass, keys, [F.desc("__x")], sums)
    above = F.col("__cp") - F.col("__pos") / 2.0
    precision = F.col("__cp") / (F.col("__cp") + F.col("__cn"))
    out = ranked.groupBy(*keys).agg(
        F.sum("__n").alias("rows"),
        F.sum("__pos").alias("__p"),
        F.sum("__neg").alias("__q"),
        F.sum("__sq").alias("__s"),
        F.sum(F.col("__neg") * above).alias("__area"),
        F.sum(F.col("__pos") * precision).alias("__ap"),
    )
    both = (F.col("__p") > 0) & (F.col("__q") > 0)
    out = out.withColumns(
        {
            "prevalence": ratio("__p", F.col("__p") + F.col("__q")),
            "brier": ratio("__s", F.col("__p") + F.col("__q")),
            "auroc": F.when(both, F.col("__area") / (F.col("__p") * F.col("__q"))),
            "average_precision": F.when(both, F.col("__ap") / F.col("__p")),
        }
    ).drop("__p", "__q", "__s", "__area", "__ap")
    return out.drop("__all") if keys == ["__all"] else out
