"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic model on a dozen text statistics gives each document a probability.  Sites speak too:
probabilities are summed by path and by host in grouped aggregations, the spread between hosts
(and between the paths of a host) beyond what sampling explains sets how strongly means are shrunk, a host
towards the global mean and a path towards its host.  A document's score combines its own evidence, as
log-odds over the base rate, with the posterior of its path; its own probability is taken out of both sums.

The model is fitted in numpy on at most ``SAMPLE`` labelled documents, the lowest in hash order; all sums and
posteriors cover all documents.

Edge cases.  A NULL text has no words; NULL hosts and paths are sites of their own.  Labels of unknown or
repeated documents are used as they join; NULL labels teach nothing.  With no label of one of the classes every
probability is the share of good labels (one half without any).  Repeated rows count as often as they come.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegate.llm.common import WORD, annotate
from pulsegate.llm.quality import repeated_words
from pulsegate.session import durable

# Bound on the rows that the model is fitted on: 12 doubles each, 5 MB on the driver.
SAMPLE = 50_000
RIDGE = 1.0
THRESHOLD = 0.5
_WORD = re.compile(WORD)
FEATURES = (
    "log_words word_length symbols upper marks digits letters distinct repeated_lines repeated_words line_words plain_words"
).split()


def features(text: str | None) -> list[float]:
    """Statistics of a whole text, in the order of ``FEATURES``."""
    words = _WORD.findall(text) if text else []
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars = sum(map(len, words))
    letters = sum(map(str.isalpha, text))
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    return [
        math.log1p(n),
        min(chars / n, 50.0),
        sum(map(text.count, "#*$%&|<>")) / n,
        sum(map(str.isupper, text)) / max(1, letters),
        (text.count("!") + text.count("?")) / n,
        sum(map(str.isdigit, text)) / chars,
        letters / chars,
        len(set(words)) / n ** 0.9,
        1.0 - len(set(lines)) / len(lines),
        repeated_words(words) / n,
        math.log1p(n / len(lines)),
        sum(map(str.isalpha, words)) / n,
    ]


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # intercept first
    base: float

    def probability(self, x: Column) -> Column:
        """Probability as a column expression over the feature array."""
        z = F.lit(float(self.weights[0]))
        for i, (m, s, w) in enumerate(zip(self.mean, self.scale, self.weights[1:])):
            z = z + (x[i] - F.lit(float(m))) * F.lit(float(w / s))
        return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))


def solve(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> QualityModel:
    """Ridge logistic regression by Newton steps."""
    k = len(FEATURES)
    base = float(y.mean()) if len(y) else 0.5
    if base in (0.0, 1.0) or not len(y):
        shrunk = (y.sum() + 0.5) / (len(y) + 1.0)
        return QualityModel(np.zeros(k), np.ones(k), np.concatenate(([math.log(shrunk / (1 - shrunk))], np.zeros(k))), float(shrunk))
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    design = np.column_stack((np.ones(len(x)), (x - mean) / scale))
    penalty = np.diag([1e-6, *[ridge] * k])
    w = np.zeros(k + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (y - p) - penalty @ w
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + penalty, gradient)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return QualityModel(mean, scale, w, base)


def fit(described: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Model from ``described`` (``doc_id, x``) and ``labels`` (``doc_id, quality``)."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", (F.col("quality") > 0).cast("double").alias("y"))
    rows = described.join(known, "doc_id").select("x", "y", F.xxhash64("doc_id", "x", "y").alias("h"))
    known_rows = rows.count()
    if known_rows > sample:
        # Hashes are uniform: this keeps a fifth more than needed, so that few rows are sorted and sent.
        share = min(1.0, 1.2 * sample / known_rows)
        rows = rows.where(F.col("h") <= F.lit(int(-(1 << 63) + share * ((1 << 64) - (1 << 12)))))
    taken = rows.orderBy("h").limit(sample).select("x", "y").collect()
    x = np.array([r["x"] for r in taken], dtype=float).reshape(len(taken), len(FEATURES))
    return solve(x, np.array([r["y"] for r in taken], dtype=float))


def _precision(excess: float, groups: float, n: float, squares: float) -> float:
    """Prior strength (pseudo-documents) from a moment estimate of the correlation within groups."""
    free = groups - 1
    spread = n - squares / n - free if n else 0.0
    rho = (excess - free) / spread if spread > 0 else 0.0
    rho = min(max(rho, 1e-4), 1 - 1e-4)
    return 1 / rho - 1


def posteriors(scored: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """Path table ``host, path, n, p_sum, host_n, host_sum`` and the global numbers.

    ``scored`` has ``host, path, p``.  The driver gets one row of sums per level.
    """
    paths = durable(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("p_sum")))
    hosts = durable(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("p_sum").alias("host_sum")))
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_sum").alias("s"), F.count(F.lit(1)).alias("g"), F.sum(F.col("host_n") * F.col("host_n").cast("double")).alias("sq")).first()
    n = float(total["n"] or 0)
    mean = min(max((total["s"] or 0.0) / n, 1e-6), 1 - 1e-6) if n else 0.5
    apart = lambda s, n, m: n * (s / n - m) * (s / n - m) / (m * (1 - m))
    excess = hosts.agg(F.sum(apart(F.col("host_sum"), F.col("host_n"), F.lit(mean)))).first()[0] or 0.0
    kappa = _precision(excess, total["g"], n, total["sq"] or 0.0)
    joined = paths.join(hosts.withColumnRenamed("host", "__host"), F.col("host").eqNullSafe(F.col("__host"))).drop("__host")
    prior = (F.col("host_sum") + kappa * mean) / (F.col("host_n") + kappa)
    inner = joined.agg(
        F.sum(apart(F.col("p_sum"), F.col("n"), prior)).alias("e"),
        (F.count(F.lit(1)) - F.lit(total["g"]) + 1).alias("g"),
        F.sum(F.col("n") * F.col("n") / F.col("host_n").cast("double")).alias("share"),
    ).first()
    # Within hosts the free counts add up: sum of (n - sum of n^2 / host_n) over hosts.
    squares = (inner["share"] or 0.0) * n
    return joined, {"mean": mean, "host_kappa": kappa, "path_kappa": _precision(inner["e"] or 0.0, inner["g"] or 0, n, squares)}


def describe(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and the feature array ``x``."""
    return annotate(docs, keep, [F.col(text)], lambda texts: ([features(t) for t in texts],), "x array<double>")


def score(scored: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """Add ``host_post, path_post, score, kept`` to ``scored`` (``host, path, p`` and more)."""
    sites, g = posteriors(scored)
    site = sites.select(F.col("host").alias("__host"), F.col("path").alias("__path"), "n", "p_sum", "host_n", "host_sum")
    joined = scored.join(site, F.col("host").eqNullSafe(F.col("__host")) & F.col("path").eqNullSafe(F.col("__path")), "left")
    clip = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    logit = lambda c: F.log(clip(c) / (1 - clip(c)))
    p = F.col("p")
    host_post = (F.col("host_sum") - p + g["host_kappa"] * g["mean"]) / (F.col("host_n") - 1 + g["host_kappa"])
    out = joined.withColumn("host_post", host_post)
    path_post = (F.col("p_sum") - p + g["path_kappa"] * F.col("host_post")) / (F.col("n") - 1 + g["path_kappa"])
    out = out.withColumn("path_post", path_post)
    odds = logit(p) - math.log(model.base / (1 - model.base)) + logit(F.col("path_post"))
    out = out.withColumn("score", 1 / (1 + F.exp(-odds)))
    kept = F.col("score") >= threshold
    return out.withColumn("kept", kept).select(*scored.columns, "host_post", "path_post", "score", "kept")
