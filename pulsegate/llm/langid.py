"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training is one grouped sum: every task counts the n-gram buckets of its rows by language
and emits its non-zero counts.  The log-probability matrix has ``buckets x languages``
cells, whatever the corpus; it is broadcast and texts are scored in numpy from their
sparse bucket counts.

Edge cases.  Rows with a NULL language teach nothing; a NULL text counts only towards the
prior of its language.  A text that is NULL or has no letter is ``und`` with score 0, and
so is everything when nothing was learned.  Ties go to the language that sorts first.
Texts are read whole, in blocks of ``BLOCK`` characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegate.llm.common import annotate
from pulsegate.session import ship_package

ORDERS = (1, 2, 3)
BUCKETS = 1 << 14
BLOCK = 1 << 20
UNKNOWN = "und"
# Broadcast bound: 16,384 buckets x 512 languages x 4 bytes = 32 MB.
MAX_LANGUAGES = 512
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    log_prior: np.ndarray
    log_likelihood: np.ndarray  # buckets x languages


def bucket_counts(text: str, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """Occurrences of each n-gram bucket in the lower-cased text."""
    counts = np.zeros(buckets, dtype=np.int64)
    lowered, reach = text.lower(), max(orders) - 1
    for start in range(0, len(lowered), BLOCK):
        part = lowered[start : start + BLOCK + reach].encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(part, dtype="<u4").astype(np.uint64)
        gram = np.zeros(len(codes), dtype=np.uint64)
        for n in range(1, max(orders) + 1):
            if len(codes) < n:
                break
            gram = gram[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(n)
            if n in orders:
                own = gram[:BLOCK] * _MULTIPLIER >> np.uint64(40)
                counts += np.bincount((own % np.uint64(buckets)).astype(np.int64), minlength=buckets)
    return counts


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS, smoothing: float = 0.5):
    """Learn from all rows with a language; returns a :class:`LanguageModel`."""
    source = rows.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    ship_package(rows.sparkSession)
    if source.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages, for which the broadcast matrix is sized")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, name in zip(batch["text"], batch["lang"]):
                own = seen.setdefault(name, np.zeros(buckets + 1, dtype=np.int64))
                own[buckets] += 1  # the last cell counts documents
                if t:
                    own[:buckets] += bucket_counts(t, buckets)
        for name, own in seen.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"lang": name, "bucket": at, "n": own[at]})

    sums = source.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.toPandas()  # at most (buckets + 1) x languages rows
    documents = found[found["bucket"] == buckets].set_index("lang")["n"]
    languages = tuple(sorted(documents.index))
    if not languages:
        return LanguageModel((), np.zeros(0), np.zeros((buckets, 0), dtype=np.float32))
    counts = np.zeros((buckets, len(languages)))
    grams = found[found["bucket"] < buckets]
    counts[grams["bucket"].to_numpy(), np.searchsorted(languages, grams["lang"])] = grams["n"]
    smooth = counts + smoothing
    prior = documents.loc[list(languages)].to_numpy(dtype=float)
    return LanguageModel(
        languages, np.log(prior / prior.sum()), (np.log(smooth) - np.log(smooth.sum(axis=0))).astype(np.float32)
    )


def classify(model: LanguageModel, text: str | None) -> tuple[str, float]:
    """Language and posterior probability of one text."""
    if not text or not model.languages or not has_letter(text):
        return UNKNOWN, 0.0
    counts = bucket_counts(text, len(model.log_likelihood))
    at = np.flatnonzero(counts)
    total = model.log_prior + counts[at].astype(float) @ model.log_likelihood[at].astype(float)
    best = int(total.argmax())
    return model.languages[best], float(1.0 / np.exp(total - total[best]).sum())


def predict(docs: DataFrame, model: LanguageModel, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns of ``docs`` plus ``lang_pred`` and ``score``; these win over clashing names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str | None]):
        answers = [classify(shared.value, t) for t in texts]
        return [a[0] for a in answers], [a[1] for a in answers]

    return annotate(docs, keep, [F.col(text)], run, "lang_pred string, score double")


def accepted(model, docs: DataFrame, text: str = "text", least: float = 0.5):
    """Condition that holds for rows whose language is known with a posterior of ``least``."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def sure(texts: pd.Series) -> pd.Series:
        answers = (classify(shared.value, t) for t in texts)
        return pd.Series([name != UNKNOWN and score >= least for name, score in answers], dtype=bool)

    return sure(F.col(text))


def held_out(doc_id: str = "doc_id"):
    """Fixed by the contract: crc32 of the id as text leaves 2 modulo 4; a NULL id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
