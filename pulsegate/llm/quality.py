"""Quality rules, line first.

Every line is judged by itself: a line that fails the punctuation, navigation, boilerplate or
shouting rule is removed, and a document that loses more than ``MAX_LOSS`` of its words that
way is rejected.  Statistics of the whole text (:func:`statistics`) complete the verdict.

Edge cases.  A NULL text has no words and no lines; an empty text has one line without words.
Lines without a word are neither judged nor lost.  Repeated rows are judged alike.  Texts are
read whole; memory follows the longest text of a batch.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegate.llm.common import WORD, annotate

# Fixed by the contract.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# Line rules (parameters of this operator).
MAX_LOSS = 0.5
SHORT_LINE = 10
TERMINAL = r"""[.!?:;"')\]”’»…。！？][\x20\x09-\x0D]*$"""
SEPARATOR = r"(\||>|»|›|•|·|/|-)"
BOILERPLATE = (
    "all rights reserved|click here|read more|terms of (use|service)|privacy policy|accept (all )?cookies|uses cookies"
    "|enable javascript|javascript is disabled|sign up for|subscribe to our|log ?in to|skip to (main )?content"
    "|back to top|share (this|on)|lorem ipsum"
)

_WORD = re.compile(WORD)
_TERMINAL = re.compile(TERMINAL)  # a line holds no line break, so $ is its very end
_SEPARATORS = frozenset("|>»›•·/-")
_BOILERPLATE = re.compile(BOILERPLATE, re.I | re.A)


def fails(line: str, words: list[str]) -> bool:
    """True if a line with ``words`` is to be removed."""
    n = len(words)
    if n < SHORT_LINE and not _TERMINAL.search(line):
        return True
    if 2 * sum(map(line.count, SYMBOLS)) > n and sum(map(line.count, SYMBOLS)) >= 3:
        return True
    if line.count("!") >= 3 and 2 * line.count("!") > n:
        return True
    separators = sum(w in _SEPARATORS for w in words)
    if separators >= 3 and 3 * separators >= n:
        return True
    return _BOILERPLATE.search(line) is not None and n < 4 * SHORT_LINE


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside ``window``-word windows that occur twice or more; exact, by doubling ranks."""
    if len(words) <= window:
        return 0
    numbers: dict[str, int] = {}
    ranks = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    # A window's rank is made of two overlapping halves of the largest power of two below it.
    size = 1
    while size < window:
        step = min(size, window - size)
        pairs = ranks[:-step] * (ranks.max() + 1) + ranks[step:]
        distinct, ranks = np.unique(pairs, return_inverse=True)
        size += step
        if len(distinct) == len(pairs):
            return 0
    starts = np.flatnonzero(np.bincount(ranks)[ranks] > 1)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def judge(text: str | None) -> tuple:
    """Statistics, the text of the lines kept, and the words they hold."""
    if text is None:
        return 0, 0, 0, 0, 0, 0, None
    words = _WORD.findall(text)
    seen, n_dup, kept_lines, kept_words = set(), 0, [], 0
    for line in text.split("\n"):
        own = _WORD.findall(line)
        if not own:
            continue
        n_dup += line in seen
        seen.add(line)
        if not fails(line, own):
            kept_lines.append(line)
            kept_words += len(own)
    symbols = sum(map(text.count, SYMBOLS))
    return len(words), sum(map(len, words)), symbols, n_dup, repeated_words(words), kept_words, "\n".join(kept_lines)


STATISTICS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "kept_words bigint"
)


def statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, the statistics and ``kept_words``."""

    def run(texts: list[str | None]):
        return (list(zip(*map(judge, texts))) or [()] * 7)[:6]

    return annotate(docs, keep, [F.col(text)], run, STATISTICS)


def verdict(stats: DataFrame, max_loss: float = MAX_LOSS) -> DataFrame:
    """Add ``base_failed`` and ``kept`` to the output of :func:`statistics`."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    lost = F.col("n_words") - F.col("kept_words")
    return stats.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (lost <= F.lit(max_loss) * F.col("n_words"))
    )


def clean(docs: DataFrame, text: str = "text", max_loss: float = MAX_LOSS) -> DataFrame:
    """Documents that pass, with failing lines removed from their text; columns as in ``docs``."""
    rest = [c for c in docs.columns if c != text]

    def run(texts: list[str | None]):
        cleaned, kept = [], []
        for t in texts:
            n, *_, repeats, kept_words, left = judge(t)
            cleaned.append(left)
            failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
            kept.append(not failed and n - kept_words <= max_loss * n)
        return cleaned, kept

    out = annotate(docs, rest, [F.col(text)], run, f"`{text}` string, __kept boolean").where("__kept")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
