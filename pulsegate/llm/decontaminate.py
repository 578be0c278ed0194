"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

A window is ``SIZE`` consecutive words of one benchmark item; a shorter item is one window.
Windows travel as tuples of word numbers: words that no benchmark item uses are 0 and break
a run, so most of a training text is passed over without hashing.  Rolling hashes of the rest
are looked up in the sorted hash set, and every hit is verified word by word.

The hash set is broadcast only while its windows number at most ``BROADCAST_WINDOWS``.  A
larger benchmark is cut into blocks under that bound, every block is scanned against all
documents, and the hits of a document are united: nothing is left out.

Edge cases.  NULL or wordless texts have no words and no hits; NULL or wordless items and
an empty benchmark have no windows.  Items with equal windows are all reported; a repeated
item_id is reported once; a NULL item_id marks words but is not listed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegate.llm.common import annotate, raw
from pulsegate.session import durable

SIZE = 10
# About 100 bytes a window in a worker: 2,000,000 windows stay near 200 MB.
BROADCAST_WINDOWS = 2_000_000
SPANS = "array<struct<start:bigint,end:bigint>>"
_BASE = np.uint64(0x9E3779B97F4A7C15)

# Fixed by the contract: A-Z become a-z; digits, letters and bytes of non-ASCII characters
# are word bytes; every other byte separates.
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
_SQL_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal_words(data: bytes | None) -> list[bytes]:
    return data.translate(_TABLE).split() if data else []


def _rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of every window of ``size`` word numbers."""
    out = np.zeros(len(ids) - size + 1, dtype=np.uint64)
    for i in range(size):
        out = out * _BASE + ids[i : i + len(out)]
    return out


@dataclass(frozen=True)
class HashSet:
    """Windows of benchmark items by length: sorted hashes, exact windows and their items."""

    vocabulary: dict[bytes, int]
    hashes: dict[int, np.ndarray]
    items: dict[tuple[int, ...], list]


def build(items: list[tuple], size: int = SIZE) -> HashSet:
    """Hash set of ``(item_id, text bytes)`` rows."""
    vocabulary: dict[bytes, int] = {}
    windows: dict[tuple[int, ...], set] = {}
    for item, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in normal_words(text)]
        length = min(size, len(ids))
        for i in range(len(ids) - length + 1 if ids else 0):
            windows.setdefault(tuple(ids[i : i + length]), set()).add(item)
    by_length: dict[int, list] = {}
    for w in windows:
        by_length.setdefault(len(w), []).append(_rolling(np.array(w, dtype=np.uint64), len(w))[0])
    hashes = {n: np.unique(np.array(h, dtype=np.uint64)) for n, h in by_length.items()}
    return HashSet(vocabulary, hashes, {w: [i for i in own if i is not None] for w, own in windows.items()})


def scan(words: list[bytes], known: HashSet) -> tuple[np.ndarray, set]:
    """Word positions inside benchmark windows, as a mask, and the items that occur."""
    hit, found = np.zeros(len(words), dtype=bool), set()
    if not words or not known.hashes:
        return hit, found
    get = known.vocabulary.get
    ids = np.fromiter((get(w, 0) for w in words), dtype=np.uint64, count=len(words))
    gaps = np.concatenate(([0], np.cumsum(ids == 0)))
    for size, hashes in known.hashes.items():
        if len(ids) < size:
            continue
        starts = np.flatnonzero(gaps[size:] == gaps[:-size])
        if not len(starts):
            continue
        rolled = _rolling(ids, size)[starts]
        at = np.searchsorted(hashes, rolled)
        starts = starts[hashes[np.minimum(at, len(hashes) - 1)] == rolled]
        for s in starts.tolist():
            own = known.items.get(tuple(ids[s : s + size].tolist()))
            if own is not None:
                hit[s : s + size] = True
                found.update(own)
    return hit, found


def spans_of(hit: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of true cells as (start, end)."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _blocks(benchmark: DataFrame, size: int, bound: int):
    """Hash sets of at most about ``bound`` windows each, together all of the benchmark."""
    rows = benchmark.select("item_id", raw().alias("text"))
    # Every word starts one window at most, so words bound the windows of an item.
    n = F.size(F.regexp_extract_all(F.lower("text"), F.lit(_SQL_WORD), 0))
    total = benchmark.select(F.sum(F.when(F.col("text").isNotNull(), n))).first()[0] or 0
    blocks = max(1, -(-total // bound))
    for b in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else rows
        yield build([(r["item_id"], r["text"]) for r in own.toLocalIterator()], size)


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str],
    size: int = SIZE,
    bound: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """``keep`` columns plus ``n_words``, ``hits`` (word spans, end exclusive) and ``items``.

    One row per document.  With several blocks documents are told apart by ``keep`` and
    their text, and repeated rows are given back as often as they came.
    """
    context = docs.sparkSession.sparkContext
    parts = []
    for known in _blocks(benchmark, size, bound):
        shared = context.broadcast(known)

        def run(texts: list[bytes | None], shared=shared):
            n_words, hits, items = [], [], []
            for t in texts:
                words = normal_words(t)
                hit, found = scan(words, shared.value)
                n_words.append(len(words))
                hits.append([{"start": a, "end": b} for a, b in spans_of(hit)])
                items.append(sorted(map(str, found)))
            return n_words, hits, items

        new = f"n_words bigint, hits {SPANS}, items array<string>"
        parts.append(annotate(docs.withColumn("__content", F.sha2("text", 256)), [*keep, "__content"], [raw()], run, new))
    if len(parts) == 1:
        return parts[0].drop("__content")
    stacked = parts[0].withColumn("__block", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        stacked = stacked.unionByName(p.withColumn("__block", F.lit(i)))
    kept = [c for c in parts[0].columns if c not in ("n_words", "hits", "items")]
    united = stacked.groupBy(*kept).agg(
        F.first("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_set("hits"))).alias("hits"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
        F.sum((F.col("__block") == 0).cast("int")).alias("__copies"),
    )
    longer = lambda a, b: F.struct(a["start"], F.greatest(a["end"], b["end"]))
    # Spans of different blocks may overlap: unite them in order of their start.
    merged = F.aggregate(
        F.array_sort("hits"),
        F.array().cast(SPANS),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["start"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer(F.element_at(done, -1), x)).cast(SPANS)),
        ).otherwise(F.concat(done, F.array(x))),
    )
    copies = F.explode(F.sequence(F.lit(1), F.col("__copies")))
    return united.withColumns({"hits": merged, "__copy": copies}).drop("__copies", "__copy", "__content")


def _without(data: bytes, words: list[bytes], spans: list[tuple[int, int]]) -> bytes:
    """``data`` without the passages ``spans`` of its ``words``, each from its first to its last word."""
    table = data.translate(_TABLE)
    begins, at = [], 0
    for w in words:
        at = table.index(w, at)
        begins.append(at)
        at += len(w)
    for a, b in reversed(spans):
        data = data[: begins[a]] + data[begins[b - 1] + len(words[b - 1]) :]
    return data


def cut(data: bytes, known: HashSet) -> tuple[bytes, int, int]:
    """Text without benchmark passages, words at first and words removed.

    A passage is cut from its first to its last word; the text left is scanned again, as a
    cut may join words that make a window.
    """
    first = removed = None
    while True:
        words = normal_words(data)
        first = len(words) if first is None else first
        hit, _ = scan(words, known)
        if not hit.any():
            return data, first, removed or 0
        removed = (removed or 0) + int(hit.sum())
        data = _without(data, words, spans_of(hit))


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = SIZE,
    drop_share: float = 0.5,
    text: str = "text",
    bound: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """``docs`` with benchmark passages cut; documents that lose more than ``drop_share`` of their words go.

    Untouched texts are given back byte for byte; an ``n_chars`` column follows its text.
    """
    blocks = _blocks(benchmark, size, bound)
    known, more = next(blocks), next(blocks, None)
    if more is not None:
        del known, more
        return _clean_by_rounds(docs, benchmark, size, drop_share, text, bound)
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(texts: list[bytes | None]):
        cleaned, lost = [], []
        for t in texts:
            left, n, gone = (t, 0, 0) if t is None else cut(t, shared.value)
            cleaned.append(None if left is None else left.decode("utf-8", "replace"))
            lost.append(gone / n if n else 0.0)
        return cleaned, lost

    rest = [c for c in docs.columns if c != text]
    out = annotate(docs, rest, [raw(text)], run, f"`{text}` string, __lost double")
    return _kept(out, docs, drop_share, text)


def _kept(out: DataFrame, docs: DataFrame, drop_share: float, text: str) -> DataFrame:
    """Columns of ``docs`` of the rows whose share ``__lost`` is within ``drop_share``."""
    out = out.where(F.col("__lost") <= drop_share)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__lost") > 0, F.length(text)).otherwise(F.col("n_chars")).cast(kind))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def _clean_by_rounds(docs: DataFrame, benchmark: DataFrame, size: int, drop_share: float, text: str, bound: int) -> DataFrame:
    """:func:`clean` with several blocks: hits of all blocks are united before each cut, until no document is hit.

    Documents without a hit leave the rounds; each round removes words from all others.
    """
    new = f"`{text}` string, __first bigint, __gone bigint"
    rest = [c for c in docs.columns if c != text]

    def run(texts: list[bytes | None], spans: list, firsts: list[int | None], gone: list[int]):
        out = [], [], []
        for t, own, first, g in zip(texts, spans, firsts, gone):
            if own:
                words, pairs = normal_words(t), [(s["start"], s["end"]) for s in own]
                first, g = len(words) if first is None else first, g + sum(b - a for a, b in pairs)
                t = _without(t, words, pairs)
            for column, value in zip(out, (None if t is None else t.decode("utf-8", "replace"), first, g)):
                column.append(value)
        return out

    left = docs.withColumns({"__first": F.lit(None).cast("bigint"), "__gone": F.lit(0).cast("bigint")})
    parts = []
    while True:
        keyed = left.withColumn("__key", F.sha2(text, 256))
        texts = keyed.select("__key", F.col(f"`{text}`").alias("text"))
        hits = find_hits(texts, benchmark, ["__key"], size, bound).where(F.size("hits") > 0)
        hits = durable(hits.select("__key", F.col("hits").alias("__hits")).dropDuplicates(["__key"]))
        if hits.isEmpty():
            parts.append(left)
            break
        joined = keyed.join(hits, "__key", "left")
        inputs = [raw(text), F.col("__hits"), F.col("__first"), F.col("__gone")]
        marked = joined.withColumn("__hit", F.col("__hits").isNotNull())
        done = durable(annotate(marked, [*rest, "__hit"], inputs, run, new))
        parts.append(done.where(~F.col("__hit")).drop("__hit"))
        left = done.where("__hit").drop("__hit")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.withColumn("__lost", F.when(F.col("__first") > 0, F.col("__gone") / F.col("__first")).otherwise(0.0))
    return _kept(out, docs, drop_share, text)
