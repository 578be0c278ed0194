"""Periodic runs: stretches of words that repeat with a smallest period, and texts without the repeats.

A run of period q is a maximal stretch whose words q apart are identical, of length max(``SHORTEST``,
``TIMES`` * q) or more.  Documents are exploded into overlapping tiles, one set per octave of periods
[p, 2p).  In octave p boundaries lie S = 2p words apart.  A run holds a boundary b with one period before it, and
two Z-functions at b, of the reversed words before it and of the words behind it, give for every q
how far the period reaches to both sides, up to 2S words.  Fragments of at least 2q words have q
as their smallest period or a divisor of it, which is checked (Fine and Wilf), so tiles are solved
independently.  Fragments are shuffled by document and period and stitched where they overlap by q.

Tiles are only solved where a run may be: a boundary needs a block of p words behind it that also starts
p to 2p - 1 words earlier.  Block hashes of all octaves come from doubling; equal hashes only select work,
the Z-functions compare words.  Documents without such a boundary are done in the first scan, so only texts that may
hold runs are shuffled.

Edge cases.  NULL, empty and short texts have no runs; a text may have any length, as tiles bound a
task's work and stitching passes over sorted fragments.  Rows are told apart by doc_id and text: repeated rows are
solved once and all given back; a NULL doc_id is an id.  Columns not kept are ignored; kept columns that clash with new ones
are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegate.llm.common import annotate, raw, split_words
from pulsegate.session import durable, ship_package

# Fixed by the contract.
SHORTEST, TIMES = 6, 4

TILE = 4096
_CELLS, _SCANNED = 1 << 22, 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)

Rewrite = Callable[[list[bytes], int | None], list[bytes]]


def octaves(n: int) -> int:
    """Number of octaves whose least period fits ``TIMES`` times into n words."""
    return max(0, (n // TIMES).bit_length())


def _doubled(blocks: np.ndarray, width: int) -> np.ndarray:
    """Hashes of blocks of 2 * ``width`` words from those of ``width``."""
    left, right = blocks[:-width], blocks[width:]
    mixed = (left * _ODD) ^ (right + (left >> np.uint64(31)))
    return (mixed ^ (mixed >> np.uint64(29))) * _ODD


def boundaries(ids: np.ndarray, longest: int | None = None, strict: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """(octave p, boundaries that may lie in a run) of a sequence of word ids; ``longest`` bounds a run's length.

    Boundaries lie 2p words apart and need equal blocks of p words; with ``strict`` they lie p apart and need blocks of 2p
    (of 4 for p = 1), which every run gives too: 3q - p + 1 of its words or more, and 5 of 6, lie behind its first boundary.
    """
    blocks, n = ids.astype(np.uint64), len(ids)
    for o in range(octaves(min(n, longest or n))):
        p = 1 << o
        if o:
            if len(blocks) <= p // 2:
                return
            blocks = _doubled(blocks, p // 2)
        own, width = blocks, p
        while strict and width < max(2 * p, 4) and len(own) > width:
            own, width = _doubled(own, width), 2 * width
        step = p if strict else 2 * p
        at = np.arange(2 * p, len(own), step)
        found = []
        rows = max(1, _CELLS // p)
        for k in range(0, len(at), rows):
            some = at[k : k + rows]
            earlier = own[some[:, None] - np.arange(p, 2 * p)[None, :]]
            found.append(some[(earlier == own[some][:, None]).any(axis=1)])
        yield o, np.concatenate(found) if found else at


def z_function(x: Sequence[int]) -> list[int]:
    """Length of the common prefix of x and each of its suffixes; the whole length at 0."""
    n = len(x)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


@lru_cache(1 << 16)
def _divided(q: int) -> tuple[int, ...]:
    """q divided by each of its primes."""
    out, rest, d = [], q, 2
    while rest > 1:
        if d * d > rest:
            d = rest
        if rest % d == 0:
            out.append(q // d)
            while rest % d == 0:
                rest //= d
        d += 1
    return tuple(out)


def solve(x: list[int], o: int, at: Iterable[int]) -> list[tuple[int, int, int]]:
    """Fragments (period, start, end) of octave ``o`` around the boundaries ``at`` of the words ``x``, stitched.

    A fragment cut off at the reach of its boundary counts from 2 periods on, one that ends by itself from ``TIMES``.
    """
    p = 1 << o
    reach = 4 * p
    found: dict[int, list[tuple[int, int]]] = {}
    for b in at:
        low, high = max(0, b - reach), min(len(x), b + reach)
        near = max(0, b - 2 * p)
        back = z_function(x[low:b][::-1])
        ahead = z_function([*x[b:high], -1, *x[near:high]])
        base = high + 1 - near

        def extent(q: int) -> tuple[int, int]:
            return b - q - (back[q] if q < len(back) else 0), b + ahead[base - q]

        for q in range(p, min(2 * p, b - low + 1)):
            start, end = extent(q)
            cut = (start == low and low > 0) or (end == high and high < len(x))
            if end - start < (2 if cut else TIMES) * q:
                continue
            own = found.get(q)
            if own and start + q <= own[-1][1]:
                own[-1] = (min(start, own[-1][0]), max(end, own[-1][1]))
                continue
            # The same stretch with a divisor of q as its period is a run of that period.
            shorter = map(extent, _divided(q))
            if not any(s <= start and end <= e for s, e in shorter):
                found.setdefault(q, []).append((start, end))
    return [(q, s, e) for q, own in found.items() for s, e in own]


def _word_ids(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def tiles(words: list[bytes]) -> Iterator[tuple[int, int, bytes, list[int]]]:
    """Tiles (octave, place of the first word, word ids, boundaries in the tile) of one document that are to be solved."""
    ids = _word_ids(words, {})
    for o, at in boundaries(ids):
        reach = 4 << o
        span = max(TILE, 4 * reach)
        for k in np.unique(at // span):
            own = at[at // span == k]
            # One word more on either side shows whether a fragment ends by itself.
            low, high = max(0, int(own[0]) - reach - 1), min(len(ids), int(own[-1]) + reach + 1)
            yield o, low, ids[low:high].astype(np.int32).tobytes(), (own - low).tolist()


def _joined(words: list[bytes]) -> bytes:
    return b" ".join(words)


def _scan(docs: DataFrame, keep: Sequence[str], text: str, rewrite: Rewrite | None) -> DataFrame:
    """Per row of ``docs``: ``key``, and either the digest of a text without runs or the text that may hold some."""

    def run(texts: list[bytes | None], doc_ids: list[int | None]):
        keys, kept, digests = [], [], []
        held, starts, parts, size, longest = [], [], [], 0, 0
        known: dict[bytes, int] = {}

        def settle() -> None:
            may = np.zeros(len(held), dtype=bool)
            if held:
                for _, found in boundaries(np.concatenate(parts), longest, strict=True):
                    may[np.searchsorted(starts, found, side="right") - 1] = True
            for (data, d), flag in zip(held, may):
                digests.append(None if flag else hashlib.sha256(data).hexdigest())
                kept.append(data if flag else None)
                keys.append(hashlib.sha256(b"%s\n%s" % (str(d).encode(), data)).digest() if flag else None)

        for t, d in zip(texts, doc_ids):
            words = split_words(t)
            if rewrite is not None:
                words = rewrite(words, d)
            starts.append(size)
            # Every document ends with an id of its own, so that nothing repeats across documents.
            parts += [_word_ids(words, known), np.array([-len(starts)])]
            held.append((_joined(words), d))
            size += len(words) + 1
            longest = max(longest, len(words))
            if size >= _SCANNED:
                settle()
                held, starts, parts, size, longest = [], [], [], 0, 0
                known = {}
        settle()
        return keys, kept, digests

    return annotate(docs, keep, [raw(f"`{text}`"), F.col("doc_id").cast("bigint")], run, "key binary, body binary, whole_sha256 string")


def _tiled(texts: DataFrame) -> DataFrame:
    """``key, octave, at, ids, bounds``: the tiles of all texts ``key, body``, few at a time."""
    ship_package(texts.sparkSession)
    schema = "key binary, octave int, at bigint, ids binary, bounds array<int>"
    kinds = (pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int32()))
    names = ["key", "octave", "at", "ids", "bounds"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = ((k.as_py(), t) for batch in batches for k, v in zip(*batch.columns) for t in tiles(v.as_py().split()))
        for some in batched(every, 64):
            columns = [[k for k, _ in some], *[[t[i] for _, t in some] for i in range(4)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return texts.select("key", "body").mapInArrow(run, schema)


def _fragments(tiled: DataFrame) -> DataFrame:
    """``key, period, start, end`` of tiles, each solved by itself."""
    names = ["key", "period", "start", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns):
                key, o, at, ids, bounds = (v.as_py() for v in row)
                solved = solve(np.frombuffer(ids, np.int32).tolist(), o, bounds)
                columns = [[key] * len(solved), [q for q, _, _ in solved], [s + at for _, s, _ in solved], [e + at for _, _, e in solved]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), *[pa.int64()] * 3))], names=names)

    return tiled.mapInArrow(run, "key binary, period bigint, start bigint, end bigint")


def stitch(fragments: DataFrame) -> DataFrame:
    """Runs ``key, period, start, length`` from fragments; those of one run overlap by a period or more."""
    order = Window.partitionBy("key", "period").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("start") + F.col("period") > before), 1).otherwise(0)
    placed = fragments.withColumn("__opens", opens).withColumn("__run", F.sum("__opens").over(order))
    merged = placed.groupBy("key", "period", "__run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    length = F.col("end") - F.col("start")
    return merged.select("key", "period", "start", length.alias("length")).where(
        (F.col("length") >= SHORTEST) & (F.col("length") >= TIMES * F.col("period"))
    )


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Places of the words that stay: all but those behind the first period of a run (start, length, period)."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.flatnonzero(np.cumsum(change[:-1]) == 0)


def _outcome(data: bytes | None, found: list[dict] | None):
    words = data.split() if data else []
    runs = sorted((r["start"], r["length"], r["period"]) for r in found or [])
    runs.sort(key=lambda r: (r[0], r[2]))
    stays = kept_words(len(words), runs)
    return runs, _joined([words[i] for i in stays])


def find_runs(docs: DataFrame, keep: Sequence[str], text: str = "text", rewrite: Rewrite | None = None) -> DataFrame:
    """``keep`` columns, ``runs`` (``start, length, period`` by start, then period) and ``collapsed_sha256`` per row.

    ``rewrite(words, doc_id)`` may change the words of a document first.  ``docs`` needs ``doc_id``.
    """
    scanned = durable(_scan(docs, keep, text, rewrite))
    columns = [c for c in scanned.columns if c not in ("key", "body", "whole_sha256")]
    kept = [F.col(f"`{c}`") for c in columns]
    nothing = F.array().cast("array<struct<start:bigint,length:bigint,period:bigint>>")
    done = scanned.where("key IS NULL").select(*kept, nothing.alias("runs"), F.col("whole_sha256").alias("collapsed_sha256"))
    open_ = scanned.where("key IS NOT NULL")

    tiled = _tiled(open_).repartition("key", "octave", "at")
    runs = stitch(_fragments(tiled)).groupBy("key").agg(F.collect_list(F.struct("start", "length", "period")).alias("found"))
    met = open_.join(runs, "key", "left")

    def finish(bodies: list[bytes], found: list):
        out = [_outcome(b, f) for b, f in zip(bodies, found)]
        listed = [[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs, _ in out]
        return listed, [hashlib.sha256(data).hexdigest() for _, data in out]

    new = "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed_sha256 string"
    return done.unionByName(annotate(met, columns, [F.col("body"), F.col("found")], finish, new))
