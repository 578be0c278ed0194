"""Phrase mining: collocations of two to five words by direct-address tiling of frequency-ranked ids.

Symbols are words at first.  The most frequent symbols are ranked; a pair of neighbouring symbols of
ranks (x, y) has the address (x, y) in a square that is cut into tiles of ``TILE`` x ``TILE`` cells.  A tile that
gets many pairs of a block is counted densely (``numpy.bincount`` over its cells, kept for the whole task), all
other pairs as sorted coordinates.  Frequent pairs become the symbols of the next level and are ranked
anew: a phrase of k words is the pair of its first and its last k - 1 words, which overlap.

A phrase of ``least`` occurrences has only parts of as many, so a position is counted only where both parts are
frequent.  Tasks know them by a bitmap of ``FILTER_BITS`` hashed bits and the ranks of at most ``HEAD``
symbols.  Both have a fixed size: a false positive of the bitmap costs a coordinate and no more, symbols
beyond the head go to coordinates.  Texts are scanned once per level and never shuffled; what moves are
partial counts.

Symbols are told apart by 64-bit hashes seeded with the language, so that all languages are counted at once.

Edge cases.  NULL texts are empty, a NULL language is ``und``, phrases never cross a separator or a document.
Texts are cut into tokens ``_CHUNK`` bytes at a time and counted ``_BLOCK_TOKENS`` tokens at a time with the
neighbours carried over, so that a long text needs no more memory than its bytes.  Repeated rows count as
often as they occur; columns other than text and language are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegate.llm.common import annotate, raw
from pulsegate.session import durable, ship_package

# Fixed by the contract.
LEAST, LONGEST, TOP, SCALE = 100, 5, 2000, 1000
SEPARATORS = b".,;:!?\n\v\f\r"

# Tiles are dense in the square of the first SIDE * TILE ranks only; HEAD stays below 2 ** 31.
TILE, SIDE, DENSE, MAX_TILES = 512, 16, 1 << 14, 16
HEAD = 1 << 20
FILTER_BITS = 1 << 26
_CHUNK, _BLOCK_TOKENS, _HELD = 1 << 20, 1 << 18, 1 << 20
_MARK = b"\xff"  # never part of UTF-8 text
_TO_MARK = bytes.maketrans(SEPARATORS + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t", _MARK * len(SEPARATORS) + b"abcdefghijklmnopqrstuvwxyz ")
_TOP = np.uint64(1 << 63)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)


def tokens(data: bytes) -> Iterator[list[bytes]]:
    """Lower-cased words with ``_MARK`` between pieces, in chunks that end at a blank or separator."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + _CHUNK)
        part = data[at:end].translate(_TO_MARK)
        while end < n and not part.endswith((b" ", _MARK)):
            more = data[end : end + 4096].translate(_TO_MARK)
            cut = min((c for c in (more.find(b" "), more.find(_MARK)) if c >= 0), default=len(more) - 1) + 1
            part, end = part + more[:cut], end + cut
        yield part.replace(_MARK, b" \xff ").split()
        at = end


def seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode())


def word_hash(word: bytes, of: int) -> int:
    """Hash of a word; its top bit is set, so that as a signed integer it is negative and no rank."""
    return xxhash.xxh64_intdigest(word, of) | 1 << 63


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of the phrase whose first and last parts have the hashes ``left`` and ``right``."""
    mixed = (left * _MIX[0]) ^ (right + (left >> np.uint64(29)))
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX[1]
    return (mixed ^ (mixed >> np.uint64(29))) | _TOP


def parts_of(block: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all stretches of ``length`` words, and whether none of their words is a mark."""
    parts, inside = block, block != 0
    for k in range(1, length):
        parts = joined(parts[:-1], parts[1:])
        inside = inside[:-1] & (block[k:] != 0)
    return parts, inside


class _Words(dict):
    """Word to hash, made on demand and forgotten when too many."""

    def __init__(self, lang: str):
        self.seed = seed(lang)
        self[_MARK] = 0

    def __missing__(self, word: bytes) -> int:
        if len(self) > _HELD:
            self.clear()
            self[_MARK] = 0
        value = self[word] = word_hash(word, self.seed)
        return value


class Known:
    """Frequent symbols of one level as a task sees them: a bitmap of all, the ranks of the most frequent."""

    def __init__(self, slots: np.ndarray, bits: np.ndarray, head: np.ndarray, size: int):
        self.words = np.zeros(size // 64, dtype=np.uint64)
        self.words[slots] = bits
        self.mask = np.uint64(size - 1)
        order = np.argsort(head)
        self.head, self.ranks, self.by_rank = head[order], order.astype(np.int64), head

    def maybe(self, h: np.ndarray) -> np.ndarray:
        at = h & self.mask
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0

    def coded(self, h: np.ndarray) -> np.ndarray:
        """Rank of each hash, which is not negative; beyond the head the hash itself, which is."""
        own = h.view(np.int64)
        if not len(self.head):
            return own
        at = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1)
        return np.where(self.head[at] == h, self.ranks[at], own)

    def hashed(self, codes: np.ndarray) -> np.ndarray:
        """The hashes of ``coded``."""
        out, ranked = codes.view(np.uint64).copy(), codes >= 0
        out[ranked] = self.by_rank[codes[ranked]]
        return out


def _sums(keys: tuple[np.ndarray, ...], n: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Coordinates sorted by ``keys`` and summed: (*keys, count)."""
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    keys = tuple(k[order] for k in keys)
    first = np.ones(len(order), dtype=bool)
    first[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    starts = np.flatnonzero(first)
    if n is None:
        sums = np.diff(np.append(starts, len(order)))
    else:
        sums = np.add.reduceat(n[order], starts) if len(starts) else n
    return (*(k[first] for k in keys), sums.astype(np.int64))


class PairCounter:
    """Counts of pairs of coded symbols: dense tiles, sorted addresses of ranked pairs, sorted pairs of the others."""

    def __init__(self, held: int = _HELD):
        self.held = held
        self.tiles: dict[int, np.ndarray] = {}
        self.addresses: list[tuple[np.ndarray, ...]] = []
        self.others: list[tuple[np.ndarray, ...]] = []

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        ranked = (x >= 0) & (y >= 0)
        if not ranked.all():
            self.others.append(_sums((x[~ranked], y[~ranked])))
            x, y = x[ranked], y[ranked]
        square = (x < SIDE * TILE) & (y < SIDE * TILE)
        tile = np.where(square, (x // TILE) * SIDE + y // TILE, SIDE * SIDE)
        sizes = np.bincount(tile, minlength=SIDE * SIDE + 1)
        rest = np.ones(len(tile), dtype=bool)
        for t in np.flatnonzero(sizes[:-1]):
            if t in self.tiles or (sizes[t] >= DENSE and len(self.tiles) < MAX_TILES):
                own = tile == t
                counted = np.bincount((x[own] % TILE) * TILE + y[own] % TILE, minlength=TILE * TILE)
                self.tiles[t] = counted if t not in self.tiles else self.tiles[t] + counted
                rest &= ~own
        if rest.any():
            self.addresses.append(_sums((x[rest] << 32 | y[rest],)))
        if sum(len(s[0]) for s in (*self.addresses, *self.others)) > 4 * self.held:
            self._merge()

    def _merge(self) -> None:
        for held in (self.addresses, self.others):
            if len(held) > 1:
                *keys, n = (np.concatenate(c) for c in zip(*held))
                held[:] = [_sums(tuple(keys), n)]

    def full(self) -> bool:
        return sum(len(s[0]) for s in (*self.addresses, *self.others)) > self.held and len(self.addresses) < 2 and len(self.others) < 2

    def coordinates(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The coordinates held so far, which are forgotten."""
        self._merge()
        for codes, n in self.addresses:
            yield codes >> 32, codes & 0xFFFFFFFF, n
        yield from self.others
        self.addresses, self.others = [], []

    def all(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        yield from self.coordinates()
        for t, counted in self.tiles.items():
            cells = np.flatnonzero(counted)
            yield (t // SIDE) * TILE + cells // TILE, (t % SIDE) * TILE + cells % TILE, counted[cells]
        self.tiles = {}


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            data = text.as_py()
            if data:
                yield lang.as_py(), data


def _blocks(batches: Iterator[pa.RecordBatch], carry: int) -> Iterator[np.ndarray]:
    """Word hashes of all texts, 0 between pieces; each block begins with the last ``carry`` of the one before."""
    words: dict[str, _Words] = {}
    held, n = [np.zeros(1, dtype=np.uint64)], 1
    for lang, data in _texts(batches):
        known = words.get(lang)
        if known is None:
            if len(words) > 64:
                words.clear()
            known = words[lang] = _Words(lang)
        for part in tokens(data):
            held.append(np.fromiter(map(known.__getitem__, part), np.uint64, len(part)))
            n += len(part)
            if n >= _BLOCK_TOKENS:
                block = np.concatenate(held)
                yield block
                held, n = [block[len(block) - carry :] if carry else block[:0]], carry
        held.append(np.zeros(1, dtype=np.uint64))
        n += 1
    yield np.concatenate(held)


def _source(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), raw(f"`{text}`").alias("text"))


def word_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, word (binary), f`` of all words."""
    names = ["lang", "word", "f"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for own, found in counts.items():
                found.pop(_MARK, None)
                for some in batched(found.items(), 1 << 14):
                    columns = [pa.array([own] * len(some)), pa.array([w for w, _ in some], pa.binary()), pa.array([c for _, c in some], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
            counts.clear()

        for own, data in _texts(batches):
            for part in tokens(data):
                counts.setdefault(own, Counter()).update(part)
            if sum(map(len, counts.values())) > _HELD // 4:
                yield from flush()
        yield from flush()

    partial = _source(docs, text, lang).mapInArrow(run, "lang string, word binary, f bigint")
    return partial.groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _named(words: DataFrame) -> DataFrame:
    """Frequent words as level 1: ``id, f, lang, words, heads, tails``."""

    def run(langs: list[str], found: list[bytes]):
        return ([word_hash(w, seed(own)) - (1 << 64) for own, w in zip(langs, found)],)

    made = annotate(words, ["lang", "word", "f"], [F.col("lang"), F.col("word")], run, "id bigint")
    empty = F.array().cast("array<bigint>")
    return made.select("id", "f", "lang", F.array(F.col("word").cast("string")).alias("words"), empty.alias("heads"), empty.alias("tails"))


def known_symbols(level: DataFrame, head: int = HEAD, bits: int = FILTER_BITS) -> Known:
    """Bitmap and ranks of a level (``id, f``); what reaches the driver is at most ``bits / 64`` and ``head`` rows."""
    at = F.col("id").bitwiseAND(F.lit(bits - 1))
    slots = level.select(F.shiftright(at, 6).alias("slot"), F.expr("shiftleft(1L, cast(id & 63 as int))").alias("bit"))
    packed = slots.groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    # Ranks go down to the power of two above which at most ``head`` symbols lie.
    power = F.floor(F.log2("f")).cast("int")
    sizes = sorted(((r["p"], r["n"]) for r in level.groupBy(power.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    total, floor = 0, None
    for p, n in sizes:
        if total + n > head:
            break
        total, floor = total + n, p
    ranked = np.zeros(0, dtype=np.uint64)
    if floor is not None:
        rows = level.where(power >= floor).select("id", "f").toArrow()
        ids, f = rows.column("id").to_numpy(), rows.column("f").to_numpy()
        ranked = ids[np.lexsort((ids, -f))].view(np.uint64)
    slot, bit = packed.column("slot").to_numpy(), packed.column("bits").to_numpy()
    return Known(slot, bit.view(np.uint64), ranked, bits)


def pair_counts(docs: DataFrame, length: int, known: Known, least: int, text: str = "text", lang: str = "lang") -> DataFrame:
    """``id, first, last, f`` of phrases of ``length`` words and ``least`` occurrences: hashes of the phrase and of its two overlapping parts."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(known)
    names = ["first", "last", "f"]

    def batch(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(columns[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PairCounter()
        for block in _blocks(batches, length - 1):
            parts, good = parts_of(block, length - 1)
            good &= shared.value.maybe(parts)
            at = np.flatnonzero(good[:-1] & good[1:])
            codes = shared.value.coded(parts)
            counter.add(codes[at], codes[at + 1])
            if counter.full():
                for found in counter.coordinates():
                    yield from batch(*found)
        for found in counter.all():
            yield from batch(*found)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in batches:
            first, last = (shared.value.hashed(found.column(i).to_numpy()) for i in (0, 1))
            columns = [joined(first, last).view(np.int64), first.view(np.int64), last.view(np.int64)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), found.column(2)], names=["id", *names])

    partial = _source(docs, text, lang).mapInArrow(run, "first bigint, last bigint, f bigint")
    summed = partial.groupBy("first", "last").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return summed.mapInArrow(name, "id bigint, first bigint, last bigint, f bigint")


def frequent_phrases(docs: DataFrame, words: DataFrame, least: int = LEAST, longest: int = LONGEST, text: str = "text", lang: str = "lang") -> list[DataFrame]:
    """Levels 1 to ``longest``: ``id, f, lang, words`` and the counts ``heads`` and ``tails`` of all shorter first and last parts."""
    levels = [durable(_named(words.where(F.col("f") >= least)))]
    for length in range(2, longest + 1):
        before = levels[-1]
        found = pair_counts(docs, length, known_symbols(before), least, text, lang)
        own = before.select(F.col("id").alias("first"), "lang", F.col("words").alias("w"), F.concat("heads", F.array("f")).alias("heads"))
        other = before.select(F.col("id").alias("last"), F.element_at("words", -1).alias("end"), F.concat("tails", F.array("f")).alias("tails"))
        level = found.join(own, "first").join(other, "last")
        cut = level.select("id", "first", "last", "f", "lang", F.concat("w", F.array("end")).alias("words"), "heads", "tails")
        levels.append(durable(cut))
    return levels


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int | None = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: per language the ``top`` phrases (None: all) by their lowest-scoring cut.

    Phrases that a longer candidate contains as often as they occur at all are left out.
    """
    counted = durable(word_counts(docs, text, lang))
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    levels = frequent_phrases(docs, counted, least, longest, text, lang)
    kept = []
    for k in range(1, longest):
        own = levels[k].withColumnRenamed("f", "a")
        if k + 1 < longest:
            # A longer phrase as frequent as a part is so with every phrase between them: one word more tells.
            longer = levels[k + 1].select(F.explode(F.array("first", "last")).alias("id"), "f")
            own = own.join(longer.groupBy("id").agg(F.max("f").alias("most")), "id", "left").where("most IS NULL OR most < a")
        kept.append(own.select("lang", "words", "a", "heads", "tails"))
    out = kept[0]
    for other in kept[1:]:
        out = out.union(other)
    # heads[i] = f(first i + 1 words), tails[i] = f(last i + 1 words).
    wide = "decimal(19,0)"
    scored = out.join(totals, "lang")
    cuts = F.zip_with("heads", F.reverse("tails"), lambda x, y: F.struct(x.alias("l"), y.alias("r")))

    def score(c):
        over = F.col("a").cast(wide) * F.lit(SCALE).cast("decimal(4,0)") * F.col("n").cast("decimal(15,0)")
        return F.call_function("div", over, c["l"].cast(wide) * c["r"].cast(wide))

    listed = F.transform(cuts, lambda c, i: F.struct(score(c).alias("score"), i.alias("k"), c["l"].alias("l"), c["r"].alias("r")))
    best = scored.select("lang", F.array_join("words", " ").alias("phrase"), "a", "n", F.array_min(listed).alias("c"))
    flat = best.select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = flat.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
