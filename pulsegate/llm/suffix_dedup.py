"""Exact removal of repeated byte strings with suffix arrays over content-routed shards.

A string of ``LENGTH`` bytes is removed wherever it also starts earlier (lower id, or same text and
earlier start).  Equal strings must meet in one shard, so each string is routed by an anchor it holds:
the least hash of its ``GRAM``-byte substrings.  Neighbouring strings share anchors; the bytes of such a
run of strings are its context (about 35 strings, 134 bytes).

1. Anchors.  Each run becomes one narrow row: anchor, hash of the context, id, place.  Runs whose whole
   context equals an earlier one's are repeats at once; per Arrow batch that is settled before the shuffle,
   so a passage that a third of all texts hold is sent once per batch.
2. Only anchors that are left with several different contexts are looked at byte by byte: one context of each
   kind goes to a shard, where induced sorting gives the suffix array and permuted common prefixes; strings with
   ``LENGTH`` bytes in common are neighbours in it.  Shards are cut between anchors, ``SHARD_BYTES`` or so each.
3. An anchor with more than ``HOT`` contexts would outgrow a shard: its strings are routed one by one, by a
   128-bit hash of all their bytes, and the earliest of each stays.

Texts that are whole copies are settled first, by SHA-256.  Exact up to collisions of 128-bit hashes.

Edge cases.  A NULL text has no bytes.  Rows with a NULL or repeated doc_id: texts of one doc_id count in order of
their SHA-256, NULL ids last; rows that repeat both id and text are one document and get equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegate.functions.ordered import row_index
from pulsegate.llm.common import annotate, raw
from pulsegate.llm.suffix_sort import common_prefixes, join_pieces, suffix_array
from pulsegate.session import durable, ship_package

# Fixed by the contract.
LENGTH = 100

GRAM = 32
HOT = 4096
SHARD_BYTES = 1 << 20
# Places inside a piece take the low 20 bits of a window's key.
_PIECE_BITS = 20
_PIECE = 1 << _PIECE_BITS
_LOW = np.uint64(_PIECE - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)

RUNS = "a long, c long, id long, start int, n int"


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_BASE = 0x9E3779B97F4A7C15
_FORWARD = _powers(_BASE, _PIECE)
_BACK = _powers(pow(_BASE, -1, 1 << 64), _PIECE)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of every ``gram``-byte substring, by doubling; ``gram`` is a power of two."""
    h, size = data.astype(np.uint64) + np.uint64(1), 1
    while size < gram:
        h = _scramble(h[:-size] * _ODD + h[size:] + np.uint64(size))
        size *= 2
    return h


def _range_hash(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the gram hashes in [begin, end), the same wherever they stand."""
    return (prefix[end] - prefix[begin]) * _BACK[begin]


def _pieces(ids, texts, length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (id, offset, bytes) of at most ``_PIECE`` bytes together; long texts overlap by ``length`` - 1."""
    held, size = [], 0
    for i, t in zip(ids, texts):
        if len(t) < length:
            continue
        for at in range(0, len(t) - length + 1, _PIECE - length):
            part = t[at : at + _PIECE - 1]
            if size + len(part) >= _PIECE and held:
                yield held
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield held


def runs_of(pieces: list[tuple[int, int, bytes]], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Runs of strings with one anchor: anchor, context hash, id, start and number of strings."""
    data = np.frombuffer(b"".join(p[2] for p in pieces), dtype=np.uint8)
    sizes = np.array([len(p[2]) for p in pieces], dtype=np.int64)
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    h = gram_hashes(data)
    keys = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    # Sliding minimum over all grams of a string; the place in the low bits makes the leftmost win.
    width, span, least = length - GRAM + 1, 1, keys
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    anchor = (least & _LOW).astype(np.int64)
    piece = np.repeat(np.arange(len(pieces)), sizes)[: len(anchor)]
    place = np.arange(len(anchor))
    valid = place <= (begins + sizes - length)[piece]
    # A long text's pieces overlap by length - 1 bytes or more: each string is taken from one piece only.
    step = _PIECE - length
    valid &= place - begins[piece] < step
    first = np.flatnonzero(
        valid & np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1]) | ~valid[:-1]))
    )
    last = np.flatnonzero(
        valid & np.concatenate(((anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1]) | ~valid[1:], [True]))
    )
    n = last - first + 1
    weighted = np.concatenate(([np.uint64(0)], np.cumsum(h * _FORWARD[: len(h)], dtype=np.uint64)))
    context = _range_hash(weighted, first, last + width)
    mixed = _scramble(context + n.astype(np.uint64) * _ODD + (anchor[first] - first).astype(np.uint64))
    ids = np.array([p[0] for p in pieces], dtype=np.int64)[piece[first]]
    starts = (first - begins[piece[first]]) + np.array([p[1] for p in pieces], dtype=np.int64)[piece[first]]
    return h[anchor[first]].view(np.int64), mixed.view(np.int64), ids, starts, n


def merged(ids: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs sorted by id and start, touching ones joined."""
    if not len(ids):
        return ids, starts, n
    order = np.lexsort((starts, ids))
    ids, starts, n = ids[order], starts[order], n[order]
    new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (starts[1:] > starts[:-1] + n[:-1])))
    at = np.flatnonzero(new)
    ends = np.maximum.reduceat(starts + n, at)
    return ids[at], starts[at], ends - starts[at]


def _earliest(*columns: np.ndarray) -> np.ndarray:
    """True for the first row, by (id, start), of each key; columns are keys, then id and start."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), dtype=bool)
    if len(order):
        new[0] = True
        for key in columns[:-2]:
            new[1:] |= key[order][1:] != key[order][:-1]
    out = np.empty(len(order), dtype=bool)
    out[order] = new
    return out


def _batch(*columns) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(c).astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds)], names=["a", "c", "id", "start", "n"]
    )


def _settle(a, c, ids, starts, n) -> list[pa.RecordBatch]:
    """First runs of each (anchor, context) of a batch; the others are repeats, marked by a negative n and spread by id."""
    first = _earliest(a, c, ids, starts)
    out = [_batch(a[first], c[first], ids[first], starts[first], n[first])]
    i, s, m = merged(ids[~first], starts[~first], n[~first])
    if len(i):
        out.append(_batch(_scramble(i.astype(np.uint64) * _ODD).view(np.int64), np.zeros_like(i), i, s, -m))
    return out


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [runs_of(p) for p in _pieces(batch.column(0).to_pylist(), batch.column(1).to_pylist(), LENGTH)]
        if found:
            yield from _settle(*[np.concatenate(x) for x in zip(*found)])


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]


class _Groups:
    """Streams sorted runs: repeats are told at once, anchors with several contexts are handed on.

    The first ``HOT`` contexts of an anchor wait until it ends or is known to be hot, so memory is bounded.
    """

    def __init__(self) -> None:
        self.anchor = self.context = None
        self.waiting: list[tuple] = []
        self.hot = False

    def _close(self) -> list[tuple]:
        out = self.waiting if len(self.waiting) > 1 else []
        self.waiting, self.hot = [], False
        return [(*x, 0) for x in out]

    def feed(self, a, c, ids, starts, n) -> tuple[tuple, list[tuple]]:
        """Repeats as arrays, and contexts to look at as (a, id, start, n, hot)."""
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        new[0] = self.anchor is None or a[0] != self.anchor or c[0] != self.context
        told: list[tuple] = []
        kept = np.flatnonzero(new)
        ka = a[kept]
        # Anchors with one context in this batch, neither first nor last in it, are done with.
        alone = np.ones(len(kept), dtype=bool)
        alone[1:] &= ka[1:] != ka[:-1]
        alone[:-1] &= ka[1:] != ka[:-1]
        if len(kept):
            alone[-1] = False
            alone &= ka != (self.anchor if self.anchor is not None else ka[-1])
        for x, i, s, m in zip(*[v[kept[~alone]].tolist() for v in (a, ids, starts, n)]):
            if x != self.anchor:
                told += self._close()
                self.anchor = x
            if self.hot:
                told.append((x, i, s, m, 1))
                continue
            self.waiting.append((x, i, s, m))
            if len(self.waiting) > HOT:
                told += [(*w, 1) for w in self.waiting]
                self.waiting, self.hot = [], True
        if len(a):
            self.context = c[-1]
        return (ids[~new], starts[~new], n[~new]), told

    def end(self) -> list[tuple]:
        return self._close()


def _pair_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted runs to repeats (n < 0, c = 0) and contexts to look at (c = 1 if hot)."""
    groups = _Groups()

    def contexts(rows):
        a, i, s, n, hot = map(np.array, zip(*rows))
        return _batch(a, hot, i, s, n)

    for batch in batches:
        a, c, ids, starts, n = _columns(batch)
        ready = n < 0
        (i, s, m), told = (ids[:0], starts[:0], n[:0]), []
        if not ready.all():
            (i, s, m), told = groups.feed(*[x[~ready] for x in (a, c, ids, starts, n)])
        i, s, m = merged(np.concatenate((ids[ready], i)), np.concatenate((starts[ready], s)), np.concatenate((-n[ready], m)))
        yield _batch(np.zeros_like(i), np.zeros_like(i), i, s, -m)
        if told:
            yield contexts(told)
    if rows := groups.end():
        yield contexts(rows)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts with their bytes, and the strings of hot ones by hash: a, c, id, start, n, bytes."""
    for batch in batches:
        rows, hot = [], []
        for i, text, wanted in zip(*[batch.column(k).to_pylist() for k in range(3)]):
            for w in wanted:
                s, n, a = w["start"], w["n"], w["a"]
                part = text[s : s + n + LENGTH - 1]
                if not w["c"]:
                    rows.append((a, 0, i, s, n, part))
                    continue
                h = gram_hashes(np.frombuffer(part, dtype=np.uint8))
                weighted = np.concatenate(([np.uint64(0)], np.cumsum(h * _FORWARD[: len(h)], dtype=np.uint64)))
                at = np.arange(n)
                whole = _range_hash(weighted, at, at + LENGTH - GRAM + 1)
                other = _scramble(h[at] * _ODD ^ h[at + GRAM] * _MIX ^ _scramble(h[at + LENGTH - GRAM] + h[at + 2 * GRAM]))
                hot.append((whole, other, np.full(n, i), s + at))
        if hot:
            k1, k2, ids, starts = [np.concatenate(x) for x in zip(*hot)]
            k1, k2 = _scramble(k1).view(np.int64), k2.view(np.int64)
            first = _earliest(k1, k2, ids, starts)
            i, s, m = merged(ids[~first], starts[~first], np.ones(int((~first).sum()), dtype=np.int64))
            columns = [np.concatenate(x) for x in zip(
                (k1[first], k2[first], ids[first], starts[first], np.ones(int(first.sum()), dtype=np.int64)),
                (_scramble(i.astype(np.uint64) * _ODD).view(np.int64), np.zeros_like(i), i, s, -m),
            )]
            rows += zip(*[x.tolist() for x in columns], [None] * len(columns[0]))
        a, c, ids, starts, n, parts = zip(*rows) if rows else [()] * 6
        head = _batch(*[np.array(x, dtype=np.int64) for x in (a, c, ids, starts, n)])
        yield pa.RecordBatch.from_arrays([*head.columns, pa.array(parts, pa.binary())], names=[*head.schema.names, "part"])


def repeats_in(rows: list[tuple[int, int, int, bytes]], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated strings of one shard; ``rows`` are (id, start, number of strings, bytes)."""
    rows = sorted(rows)
    text, begins = join_pieces([r[3] for r in rows])
    n = np.array([r[2] for r in rows], dtype=np.int64)
    offsets = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    wanted = np.zeros(len(text), dtype=bool)
    wanted[np.repeat(begins, n) + offsets] = True
    order = suffix_array(text, length)
    order = order[wanted[order]].astype(np.int64)
    prefixes = common_prefixes(text, order, length)
    group = np.cumsum(prefixes[order] < length)
    # Pieces stand in order of id and start, so the earliest string of a group has the lowest place.
    least = np.full(int(group[-1]) + 1, len(text), dtype=np.int64)
    np.minimum.at(least, group, order)
    again = np.sort(order[order != least[group]])
    piece = np.searchsorted(begins, again, side="right") - 1
    ids, starts = (np.array([r[k] for r in rows], dtype=np.int64) for k in (0, 1))
    return merged(ids[piece], starts[piece] + again - begins[piece], np.ones(len(again), dtype=np.int64))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats among sorted contexts, shard by shard, and among sorted hot strings."""
    held: list[tuple] = []
    size, last, key = 0, None, None

    def repeats(ids, starts, n):
        return _batch(np.zeros_like(ids), np.zeros_like(ids), ids, starts, -n)

    for batch in batches:
        a, c, ids, starts, n = _columns(batch)
        parts = batch.column(5)
        kinds = np.asarray(parts.is_null()) if len(parts) else np.zeros(0, bool)
        ready, single = kinds & (n < 0), kinds & (n > 0)
        out = [(ids[ready], starts[ready], -n[ready])]
        if single.any():
            ka, kc = a[single], c[single]
            new = np.ones(len(ka), dtype=bool)
            new[1:] = (ka[1:] != ka[:-1]) | (kc[1:] != kc[:-1])
            new[0] = key != (ka[0], kc[0])
            key = (ka[-1], kc[-1])
            out.append((ids[single][~new], starts[single][~new], n[single][~new]))
        yield repeats(*merged(*[np.concatenate(x) for x in zip(*out)]))
        for k in np.flatnonzero(~kinds).tolist():
            if size >= SHARD_BYTES and a[k] != last:
                yield repeats(*repeats_in(held))
                held, size = [], 0
            part = parts[k].as_py()
            held.append((int(ids[k]), int(starts[k]), int(n[k]), part))
            size, last = size + len(part), a[k]
    if held:
        yield repeats(*repeats_in(held))


def _finish(texts: list[bytes], flags: list[list[dict] | None]):
    n_bytes, n_removed, n_spans, digests = [], [], [], []
    for text, own in zip(texts, flags):
        begins, ends = [], []
        for s, n in sorted((f["start"], f["n"]) for f in own or ()):
            if ends and s <= ends[-1]:
                ends[-1] = max(ends[-1], s + n + LENGTH - 1)
            else:
                begins.append(s)
                ends.append(s + n + LENGTH - 1)
        kept = hashlib.sha256()
        at = 0
        for b, e in zip(begins, ends):
            kept.update(memoryview(text)[at:b])
            at = e
        kept.update(memoryview(text)[at:])
        n_bytes.append(len(text))
        n_removed.append(sum(ends) - sum(begins))
        n_spans.append([{"start": b, "end": e} for b, e in zip(begins, ends)])
        digests.append(kept.hexdigest())
    return n_bytes, n_removed, n_spans, digests


def _numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``doc_id, __id, sha, text``, and whether ids are unique as they come.  ``__id`` is one per distinct document and orders documents."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(raw(), F.lit(b"")).alias("text"))
    rows = rows.withColumn("sha", F.sha2("text", 256))
    counted = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if not counted.where("n > 1 OR doc_id IS NULL").limit(1).count():
        return rows.withColumn("__id", F.col("doc_id")), True
    keys = rows.select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("k"), "sha").distinct()
    ids = row_index(keys, ["none", "k", "sha"], "__id").withColumnRenamed("sha", "__sha")
    same = (F.col("doc_id").isNull() == F.col("none")) & (F.coalesce("doc_id", F.lit(0)) == F.col("k")) & (F.col("sha") == F.col("__sha"))
    return rows.join(durable(ids), same).select("doc_id", "__id", "sha", "text"), False


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, spans`` (bytes removed, end exclusive), ``kept_sha256``.

    Column pruning and exchange reuse move each text once: anchors, contexts and the result are all made where
    the texts lie after one shuffle by id.
    """
    spark = docs.sparkSession
    ship_package(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, unique = _numbered(docs)
    narrow = durable(rows.select("doc_id", "__id", "sha", F.octet_length("text").cast("long").alias("size")))
    firsts = narrow.groupBy("sha").agg(F.min("__id").alias("first"))
    # A copy moves no text: it is removed whole if it holds a string at all.
    placed = narrow.join(firsts, "sha").select("doc_id", "__id", "sha", "size", (F.col("__id") > F.col("first")).alias("copy"))
    placed = durable(placed)
    kept_ids = placed.where("NOT copy").select("__id").distinct()
    # Where ids are unique they go under their own name: an alias would keep Spark from reusing the exchange.
    source = rows.select("doc_id", "text") if unique else rows.select(F.col("__id").alias("doc_id"), "text")
    texts = source.join(kept_ids.hint("merge"), source["doc_id"] == kept_ids["__id"], "left_semi").select("doc_id", "text")
    if not unique:
        texts = texts.dropDuplicates(["doc_id"])

    order = ["a", "c", "id", "start"]
    runs = texts.mapInArrow(_anchors, RUNS).repartition(n, "a").sortWithinPartitions(*order)
    paired = runs.mapInArrow(_pair_up, RUNS)
    contexts = paired.where("n > 0").groupBy("id").agg(F.collect_list(F.struct("start", "n", "a", "c")).alias("wanted"))
    bytes_of = (
        texts.join(contexts.hint("merge"), texts["doc_id"] == contexts["id"])
        .select("doc_id", "text", "wanted")
        .mapInArrow(_extract, RUNS + ", part binary")
    )
    sharded = bytes_of.repartition(n, "a").sortWithinPartitions(*order).mapInArrow(_shards, RUNS)
    flags = (
        paired.where("n < 0")
        .unionAll(sharded)
        .select("id", "start", (-F.col("n")).alias("n"))
        .groupBy("id")
        .agg(F.collect_list(F.struct("start", "n")).alias("flags"))
    )
    spans = "array<struct<start:bigint,end:bigint>>"
    done = annotate(
        texts.join(flags.hint("merge"), texts["doc_id"] == flags["id"], "left"),
        ["doc_id"],
        [F.col("text"), F.col("flags")],
        _finish,
        f"n_bytes bigint, n_removed bigint, spans {spans}, kept_sha256 string",
    )
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("size").alias("end")))
    gone = F.col("size") >= LENGTH
    copies = placed.where("copy").select(
        "doc_id",
        F.col("size").alias("n_bytes"),
        F.when(gone, F.col("size")).otherwise(0).alias("n_removed"),
        F.when(gone, whole).otherwise(F.array().cast(spans)).alias("spans"),
        F.when(gone, F.lit(hashlib.sha256().hexdigest())).otherwise(F.col("sha")).alias("kept_sha256"),
    )
    ids = placed.where("NOT copy").select("doc_id", "__id")
    own = done.withColumnRenamed("doc_id", "id").join(ids, F.col("id") == F.col("__id")).select("doc_id", "n_bytes", "n_removed", "spans", "kept_sha256")
    return own.unionByName(copies)
