"""SimHash near-duplicates by covering locality-sensitive hashing.

For radius r, bit i of a fingerprint gets a non-zero vector m(i) of r + 1 bits, and every
non-zero vector v of r + 1 bits is a table whose mask keeps the bits with <m(i), v> = 1.  The
vectors of r differing bits span at most r dimensions, so some v is orthogonal to all of them:
in that table the two fingerprints agree on all kept bits.  No pair within the radius is missed.

Equal fingerprints are one row first.  Inside a bucket no list of all pairs is made: up to
``IN_TASK`` members are connected in numpy, block by block, giving links to the least member of
each connected part; larger buckets go through hubs.  Two members within distance 3 share a value
z at distance 1 of the one and 2 of the other, so grouping by z links every such pair through
the least member at distance 1; a value z has a bounded number of members, whatever the bucket.

Edge cases.  NULL, empty and wordless texts have fingerprint 0 and link like any other.  A NULL
doc_id is never the id of its component unless all are NULL.  Repeated rows are all given back.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegate.llm.common import annotate, raw
from pulsegate.llm.components import components
from pulsegate.session import durable

# Fixed by the contract.
SHINGLE, SEED, RADIUS, BITS = 3, 42, 3, 64

IN_TASK = 20_000
_BLOCK = 1 << 15


def fingerprint(data: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of lower-cased words, as an unsigned integer."""
    words = data.lower().split() if data else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if n == 1:
        return hashed(joined, SEED)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    return majority(np.fromiter((hashed(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :])), ">u8", n))


def majority(values: np.ndarray) -> int:
    """The bits that are set in over half of some hashes (big-endian)."""
    n, ones = len(values), np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, _BLOCK):
        block = values[at : at + _BLOCK]
        ones += np.unpackbits(block.view(np.uint8).reshape(len(block), 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(radius: int = RADIUS) -> list[int]:
    """The 2^(radius + 1) - 1 covering masks, as signed 64-bit integers."""
    vectors = [i % ((2 << radius) - 1) + 1 for i in range(BITS)]
    return [
        _signed(sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1))
        for v in range(1, 2 << radius)
    ]


def bucket_links(members: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links of the connected parts of a bucket to their least members; block by block."""
    left = np.sort(np.array(members, dtype=np.int64))
    found = []
    while len(left) > 1:
        root, left = left[0], left[1:]
        frontier = np.array([root])
        while len(frontier) and len(left):
            near = np.zeros(len(left), dtype=bool)
            for f in frontier:
                near |= np.bitwise_count((left ^ f).view(np.uint64)) <= radius
            frontier, left = left[near], left[~near]
            found += [(int(x), int(root)) for x in frontier]
    return found


def _hub_links(large: DataFrame, radius: int) -> DataFrame:
    """Links of oversized buckets ``t, key, fp`` without pairing their members."""
    free = {t: [1 << i for i in range(BITS) if not m & (1 << i)] for t, m in enumerate(masks(radius))}
    near = radius // 2

    def around(value: int, bits: list[int], reach: int) -> set[int]:
        ring = {value}
        for _ in range(reach):
            ring |= {x ^ b for x in ring for b in bits}
        return ring

    def run(tables: list[int], values: list[int]):
        rings = []
        for t, v in zip(tables, values):
            v &= (1 << 64) - 1
            inner, outer = around(v, free[t], near), around(v, free[t], radius - near)
            rings.append([{"z": _signed(z), "inner": z in inner} for z in inner | outer])
        return (rings,)

    rings = annotate(large, ["t", "fp"], [F.col("t"), F.col("fp")], run, "rings array<struct<z:bigint,inner:boolean>>")
    spread = rings.select("t", "fp", F.inline("rings"))
    hubs = spread.groupBy("t", "z").agg(
        F.min(F.when(F.col("inner"), F.col("fp"))).alias("b"), F.collect_set("fp").alias("members")
    )
    return hubs.where("b IS NOT NULL").select(F.explode("members").alias("a"), "b").where("a <> b")


def links(fingerprints: DataFrame, radius: int = RADIUS, in_task: int = IN_TASK) -> DataFrame:
    """Links ``a, b`` that connect all distinct ``fp`` within ``radius`` of each other."""
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks(radius))])
    keyed = fingerprints.select("fp", F.inline(tables))
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = keyed.join(sizes, ["t", "key"])
    small = shared.where(F.col("n") <= in_task).groupBy("t", "key").agg(F.collect_list("fp").alias("members"))

    def run(groups: list[list[int]]):
        return ([[{"a": a, "b": b} for a, b in bucket_links(g, radius)] for g in groups],)

    pairs = annotate(small, [], [F.col("members")], run, "links array<struct<a:bigint,b:bigint>>")
    found = pairs.select(F.inline("links"))
    if sizes.where(F.col("n") > in_task).limit(1).count():
        found = found.union(_hub_links(shared.where(F.col("n") > in_task).select("t", "fp"), radius))
    return found.distinct()


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``keep`` columns and ``fp``, the fingerprint as a signed long."""

    def run(texts: list[bytes | None]):
        return ([_signed(fingerprint(t, shingle)) for t in texts],)

    return annotate(docs, keep, [raw(text)], run, "fp bigint")


def groups(rows: DataFrame, radius: int = RADIUS, in_task: int = IN_TASK) -> DataFrame:
    """``rows`` (with ``doc_id`` and ``fp``) plus ``root``, the least fingerprint, and ``component_id``, the least doc_id reachable.

    ``rows`` is read several times: pass a written table.
    """
    distinct = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    roots = components(links(distinct.select("fp"), radius, in_task)).withColumnRenamed("node", "fp")
    placed = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    # A fingerprint of one document in a component of its own needs no row here.
    named = placed.join(least, "root").where("n > 1 OR root <> fp OR NOT component_id <=> first")
    out = rows.join(named.select("fp", "component_id", "root"), "fp", "left")
    return out.withColumns({"component_id": F.coalesce("component_id", "doc_id"), "root": F.coalesce("root", "fp")})


def _row_key(doc_id: Column, sha: Column) -> Column:
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(sha, F.lit("")))


def deduplicate(docs: DataFrame, text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One document of each group: the least doc_id, NULLs last, then the least SHA-256 of its text; columns as in ``docs``."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("__sha"), text)
    rows = durable(fingerprints(keyed, ["doc_id", "__sha"], text))
    named = groups(rows, radius)
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("doc_id"), F.col("__sha").alias("sha"))
    kept = named.groupBy("root").agg(F.min(order).alias("k")).select(_row_key(F.col("k.doc_id"), F.col("k.sha")).alias("__row_key"))
    # One key for the join and for repeated rows, so that texts are shuffled and sorted once.
    own = docs.withColumn("__row_key", _row_key(F.col("doc_id").cast("long"), F.sha2(text, 256)))
    first = own.join(kept, "__row_key", "left_semi")
    # Repeated rows share id and text: any one of them stays, they differ at most in other columns.
    return first.dropDuplicates(["__row_key"]).select(*[F.col(f"`{c}`") for c in docs.columns])
