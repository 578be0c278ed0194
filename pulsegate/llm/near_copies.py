"""Near copies: texts whose sets of word shingles have a Jaccard similarity of ``SIMILARITY`` or more.

Equal texts are one text first.  Candidates come from SimHash: fingerprints of the shingle sets within ``RADIUS``
bits share one of the covering masks of ``simhash``, so no such pair is missed.  A pair at 0.8 differs in some ten
bits of 64, so candidates also share a band of MinHashes: with ``BANDS`` bands of ``ROWS`` hashes a pair at 0.8
shares none with a chance of (1 - 0.8 ** 5) ** 20 = 4e-4, a closer one more rarely.  Every link is verified on
whole shingle sets.  Groups are the connected components of the links.

There are two rounds, whatever the buckets hold.  First, every member of a bucket meets its hub: the
member whose buckets are largest in sum, as an original shares more bands with its copies than they share
with each other.  Second, only buckets left with several groups are solved, ``BLOCK`` members against ``BLOCK`` members in
a task: a union-find passes over pairs of different groups, those nearest to the bucket's common
signature first, and verifies pairs whose fingerprints are within ``RADIUS`` bits or whose signatures agree in
``LIKELY`` of the hashes (a pair at 0.8 does not with a chance of 2e-4).  A task gives at most one link per member; no list of pairs is made.

Edge cases.  Texts of fewer words than a shingle are one shingle; NULL, empty and wordless texts are
alike.  NULL doc_ids come last in the choice of the document that stays.  Repeated rows are one document.  Columns
may have any names: internal ones are kept apart.  Texts are told apart by SHA-256; texts whose 64-bit ids
collide are left alone.  Verified sets hold 32-bit hashes of shingles, which two sets of n shingles share by
chance n * n / 2 ** 32 of.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegate.llm.common import annotate, raw, sized_broadcast
from pulsegate.llm.components import components
from pulsegate.llm.simhash import RADIUS, _row_key, majority, masks
from pulsegate.session import Scratch, durable

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 5
LIKELY = 0.65
BLOCK = 1024
# Rows of two integers that are sent to the other side of a join; beyond, both sides are shuffled.
SENT = 500_000
_SEED = 42
_CHUNK = 1 << 11
_DRAWN = np.random.default_rng(_SEED).integers(0, 1 << 64, size=(3, BANDS * ROWS), dtype=np.uint64)
_FLIPS, _FACTORS, _MIXERS = _DRAWN[0][:, None], (_DRAWN[1] | np.uint64(1))[:, None], _DRAWN[2].reshape(BANDS, ROWS) | np.uint64(1)

_MASKS = np.array(masks(), dtype=np.int64).view(np.uint64)
_SALTS, _SPREAD = np.random.default_rng(_SEED + 1).integers(0, 1 << 64, size=(2, len(_MASKS)), dtype=np.uint64)


def shingles(data: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of lower-cased words; one shingle at least."""
    words = data.lower().split() if data else []
    n = max(1, len(words) - size + 1)
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((hashed(b" ".join(words[i : i + size]), _SEED) for i in range(n)), np.uint64, n))


def short(values: np.ndarray) -> np.ndarray:
    """Sorted 32-bit hashes of a set."""
    return np.unique((values >> np.uint64(32)).astype(np.uint32))


def signature(values: np.ndarray) -> np.ndarray:
    """MinHashes of a set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(values), _CHUNK):
        np.minimum(least, ((values[at : at + _CHUNK] ^ _FLIPS) * _FACTORS).min(axis=1), out=least)
    return least


def bands(least: np.ndarray) -> list[int]:
    """One key per band, which texts of equal MinHashes in it share; keys of different bands differ."""
    mixed = least.reshape(BANDS, ROWS)
    mixed = ((mixed ^ (mixed >> np.uint64(32))) * _MIXERS).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    return (mixed ^ (mixed >> np.uint64(29))).view(np.int64).tolist()


def print_of(values: np.ndarray) -> np.uint64:
    """SimHash of a set."""
    return np.uint64(majority(values.astype(">u8")))


def covers(fingerprint: np.uint64) -> list[int]:
    """One key per covering mask; fingerprints within ``RADIUS`` bits share one, keys of different masks differ."""
    mixed = ((fingerprint & _MASKS) ^ _SALTS) * (_SPREAD | np.uint64(1))
    return (mixed ^ (mixed >> np.uint64(29))).view(np.int64).tolist()


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets are similar enough."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
        return False
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= similarity * (len(x) + len(y) - shared) - 1e-9


def block_links(members: list[dict], cross: bool, similarity: float) -> list[tuple[int, int]]:
    """Verified links that join all similar members ``id, root, part, signature, shingles`` of different roots.

    With ``cross`` only members of different ``part`` are compared.  A fingerprint may follow the MinHashes of a signature.
    """
    signs = np.array([np.frombuffer(m["signature"], np.uint16) for m in members])
    signs, prints = np.hsplit(signs, [BANDS * ROWS])
    common = np.array([v[np.argmax(n)] for v, n in (np.unique(c, return_counts=True) for c in signs.T)])
    order = np.argsort(-(signs == common).sum(axis=1), kind="stable")
    members, signs, prints = [members[i] for i in order], signs[order], prints[order]
    part = np.array([m["part"] for m in members])
    names = {r: i for i, r in enumerate(dict.fromkeys(m["root"] for m in members))}
    # group[i] is kept flat: joining two groups relabels the members of one.
    group = np.array([names[m["root"]] for m in members])
    sets: dict[int, np.ndarray] = {}

    def own(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = np.frombuffer(members[i]["shingles"], np.uint32)
        return sets[i]

    found = []
    for i in range(len(members) - 1):
        near = (signs[i + 1 :] == signs[i]).sum(axis=1) >= LIKELY * signs.shape[1]
        if prints.shape[1]:
            near |= np.bitwise_count(prints[i + 1 :] ^ prints[i]).sum(axis=1) <= RADIUS
        near &= group[i + 1 :] != group[i]
        if cross:
            near &= part[i + 1 :] != part[i]
        for j in i + 1 + np.flatnonzero(near):
            if group[i] != group[j] and similar(own(i), own(j), similarity):
                found.append((members[i]["id"], members[j]["id"]))
                group[group == group[j]] = group[i]
        if (group == group[0]).all():
            break
    return found


def _of(rows: DataFrame, wanted: DataFrame, *columns: str) -> DataFrame:
    """One row ``id, *columns`` per ``id`` of the written table ``wanted``; few ids are sent to the rows."""
    met = rows.join(sized_broadcast(wanted, SENT), "id", "left_semi")
    return met.groupBy("id").agg(*[F.first(c).alias(c) for c in columns])


def _starred(star: DataFrame, texts: DataFrame, write, similarity: float) -> DataFrame:
    """The pairs member a, hub b that are similar; a text moves once to its pairs and once to its hub."""

    def run(left: list[bytes], right: list[bytes]):
        alike, last, hub = [], None, None
        for x, y in zip(left, right):
            if y != last:
                last, hub = y, short(shingles(y))
            alike.append(similar(short(shingles(x)), hub, similarity))
        return (alike,)

    ids = star.select(F.col("a").alias("id")).union(star.select(F.col("b").alias("id")))
    distinct = _of(texts, write(ids.distinct()), "text")
    own = star.join(distinct.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
    both = own.join(distinct.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    return annotate(both, ["a", "b"], [raw("x"), raw("y")], run, "alike boolean").where("alike").select("a", "b")


def links(texts: DataFrame, rows: DataFrame, write, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Verified links a, b; ``texts`` has ``id, text``, ``rows`` ``id, keys, signature, n_own``; copies of a text share an id.

    ``write`` keeps a table that several steps read.
    """
    keyed = rows.select("id", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
    shared = write(sizes.where("low <> high").select("key", "n"))
    members = write(keyed.join(sized_broadcast(shared, SENT), "key").distinct())
    marked = write(_of(rows, write(members.select("id").distinct()), "signature", "n_own"))
    central = members.groupBy("id").agg(F.sum("n").alias("degree")).join(marked.select("id", "n_own"), "id")
    placed = members.select("key", "id").join(central, "id")
    best = placed.groupBy("key").agg(F.max(F.struct("degree", F.bitwise_not("id").alias("back"), "id", "n_own")).alias("hub"))
    star = placed.join(best, "key").where("id <> hub.id").select(
        F.col("id").alias("a"), F.col("hub.id").alias("b"), F.col("n_own").alias("n_a"), F.col("hub.n_own").alias("n_b")
    )
    fits = F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-9
    first = write(_starred(write(star.where(fits).select("a", "b").distinct()), texts, write, similarity))

    roots = components(first, write).withColumnRenamed("node", "id")
    rooted = write(members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")))
    split = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("n").alias("size")).where("low <> high")
    blocks = F.ceil(F.col("size") / block).cast("int")
    open_ = write(rooted.join(split.select("key", blocks.alias("blocks")), "key").select("key", "id", "root", "blocks"))

    def numbered(ts: list[bytes]):
        return ([short(shingles(t)).tobytes() for t in ts],)

    sets = annotate(_of(texts, write(open_.select("id").distinct()), "text"), ["id"], [raw()], numbered, "shingles binary")
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int")
    whole = open_.withColumn("part", part).join(sets, "id").join(marked.select("id", "signature"), "id")
    # Every member meets each part of its bucket in one group of two parts.
    spread = whole.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    member = F.struct("id", "root", "part", "signature", "shingles")
    groups = spread.groupBy("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")).agg(F.collect_list(member).alias("members"))

    def solve(listed: list[list[dict]], crossed: list[bool]):
        return ([[{"a": a, "b": b} for a, b in block_links(m, c, similarity)] for m, c in zip(listed, crossed)],)

    second = annotate(groups, [], [F.col("members"), F.col("low") != F.col("high")], solve, "links array<struct<a:bigint,b:bigint>>")
    return first.union(write(second.select(F.inline("links")))).distinct()


def deduplicate(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY, bound: int = 200_000) -> DataFrame:
    """One document of each group: the least doc_id, NULLs last, then the least SHA-256 of its text; columns as in ``docs``."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    sha = F.sha2(body, 256)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), sha.alias("sha"), F.xxhash64(sha).alias("id"), body.alias("text"))

    def run(texts: list[bytes]):
        own = [shingles(t) for t in texts]
        signs, prints = [signature(v) for v in own], [print_of(v) for v in own]
        tops = [(s >> np.uint64(48)).astype(np.uint16).tobytes() + p.tobytes() for s, p in zip(signs, prints)]
        return [bands(s) + covers(p) for s, p in zip(signs, prints)], tops, [len(v) for v in own]

    with Scratch(docs.sparkSession) as write:
        rows = write(annotate(named, ["doc_id", "sha", "id"], [raw()], run, "keys array<bigint>, signature binary, n_own bigint"))
        second = F.xxhash64(F.lit(1), "sha")
        clashes = write(rows.groupBy("id").agg(F.min(second).alias("low"), F.max(second).alias("high")).where("low <> high").select("id"))
        clash = sized_broadcast(clashes, SENT)
        alike = links(named.select("id", "text"), rows.join(clash, "id", "left_anti"), write, similarity)
        roots = write(components(alike, write).withColumnRenamed("node", "id"))
        placed = rows.select("doc_id", "sha", "id").join(sized_broadcast(roots, SENT), "id", "left")
        placed = placed.join(clash.withColumn("clash", F.lit(True)), "id", "left")
        # A text without links is a group of its own.
        group = F.when(F.col("clash"), F.xxhash64(F.lit(2), "sha")).otherwise(F.coalesce("root", "id"))
        order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("doc_id"), F.col("sha").alias("sha"))
        placed = write(placed.select(group.alias("group"), _row_key(F.col("doc_id"), F.col("sha")).alias("__row_key"), order.alias("k")))
        several = placed.groupBy("group").agg(F.min("k").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        stays = placed.join(sized_broadcast(write(several), bound), "group").select("__row_key", F.col("k").eqNullSafe(F.col("least")).alias("stays"))
        keys = durable(stays.groupBy("__row_key").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n")).where("NOT stays OR n > 1"))
    own = docs.withColumn("__row_key", _row_key(F.col("doc_id").cast("long"), sha))
    single = own.join(sized_broadcast(keys.select("__row_key"), bound), "__row_key", "left_anti")
    # Repeated rows share id and text: any one of them stays, they differ at most in other columns.
    several = own.join(sized_broadcast(keys.where("stays").select("__row_key"), bound), "__row_key", "left_semi").dropDuplicates(["__row_key"])
    return single.unionByName(several).select(*[F.col(f"`{c}`") for c in docs.columns])
