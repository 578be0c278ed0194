"""Near copies: families that only hang together by their original, buckets solved in blocks, nothing left behind."""

from __future__ import annotations

import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegate.llm import near_copies as N
from pulsegate.llm.common import annotate, raw
from pulsegate.llm.components import components
from pulsegate.session import Scratch, checkpoint_dir
from tests.llm.conftest import prose


def families(seed: int) -> list[str]:
    """Originals with copies that are similar to them, hardly to each other."""
    rng = random.Random(seed)
    out = []
    for n, copies, changes in ((100, 40, 2), (60, 12, 1), (200, 25, 5)):
        base = prose(rng, n).split()
        out.append(" ".join(base))
        for _ in range(copies):
            words = list(base)
            for at in rng.sample(range(n), changes):
                words[at] = prose(rng, 1)
            out.append(" ".join(words))
    rng.shuffle(out)
    return out


def groups(texts: list[str]) -> set[frozenset[int]]:
    sets = [set(N.shingles(t.encode()).tolist()) for t in texts]
    group = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
            group = [group[i] if g == group[j] else g for g in group]
    return {frozenset(i for i, g in enumerate(group) if g == k) for k in set(group)}


@pytest.mark.parametrize("block", [8, 1024])
def test_families(spark, block):
    texts = families(3)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")

    def run(found):
        own = [N.shingles(t) for t in found]
        signs = [N.signature(v) for v in own]
        return [N.bands(s) for s in signs], [(s >> np.uint64(48)).astype(np.uint16).tobytes() for s in signs], [len(v) for v in own]

    with Scratch(spark) as write:
        rows = write(annotate(df, ["id"], [raw()], run, "keys array<bigint>, signature binary, n_own bigint"))
        roots = dict(tuple(r) for r in components(N.links(df, rows, write, block=block), write).collect())
        folder = write.root.removeprefix("file:")
        assert os.path.isdir(folder)
    assert not os.path.exists(folder)
    placed = {}
    for i in range(len(texts)):
        placed.setdefault(roots.get(i, i), set()).add(i)
    assert {frozenset(g) for g in placed.values()} == groups(texts)


def member(i, text, root=None, part=0):
    values = N.shingles(text.encode())
    sign = (N.signature(values) >> np.uint64(48)).astype(np.uint16).tobytes()
    return {"id": i, "root": i if root is None else root, "part": part, "signature": sign, "shingles": N.short(values).tobytes()}


def test_block_links_are_few_and_enough():
    texts = families(4)
    found = N.block_links([member(i, t) for i, t in enumerate(texts)], False, 0.8)
    want = groups(texts)
    assert len(found) == len(texts) - len(want)
    assert all(any(a in g and b in g for g in want) for a, b in found)
    # Members of one part are not compared when parts are crossed.
    same = [member(0, texts[0], part=0), member(1, texts[0], part=0), member(2, texts[0], part=1)]
    assert len(N.block_links(same, True, 0.8)) == 2 and N.block_links(same[:2], True, 0.8) == []


def test_clashing_names_and_repeated_rows(spark):
    rows = [(5, "a b c d e f", 1, 2), (5, "a b c d e f", 1, 2), (4, "a b c d e f", 3, 4), (None, "q r s t u v", 5, 6), (None, None, 0, 0), (9, "", 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id int, root int").withColumn("keys", F.lit("k")).withColumn("sha", F.lit("s"))
    kept = N.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(False, 4, "a b c d e f"), (False, 9, ""), (True, 0, "q r s t u v")]
    assert not [f for f in os.listdir(checkpoint_dir(spark).removeprefix("file:")) if f.startswith("scratch-")]


# Five-word similarity 0.8, fingerprints 2 and 3 bits apart, no band of MinHashes in common.
MISSED_BY_BANDS = [
    ("w852 w180 w779 w718 w699 w395 w435 w382 w538 w145 w819 w69", "w916", "w524"),
    ("w663 w82 w994 w470 w480 w968 w399 w486 w97 w992 w270 w594", "w738", "w908"),
]


def test_covering_masks_find_what_bands_miss(spark):
    rows = []
    for i, (base, *last) in enumerate(MISSED_BY_BANDS):
        x, y = (N.shingles(f"{base} {w}".encode()) for w in last)
        assert N.similar(x, y, 0.8) and not set(N.bands(N.signature(x))) & set(N.bands(N.signature(y)))
        rows += [(10 * i + k, f"{base} {w}") for k, w in enumerate(last)]
    kept = N.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 10]


def test_prints_within_the_radius_share_a_cover():
    rng = random.Random(6)
    for _ in range(200):
        value = rng.getrandbits(64)
        other = value
        for bit in rng.sample(range(64), rng.randint(0, N.RADIUS)):
            other ^= 1 << bit
        keys = N.covers(np.uint64(value))
        assert len(set(keys)) == len(keys) == 15
        assert set(keys) & set(N.covers(np.uint64(other)))


def test_close_prints_are_compared_whatever_their_signatures():
    base, *last = MISSED_BY_BANDS[0]
    listed = [member(i, f"{base} {w}") for i, w in enumerate(last)]
    prints = [N.print_of(N.shingles(f"{base} {w}".encode())) for w in last]
    for m, p, other in zip(listed, prints, (0, 7)):
        m["signature"] = bytes([other]) * len(m["signature"]) + p.tobytes()
    assert N.block_links(listed, False, 0.8) == [(0, 1)]
