"""Periodic runs against trying every period at every place."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsegate.llm import periodic_runs as P
from pulsegate.llm.queries import op13_periodic_runs, planted_period


def by_hand(w):
    """(start, length, period) of all runs."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(6, 4 * q) and not any(w[s + d : e] == w[s : e - d] for d in range(1, q)):
                out.append((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def solved(words):
    """Runs by tiles, stitched in Python."""
    out, open_ = [], {}
    pieces = [(q, s + at, e + at) for o, at, ids, b in P.tiles(words) for q, s, e in P.solve(np.frombuffer(ids, np.int32).tolist(), o, b)]
    for q, s, e in sorted(pieces):
        if q in open_ and s + q <= open_[q][1]:
            open_[q][1] = max(open_[q][1], e)
            continue
        if q in open_:
            out.append((open_[q][0], open_[q][1] - open_[q][0], q))
        open_[q] = [s, e]
    out += [(s, e - s, q) for q, (s, e) in open_.items()]
    return sorted((r for r in out if r[1] >= max(6, 4 * r[2])), key=lambda r: (r[0], r[2]))


STRETCH = st.tuples(st.lists(st.sampled_from([b"a", b"b"]), min_size=1, max_size=9), st.integers(1, 60)).map(lambda t: (t[0] * 60)[: t[1]])


@settings(max_examples=400, deadline=None)
@given(st.lists(STRETCH, max_size=5), st.sampled_from([4, 16, 64, 4096]), st.integers(0, 7))
def test_tiles(stretches, tile, shift):
    words = [w for s in stretches for w in s]
    held, P.TILE = P.TILE, tile
    try:
        want = by_hand(words)
        assert solved(words) == want
    finally:
        P.TILE = held
    if want:
        ids = np.concatenate([-100 - np.arange(shift), P._word_ids(words, {}), [-1]])
        assert any(len(at) for _, at in P.boundaries(ids, len(words), strict=True))


def test_long_period():
    rng = random.Random(1)
    words = [b"%d" % rng.randint(0, 5000) for _ in range(60_000)]
    words[1000:41_000] = (words[1000:8000] * 6)[:40_000]
    assert solved(words) == [(1000, 40_000, 7000)]
    assert solved([b"x"] * 20_000) == [(0, 20_000, 1)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    unit = [["".join(rng.choice("abcd") for _ in range(3)) for _ in range(rng.randint(1, 40))] for _ in range(60)]
    out = [" ".join(u[:5] + u * rng.randint(1, 7) + u[:3] + ["end"]) for u in unit]
    return [(i, t) for i, t in enumerate(out)] + [(70, out[0]), (70, out[0]), (70, out[1]), (None, "x " * 9), (None, None), (71, ""), (72, "a b"), (73, "x\x0by\x0cx y\tx y\rx y \x1c")]


def want(doc_id, text):
    words = planted_period((text or "").encode().split(), doc_id)
    runs = by_hand(words)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    left = b" ".join(w for i, w in enumerate(words) if i not in drop)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, hashlib.sha256(listed).hexdigest(), hashlib.sha256(left).hexdigest())


def test_query(spark, texts, tmp_path):
    df = spark.createDataFrame([(i, t, 5) for i, t in texts], "doc_id long, text string, runs int").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op13_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((want(i, t) for i, t in texts), key=repr)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in texts if i is not None)


def test_stitched_over_tiles(spark, monkeypatch):
    """Tiles of one long run are solved apart and come back as one run; clashing names do no harm."""
    words = [f"w{i % 700}" for i in range(30_000)]
    df = spark.createDataFrame([(1, " ".join(words), "k")], "doc_id long, text string, key string")
    out = P.find_runs(df, ["doc_id"]).first()
    assert [tuple(r) for r in out["runs"]] == [(0, 30_000, 700)]
    assert out["collapsed_sha256"] == hashlib.sha256(" ".join(words[:700]).encode()).hexdigest()
