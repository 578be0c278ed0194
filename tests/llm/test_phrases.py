"""Phrase mining against counting by hand, with tiles, blocks and chunks small enough to meet their edges."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from pulsegate.llm import phrases as P


def by_hand(docs, least, longest=5):
    f, n, out = Counter(), Counter(), {}
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    frequent = {p: a for p, a in f.items() if a >= least}
    for (lang, p), a in frequent.items():
        if len(p) < 2:
            continue
        inside = any(
            lo == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q)))
            for (lo, q), b in frequent.items()
        )
        if inside:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    return sorted(
        (lang, i + 1, p.decode(), -a, left, r, total, -s)
        for lang, found in out.items()
        for i, (s, a, p, left, r, total) in enumerate(sorted(found))
    )


def corpus(seed: int, n: int = 120):
    rng = random.Random(seed)
    words = ["the", "The", "of", "é", "a" * 300, "x-y", "New", "York", "new", "\x00", " b"]
    docs = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 60)):
            parts.append(rng.choice(words) if rng.random() < 0.8 else "new york city hall is")
            parts.append(rng.choice([" ", " ", " ", "\t", "  ", ".", ", ", "\n", "\x0b", " ; "]))
        docs.append(("".join(parts), rng.choice(["en", "de", None, "und"])))
    return [*docs, ("", "en"), (None, None), ("one", "fr"), ("New York " * 500, "en")]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("small", [False, True])
def test_by_hand(spark, monkeypatch, seed, small):
    if small:
        for name, value in {"_CHUNK": 7, "_BLOCK_TOKENS": 5, "_HELD": 3, "TILE": 2, "SIDE": 2, "DENSE": 2, "HEAD": 4, "FILTER_BITS": 64}.items():
            monkeypatch.setattr(P, name, value)
    docs = corpus(seed)
    monkeypatch.setattr(P, "known_symbols", lambda level, known=P.known_symbols: known(level, P.HEAD, P.FILTER_BITS))
    rows = [(t, lang, i) for i, (t, lang) in enumerate(docs)]
    df = spark.createDataFrame(rows, "text string, lang string, f long").repartition(3)
    got = sorted(tuple(r) for r in P.mine(df, least=12).collect())
    assert got == by_hand(docs, 12)
    assert {r[0] for r in got} >= {"en", "de", "und"}


def test_counters_at_edges(monkeypatch):
    """The counting of one task with tiny tiles, blocks and chunks; tasks of the test above run in other processes."""
    import numpy as np
    import pyarrow as pa

    for name, value in {"_CHUNK": 7, "_BLOCK_TOKENS": 5, "_HELD": 3, "TILE": 2, "SIDE": 2, "DENSE": 2, "HEAD": 4}.items():
        monkeypatch.setattr(P, name, value)
    docs = [(t, lang or "und") for t, lang in corpus(3, 40) if t]
    whole = Counter()
    for length in (2, 3, 4):
        want, ids = Counter(), []
        for t, lang in docs:
            words = [x for part in P.tokens(t.encode()) for x in part]
            hashes = [0 if w == P._MARK else P.word_hash(w, P.seed(lang)) for w in words]
            ids += hashes
            for i in range(len(hashes) - length + 1):
                some = np.array(hashes[i : i + length], dtype=np.uint64)
                if (some != 0).all():
                    while len(some) > 2:
                        some = P.joined(some[:-1], some[1:])
                    want[int(some[0]), int(some[1])] += 1
        parts = {x for pair in want for x in pair}
        head = np.array(sorted(parts)[:4], dtype=np.uint64)
        packed = {}
        for x in parts:
            packed[(x & 255) >> 6] = packed.get((x & 255) >> 6, 0) | 1 << (x & 63)
        known = P.Known(np.array(list(packed)), np.array(list(packed.values()), dtype=np.uint64), head, 256)
        counter, got = P.PairCounter(3), Counter()

        def take(found):
            for x, y, c in zip(known.hashed(found[0]), known.hashed(found[1]), found[2]):
                got[int(x), int(y)] += int(c)

        batch = pa.RecordBatch.from_arrays([pa.array([lang for _, lang in docs]), pa.array([t.encode() for t, _ in docs])], names=["lang", "text"])
        for block in P._blocks(iter([batch]), length - 1):
            part, good = P.parts_of(block, length - 1)
            good &= known.maybe(part)
            at, codes = np.flatnonzero(good[:-1] & good[1:]), known.coded(part)
            counter.add(codes[at], codes[at + 1])
            if counter.full():
                for found in counter.coordinates():
                    take(found)
        for found in counter.all():
            take(found)
        assert got == want
        whole += got
    assert whole


def test_large_numbers(spark):
    """Scores are exact where products pass 64 bits."""
    wide = "decimal(19,0)"
    a, n, left, right = 10**12 + 7, 2 * 10**13 + 3, 10**12 + 11, 3 * 10**12 + 1
    row = spark.sql(f"SELECT (cast({a}L as {wide}) * cast(1000 as decimal(4,0)) * cast({n}L as decimal(15,0))) div (cast({left}L as {wide}) * cast({right}L as {wide})) s").first()
    assert row["s"] == 1000 * a * n // (left * right)


def test_empty(spark):
    assert P.mine(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert P.mine(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).count() == 0
