"""Suffix arrays by induced sorting, vectorised for one bounded shard of short pieces.

Suffixes are classified S or L; leftmost-smaller (LMS) substrings are sorted by one round of
induction, named, and the reduced string of names is ranked recursively; the whole array follows
by a second induction in linear time.  Induction goes bucket by bucket in numpy: what a bucket
induces into later buckets is moved in one stable step, what it induces into itself in waves,
at most as many as the longest run of one byte.  An induction costs one step per symbol, so the
reduced string, whose alphabet is as large as the shard, is ranked by pairing names instead.
Order is exact to ``depth`` symbols, all that is asked of it.
"""

from __future__ import annotations

import numpy as np

_END, _GAP, _SHIFT = 0, 1, 2


def join_pieces(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all pieces, each closed by a gap, the whole by an end; and where pieces begin."""
    lengths = np.array([len(p) + 1 for p in pieces], dtype=np.int64)
    begins = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(pieces) else np.zeros(0, np.int64)
    text = np.full(int(lengths.sum()) + 1, _GAP, dtype=np.uint16)
    data = np.frombuffer(b"\0".join(pieces) + b"\0", dtype=np.uint8) if pieces else np.zeros(0, np.uint8)
    text[: len(data)] = data.astype(np.uint16) + _SHIFT
    if len(pieces):
        text[begins + lengths - 1] = _GAP
    text[-1] = _END
    return text, begins


def classify(text: np.ndarray) -> np.ndarray:
    """True for S suffixes: smaller than the one that follows; the end is S."""
    n = len(text)
    rises = np.empty(n, dtype=bool)
    rises[:-1] = text[:-1] < text[1:]
    rises[-1] = True
    differs = np.empty(n, dtype=bool)
    differs[:-1] = text[:-1] != text[1:]
    differs[-1] = True
    # A symbol equal to its follower has the type of the next place where symbols differ.
    at = np.where(differs, np.arange(n), n)
    return rises[np.minimum.accumulate(at[::-1])[::-1]]


def _move(sa, free, chars, values, step):
    """Place ``values`` into the buckets of ``chars`` in order; ``free`` are the next free slots."""
    order = np.argsort(chars, kind="stable")
    chars, values = chars[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], chars[1:] != chars[:-1])))
    sizes = np.diff(np.concatenate((first, [len(chars)])))
    rank = np.arange(len(chars)) - np.repeat(first, sizes)
    sa[free[chars] + step * rank] = values
    free[chars[first]] += step * sizes


def _induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Suffix array from LMS suffixes in order."""
    n = len(text)
    sizes = np.bincount(text)
    tails = np.cumsum(sizes)
    heads = tails - sizes
    sa = np.full(n, -1, dtype=np.int32)
    symbols = np.flatnonzero(sizes)
    lms_at = np.searchsorted(text[lms], np.arange(len(sizes) + 1))

    free = heads.copy()
    for c in symbols:
        done = heads[c]
        while done < free[c]:
            own = sa[done : free[c]]
            done = free[c]
            _left(sa, text, own, ~small, free, 1)
        _left(sa, text, lms[lms_at[c] : lms_at[c + 1]], ~small, free, 1)
    large_end = free

    free = tails - 1
    for c in symbols[::-1]:
        done = tails[c] - 1
        while done > free[c]:
            own = sa[free[c] + 1 : done + 1][::-1]
            done = free[c]
            _left(sa, text, own, small, free, -1)
        _left(sa, text, sa[heads[c] : large_end[c]][::-1], small, free, -1)
    sa[0] = n - 1
    return sa


def _left(sa, text, own, wanted, free, step):
    before = own[own > 0] - 1
    before = before[wanted[before]]
    if len(before):
        _move(sa, free, text[before], before, step)


def _names(text: np.ndarray, ordered: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ranks of LMS substrings (to the next LMS place, inclusive) given in sorted order; equal ones share a rank."""
    a, b = ordered[:-1], ordered[1:]
    length = ends[b] - b
    new = np.ones(len(ordered), dtype=bool)
    at, k = np.flatnonzero(ends[a] - a == length), 0
    while len(at):
        at = at[text[a[at] + k] == text[b[at] + k]]
        whole = length[at] == k
        new[at[whole] + 1] = False
        at, k = at[~whole], k + 1
    return np.cumsum(new) - 1


def _rank(names: np.ndarray, symbols: int) -> np.ndarray:
    """Order of the suffixes of the reduced string, exact to ``symbols`` names; recursive by pairs of ranks."""
    distinct = int(names.max()) + 1
    if distinct == len(names) or symbols <= 1:
        return np.argsort(names, kind="stable")
    return _rank_by(names, 1, symbols)


def _rank_by(ranks: np.ndarray, step: int, symbols: int) -> np.ndarray:
    behind = np.zeros(len(ranks), dtype=np.int64)
    behind[:-step] = ranks[step:] + 1
    pairs = ranks.astype(np.int64) * (int(ranks.max()) + 2) + behind
    distinct, joined = np.unique(pairs, return_inverse=True)
    if len(distinct) == len(ranks) or 2 * step >= min(symbols, len(ranks)):
        return np.argsort(joined, kind="stable")
    return _rank_by(joined, 2 * step, symbols)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of ``text`` (see :func:`join_pieces`), exact to ``depth`` symbols."""
    small = classify(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    if len(lms) == 1:
        return _induce(text, small, lms)
    by_symbol = lms[np.argsort(text[lms], kind="stable")]
    first = _induce(text, small, by_symbol)
    is_lms = np.zeros(len(text), dtype=bool)
    is_lms[lms] = True
    ordered = first[is_lms[first]]
    ends = np.zeros(len(text), dtype=np.int32)
    ends[lms[:-1]] = lms[1:]
    ends[lms[-1]] = lms[-1]
    names = np.empty(len(text), dtype=np.int64)
    names[ordered] = _names(text, ordered, ends)
    # An LMS substring has two symbols or more before the next one begins.
    order = _rank(names[lms], depth // 2 + 2)
    return _induce(text, small, lms[order])


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Permuted common prefixes, by place in the text: symbols that ``order[i]`` shares with ``order[i - 1]``, up to ``depth``.

    Places that are not in ``order`` get -1.  All places in ``order`` have ``depth`` symbols left.
    """
    out = np.full(len(text), -1, dtype=np.int16)
    if not len(order):
        return out
    shared = np.zeros(len(order), dtype=np.int16)
    a, b = order[:-1], order[1:]
    # Eight symbols at once, then one by one where a word differs.
    bytes_ = np.where(text >= _SHIFT, text - _SHIFT, 0).astype(np.uint64)
    words = np.zeros(len(text), dtype=np.uint64)
    for i in range(8):
        words[: len(text) - i] |= bytes_[i:] << np.uint64(8 * i)
    at, k = np.arange(len(a)), 0
    while k + 8 <= depth and len(at):
        at = at[words[a[at] + k] == words[b[at] + k]]
        k += 8
        shared[at + 1] = k
    at = np.arange(len(a))
    for _ in range(8):
        here = shared[at + 1].astype(np.int64)
        at, here = at[here < depth], here[here < depth]
        at = at[text[a[at] + here] == text[b[at] + here]]
        shared[at + 1] += 1
    out[order] = shared
    return out
