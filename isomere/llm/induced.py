"""Suffix arrays by induced sorting, and permuted common prefixes.

The byte level works on whole buckets at a time with numpy: scanning a bucket
in order and dropping each suffix's predecessor into its bucket is done in
waves, a wave being the part of the bucket filled so far, so equal letters in a
row cost a wave each. The strings of names below are sorted by the same scheme
letter by letter.
"""
from __future__ import annotations

import numpy as np

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S32 = np.uint64(29), np.uint64(32)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two 64-bit hashes, elementwise; the order counts."""
    x = a * M1
    x ^= x >> _S29
    x += b
    x *= M2
    x ^= x >> _S32
    return x


def levels(data: np.ndarray, most: int) -> dict[int, np.ndarray]:
    """Hashes of all substrings of 1, 2, 4, ... ``most`` letters."""
    h, k = mix(data.astype(np.uint64) + np.uint64(1), np.uint64(7)), 1
    out = {1: h}
    while k < most and len(h) > k:
        h = mix(h[:-k], h[k:])
        k *= 2
        out[k] = h
    return out


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the last suffix counts as smaller."""
    n = len(t)
    d = np.ones(n, np.int8)
    d[:-1] = np.sign(t[1:].astype(np.int32) - t[:-1].astype(np.int32))
    at = np.where(d != 0, np.arange(n), n)
    return d[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, letters: int) -> np.ndarray:
    """The suffix array induced from leftmost-smaller suffixes given in order."""
    n = len(t)
    count = np.bincount(t, minlength=letters)
    end = np.cumsum(count)
    start = end - count
    sa = np.full(n, -1, np.int64)
    head, tail = start.copy(), end.copy()
    first = t[lms]
    group = np.argsort(first, kind="stable")
    bounds = np.searchsorted(first[group], np.arange(letters + 1))
    seeds = lms[group]

    def drop(block: np.ndarray, want_small: bool, at: np.ndarray, up: bool) -> None:
        prev = block[block > 0] - 1
        prev = prev[small[prev] == want_small]
        if not len(prev):
            return
        c = t[prev]
        order = np.argsort(c, kind="stable")
        c, prev = c[order], prev[order]
        new = np.flatnonzero(np.diff(c, prepend=-1))
        size = np.diff(np.append(new, len(c)))
        rank = np.arange(len(c)) - np.repeat(new, size)
        if up:
            sa[at[c] + rank] = prev
            at[c[new]] += size
        else:
            sa[at[c] - 1 - rank] = prev
            at[c[new]] -= size

    ts = t.astype(np.int32)
    t = ts
    for c in range(letters):
        lo = start[c]
        while lo < head[c]:
            lo, block = head[c], sa[lo : head[c]]
            drop(block, False, head, True)
        if bounds[c] < bounds[c + 1]:
            drop(seeds[bounds[c] : bounds[c + 1]], False, head, True)
    for c in range(letters - 1, -1, -1):
        hi = end[c]
        while hi > tail[c]:
            hi, block = tail[c], sa[tail[c] : hi][::-1]
            drop(block, True, tail, False)
        if start[c] < head[c]:
            drop(sa[start[c] : head[c]][::-1], True, tail, False)
    sa[0] = n - 1  # the sentinel is nobody's predecessor
    return sa


def _names(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the leftmost-smaller substrings by position, equal ones alike; their number."""
    n = len(t)
    length = np.empty(n, np.int64)
    length[lms] = np.append(np.diff(lms), 1)
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    live, k = np.flatnonzero(same), 0
    while len(live):
        equal = t[a[live] + k] == t[b[live] + k]
        same[live[~equal]] = False
        live = live[equal & (k < length[a[live]])]
        k += 1
    name = np.empty(n, np.int64)
    name[order] = np.concatenate([[0], np.cumsum(~same)])
    return name[lms], int(name[order[-1]]) + 1


def sort_names(s: list[int], letters: int) -> list[int]:
    """Suffix array of a list of names by induced sorting; the last name is the smallest and unique."""
    n = len(s)
    if n < 2:
        return list(range(n))
    small = bytearray(n)
    small[n - 1] = 1
    for i in range(n - 2, -1, -1):
        a, b = s[i], s[i + 1]
        if a < b or a == b and small[i + 1]:
            small[i] = 1
    count = [0] * (letters + 1)
    for c in s:
        count[c + 1] += 1
    for c in range(letters):
        count[c + 1] += count[c]
    lms = [i for i in range(1, n) if small[i] and not small[i - 1]]

    def induce(seeds: list[int]) -> list[int]:
        sa = [-1] * n
        at = count[1:]
        for i in reversed(seeds):
            c = s[i]
            at[c] -= 1
            sa[at[c]] = i
        at = count[:-1]
        for i in sa:
            if i > 0 and not small[i - 1]:
                c = s[i - 1]
                sa[at[c]] = i - 1
                at[c] += 1
        at = count[1:]
        for k in range(n - 1, -1, -1):
            i = sa[k]
            if i > 0 and small[i - 1]:
                c = s[i - 1]
                at[c] -= 1
                sa[at[c]] = i - 1
        return sa

    sa = induce(lms)
    mark = bytearray(n)
    for i in lms:
        mark[i] = 1
    order = [i for i in sa if mark[i]]
    stop = {a: b for a, b in zip(lms, lms[1:], strict=False)}
    stop[n - 1] = n - 1
    name, k, before = {}, -1, None
    for i in order:
        piece = s[i : stop[i] + 1]
        if piece != before:
            k += 1
        before, name[i] = piece, k
    if k + 1 == len(lms):
        return induce(order)
    return induce([lms[i] for i in sort_names([name[i] for i in lms], k + 1)])


def suffix_array(t: np.ndarray, letters: int) -> np.ndarray:
    """Suffix array of ``t``, whose last letter 0 occurs nowhere else."""
    if len(t) < 3:
        return np.arange(len(t))[::-1].copy()
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sa = _induce(t, small, lms, letters)
    mark = np.zeros(len(t), bool)
    mark[lms] = True
    order = sa[mark[sa]]
    name, kinds = _names(t, lms, order)
    if kinds < len(lms):
        order = lms[np.array(sort_names(name.tolist(), kinds), np.int64)]
    return _induce(t, small, order, letters)


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int = 200, stride: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """For each position the suffix before it in the array (-1 for the first) and the length of their common prefix, up to ``most``.

    In text order a prefix is at most one letter shorter than the one before.
    Every ``stride``-th position is walked from its start, ``stride`` letters
    beyond ``most``; the others begin where the last walked one says that they
    agree, so positions within long repeats are not read again. Letters
    themselves are compared, four at a time.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    width = 4
    # the last letter stands nowhere else, so what lies behind it is never compared as equal
    padded = np.concatenate([t.astype(np.uint16), np.zeros(most + stride + width, np.uint16)])
    words = np.ndarray((len(padded) - width + 1,), np.uint64, padded.data, 0, (2,)).copy()

    def walk(i: np.ndarray, done: np.ndarray, limit: int) -> np.ndarray:
        j = phi[i]
        live = np.flatnonzero((j >= 0) & (done < limit))
        while len(live):
            same = words[i[live] + done[live]] == words[j[live] + done[live]]
            done[live[same]] += width
            live = live[same]
            live = live[done[live] < limit]
        rest = np.flatnonzero((j >= 0) & (done < limit))
        for _ in range(width - 1):
            rest = rest[padded[i[rest] + done[rest]] == padded[j[rest] + done[rest]]]
            done[rest] += 1
        return np.minimum(done, limit)

    at = np.arange(0, n, stride)
    out = np.zeros(n, np.int64)
    out[at] = walk(at, np.zeros(len(at), np.int64), most + stride)
    other = np.flatnonzero(np.arange(n) % stride)
    known = np.minimum(most, np.maximum(0, out[other // stride * stride] - other % stride))
    out[other] = walk(other, known, most)
    return phi, np.minimum(out, most)
