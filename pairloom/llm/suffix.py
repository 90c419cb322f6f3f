"""Suffix arrays by induced sorting (Nong, Zhang and Chan 2009) and permuted common prefixes (Karkkainen, Manzini and Puglisi 2009), with NumPy.

Suffixes are classified by comparing neighbours; leftmost-smaller (LMS) substrings are sorted by an induced pass, named, and
sorted recursively by the suffix array of their names; a last pass induces all suffixes from them. A pass works bucket by bucket:
the entries of a bucket that are known are pushed together to the buckets of the suffixes before them, each once. Alphabets of
over WIDE symbols, as deeper levels have, are scanned entry by entry.
"""

from __future__ import annotations

import numpy as np

WIDE = 400


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of t (integers of at least 0) in ascending order; a suffix that is a prefix of another comes first."""
    if len(t) < 2:
        return np.arange(len(t))
    t = np.concatenate((np.asarray(t, dtype=np.int64) + 1, [0]))
    return _sort(t, int(t.max()) + 1)[1:]


def _narrow(t: np.ndarray, sigma: int) -> np.ndarray:
    """Symbols in two bytes where they fit: sorting these is linear (radix)."""
    return t.astype(np.uint16) if sigma <= 1 << 16 else t


def _classes(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next one (the last, the sentinel, is)."""
    differ = np.flatnonzero(t[:-1] != t[1:])
    less = t[differ] < t[differ + 1]
    return np.concatenate((np.repeat(less, np.diff(np.concatenate(([-1], differ)))), np.ones(len(t) - 1 - differ[-1], dtype=bool)))


def _sort(t: np.ndarray, sigma: int) -> np.ndarray:
    small = _classes(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) == 1:
        return _induce(t, small, lms, sigma)
    sa = _induce(t, small, lms, sigma)
    mark = np.zeros(len(t), dtype=bool)
    mark[lms] = True
    order = sa[mark[sa]]
    after = np.zeros(len(t), dtype=np.int64)
    after[lms[:-1]], after[lms[-1]] = lms[1:], len(t) - 1
    name = np.zeros(len(t), dtype=np.int64)
    name[order] = np.cumsum(np.concatenate(([False], ~_equal(t, order[:-1], order[1:], after))))
    names = int(name[order[-1]]) + 1
    if names < len(lms):
        order = lms[_sort(name[lms], names)]
    return _induce(t, small, order, sigma)


def _equal(t: np.ndarray, a: np.ndarray, b: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Whether the LMS substrings at a and b are equal, up to and with the next LMS place."""
    n = after[a] - a
    same = n == after[b] - b
    left, k = np.flatnonzero(same), 0
    while len(left):
        bad = t[a[left] + k] != t[b[left] + k]
        same[left[bad]] = False
        k += 1
        left = left[~bad & (n[left] >= k)]
    return same


def _induce(t: np.ndarray, small: np.ndarray, order: np.ndarray, sigma: int) -> np.ndarray:
    """All suffixes, from LMS suffixes in the given order."""
    if sigma > WIDE:
        return _induce_wide(t, small, order, sigma)
    n, size, t = len(t), np.bincount(t, minlength=sigma), _narrow(t, sigma)
    tail = np.cumsum(size)
    head = tail - size
    sa = np.full(n, -1, dtype=np.int64)
    seed = order[np.argsort(t[order], kind="stable")]
    cut = np.searchsorted(t[seed], np.arange(sigma + 1))

    def place(before: np.ndarray, at: np.ndarray, way: int) -> None:
        """Puts places at the free ends of their symbols' buckets, in order."""
        if not len(before):
            return
        c = t[before]
        if len(before) == 1:
            sa[at[c[0]] - (way < 0)] = before[0]
            at[c[0]] += way
            return
        o = np.argsort(c, kind="stable")
        c, before, k = c[o], before[o], np.bincount(c, minlength=sigma)
        rank = np.arange(len(c)) - (np.cumsum(k) - k)[c]
        sa[at[c] + rank if way > 0 else at[c] - 1 - rank] = before
        at += way * k

    def previous(x: np.ndarray, kind: bool) -> np.ndarray:
        x = x[x > 0] - 1
        return x[small[x] == kind]

    low = head.copy()
    for c in range(sigma):
        a = head[c]
        while a < low[c]:
            a, b = low[c], a
            place(previous(sa[b:a], False), low, 1)
        place(previous(seed[cut[c] : cut[c + 1]], False), low, 1)
    high = tail.copy()
    for c in range(sigma - 1, -1, -1):
        b = tail[c]
        while high[c] < b:
            b, a = high[c], b
            place(previous(sa[b:a][::-1], True), high, -1)
        place(previous(sa[head[c] : low[c]][::-1], True), high, -1)
    sa[0] = n - 1
    return sa


def _induce_wide(t: np.ndarray, small: np.ndarray, order: np.ndarray, sigma: int) -> np.ndarray:
    """The same entry by entry, for alphabets with few entries a bucket. Free entries are 0, whose place before is that of the sentinel, which is never placed."""
    n = len(t)
    ends = np.cumsum(np.bincount(t, minlength=sigma))
    starts = np.concatenate(([0], ends[:-1]))
    sa = np.zeros(n, dtype=np.int64)
    k = np.bincount(t[order], minlength=sigma)
    seed = order[np.argsort(t[order], kind="stable")]
    sa[np.arange(len(seed)) + np.repeat(ends - np.cumsum(k), k)] = seed  # at the ends of their buckets
    sa, low = sa.tolist(), starts.tolist()
    larger = np.where(small, -1, t).tolist()
    for p in sa:  # the list grows ahead of the reader
        c = larger[p - 1]
        if c >= 0:
            at = low[c]
            sa[at] = p - 1
            low[c] = at + 1
    smaller = np.where(small, t, -1)
    smaller[-1] = -1
    smaller, high = smaller.tolist(), ends.tolist()
    for p in reversed(sa):
        c = smaller[p - 1]
        if c >= 0:
            at = high[c] = high[c] - 1
            sa[at] = p - 1
    sa[0] = n - 1
    return np.array(sa, dtype=np.int64)


def permuted_lcp(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place, the common prefix of its suffix and the next smaller one.

    Only places where the two suffixes are preceded by different symbols are compared; each other place has one less than the place before it.
    """
    n = len(t)
    if not n:
        return np.zeros(0, dtype=np.int64)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    where = np.arange(n)
    own = np.ones(n, dtype=bool)
    inner = np.flatnonzero((where > 0) & (before > 0))
    own[inner] = t[inner - 1] != t[before[inner] - 1]
    lcp = np.zeros(n, dtype=np.int64)
    left, step = np.flatnonzero(own & (before >= 0)), 16
    line = _narrow(np.concatenate((np.asarray(t, dtype=np.int64), np.zeros(step, dtype=np.int64))), int(t.max()) + 1)
    line = np.lib.stride_tricks.sliding_window_view(line, step)
    while len(left):
        new = []
        for k in range(0, len(left), 1 << 15):
            part = left[k : k + (1 << 15)]
            a, b = part + lcp[part], before[part] + lcp[part]
            differ = line[a] != line[b]
            first = np.where(differ.any(1), differ.argmax(1), step)
            first = np.minimum(first, n - np.maximum(a, b))
            lcp[part] += first
            new.append(part[first == step])
        left = np.concatenate(new)
    last = np.maximum.accumulate(np.where(own, where, 0))
    return lcp[last] - (where - last)


def repeated_starts(t: np.ndarray, length: int) -> np.ndarray:
    """Which places start a string of `length` symbols that starts elsewhere too."""
    sa = suffix_array(t)
    lcp = permuted_lcp(t, sa)
    out = np.zeros(len(t), dtype=bool)
    hit = np.flatnonzero(lcp[sa] >= length)
    out[sa[hit]] = True
    out[sa[hit[hit > 0] - 1]] = True
    return out
