"""Simple-8b: a 64-bit word holds a selector (4 bits) and as many ids as fit in 60 bits.

Selectors 2 to 15 pack 60, 30, 20, ... 1 ids of 1, 2, 3, ... 60 bits. Selector 0
is an escape: the next word is one raw 64-bit id. Selector 1 is not used.
"""

from __future__ import annotations

import numpy as np

COUNTS = np.array([1, 0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
_ORDER = range(2, 16)
SEGMENT = 2048


def _selectors(ids: np.ndarray) -> np.ndarray:
    """For each position the selector that packs most ids from there on."""
    n = ids.size
    best = np.zeros(n, np.int8)
    open_ = np.arange(n)
    for s in _ORDER:
        c, limit = int(COUNTS[s]), np.uint64(1) << np.uint64(BITS[s])
        wide = np.flatnonzero(ids >= limit)
        if n - wide.size < min(c, n):
            continue
        # distance from each open position to the next id that does not fit
        nxt = np.append(wide, n + 60)
        if wide.size:
            run = nxt[np.searchsorted(wide, open_)] - open_
            ok = run >= c
            best[open_[ok]] = s
            open_ = open_[~ok]
        else:
            best[open_] = s
            open_ = open_[:0]
        if not open_.size:
            break
    return best


def pack(ids: np.ndarray) -> np.ndarray:
    """The words (uint64) for ids (any unsigned integers below 2**64)."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = ids.size
    if not n:
        return np.empty(0, np.uint64)
    if int(ids.max()) < 1 << 20:
        best = _narrow(ids)
    else:
        best = _selectors(ids)
    starts = _chain(COUNTS[best])
    sel = best[starts].astype(np.int64)
    words_per = np.where(sel == 0, 2, 1)
    place = np.cumsum(words_per) - words_per
    out = np.zeros(int(words_per.sum()), np.uint64)
    padded = np.concatenate([ids, np.zeros(60, np.uint64)])
    for s in np.unique(sel):
        at = starts[sel == s]
        if s == 0:
            out[place[sel == 0] + 1] = ids[at]
            continue
        word = np.full(at.size, np.uint64(s) << np.uint64(60))
        for j in range(int(COUNTS[s])):
            word |= padded[at + j] << np.uint64(j * BITS[s])
        out[place[sel == s]] = word
    return out


def _chain(step: np.ndarray) -> np.ndarray:
    """The positions reached from 0 when position p leads to p + step[p].

    All runs of SEGMENT positions are walked at once, each from its own start; then each
    run's true entry is followed until it meets that walk, which it does after a few words.
    """
    n = step.size
    begin = np.arange(0, n, SEGMENT)
    stop = np.minimum(begin + SEGMENT, n)
    hit = np.zeros(n, bool)
    leave = begin.copy()
    live, at = np.arange(begin.size), begin
    while live.size:
        hit[at] = True
        at = at + step[at]
        inside = at < stop[live]
        if not inside.all():
            leave[live[~inside]] = at[~inside]
            live, at = live[inside], at[inside]
    p = 0
    for lo, hi, out in zip(begin.tolist(), stop.tolist(), leave.tolist(), strict=True):
        own = []
        while p < hi and not hit[p]:
            own.append(p)
            p += int(step[p])
        hit[lo : min(p, hi)] = False
        hit[own] = True
        if p < hi:
            p = out
    return np.flatnonzero(hit)


def _narrow(ids: np.ndarray) -> np.ndarray:
    """_selectors for ids below 2**20, of which three or more always fit; the tail is padded with zeros."""
    small = ids.astype(np.uint32)
    n = small.size
    best = np.full(n, 13, np.int8)
    for s in range(12, 1, -1):
        c = int(COUNTS[s])
        fits = small < (1 << int(BITS[s]))
        if np.count_nonzero(fits) < min(c, n):
            break
        run = np.append(fits, np.ones(c - 1, bool))
        width = 1
        while width < c:  # run[i]: the next width ids fit
            step = min(width, c - width)
            run = run[: run.size - step] & run[step:]
            width += step
        run = run[:n]
        if not run.any():  # nor will longer runs of narrower ids
            break
        best[run] = s
    return best


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The n ids that pack() put into words."""
    words = np.ascontiguousarray(words, np.uint64)
    if not n:
        return np.empty(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    if (sel == 0).any():  # a raw word follows an escape; its own top bits mean nothing
        raw = np.zeros(words.size, bool)
        for i in np.flatnonzero(sel == 0):
            if not raw[i]:
                raw[i + 1] = True
        escape = (sel == 0) & ~raw
        value = np.append(words[1:], np.uint64(0))
        keep = ~raw
        words, sel = np.where(escape, value, words)[keep], np.where(escape, 0, sel)[keep]
    counts = COUNTS[sel]
    place = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.uint64)
    for s in np.unique(sel):
        at, w = place[sel == s], words[sel == s]
        if s == 0:
            out[at] = w
            continue
        mask = (np.uint64(1) << np.uint64(BITS[s])) - np.uint64(1)
        for j in range(int(COUNTS[s])):
            out[at + j] = (w >> np.uint64(j * BITS[s])) & mask
    return out[:n]
