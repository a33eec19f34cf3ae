"""Which windows of a sequence can repeat: a lossless filter for repeated passages.

A window is ``window`` consecutive units (bytes or words) of one document. Each window has an anchor: the smallest of the
hashes of its ``gram``-unit pieces, of equal ones the first. Equal windows have equal anchors, so a window whose anchor occurs nowhere else
does not repeat. Neighbouring windows mostly share their anchor (the same occurrence of it); such a *run* is sent as one row, about one for
every (window - gram) / 2 units, with a hash of all units it touches.
"""
from __future__ import annotations

import numpy as np

from tickloom.llm.common import mix, powers

#: Units handled at a time, so that the arrays stay in the processor's cache; longer documents are cut with overlap.
SLICE = 1 << 16
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def prefix_sums(units: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash of 64-bit unit values."""
    up, _ = powers(len(units) + 1)
    out = np.empty(len(units) + 1, np.uint64)
    out[0] = 0
    np.cumsum(units * up[:len(units)], out=out[1:])
    return out


def stretch_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the units in [start, end), the length included."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def anchor_of(sums: np.ndarray, count: int, window: int, gram: int) -> int:
    """Start of the anchor that the first ``count`` windows share: the first smallest piece that all of them hold."""
    _, down = powers(len(sums))
    at = np.arange(count - 1, window - gram + 1)
    return count - 1 + int(mix((sums[at + gram] - sums[at]) * down[at]).argmin())


def _slice_runs(units: np.ndarray, offsets: np.ndarray, window: int, gram: int):
    n, w = len(units), window - gram + 1
    if n < window:
        return None
    sums = prefix_sums(units)
    _, down = powers(n + 1)
    grams = low = mix((sums[gram:] - sums[:-gram]) * down[:n - gram + 1])
    size = 1
    while size * 2 <= w:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if w > size:
        low = np.minimum(low[:-(w - size)], low[w - size:])
    valid = np.zeros(n + 1, np.int64)  # windows that lie inside one document
    ends = offsets[1:]
    has = ends - offsets[:-1] >= window
    valid[offsets[:-1][has]] += 1
    valid[ends[has] - window + 1] -= 1
    valid = np.cumsum(valid)[:len(low)] > 0
    fresh = valid.copy()
    fresh[1:] &= (low[1:] != low[:-1]) | (grams[:len(low) - 1] == low[:-1]) | ~valid[:-1]  # the anchor changes or is left behind
    fresh[offsets[:-1][has]] = True
    start = np.flatnonzero(fresh)
    if not len(start):
        return None
    last = valid.copy()
    last[:-1] &= fresh[1:] | ~valid[1:]
    count = np.flatnonzero(last) + 1 - start
    return start, count, low[start], stretch_hash(sums, start, start + count + window - 1)


def runs(units: np.ndarray, offsets: np.ndarray, window: int, gram: int):
    """document index, start in the document, number of windows, anchor and hash of every run of many documents."""
    out, at, docs = [], 0, len(offsets) - 1
    while at < docs:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        begin, end = int(offsets[at]), int(offsets[upto])
        step = SLICE * 4
        if upto == at + 1 and end - begin > step:  # one long document, cut so that each window is in one part
            for b in range(begin, end - window + 1, step):
                e = min(end, b + step + window - 1)
                if (r := _slice_runs(units[b:e], np.array([0, e - b]), window, gram)) is not None:
                    out.append((np.full(len(r[0]), at), r[0] + (b - begin), *r[1:]))
        else:
            own = offsets[at:upto + 1] - begin
            if (r := _slice_runs(units[begin:end], own, window, gram)) is not None:
                doc = np.searchsorted(own, r[0], "right") - 1
                out.append((doc + at, r[0] - own[doc], *r[1:]))
        at = upto
    if not out:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    return tuple(np.concatenate(c) for c in zip(*out))
