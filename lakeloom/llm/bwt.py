"""Column-wise construction of the Burrows-Wheeler transform and the common prefixes of many strings.

One symbol of every string is inserted a round, from the last to the first: the suffix that grew in the round before stands in row p
of the sorted suffixes so far, its next symbol c sends the longer suffix to row C[c] + rank_c(p), and common prefixes of
new neighbours are one more than the least between the rows they come from. The transform, the common prefixes and the rows'
owners lie in files of their own, which a round reads once and writes once from front to back."""

from __future__ import annotations

import tempfile

import numpy as np


class _File:
    """An array in a file, read and written as a whole from front to back. The file stays open and only grows: one that is cut to
    nothing and written anew each round has its blocks sent to the disk at every close."""

    def __init__(self, dtype) -> None:
        self.file, self.dtype = tempfile.TemporaryFile(buffering=0), dtype

    def read(self) -> np.ndarray:
        self.file.seek(0)
        return np.fromfile(self.file, self.dtype)

    def write(self, x: np.ndarray) -> None:
        self.file.seek(0)
        x.astype(self.dtype, copy=False).tofile(self.file)

    def __enter__(self) -> "_File":
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def _merged(old: np.ndarray, at: np.ndarray, new: np.ndarray) -> np.ndarray:
    """old with the values of new at the rows `at` (sorted) of the result."""
    out = np.empty(len(old) + len(new), old.dtype)
    keep = np.ones(len(out), bool)
    keep[at] = False
    out[at] = new
    out[keep] = old
    return out


def build(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of strings raw[off[i]:off[i + 1]] (bytes above 0, up to 254 of them): for each suffix, in order (equal ones by string), the
    symbol before it (0 at a string's start), the common prefix with the suffix before, its string and its length."""
    n = len(off) - 1
    size = np.diff(off)
    with _File(np.uint8) as bwt, _File(np.uint8) as lcp:
        # rows 0 to n - 1 are the empty suffixes
        last = np.zeros(n, np.uint8)
        last[size > 0] = raw[off[1:][size > 0] - 1]
        bwt.write(last)
        lcp.write(np.zeros(n, np.uint8))
        live, source, symbol = np.flatnonzero(size > 0), np.flatnonzero(size > 0), last[size > 0]
        done = 0
        while len(live):
            b, l = bwt.read(), lcp.read()
            order = np.argsort(b, kind="stable")  # rows by symbol; a row's place among them is that of the longer suffix
            bounds = np.r_[0, np.cumsum(np.bincount(b, minlength=256))]
            by = np.argsort(symbol, kind="stable")  # sources are sorted, so this sorts by place
            live, source, symbol = live[by], source[by], symbol[by]
            k = np.empty(len(source), np.int64)
            cut = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1], True])
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                lo, hi = bounds[symbol[i]], bounds[symbol[i] + 1]
                k[i:j] = lo + np.searchsorted(order[lo:hi], source[i:j])
            done += 1
            at = n + k - bounds[1]
            # common prefixes: with the row before, and of the row after with this one
            joined = k > bounds[symbol]
            mine = np.zeros(len(k), np.uint8)
            mine[joined] = 1 + _least(l, order[k[joined] - 1], source[joined])
            follows = k + 1 < bounds[symbol.astype(np.int64) + 1]
            theirs = 1 + _least(l, source[follows], order[k[follows] + 1])
            now = _merged(l, at, mine)
            now[at[follows] + 1] = theirs
            # a new row's own predecessor may be new as well; its prefix was reckoned from the same sources
            lcp.write(now)
            longer = size[live] > done
            symbol = np.zeros(len(live), np.uint8)
            symbol[longer] = raw[off[1:][live[longer]] - done - 1]
            bwt.write(_merged(b, at, symbol))
            live, source, symbol = live[longer], at[longer], symbol[longer]
        b, l = bwt.read(), lcp.read()
    # from each empty suffix on, rows of longer suffixes of the same string follow by symbol and rank
    order = np.argsort(b, kind="stable")
    step = np.full(len(b), -1)
    zeros = int((b == 0).sum())
    step[order[zeros:]] = n + np.arange(len(b) - zeros)
    string, length = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
    live, row, done = np.arange(n), np.arange(n), 0
    while len(live):
        string[row], length[row] = live, done
        row, done = step[row], done + 1
        live, row = live[row >= 0], row[row >= 0]
    return b[n:], l[n:], string[n:], length[n:]


def _least(l: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The least of l over rows a + 1 to z, for each a and z, with a below z."""
    if not len(a):
        return np.zeros(0, np.uint8)
    by = np.argsort(z)
    got = np.empty(len(a), np.uint8)
    got[by] = np.minimum.reduceat(np.append(l, np.uint8(0)), np.stack([a[by] + 1, z[by] + 1], 1).ravel())[::2]
    return got
