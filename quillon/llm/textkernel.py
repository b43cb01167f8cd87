"""Words and word shingles of whole Arrow batches as numpy arrays of 64-bit hashes.

A batch's texts lie end to end in one byte buffer. Words are found with byte masks, and a
word's hash comes from prefix sums of a polynomial modulo 2**64, so no Python object is made
for a word. Doc boundaries part words as white space does.
"""

from __future__ import annotations

import numpy as np

#: Odd multiplier of the polynomial, its inverse modulo 2**64, and mixing constants.
MULT = 0x9E3779B97F4A7C15
_INV = pow(MULT, -1, 1 << 64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes over which one set of powers is used.
SLICE = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    n = max(n, SLICE)
    if not _powers or len(_powers[0]) < n + 1:
        out = []
        for base in (MULT, _INV):
            a = np.full(n + 1, np.uint64(base))
            a[0] = 1
            out.append(np.cumprod(a))
        if n > 4 * SLICE:  # one huge word: don't keep its tables
            return out[0], out[1]
        _powers[:] = out
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def word_spans(buf: np.ndarray, offsets: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and first[d]: the index of the first word of text d (len: texts + 1)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~sep[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    st = word.copy()
    st[1:] &= ~word[:-1] | edge[1:-1]
    en = word.copy()
    en[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(st), np.flatnonzero(en) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands."""
    out = np.zeros(len(starts), np.uint64)
    lo = 0
    with np.errstate(over="ignore"):
        while lo < len(starts):
            base = int(starts[lo])
            hi = max(lo + 1, int(np.searchsorted(ends, base + SLICE, "right")))
            top = int(ends[hi - 1])
            p, inv = _power_tables(top - base)
            sums = np.zeros(top - base + 1, np.uint64)
            np.cumsum((buf[base:top].astype(np.uint64) + np.uint64(1)) * p[: top - base], out=sums[1:])
            s, e = starts[lo:hi] - base, ends[lo:hi] - base
            h = (sums[e] - sums[s]) * inv[s]
            out[lo:hi] = mix(h + (e - s).astype(np.uint64) * _MIX2)
            lo = hi
    return out


def shingles(words: np.ndarray, first: np.ndarray, k: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in order and their first[]: with short, a text of fewer
    words has its whole sequence as one shingle."""
    n = len(words)
    counts = np.diff(first)
    with np.errstate(over="ignore"):
        c = [np.uint64(pow(MULT, 3 + 2 * j, 1 << 64)) for j in range(k)]
        run = np.zeros(max(0, n - k + 1), np.uint64)
        for j in range(k):
            run += mix(words[j : n - k + 1 + j] ^ c[j]) * c[j]
        run = mix(run)
        kept = np.maximum(counts - k + 1, 0)
        out_first = np.zeros(len(first), np.int64)
        extra = ((counts > 0) & (counts < k)).astype(np.int64) if short else np.zeros(len(counts), np.int64)
        np.cumsum(kept + extra, out=out_first[1:])
        out = np.zeros(int(out_first[-1]), np.uint64)
        whole = kept > 0
        if whole.any():
            src = np.repeat(first[:-1][whole] - np.concatenate(([0], np.cumsum(kept[whole])[:-1])), kept[whole]) + np.arange(int(kept[whole].sum()))
            dst = np.repeat(out_first[:-1][whole] - np.concatenate(([0], np.cumsum(kept[whole])[:-1])), kept[whole]) + np.arange(int(kept[whole].sum()))
            out[dst] = run[src]
        for d in np.flatnonzero(extra):
            h = np.uint64(counts[d]) * _MIX1
            for j, x in enumerate(words[first[d] : first[d + 1]]):
                h = h + mix(np.asarray(x ^ c[j] ^ _MIX2)) * c[j]
            out[out_first[d]] = mix(np.asarray(h))
    return out, out_first
