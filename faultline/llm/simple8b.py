"""Simple-8b: runs of integers packed into 64-bit words.

The top four bits of a word select how many values of how many bits fill the
low 60 bits.  A value that needs more than 30 bits is an escape: the word
carries that single value in 60 bits.  Words are grouped into blocks of
``BLOCK`` values; the offsets of the blocks' first words are kept, so that any
block decodes by itself and all of a block's words decode as arrays.
"""

from __future__ import annotations

import numpy as np

#: (values, bits) by selector; the last is the escape
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = len(SELECTORS) - 1
BLOCK = 65_536
_COUNT = np.array([n for n, _ in SELECTORS], np.int64)
#: the fewest bits of a selector that hold a value of so many bits
_WIDTH = np.array([min(b for _, b in SELECTORS if b >= max(n, 1)) for n in range(61)], np.uint8)


def _choices(values: np.ndarray) -> np.ndarray:
    """For each position the selector whose word holds the most values."""
    n = len(values)
    # bits that a selector has to have for a value
    width = _WIDTH[np.minimum(np.frexp(values.astype(np.float64))[1], 60)]  # 2**60 - 1 is rounded up
    counts = np.cumsum(np.bincount(width, minlength=61))
    widest, k = {1: width}, 1  # the largest width among the next k values
    best = np.full(n, ESCAPE, np.uint8)
    for s in range(len(SELECTORS) - 1, -1, -1):
        count, bits = SELECTORS[s]
        if count > n or counts[bits] < count:
            continue  # nowhere are so many values so small
        half = 1 << (count.bit_length() - 1)
        while k < half:
            full = widest[k].copy()
            full[: max(n - k, 0)] = np.maximum(full[: max(n - k, 0)], widest[k][k:])
            k *= 2
            widest[k] = full
        most = np.maximum(widest[half][: n - count + 1], widest[half][count - half : n - half + 1])
        best[: n - count + 1][most <= bits] = s
    return best


def encode_block(values: np.ndarray) -> np.ndarray:
    """The words of one block; every value must be below 2**60."""
    values = np.asarray(values, np.uint64)
    if not len(values):
        return np.zeros(0, np.uint64)
    if int(values.max()) >> 60:
        raise ValueError("Simple-8b holds values below 2**60")
    best = _choices(values)
    steps = _COUNT[best].tolist()
    starts, at, n = [], 0, len(steps)
    while at < n:
        starts.append(at)
        at += steps[at]
    starts = np.array(starts, np.int64)
    chosen = best[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen).tolist():
        count, bits = SELECTORS[s]
        rows = np.flatnonzero(chosen == s)
        part = values[starts[rows][:, None] + np.arange(count)]
        words[rows] |= np.bitwise_or.reduce(part << (np.arange(count, dtype=np.uint64) * np.uint64(bits)), axis=1)
    return words


def decode_block(words: np.ndarray) -> np.ndarray:
    words = np.asarray(words, np.uint64)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNT[chosen]
    starts = np.concatenate(([0], np.cumsum(counts)))
    out = np.zeros(int(starts[-1]), np.uint64)
    for s in np.unique(chosen).tolist():
        count, bits = SELECTORS[s]
        rows = np.flatnonzero(chosen == s)
        shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
        out[starts[rows][:, None] + np.arange(count)] = (words[rows][:, None] >> shifts) & np.uint64((1 << bits) - 1)
    return out


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, index of each block's first word and the number of words)."""
    blocks = [encode_block(values[lo : lo + BLOCK]) for lo in range(0, len(values), BLOCK)]
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in blocks]))).astype(np.uint64)
    return (np.concatenate(blocks) if blocks else np.zeros(0, np.uint64)), offsets


def decode(words: np.ndarray, offsets: np.ndarray, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Values lo to hi, decoding only the blocks that hold them."""
    offsets = np.asarray(offsets, np.int64)
    first = lo // BLOCK
    last = len(offsets) - 1 if hi is None else min(-(-hi // BLOCK), len(offsets) - 1)
    parts = [decode_block(words[offsets[k] : offsets[k + 1]]) for k in range(first, last)]
    got = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return got[lo - first * BLOCK : None if hi is None else hi - first * BLOCK]
