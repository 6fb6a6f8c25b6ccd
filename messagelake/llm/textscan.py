"""Vectorised scans of text buffers: runs of word bytes, and 64-bit hashes of any stretch of bytes."""

from __future__ import annotations

import functools

import numpy as np

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_BYTES = np.random.default_rng(20_240_229).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)

#: A-Z as a-z, the rest as it is.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Bytes of words split at white space, and of words of letters, digits and what is not ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, np.uint64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([one, np.full(n, _MULTIPLIER, np.uint64)]))
        down = np.cumprod(np.concatenate([one, np.full(n, _INVERSE, np.uint64)]))
    return up, down


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(1 << 21, 1 << max(1, n).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix(data: np.ndarray) -> np.ndarray:
    """Sums from which stretch() hashes any stretch in constant time."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def stretch(sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The hash of the bytes in [first, last); equal bytes have equal hashes wherever they stand."""
    return mix((sums[last] - sums[first]) * powers(len(sums))[1][first])


def runs(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, text) of the longest runs of bytes that the table admits; no run crosses texts."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = table[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    starts = at[:-1]
    before[starts[starts < len(data)]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    ends = at[1:]
    after[ends[ends > 0] - 1] = False
    first = np.flatnonzero(inside & ~before)
    last = np.flatnonzero(inside & ~after) + 1
    return first, last, np.searchsorted(at, first, "right") - 1


def fold_doc(text: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values told apart by text as well, for counts of distinct values per text."""
    return values ^ mix(text.astype(np.uint64) + np.uint64(1))
