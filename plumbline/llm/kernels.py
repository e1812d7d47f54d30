"""Numpy work on the bytes of one Arrow batch of texts: words, hashes, shingles.

All of it runs inside Spark tasks on batches that Spark deals out. Nothing
here loops over characters; long texts are worked off in blocks.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once.
BLOCK = 1 << 20
U = np.uint64

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32  # A-Z to a-z
#: Words between white space: every byte but space and \t to \r.
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Words of digits, ASCII letters and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    ALNUM[_lo:_hi] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (murmur's finaliser)."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit constants that depend on the seed alone."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


_BYTE = constants(256, 11)[FOLD]  # hashes see lower case
_P = int(constants(1, 12)[0])
_P_INV = pow(_P, -1, 1 << 64)


@lru_cache(maxsize=2)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text starts and ends in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(at, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(at: np.ndarray, size: int = BLOCK, most: int = 2048):
    """Ranges of up to ``most`` documents of about ``size`` bytes; a longer document stands alone."""
    first, n = 0, len(at) - 1
    while first < n:
        last = min(first + most, max(first + 1, int(np.searchsorted(at, at[first] + size, side="right")) - 1))
        yield first, last
        first = last


def portions(batches, column: int):
    """Slices of the batches of about ``BLOCK`` bytes of text; what Arrow keeps for batches to come is given back at the end."""
    for batch in batches:
        _, at = utf8(batch.column(column))
        for lo, hi in chunks(at):
            yield batch.slice(lo, hi - lo)
    pa.default_memory_pool().release_unused()


def words(buf: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each document the number of words before it."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    mask = is_word[buf]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, mask[:-1]
    after[-1], after[:-1] = False, mask[1:]
    before[at[:-1][at[:-1] < n]] = False  # a document's edge ends a word
    after[at[1:][at[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, at, side="left")


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, cuts: tuple[int, ...] = ()) -> np.ndarray:
    """A 64-bit hash of each word in lower case, from prefix sums of a polynomial.

    With ``cuts`` there is a further row for each: the hashes of the words' first
    so many bytes, and 0 for words that aren't longer.
    """
    out = np.zeros((1 + len(cuts), len(starts)), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, side="right")))
        lo, hi = starts[i], ends[j - 1]
        size = 1 << max(20, int(hi - lo + 1).bit_length())
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[buf[lo:hi]] * _powers(_P, size)[: hi - lo], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        back = _powers(_P_INV, size)[s]
        out[0, i:j] = mix((total[e] - total[s]) * back)
        for row, cut in enumerate(cuts, 1):
            some = np.flatnonzero(e - s > cut)
            out[row, i + some] = mix((total[s[some] + cut] - total[s[some]]) * back[some] + U(cut))
        i = j
    return out if cuts else out[0]


def shingle_sets(hashes: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct shingle hashes, sorted, one after the other, and the ends of their ranges.

    A document of fewer than ``width`` words, but not none, has its whole
    sequence as its one shingle.
    """
    k = constants(width, 21)
    n = len(hashes)
    whole = np.zeros(max(0, n - width + 1), np.uint64)
    for j in range(width):
        if len(whole):
            whole += hashes[j : n - width + 1 + j] * k[j]
    whole = mix(whole)
    sets, sizes = [], np.zeros(len(first), np.int64)
    for d in range(len(first) - 1):
        a, b = first[d], first[d + 1]
        if b - a >= width:
            got = np.sort(whole[a : b - width + 1])
            if len(got) > 1:
                got = got[np.concatenate(([True], got[1:] != got[:-1]))]
        elif b > a:
            got = mix((hashes[a:b] * k[: b - a]).sum(dtype=np.uint64, keepdims=True) + U(b - a))
        else:
            continue
        sets.append(got)
        sizes[d + 1] = len(got)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.cumsum(sizes)
