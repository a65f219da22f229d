"""Hashes of words, word shingles and byte windows, for many texts at once."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_rng = np.random.default_rng(20240229)
#: A random number for each byte; a base that is odd, so that it has an inverse modulo 2 ** 64.
BYTE = _rng.integers(0, 2**64, 256, dtype=U64)
BASE = int(_rng.integers(0, 2**62)) * 2 + 1
INVERSE = pow(BASE, -1, 2**64)
#: A to Z to lower case, other bytes as they are; and the bytes that part words.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.ones(size, U64)
        filled = 1
        while filled < size:
            have[filled : 2 * filled] = have[:filled] * U64(pow(base, filled, 2**64))
            filled *= 2
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(31)
    x *= U64(0x7FB5D329728EA185)
    x ^= x >> U64(27)
    x *= U64(0x81DADEF4BC2DD44D)
    x ^= x >> U64(33)
    return x


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes (one more than bytes); see ``span_hashes``."""
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE[data] * powers(BASE, len(data)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[begin:end], equal for equal bytes wherever they stand."""
    return (sums[end] - sums[begin]) * powers(INVERSE, len(sums))[begin]


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mixed hashes of all words, A to Z lower-cased, and where each text's begin (one more than texts)."""
    low = LOWER[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~SPACE[data]
    starts = inside[:-1].copy()
    starts[1:] &= ~inside[: len(data) - 1]
    edges = offsets[(offsets < len(data))]
    starts[edges] = inside[edges]  # a text's first byte begins a word even if the text before ends in one
    begin = np.flatnonzero(starts)
    ends = inside[:-1] & ~inside[1:]
    last = offsets[offsets > 0] - 1
    ends[last] = inside[last]
    end = np.flatnonzero(ends) + 1
    # a byte's number depends on its place in the word and is no power of a base, which some long words of two letters defeat for every base
    size = end - begin
    upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
    place = np.arange(upto[-1]) - np.repeat(upto[:-1], size)
    sums = np.concatenate((np.zeros(1, U64), np.cumsum(mix(BYTE[low[place + np.repeat(begin, size)]] + place.astype(U64) * U64(0x9E3779B97F4A7C15)), dtype=U64)))
    return mix(sums[upto[1:]] - sums[upto[:-1]] + size.astype(U64)), np.searchsorted(begin, offsets)


def shingle_sets(offsets: np.ndarray, data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text's word n-grams, sorted, text after text, and where each text's begin.

    A text of fewer than ``n`` words, but one at least, has its whole sequence
    as its one shingle.
    """
    w, upto = words(offsets, data)
    sets, ends = [], [0]
    grams = np.zeros(0, U64)
    if len(w) >= n:
        grams = w[: len(w) - n + 1].copy()
        for k in range(1, n):
            grams = mix(grams * U64(0x9E3779B97F4A7C15) + w[k : len(w) - n + 1 + k])
    for a, b in zip(upto[:-1].tolist(), upto[1:].tolist()):
        if b - a >= n:
            found = np.unique(grams[a : b - n + 1])
        elif b > a:
            one = w[a : a + 1]
            for k in range(a + 1, b):
                one = mix(one * U64(0x9E3779B97F4A7C15) + w[k : k + 1])
            found = mix(one + U64(b - a))
        else:
            found = grams[:0]
        sets.append(found)
        ends.append(ends[-1] + len(found))
    return (np.concatenate(sets) if sets else grams), np.array(ends)


#: ``LOWER`` for bytes.translate.
_LOWER = LOWER.tobytes()


def exact_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_sets`` with numbers in place of hashes, equal within these texts for equal words and only for these."""
    names: dict[bytes, int] = {}
    whole: dict[tuple[int, ...], int] = {}
    lists = [[names.setdefault(w, len(names)) for w in t.translate(_LOWER).split()] for t in texts]
    ids = np.fromiter((i for x in lists for i in x), np.int64)
    upto = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(x) for x in lists], dtype=np.int64)))
    grams, bits = ids[: max(0, len(ids) - n + 1)], max(1, len(names)).bit_length()
    used = bits
    for k in range(1, n):
        if used + bits > 63:
            _, grams = np.unique(grams, return_inverse=True)
            used = max(1, len(grams)).bit_length()
        grams, used = (grams << bits) | ids[k : len(grams) + k], used + bits
    sets = []
    for x, a, b in zip(lists, upto[:-1].tolist(), upto[1:].tolist()):
        if b - a >= n:
            sets.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            sets.append(np.array([-1 - whole.setdefault(tuple(x), len(whole))]))
        else:
            sets.append(ids[:0])
    return np.concatenate([ids[:0], *sets]), np.concatenate((np.zeros(1, np.int64), np.cumsum([len(x) for x in sets], dtype=np.int64)))
