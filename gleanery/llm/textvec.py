"""Vectorised hashes of words and shingles of whole texts.

A word's hash is a polynomial over random values of its bytes modulo 2^64, mixed; it comes from prefix sums, so a slice of many
texts takes a handful of array steps. Hashes have 64 bits: different words or shingles meet in one value with a chance of 2^-64 a pair.
"""

from __future__ import annotations

from functools import cache as memo

import numpy as np

#: A text longer than this many bytes is hashed in stretches cut at blanks.
STRETCH = 1_000_000
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes that part words: space, and 9 to 13.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
VALUE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
LOWER = VALUE.copy()
LOWER[65:91] = VALUE[97:123]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@memo
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: int) -> np.ndarray:
        x = np.full(n, base, np.uint64)
        x[0] = 1
        return np.multiply.accumulate(x)

    return of(BASE), of(INVERSE)


def _hashes(data: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    blank = BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = powers(1 << (len(data) + 1).bit_length())
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def word_hashes(texts: list[str], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``texts``, in order, and the number where each text's words begin (one more at the end).

    A word is a run without space or the characters 9 to 13; A to Z count as a to z if ``lower``.
    """
    encoded = [t.encode() for t in texts]
    value = LOWER if lower else VALUE
    found, counts = [], np.zeros(len(texts) + 1, np.int64)
    group: list[bytes] = []
    first = 0

    def flush(upto: int) -> None:
        nonlocal group, first
        if group:
            h, starts = _hashes(np.frombuffer(b"\n".join(group), np.uint8), value)
            offsets = np.cumsum([0, *(len(g) + 1 for g in group)])
            counts[first + 1 : upto + 1] = np.diff(np.searchsorted(starts, offsets))
            found.append(h)
        group, first = [], upto

    size = 0
    for i, e in enumerate(encoded):
        if len(e) > STRETCH:
            flush(i)
            n, start = 0, 0
            while start < len(e):
                end = min(len(e), start + STRETCH)
                while end < len(e) and not BLANK[e[end]]:
                    end += 1
                h, _ = _hashes(np.frombuffer(e[start:end], np.uint8), value)
                found.append(h)
                n += len(h)
                start = end
            counts[i + 1] = n
            first, size = i + 1, 0
        else:
            if size + len(e) > STRETCH:
                flush(i)
                size = 0
            group.append(e)
            size += len(e) + 1
    flush(len(texts))
    return np.concatenate(found) if found else np.zeros(0, np.uint64), np.cumsum(counts)


def shingle_sets(texts: list[str], words: int = 4) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``words`` words; of a shorter text, the whole sequence as one."""
    hashes, at = word_hashes(texts)
    joined = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k in range(words):
        joined = mix(joined * np.uint64(BASE) + hashes[k : k + len(joined)] + np.uint64(words))
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= words:
            out.append(np.unique(joined[a : b - words + 1]))
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for k in range(a, b):
                whole = mix(whole * np.uint64(BASE) + hashes[k : k + 1] + np.uint64(b - a))
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
