"""Words and shingles of whole Arrow slices as arrays.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. A word is hashed over its UTF-8 bytes with a random 64-bit number
for each byte value and each place (a multilinear hash), then mixed; a shingle hashes the hashes of its words in order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: Places that have random numbers of their own; longer words fold their further bytes with powers of an odd number.
PLACES = 4096

_rng = np.random.default_rng(20240229)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = _rng.integers(1 << 62, (1 << 63) - 1, 256, dtype=np.int64).astype(np.uint64)
_BYTE_OR_0 = np.where(SPACE, np.uint64(0), _BYTE[LOWER])
_PLACE = _rng.integers(1 << 62, (1 << 63) - 1, PLACES, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PARTS = (_rng.integers(1 << 62, (1 << 63) - 1, 64, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """All words of a slice: byte ranges in `data`, hashes, and the first word of each document (one more at the end)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    offsets: np.ndarray


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offsets into them; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words_of(column: pa.Array, breaks: Callable[[np.ndarray], np.ndarray] | None = None) -> Words:
    """`breaks` marks the bytes before which words are parted as well."""
    data, offsets = utf8(column)
    n = data.size
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64), offsets)
    word = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    if breaks is not None:
        edge[:n] |= breaks(data)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    before &= ~edge[:n]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    after &= ~edge[1:]
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    if not starts.size:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64), offsets)
    lengths = np.diff(starts, append=n)
    place = np.arange(starts[0], n, dtype=np.int64) - np.repeat(starts, lengths)
    weight = _PLACE[place & (PLACES - 1)]
    if (ends - starts).max() > PLACES:
        far = np.flatnonzero(place >= PLACES)
        weight[far] = weight[far] * (_ODD ** (place[far] // PLACES).astype(np.uint64))
    terms = _BYTE_OR_0[data[starts[0] :]] * weight
    hashes = mix(np.add.reduceat(terms, starts - starts[0]) + (ends - starts).astype(np.uint64) * _ODD)
    return Words(data, starts, ends, hashes, np.searchsorted(starts, offsets), offsets)


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words from each place on, over the whole array; the last size-1 places have none."""
    n = max(0, hashes.size - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += hashes[k : k + n] * _PARTS[k]
    return mix(out)


def shingle_sets(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct shingles, sorted, back to back, and each document's offsets into them.

    A document with fewer words than `size` has its whole sequence as one shingle; without words it has none.
    """
    every = grams(w.hashes, size)
    parts, counts = [], np.zeros(w.first.size - 1, np.int64)
    for d, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
        if b - a >= size:
            x = np.sort(every[a : b - size + 1])
            keep = np.empty(x.size, bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            x = x[keep]
        elif b > a:
            x = mix((w.hashes[a:b] * _PARTS[: b - a]).sum(keepdims=True) + np.array([b - a], np.uint64) * _ODD)
        else:
            continue
        parts.append(x)
        counts[d] = x.size
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(counts)])
