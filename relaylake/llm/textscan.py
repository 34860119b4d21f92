"""Vectorised scanning of text: words, lines and their hashes straight from Arrow buffers.

A text is handled as UTF-8 bytes. A word is a maximal run of ASCII letters and
digits and of non-ASCII characters; the callers lower-case in the JVM first.
Words are hashed eight bytes at a time. Hashes of other byte ranges are polynomial
over 64-bit integers, taken from prefix sums, so that any number of ranges costs a
constant number of numpy operations each; a final mixing step spreads them over all
bits. Polynomials modulo 2**64 have structured collisions (Thue-Morse strings, of any
base), so they only find candidates: words of STRONG bytes and more are hashed by
BLAKE2b, and lines are told apart by its 128-bit form.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK_BYTES = 1 << 20
#: Words from this length on are hashed by BLAKE2b.
STRONG = 128

WORD_BYTES = np.zeros(256, np.uint8)
for _b in [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]:
    WORD_BYTES[_b] = _b

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, CHUNK_BYTES + 2)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=np.uint64)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte * BASE**position; range_hash reads them."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(data * powers(BASE, len(data))[: len(data)], dtype=np.uint64, out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each pair, equal for equal bytes wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(INVERSE, len(sums))[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Split into runs of whole texts of about ``limit`` bytes: (first, last + 1, bytes, offsets).

    A longer text is a run of its own, never cut.
    """
    data, offsets = buffers(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range without zero bytes, eight bytes at a time; the ranges are short."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = end - start
    # Up to eight bytes this is one to one: padding is not part of a word.
    out = (eight[start] & _MASKS[np.minimum(size, 8)]) * np.uint64(BASE)
    done, left = 8, np.flatnonzero(size > 8)
    while len(left):
        rest = eight[start[left] + done] & _MASKS[np.minimum(size[left] - done, 8)]
        mine = (out[left] ^ (out[left] >> np.uint64(29)) ^ rest) * np.uint64(0xD6E8FEB86659FD93)
        out[left] = mine + np.uint64(done)
        done += 8
        left = left[size[left] > done]
    return mix(out)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, bounds): words of all texts in order; text i has words bounds[i]:bounds[i+1]."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64)
    kept = WORD_BYTES[data]
    inside = np.zeros(len(data) + 2, bool)
    np.not_equal(kept, 0, out=inside[1:-1])
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = inside[edge + 1]
    last[edge - 1] = inside[edge]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = word_hashes(data, start, end)
    for i in np.flatnonzero(end - start >= STRONG).tolist():
        hashes[i] = int.from_bytes(blake2b(kept[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return hashes, start, end, np.searchsorted(start, offsets)


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(ranges, 2) 64-bit halves of the 128-bit BLAKE2b digest of each byte range."""
    raw = data.tobytes()
    made = b"".join([blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(made, np.int64).reshape(-1, 2)


def lowered(column: pa.Array) -> pa.Array:
    """Lower case that keeps every byte where it was: a letter whose lower case has another length stays."""
    low = pc.utf8_lower(column)
    moved = np.flatnonzero(np.diff(np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]) != np.diff(buffers(column)[1]))
    if len(moved):
        texts = low.to_pylist()
        for i in moved:
            texts[i] = "".join(b if len((b := c.lower()).encode()) == len(c.encode()) else c for c in column[int(i)].as_py())
        low = pa.array(texts, pa.large_string())
    return low


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, bounds) of the runs of ``size`` words of each text; a shorter text that has words has one run, of all of them."""
    total, count = len(hashes), np.diff(bounds)
    if not total:
        return np.zeros(0, np.uint64), np.zeros_like(bounds)
    out = hashes * np.uint64(BASE)
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    for k in range(1, size):
        out += padded[k : k + total] * powers(BASE, size + 1)[k + 1]
    short = np.flatnonzero((count > 0) & (count < size))
    for i in short:
        own = hashes[bounds[i] : bounds[i + 1]]
        out[bounds[i]] = (own * powers(BASE, size + 1)[1 : len(own) + 1]).sum(dtype=np.uint64)
    keep = np.ones(total, bool)
    for k in range(1, size):
        at = bounds[1:] - k
        keep[at[at >= bounds[:-1] + (count < size)]] = False
    kept = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
    return mix(out[keep]), np.concatenate([[0], np.cumsum(kept)])


class Lookup:
    """Places of hashes in a sorted array of distinct ones, by a table over their leading bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        bits = max(1, min(22, int(len(hashes)).bit_length() + 1))
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.first = np.append(self.first, np.int32(len(hashes)))

    def find(self, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indices of those that are there, their places)."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        slot = (sought >> self.shift).astype(np.int32)
        at, end = self.first[slot], self.first[slot + 1]
        left = np.flatnonzero(at < end)
        at, end, found, places = at[left], end[left], [], []
        while len(left):
            hit = self.hashes[at] == sought[left]
            found.append(left[hit])
            places.append(at[hit])
            go = ~hit & (at + 1 < end)
            left, at, end = left[go], at[go] + 1, end[go]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        found, places = np.concatenate(found), np.concatenate(places)
        order = np.argsort(found, kind="stable")
        return found[order], places[order]


def distinct_words(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, count) of the distinct words of each text, by text, then hash."""
    hashes = hashes.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[bounds[:-1][bounds[:-1] < len(hashes)]] = True
    at = np.flatnonzero(new)
    text = np.searchsorted(bounds, at, "right") - 1
    return hashes[at], text.astype(np.int32), np.diff(np.append(at, len(hashes))).astype(np.int32)
