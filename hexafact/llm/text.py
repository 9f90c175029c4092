"""Vectorised text handling over Arrow batches.

A *slice* is a run of rows whose texts together stay under a byte limit (one
longer text makes a slice of its own), so a worker's memory follows the limit
and its longest text, never the batch. Null texts count as empty.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. In UTF-8 no
other character contains those bytes, so bytes can be split without decoding.

Words are hashed in chunks of 8 bytes, each mixed into the state before the next
(words of over 64 bytes: blake2b), and windows of words by doubling, mixed at each
step: no structure of the text survives, and words of up to 8 bytes never collide.

``Hasher`` gives hashes of any range: polynomial modulo 2**64 with an odd base,
with ``S`` the prefix sums of ``value[i] * base**-i``, the hash of ``[a, b)`` is
``(S[b]-S[a]) * base**a``. Equal ranges always have equal hashes, but unlike ones
of over 1,000 places can be made to collide, so it only serves where the bytes
themselves are compared, or where a collision does no harm.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = (n >> 18) + 1 << 18  # whole steps of 2 MB each
            self.up = np.full(size, BASE, np.uint64)
            self.down = np.full(size, BASE_INVERSE, np.uint64)
            self.up[0] = self.down[0] = 1
            np.multiply.accumulate(self.up, out=self.up)
            np.multiply.accumulate(self.down, out=self.down)
        return self.up, self.down


_POWERS = _Powers()


@dataclass
class Hasher:
    """Range hashes over a sequence of 64-bit values."""

    sums: np.ndarray
    up: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> Hasher:
        n = len(values)
        up, down = _POWERS.get(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * down[:n], out=sums[1:])
        return cls(sums, up)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.up[start]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an Arrow string column, and n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes stay under the limit; at least one row each."""
    row, n = 0, len(offs) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


def trim() -> None:
    """Give freed memory back to the system: a worker lives on after its task, beside others."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def each_slice(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their bytes, their offsets) for each slice of each batch."""
    for batch in batches:
        data, offs = utf8(batch.column(batch.schema.get_field_index(text)))
        for a, b in slices(offs, limit):
            yield batch.slice(a, b - a), data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
    trim()


@dataclass
class Words:
    """Words of a slice: byte ranges, and ``first[d]:first[d+1]`` for document d."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split_words(data: np.ndarray, offs: np.ndarray) -> Words:
    """Words of every document; a document's end always ends a word."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(offs), np.int64))
    solid = ~IS_SPACE[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, solid[:-1]
    after[-1], after[:-1] = False, solid[1:]
    edges = offs[(offs > 0) & (offs < n)]
    before[edges] = False
    after[edges - 1] = False
    start = np.flatnonzero(solid & ~before)
    end = np.flatnonzero(solid & ~after) + 1
    return Words(start, end, np.searchsorted(start, offs))


_ODD = np.uint64(0x9FB21C651E98DF25)
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of a word that are hashed in chunks; longer words go to blake2b.
_CHUNKED = 64


def hash_words(data: np.ndarray, words: Words, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes and length."""
    n = len(data)
    if not len(words.start):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((n,), "<u8", padded, strides=(1,))  # the 8 bytes from each place on
    size = words.end - words.start
    h = mix(size.astype(np.uint64) * _ODD + np.uint64(seed))
    h = mix(h ^ (eight[words.start] & _LOW[np.minimum(size, 8)]))
    at, done = np.flatnonzero((size > 8) & (size <= _CHUNKED)), 8
    while len(at):
        left = size[at] - done
        h[at] = mix(h[at] * _ODD ^ (eight[words.start[at] + done] & _LOW[np.minimum(left, 8)]))
        at, done = at[left > 8], done + 8
    key = seed.to_bytes(8, "little")
    for i in np.flatnonzero(size > _CHUNKED).tolist():
        h[i] = int.from_bytes(blake2b(data[words.start[i] : words.end[i]], digest_size=8, key=key).digest(), "little")
    return h


def windowed(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` values, by the place where it starts."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    level, span, out, covered = values, 1, None, 0
    while True:
        if width & span:
            part = level[covered : covered + n]
            out = mix(part + np.uint64(width)) if out is None else mix(out * _ODD + part)
            covered += span
        if 2 * span > width:
            return out
        level = mix(level[:-span] * _ODD + level[span:])
        span *= 2


def windows(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all full windows within documents, and each one's document."""
    count = np.maximum(np.diff(first) - width + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    ends = np.cumsum(count)
    start = np.arange(len(doc)) - np.repeat(ends - count, count) + first[:-1][doc]
    return start, doc


def pack(parts: dict[str, np.ndarray]) -> dict[str, bytes]:
    return {k: np.ascontiguousarray(v).tobytes() for k, v in parts.items()}


def binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())
