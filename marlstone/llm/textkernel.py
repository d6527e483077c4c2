"""Vectorised word and shingle kernels over Arrow string columns.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``.  Texts are handled in chunks of about
``CHUNK`` bytes, so memory follows the chunk (or the longest single document), not the batch.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: a bijection in which every bit of the input reaches every bit of the output."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


LANES = 8


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes data[start:end] for each pair.

    Spans of up to 64 bytes are folded eight bytes at a time, each step a bijection of the state, so different spans of
    at most eight bytes never collide for one length; longer spans take eight bytes of BLAKE2b.  Nothing is linear in the
    bytes, so no arrangement of plain letters cancels out.
    """
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))  # the eight bytes from each place on
    size = end - start
    acc = mix(size.astype(U64) + U64(0xD6E8FEB86659FD93))
    some = np.arange(len(size)) if (size > 0).all() else np.flatnonzero(size)
    for k in range(LANES):
        if not len(some):
            break
        left = size[some] - 8 * k
        lane = lanes[start[some] + 8 * k]
        short = left < 8
        lane = np.where(short, lane & ((U64(1) << (np.minimum(left, 7) * 8).astype(U64)) - U64(1)), lane)
        acc[some] = mix((acc[some] ^ lane) * _ODD + U64(k + 1))
        some = some[left > 8]
    if len(some):
        raw = data.tobytes()
        long = [hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(start[some].tolist(), end[some].tolist(), strict=True)]
        acc[some] = np.frombuffer(b"".join(long), "<u8")
    return acc


class Chunk:
    """Some consecutive rows' texts with their words.

    data: bytes; offs: row i is data[offs[i]:offs[i+1]]; start, end: byte span of each word;
    words: row i's words are words[i]:words[i+1].
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray, first: int):
        self.data, self.offs, self.first = data, offs, first
        n = len(data)
        full = ~_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = full[:-1]
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = full[1:]
        self.start = np.flatnonzero(full & (~before | edge[:-1]))
        self.end = np.flatnonzero(full & (~after | edge[1:])) + 1
        self.words = np.searchsorted(self.start, offs)

    def __len__(self) -> int:
        return len(self.offs) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.words)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.counts)

    def word_hashes(self, lower: bool = False) -> np.ndarray:
        d = _LOWER[self.data] if lower else self.data
        return span_hash(d, self.start, self.end)

    def text(self, i: int) -> bytes:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes()


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words; runs that cross rows are the caller's to drop."""
    count = max(0, len(words) - n + 1)
    acc = np.full(count, n, U64)
    for j in range(n):
        acc = acc * _ODD + words[j : j + count]
        acc ^= acc >> U64(29)
    return mix(acc)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, with null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(column: pa.Array | pa.ChunkedArray, size: int = CHUNK) -> Iterator[Chunk]:
    """The column's rows in order; a chunk holds more than size bytes only if one row does."""
    data, offs = buffers(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, side="right")) - 1)
        j = min(j, n, i + 65_000)
        yield Chunk(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], i)
        i = j


def release() -> None:
    """Gives freed memory back to the system, since a worker process may idle for long beside others that need it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass
