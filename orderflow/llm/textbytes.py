"""Vectorised work on batches of UTF-8 texts (numpy over Arrow buffers).

Operators pass whole texts; ``slices`` only bounds how many texts are looked
at together, so temporaries stay small. A single text longer than the bound is
a slice of its own and is still processed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18

# The word contract: words are runs of bytes other than blanks and \t..\r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (avalanches every input bit)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX_A
        x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


class RangeHash:
    """64-bit hashes of arbitrary byte ranges of one buffer.

    Ranges of up to ``SHORT`` bytes mix their 8-byte words one after the other, longer ones
    are hashed by BLAKE2b. Neither is linear in the bytes, so no pair of texts
    collides by its structure, as it does under a polynomial modulo 2**64.
    """

    SHORT = 32

    def __init__(self, buf: np.ndarray):
        self._buf = buf
        word = np.concatenate([buf, np.zeros(8, np.uint8)]).astype(np.uint64)
        for k in (1, 2, 4):
            word = word[:-k] | (word[k:] << np.uint64(8 * k))
        self._word = word                                # the 8 bytes from each position on

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = end - start
        with np.errstate(over="ignore"):
            out = mix(length.astype(np.uint64) * _MIX_A + _ODD)
            for k in range(0, self.SHORT, 8):
                some = np.flatnonzero((length > k) & (length <= self.SHORT))
                over = np.maximum(8 - (length[some] - k), 0).astype(np.uint64) * np.uint64(8)
                out[some] = mix(out[some] * _ODD + ((self._word[start[some] + k] << over) >> over))
        for i in np.flatnonzero(length > self.SHORT):
            out[i] = int.from_bytes(hashlib.blake2b(self._buf[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
        return out


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def slices(buf: np.ndarray, offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most ``most`` bytes, or of one text."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = b


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of a per-byte array over each row."""
    out, filled = np.zeros(len(offsets) - 1, np.int64), offsets[1:] > offsets[:-1]
    if filled.any():
        out[filled] = np.add.reduceat(flags.view(np.uint8), offsets[:-1][filled], dtype=np.int64)
    return out


class Words:
    """Words of each text: byte ranges, owning row, hashes."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf, self.offsets, self.rows = buf, offsets, len(offsets) - 1
        self.inside = inside = ~SPACE[buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[offsets] = True
        first = inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])) if len(buf) else inside
        last = inside & (edge[1:] | ~np.concatenate([inside[1:], [False]])) if len(buf) else inside
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.count = np.bincount(self.row, minlength=self.rows).astype(np.int64)
        self.first_word = np.concatenate([[0], np.cumsum(self.count)])

    def hashes(self, ranges: RangeHash | None = None) -> np.ndarray:
        return (ranges or RangeHash(self.buf))(self.start, self.end)


def windows(hashes: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions of runs of k words in one row, and the runs' hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        run = hashes[:n].copy()
        for j in range(1, k):
            run = run * _ODD + hashes[j : n + j]
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return at, mix(run[at])
