"""Words of whole Arrow columns of text, found and hashed with numpy on the UTF-8 bytes.

A word is a run of bytes outside `[\\x20\\x09-\\x0D]`. No Python object is made for a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_PRIME = np.uint64(0x100000001B3)
_LONG_WORD = 64


def mix(h: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of text; a row is never cut."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and where each row starts (one more entry than rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def find(data: np.ndarray, rows: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row its first word's place in those (one more than rows). cuts: places that part words as well."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(rows), np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[rows] = True
    if cuts is not None:
        edge[cuts] = True
    solid = ~_SPACE[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:n]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | edge[1:n]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, rows, side="left")


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each word, the same on every machine."""
    size = ends - starts
    h = np.full(len(starts), 0xCBF29CE484222325, dtype=np.uint64)
    alive = np.flatnonzero(size <= _LONG_WORD)
    step = 0
    while len(alive):
        h[alive] = (h[alive] ^ data[starts[alive] + step]) * _PRIME
        step += 1
        alive = alive[size[alive] > step]
    for i in np.flatnonzero(size > _LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return mix(h)


def shingles(words: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of `width` words inside a row, and where each row's start.

    A row with fewer words, but one at least, has one run: all its words.
    """
    counts = np.diff(rows)
    runs = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(runs)])
    total = int(at[-1])
    row = np.repeat(np.arange(len(counts)), runs)
    first = rows[row] + (np.arange(total) - at[row])
    left = rows[row + 1] - first
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    out = np.zeros(total, np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for j in range(width):
            w = padded[first + j]
            out = out * factor + np.where(left > j, w, np.uint64(j + 1))
    return mix(out), at


def counts(column: pa.Array) -> np.ndarray:
    """Words in each row; null has none."""
    data, rows = utf8(column)
    return np.diff(find(data, rows)[2])
