"""Terms of Arrow columns of text: maximal runs of term bytes, only A-Z lower-cased, numbered exactly by an Arrow dictionary."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import utf8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _table(digits: bool) -> np.ndarray:
    out = np.zeros(256, bool)
    out[0x41:0x5B] = out[0x61:0x7B] = out[0x80:] = True
    out[0x30:0x3A] = digits
    return out


#: Bytes of a term: ASCII letters and all of other signs, with ASCII digits or without.
WITH_DIGITS, LETTERS = _table(True), _table(False)


def found(column: pa.Array, table: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms of a text column, the number of each occurrence's term in text order, and where each row's occurrences start (one more than rows); null has none."""
    data, rows = utf8(column)
    n = len(data)
    if not n:
        return pa.array([], pa.large_string()), np.zeros(0, np.int32), np.zeros(len(rows), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[rows] = True
    solid = table[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:n]
    starts = np.flatnonzero(begin)
    flat = _LOWER[data[solid]]
    place = np.cumsum(solid, dtype=np.int64)
    offsets = np.append(place[starts] - 1, len(flat)).astype(np.int64)
    spelled = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(flat)).dictionary_encode()
    return spelled.dictionary, spelled.indices.to_numpy(zero_copy_only=False), np.searchsorted(starts, rows, side="left")
