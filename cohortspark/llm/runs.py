"""Runs of wanted bytes in whole columns of text, and their counts for one part of a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .textbytes import byte_column, chunks

#: Bytes of text that are counted together.
PART = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def parts(column: pa.Array, most: int = PART) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end, bytes with A-Z in lower case, offsets) of groups of whole rows of a text column."""
    data, offsets = byte_column(column)
    for lo, hi in chunks(offsets, most):
        own = offsets[lo : hi + 1]
        yield lo, hi, _LOWER[data[int(own[0]) : int(own[-1])]], own - own[0]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of `inside` that don't leave their row."""
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(inside)]
    first[inner] = inside[inner]
    starts = np.flatnonzero(first)
    row = np.searchsorted(offsets, starts, "right") - 1
    gaps = np.append(np.flatnonzero(~inside), len(inside))
    return starts, np.minimum(gaps[np.searchsorted(gaps, starts)], offsets[row + 1]), row


def gather(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The bytes from each start to its end as an Arrow array of binary or string."""
    size = ends - starts
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], size)
    return pa.Array.from_buffers(kind, len(size), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(text[at])])
