"""Word shingles of whole text columns as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from .textbytes import mix, prefix_hashes, span_hash

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


#: Bytes of words in searches: ASCII letters and digits, and all bytes of other characters.
ALPHANUMERIC = np.array([i >= 0x80 or chr(i).isalnum() for i in range(256)])


def word_hashes(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of all words in order; words are runs of `solid` bytes (by default of all but space and 0x09-0x0D)
    within a row, A-Z in lower case."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    text = _LOWER[data[lo:hi]]
    inside = (~_SPACE if solid is None else solid)[text]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    inner = offsets[1:-1] - lo
    inner = inner[inner < len(text)]
    first[inner] = inside[inner]
    starts = np.flatnonzero(first)
    row = np.searchsorted(offsets - lo, starts, "right") - 1
    gaps = np.flatnonzero(~inside)
    ends = np.minimum(np.append(gaps, len(text))[np.searchsorted(gaps, starts)], offsets[row + 1] - lo)
    return mix(span_hash(prefix_hashes(text), starts, ends)), row


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, row of each) of rows of text in bytes.

    Words are runs of bytes other than space, tab and line breaks (0x09-0x0D), A-Z in lower case. A row with fewer words than
    `words` has its whole sequence as one shingle; a row without words has none."""
    rows = len(offsets) - 1
    h, row_of = word_hashes(data, offsets)
    count = np.bincount(row_of, minlength=rows)
    last = np.cumsum(count)
    begin = last - count
    n = len(h)
    out_hash, out_row = [], []
    if n >= words:
        k = np.arange(n - words + 1)
        k = k[row_of[k] == row_of[k + words - 1]]
        s = np.zeros(len(k), np.uint64)
        for j in range(words):
            s = s * np.uint64(0xD6E8FEB86659FD93) + h[k + j]
        out_hash.append(mix(s))
        out_row.append(row_of[k])
    for r in np.flatnonzero((count > 0) & (count < words)):
        s = np.uint64(count[r])
        with np.errstate(over="ignore"):
            for x in h[begin[r] : last[r]]:
                s = s * np.uint64(0xD6E8FEB86659FD93) + x
        out_hash.append(mix(np.array([s ^ np.uint64(0x5555)])))
        out_row.append(np.array([r]))
    if not out_hash:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes, owner = np.concatenate(out_hash), np.concatenate(out_row)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[keep], owner[keep]
