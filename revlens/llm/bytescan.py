"""Vectorised scans over the UTF-8 bytes of many texts at once, for use inside tasks.

Texts arrive as Arrow strings. They are taken in slices of a bounded number of bytes, so a task holds
a few arrays of that size besides its Arrow batch, however long the texts of a batch are together.
A single text longer than the bound makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


_LETTERS = mixed(np.arange(1, 257, dtype=np.uint64))
_FOLDED = _LETTERS.copy()
_FOLDED[65:91] = _LETTERS[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    forward = np.full(size, _BASE, dtype=np.uint64)
    backward = np.full(size, _INVERSE, dtype=np.uint64)
    forward[0] = backward[0] = 1
    return np.multiply.accumulate(forward), np.multiply.accumulate(backward)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for sizes rounded up to a power of two."""
    return _powers(1 << max(SLICE_BYTES, size).bit_length())


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and a null flag of each text of an Arrow string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    missing = column.is_null().to_numpy(zero_copy_only=False)
    column = column.fill_null("").cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = buffers[2] if buffers[2] is not None else b""
    return np.frombuffer(data, dtype=np.uint8), offsets, missing


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets, nulls) of consecutive texts within the byte bound."""
    data, offsets, missing = string_parts(column)
    first, count = 0, len(offsets) - 1
    while first < count:
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1
        last = min(max(last, first + 1), count)
        start = offsets[first]
        yield (
            first,
            last,
            data[start : offsets[last]],
            offsets[first : last + 1] - start,
            missing[first:last],
        )
        first = last


@dataclass
class Words:
    """The words of a slice of texts: where they start and end, and whose they are."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    # word numbers where each text begins, with the total at the end
    bounds: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words are maximal runs of bytes other than blanks; none crosses from a text to the next."""
    inside = ~_SPACE[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = np.unique(offsets)
    edges = edges[(edges > 0) & (edges < len(data))]
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(opens)
    end = np.flatnonzero(closes) + 1
    bounds = np.searchsorted(start, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    return Words(data, offsets, start, end, text, bounds)


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold_case: bool) -> np.ndarray:
    """A 64-bit hash of the bytes of each range; A-Z count as a-z where case is folded."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    forward, backward = powers(len(data))
    weighted = (_FOLDED if fold_case else _LETTERS)[data] * forward[: len(data)]
    prefix = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(weighted, dtype=np.uint64)])
    sums = (prefix[end] - prefix[start]) * backward[start]
    return mixed(sums + (end - start).astype(np.uint64))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of `width` consecutive hashes, by where the run starts."""
    runs = len(hashes) - width + 1
    if runs <= 0:
        return np.zeros(0, dtype=np.uint64)
    combined = hashes[:runs].copy()
    for step in range(1, width):
        combined = combined * _STEP + hashes[step : step + runs]
    return mixed(combined)
