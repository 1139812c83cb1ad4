"""Word shingles of whole texts as sorted arrays of 64-bit hashes, computed in numpy batches.

Words are maximal runs of bytes outside blank, tab, line feed, vertical tab, form feed and
carriage return; A-Z is lowered. A text with fewer words than a shingle has one shingle, the
whole sequence; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_ONE = np.uint64(1)
_MULTIPLIERS = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit over the word (a bijection on 64 bits)."""
    x = (x ^ (x >> np.uint64(30))) * _MULTIPLIERS[0]
    x = (x ^ (x >> np.uint64(27))) * _MULTIPLIERS[1]
    return x ^ (x >> np.uint64(31))


def _power_tables(length: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < length:
        size = max(length, 1 << 16)
        for k, factor in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, factor, dtype=np.uint64)
            steps[0] = _ONE
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def range_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray, fold: bool) -> np.ndarray:
    """Hash of each byte range: a polynomial from prefix sums, so all ranges cost one pass."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(((_FOLD[data] if fold else data).astype(np.uint64) + _ONE) * up[: len(data)], out=sums[1:])
    return mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))


def word_ranges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, stop) of the words of UTF-8 bytes, in order."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _GAP[data], [True])).view(np.int8)))
    return edge[0::2], edge[1::2]


def word_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of each word of one text's UTF-8 bytes, in order."""
    start, stop = word_ranges(data)
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    return range_hashes(data, start, stop, fold=True)


def shingle_set(data: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text's UTF-8 bytes."""
    words = word_hashes(data)
    if not len(words):
        return words
    span = min(width, len(words))
    total = np.full(len(words) - span + 1, span, dtype=np.uint64)
    for k in range(span):
        total = mix(total * _BASE + words[k : len(words) - span + 1 + k])
    return np.unique(total)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without nulls."""
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    values = column.buffers()[2]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets


def each_text(column) -> Iterator[np.ndarray]:
    """UTF-8 bytes of each value."""
    data, offsets = text_bytes(column)
    for start, stop in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield data[start:stop]


def text_chunks(column, size: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of stretches of whole texts of about ``size`` bytes."""
    data, offsets = text_bytes(column)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        end = min(end, len(column))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
