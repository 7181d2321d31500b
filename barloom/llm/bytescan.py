"""Word scans over whole Arrow batches: the bytes of many notes at once, as NumPy arrays.

A batch is cut into slices of whole notes (about `SLICE` bytes; a longer note is a slice of its own), so the arrays of a
slice stay small whatever the batch holds. Word separators are space and the control characters 9 to 13; nothing crosses
a note."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over a 64-bit word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first `n` powers of the rolling base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the bounds of its rows; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), bounds


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, bounds within them) of consecutive slices."""
    data, bounds = text_bytes(column)
    row, rows = 0, len(bounds) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + size, "right")) - 1)
        end = min(end, rows)
        yield row, end, data[bounds[row]:bounds[end]], bounds[row:end + 1] - bounds[row]
        row = end


class Words:
    """Words of a slice: `start` and `end` byte, `row`, and a 64-bit `hash` of each."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, separator: np.ndarray = SEPARATOR):
        inside = ~separator[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        starts = bounds[:-1][bounds[:-1] < bounds[1:]]
        ends = bounds[1:][bounds[:-1] < bounds[1:]] - 1
        first[starts] = inside[starts]
        last[ends] = inside[ends]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.per_row = np.diff(np.searchsorted(self.start, bounds))
        self.row = np.repeat(np.arange(len(bounds) - 1), self.per_row)
        self.hash = mix(span_hash(prefix_hash(data), self.start, self.end))

    def __len__(self) -> int:
        return len(self.start)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words that begin at each word, and whether they all lie in one row."""
        k = len(self) - n + 1
        if k <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        out = np.zeros(k, np.uint64)
        for j in range(n):
            out = out * _BASE + self.hash[j:j + k]
        return mix(out), self.row[:k] == self.row[n - 1:]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rolling hash of data[start:end], the same wherever the span stands."""
    _, down = powers(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches; an empty one gives 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]
