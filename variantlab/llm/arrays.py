"""Words and sentences of Arrow text columns as numpy arrays, without a Python loop over words.

Texts are handled as UTF-8 bytes.  A polynomial in the bytes modulo 2**64 gives every word a
64-bit value; prefix sums make that one pass over the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that end a word: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes handled together, so that temporaries stay small; one longer text is handled alone.
CHUNK = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            m = max(n, CHUNK + 1)
            self.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(m, _BASE, np.uint64))])
            self.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(m, _INVERSE, np.uint64))])
        return self.up, self.down


_POWERS = _Powers()


def mix(z: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    z = z ^ (z >> np.uint64(32))
    z = z * np.uint64(0xD6E8FEB86659FD93)
    z = z ^ (z >> np.uint64(29))
    z = z * np.uint64(0xC2B2AE3D27D4EB4F)
    return z ^ (z >> np.uint64(32))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offset of each; a null text is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer text makes a range of its own."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end
        row = end


class Words:
    """The words of some texts: `start`, `end` (bytes), `value` (64 bits), `first` (of each text)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> None:
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = ~separators[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n + 1, bool)
        before[0], before[1:] = True, ~inside
        after = np.empty(n + 1, bool)
        after[n], after[:n] = True, ~inside
        self.start = np.flatnonzero(inside & (before[:n] | edge[:n]))
        self.end = np.flatnonzero(inside & (after[1:] | edge[1:])) + 1
        up, self.down = _POWERS.to(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])
        self.first = np.searchsorted(self.start, offsets)

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit value of each byte span."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start] ^ (end - start).astype(np.uint64) << np.uint64(40))

    @property
    def value(self) -> np.ndarray:
        return self.span(self.start, self.end)


def runs(values: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of all runs of `size` words and the text of each; a shorter text with words has one run, all of it."""
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + first[:-1][text]
    end = first[1:][text]
    padded = np.concatenate([values, np.zeros(size, np.uint64)])
    out = np.zeros(len(text), np.uint64)
    for j in range(size):
        out = out * np.uint64(_BASE) + np.where(at + j < end, padded[at + j], np.uint64(j + 1))
    return mix(out), text


def counted(values: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each text, their text and how often each occurs there; sorted by text and value."""
    order = np.lexsort((values, text))
    v, t = values[order], text[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    return v[at], t[at], np.diff(np.append(at, len(v)))
