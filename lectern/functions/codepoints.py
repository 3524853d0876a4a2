"""Arrow strings as flat code-point arrays, and rolling hashes over them.

Everything here is vectorised: one batch is one numpy array, so a worker's
cost is a few passes over its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


#: Bytes of text that one pass of array code takes; a worker's memory is some thirty times that, however long the texts.
SLICE_BYTES = 8 << 20


def sliced(batches: Iterator[pa.RecordBatch], *columns: str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches cut into slices with at most ``most`` (SLICE_BYTES) bytes of text in the columns (strings or lists of them), or of one row."""
    most = most or SLICE_BYTES
    for batch in batches:
        sizes = np.ones(len(batch), np.int64)
        for name in columns:
            column = batch.column(name)
            if pa.types.is_list(column.type):
                lengths = np.asarray(pc.fill_null(pc.binary_length(column.flatten()), 0), np.int64)
                sizes += np.bincount(np.asarray(pc.list_parent_indices(column), np.int64), weights=lengths, minlength=len(batch)).astype(np.int64)
            else:
                sizes += np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
        first, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if total + n > most and i > first:
                yield batch.slice(first, i - first)
                first, total = i, 0
            total += n
        if first < len(batch) or not len(batch):
            yield batch.slice(first)


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One contiguous array of nullable strings; null becomes the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def flatten(column: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Elements of a list<string> column: (texts, row of each, index in its row)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = np.asarray(pc.list_parent_indices(column), dtype=np.int64)
    texts = strings(pc.list_flatten(column))
    first = np.searchsorted(rows, rows, side="left")
    return texts, rows, np.arange(len(rows)) - first


def codepoints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of an array of texts, and the n + 1 offsets between texts."""
    lengths = np.asarray(pc.utf8_length(texts), dtype=np.int64)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    if not len(texts) or not offsets[-1]:
        return np.zeros(0, np.uint32), offsets
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = bytes(texts.buffers()[2][bounds[0] : bounds[-1]])
    return np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32), offsets


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base & 0xFFFFFFFFFFFFFFFF, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


class Rolling:
    """Hashes of any fixed-length window of a code-point array, after one prefix pass; another seed gives others."""

    def __init__(self, points: np.ndarray, seed: int = 0x9E37):
        with np.errstate(over="ignore"):
            n = len(points)
            self._back, powers = _powers(_INVERSE, n + 1), _powers(_BASE, n + 1)[:n]
            terms = mix(points.astype(np.uint64) + np.uint64(seed)) * powers
            self._sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))

    def at(self, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self._sums[starts + length] - self._sums[starts]) * self._back[starts])

    def all(self, length: int) -> np.ndarray:
        """Hash of the window at every start; empty if the array is shorter."""
        n = len(self._sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return mix((self._sums[length:] - self._sums[:n]) * self._back[:n])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` values, by doubling."""
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out
