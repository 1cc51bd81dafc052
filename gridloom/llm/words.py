"""Words of whole texts as numpy arrays, made without a Python object for each word.

A word is a run of bytes outside 0x20 and 0x09-0x0D. Its hash is a multilinear sum over its
bytes (a random 64-bit value for the byte times one for its place), finished by a mixing
function, so that equal words have equal hashes and other words differ but for 2**-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLAB = 1 << 17
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of SplitMix64: a bijection of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _stream(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BYTES = {low: np.where(_SEP, np.uint64(0), _stream(7, 256)[_LOWER if low else np.arange(256)]) for low in (False, True)}


class Words:
    """Word hashes of a run of documents: hashes[first[i]:first[i + 1]] are those of document i."""

    __slots__ = ("data", "ends", "first", "hashes", "starts")

    def __init__(self, hashes, starts, ends, first, data):
        self.hashes, self.starts, self.ends, self.first, self.data = hashes, starts, ends, first, data

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and the offsets of its rows; a null has no bytes."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    body = column.buffers()[2] if len(column) else None
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words_of(column: pa.Array, lower: bool = False) -> Words:
    """Hashes and byte ranges of the words of each row."""
    data, offsets = text_bytes(column)
    n, table, parts = len(data), _BYTES[lower], []
    at = 0
    while at < n:
        end = min(at + SLAB, n)
        while end < n:  # a slab ends where a document or a word does
            cut = np.flatnonzero(_SEP[data[at:end]])
            if len(cut):
                end = at + int(cut[-1]) + 1
                break
            after = offsets[np.searchsorted(offsets, at, "right")]
            if after <= end:
                end = int(offsets[np.searchsorted(offsets, end, "right") - 1])
                break
            end = min(end + SLAB, n)
        piece = data[at:end]
        word = ~_SEP[piece]
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        lo, hi = np.searchsorted(offsets, [at, end])
        edge = offsets[lo:hi] - at
        edge = edge[edge < len(piece)]
        begin[edge] = word[edge]
        starts = np.flatnonzero(begin)
        if len(starts):
            stop = word.copy()
            stop[:-1] &= ~word[1:] | begin[1:]
            ends = np.flatnonzero(stop) + 1
            skip = int(starts[0])
            lens = np.diff(np.append(starts, len(piece)))
            place = np.arange(len(piece) - skip) - np.repeat(starts - skip, lens)
            with np.errstate(over="ignore"):
                value = table[piece[skip:]] * (_stream(11, int(lens.max())) | np.uint64(1))[place]
            parts.append((mix(np.add.reduceat(value, starts - skip) + (ends - starts).astype(np.uint64)), starts + at, ends + at))
        at = end
    if parts:
        hashes, starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
    else:
        hashes, starts, ends = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets), data)


def gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... of all runs, one run after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def hash_runs(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes, as words have them, of runs of bytes (each of one byte at least) that lie end to end in data."""
    if not len(sizes):
        return np.zeros(0, np.uint64)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(data)) - np.repeat(first, sizes)
    with np.errstate(over="ignore"):
        value = _BYTES[False][data] * (_stream(11, int(sizes.max())) | np.uint64(1))[place]
    return mix(np.add.reduceat(value, first) + sizes.astype(np.uint64))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words of one array; entry i belongs to words i..i+k-1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i, m in enumerate(_stream(101, k) | np.uint64(1)):
            out += hashes[i : i + n] * m
    return mix(out + np.uint64(k))


def slices(batch: pa.RecordBatch, size: int = 1 << 22, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Runs of rows with about size bytes of text, one row at least."""
    _, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def released(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """rows as a task's function that gives free memory back at its end: Python workers outlive tasks, and what they keep adds up."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return task
