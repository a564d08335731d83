"""Vectorised text work on Arrow string buffers: slices, words, hashes.

Texts stay UTF-8 bytes in one buffer; a word is a run of bytes other than 0x20 and 0x09-0x0D, so multi-byte
characters are never split. All hashes are 64-bit and depend on content only, never on the batch or the process.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
WHITESPACE = np.zeros(256, bool)
WHITESPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Text bytes that are worked on at once; a longer text makes a slice of its own.
SLICE_BYTES = 3 << 20

_BASE = U64(0x9E3779B97F4A7C15 | 1)
_WRAP = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # not glibc
    _trim = None


def give_back() -> None:
    """Hand memory that is free to the system; allocators keep it for themselves."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def giving_back(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``work``, with give_back() at its end: else a Python worker that waits for its next task, of whatever stage, holds
    the most that a task of its took, beside its executor's JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return run


_POWERS = np.multiply.accumulate(np.full(_WRAP, _BASE, U64))
_BYTES = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and the offsets of each; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text, each with a row at least."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = min(rows, max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1))
        yield row, end
        row = end


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for slices of a column."""
    data, offsets = text_buffer(column)
    for row, end in slices(offsets, most):
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal first ``keys`` columns, of rows sorted by them; one run is held at a time."""
    left: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)])
        cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
        if left and any(left[-1].column(i)[-1].as_py() != batch.column(i)[0].as_py() for i in range(keys)):
            yield pa.Table.from_batches(left).combine_chunks().to_batches()[0]
            left = []
        for a, b in zip([0, *cuts[:-1]], cuts, strict=False):
            yield pa.Table.from_batches([*left, batch.slice(a, b - a)]).combine_chunks().to_batches()[0] if left else batch.slice(a, b - a)
            left = []
        left.append(batch.slice(cuts[-1] if len(cuts) else 0))
    if left:
        yield pa.Table.from_batches(left).combine_chunks().to_batches()[0]


def word_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts, and whether each byte is whitespace; a text's end ends its last word."""
    space = WHITESPACE[data]
    first = np.empty(len(data), bool)
    first[:1] = True
    first[1:] = space[:-1]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    first &= ~space
    return np.flatnonzero(first), space


def segment_hashes(values: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """A hash of each run of 64-bit ``values`` from one start to the next; zero values don't count."""
    if not len(starts):
        return np.zeros(0, U64)
    lengths = np.diff(np.append(starts, count))
    at = np.arange(starts[0], count) - np.repeat(starts, lengths)
    at &= _WRAP - 1
    return mix(np.add.reduceat(values[starts[0] :] * _POWERS[at], starts - starts[0]))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of each word, the text of each word, and the words before each text (one more than texts)."""
    if lower:
        data = LOWER[data]
    starts, space = word_starts(data, offsets)
    values = _BYTES[data]
    values[space] = 0
    hashes = segment_hashes(values, starts, len(data))
    before = np.searchsorted(starts, offsets)
    return hashes, np.repeat(np.arange(len(offsets) - 1), np.diff(before)), before


_STEPS = mix(np.arange(1, 65, dtype=U64)) | U64(1)


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k consecutive entries, as if all entries were of one text."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, U64)
    for i in range(k):
        out += words[i : i + n] * _STEPS[i]
    return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct k-word shingles, sorted, end to end, and their offsets.

    A text of fewer words has its whole sequence as its one shingle; a text without words has none.
    """
    words, _, before = word_hashes(data, offsets)
    runs = run_hashes(words, k)
    counts = np.diff(before)
    sizes = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(ends[-1], U64)
    keep = np.empty(ends[-1], bool)
    for row, (n, a, b) in enumerate(zip(counts.tolist(), before.tolist(), ends.tolist(), strict=False)):
        if n >= k:
            part = out[b : ends[row + 1]]
            part[:] = runs[a : a + n - k + 1]
            part.sort()
            keep[b] = True
            np.not_equal(part[1:], part[:-1], out=keep[b + 1 : ends[row + 1]])
        elif n:
            out[b] = run_hashes(words[a : a + n], n)[0] ^ _STEPS[32 + n]
            keep[b] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], kept[ends]
