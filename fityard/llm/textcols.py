"""Whole columns of texts as numpy arrays: words, shingles and their hashes without a Python string per word.

Batches come from ``mapInArrow``. A text column is one buffer of UTF-8 bytes and one of offsets; all
functions here work on those, in pieces of about ``PIECE_BYTES`` (a longer text is a piece of its own,
so memory is bounded by the piece size or by the longest single text).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
U64 = np.uint64
_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)

# White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RAISED = [np.arange(1, 257, dtype=U64), LOWER.astype(U64) + U64(1)]  # a byte's value plus 1, as it is and lower-cased

_powers = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, PIECE_BYTES + 1)
        for k, base in enumerate((_ODD, _ODD_INVERSE)):
            table = np.full(size, base, dtype=U64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, from 0) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    offsets = offsets.astype(np.int64)
    return data[offsets[0]:offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together, one text at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True,
                space: np.ndarray = SPACE, beginning: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts that ``offsets`` cut out of ``data``, and where each text's words
    begin in it. A-Z are lower-cased. Words are maximal runs of bytes that aren't white space. With
    ``beginning``, every word's hash is followed by that of its first so many bytes."""
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    inside = np.take(~space, data)
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last[:-1] &= ~inside[1:] | cut[1:n]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, dtype=U64)
    terms = np.take(_RAISED[bool(lower)], data)
    terms *= up[:n]
    np.cumsum(terms, out=sums[1:])
    words, at = mix((sums[end] - sums[begin]) * down[begin]), np.searchsorted(begin, offsets)
    if not beginning:
        return words, at
    both = np.empty(2 * len(words), dtype=U64)
    both[::2] = words
    both[1::2] = mix((sums[np.minimum(end, begin + beginning)] - sums[begin]) * down[begin] ^ U64(_ODD))
    return both, 2 * at


def shingle_hashes(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``k`` words inside one text; a text of fewer words has its whole sequence as
    the only one, a text without words none. Returns hashes and where each text's begin."""
    counts = np.diff(at)
    made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    to = np.concatenate([[0], np.cumsum(made)])
    out = np.empty(to[-1], dtype=U64)
    begin = np.repeat(at[:-1] - to[:-1], made) + np.arange(to[-1])
    length = np.repeat(np.minimum(counts, k), made)
    full = length == k
    if full.all():
        parts = [(slice(None), begin, k)]
    else:
        parts = [(rows := np.flatnonzero(length == m), begin[rows], m) for m in range(1, k + 1)]
    for rows, from_, m in parts:
        h = np.full(len(from_), m, dtype=U64)
        for i in range(m):
            h = h * U64(_ODD) + words[from_ + i]
        out[rows] = mix(h)
    return out, to


def texts_words(column: pa.Array, lower: bool = True,
                limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each piece of a text column: first text, end, word hashes, and where each text's words begin."""
    data, offsets = buffers(column)
    for a, b in pieces(offsets, limit):
        words, at = word_hashes(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], lower)
        yield a, b, words, at


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``work`` for ``mapInArrow``, giving back the memory that it leaves unused, Arrow's and the C library's: a Python
    worker outlives its task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            _give_back()

    return run


def whole_groups(batches: Iterator[pa.RecordBatch], least_rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups, of about ``least_rows`` rows; batches come sorted by the first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(h.num_rows for h in held) < least_rows:
            continue
        key = np.asarray(batch.column(0))
        last = int(np.searchsorted(key, key[-1]))
        if last or (len(held) > 1 and held[-2].column(0)[-1].as_py() != key[0]):
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, last)])
            held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)
