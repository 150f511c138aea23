"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column.

All work is cut into pieces of about PIECE bytes, so that memory does not grow with the batch, and a
text longer than a piece is a piece of its own.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 1 << 16


def _trimmed() -> None:
    """Gives memory that this process has freed back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def released() -> None:
    """Gives back what earlier tasks of other operators left in this worker: remembered tokens, unused buffers."""
    tokens = sys.modules.get("lodestar.llm.tokens")
    if tokens is not None:
        tokens.forget()
    _trimmed()


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches], first: Callable[[], None] = released) -> Callable[[Batches], Batches]:
    """run, for mapInArrow, with a worker's idle memory given back before and after: workers outlive their tasks."""

    def tidied(batches: Batches) -> Batches:
        first()
        try:
            yield from run(batches)
        finally:
            _trimmed()

    return tidied


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans that is true within the given inclusive ranges."""
    table = np.zeros(256, dtype=bool)
    for first, last in ranges:
        table[first : last + 1] = True
    return table


#: Digits, letters and every byte of a code point beyond ASCII.
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: All but space, tab, line feed, vertical tab, form feed and carriage return.
NONSPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, kind)
    data = column.buffers()[2] if len(column) else None
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets.astype(np.int64)


def pieces(column: pa.Array, limit: int = PIECE, most: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of at most most rows and of about limit bytes: first row, end row, bytes, offsets from 0."""
    raw, offsets = utf8(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = min(row + most, max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1))
        yield row, end, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes in table; no run crosses an offset."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = table[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    before[cuts] = False
    after[cuts - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def mix(h: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit values in which every bit depends on every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, _STEP + 1)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), _STEP + 1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings data[start:end], equal for equal strings."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        base = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, base + _STEP, "right")))
        span = int(ends[last - 1] - base)
        if span > _STEP:  # one word longer than a step: Horner over its steps
            h, word = np.uint64(0), data[base : ends[first]]
            with np.errstate(over="ignore"):
                for at in range(0, len(word), _STEP):
                    part = word[at : at + _STEP].astype(np.uint64) + np.uint64(1)
                    h = mix(np.array([h + (part * _UP[: len(part)]).sum(dtype=np.uint64)]))[0]
            out[first] = h
        else:
            total = np.zeros(span + 1, np.uint64)
            np.cumsum((data[base : base + span].astype(np.uint64) + np.uint64(1)) * _UP[:span], out=total[1:])
            s, e = starts[first:last] - base, ends[first:last] - base
            out[first:last] = (total[e] - total[s]) * _DOWN[s]
        first = last
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(_BASE))


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """For every run of length words the hash of the run; len(words) - length + 1 of them at most."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, factor in enumerate(_powers(0xD1342543DE82EF95, length + 1)[1:]):
        out += words[k : k + n] * factor
    return mix(out)


def whole_hash(words: np.ndarray) -> np.uint64:
    """The hash of a whole sequence of words, as run_hashes(words, len(words))[0]."""
    return mix(np.array([(words * _powers(0xD1342543DE82EF95, len(words) + 1)[1:]).sum(dtype=np.uint64)], np.uint64))[0]


def rows_of(bounds: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """For each of the sorted positions the row whose offsets hold it."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(np.searchsorted(positions, bounds)))
