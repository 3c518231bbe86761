"""Vectorised word splitting and hashing over the UTF-8 bytes of Arrow string columns.

All of it runs on whole Arrow batches, in slices of bounded size, so a very long text costs no more
memory at a time than many short ones.
"""
from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes that are handled at once.
SLICE = 1 << 20
_ODD = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_tables: dict[int, np.ndarray] = {}

#: Byte classes. Words of `[^\x20\x09-\x0D]+`: every byte but ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z: digits, a-z, all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(n: int, base: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64."""
    have = _tables.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE + 1)
        out = np.empty(size, np.uint64)
        out[0] = 1
        done = 1
        with np.errstate(over="ignore"):
            while done < size:
                step = min(done, size - done)
                out[done:done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
                done += step
        have = _tables[base] = out
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's constants), in place on a fresh array."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end]; spans lie in ascending order. The length takes part."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    inverse = pow(_ODD, -1, 1 << 64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            low = int(starts[at])
            to = max(at + 1, int(np.searchsorted(ends, low + SLICE, side="right")))
            high = int(ends[to - 1])
            sums = np.empty(high - low + 1, np.uint64)
            sums[0] = 0
            np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * _powers(high - low, _ODD)[:high - low], out=sums[1:])
            s, e = starts[at:to] - low, ends[at:to] - low
            out[at:to] = (sums[e] - sums[s]) * _powers(high - low + 1, inverse)[s] + (e - s).astype(np.uint64)
            at = to
    return mix(out)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (int64, rows + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of every row, and each row's first word number (rows + 1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]  # first bytes of rows that have any
    begins[edges] = inside[edges]
    before = edges[edges > 0] - 1
    stops[before] = inside[before]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def row_blocks(batch: pa.RecordBatch, column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about `most` bytes; a longer text stands alone."""
    if not batch.num_rows:
        return
    _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
    row = 0
    while row < batch.num_rows:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield batch.slice(row, to - row)
        row = to


def words_of(column: pa.Array, table: np.ndarray, lower: bool = True):
    """(data, starts, ends, first word of each row, hashes) of a string column's words."""
    data, offsets = text_bytes(column)
    if lower:
        data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, table)
    return data, starts, ends, first, span_hashes(data, starts, ends)


assert sys.byteorder == "little"
