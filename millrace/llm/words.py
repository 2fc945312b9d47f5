"""Vectorised words and word n-grams of Arrow string columns: hashes of 64 bits, no Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text is handled in slices of about so many bytes (a longer text is a slice of its own), to bound memory.
SLICE_BYTES = 1 << 20
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)

#: Classes of bytes: 0 separates words. Bytes of multi-byte characters always belong to words.
SPACES = np.ones(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = False
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(256, dtype=np.uint64))


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    group = np.cumsum(sizes) // SLICE_BYTES if len(sizes) else sizes
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def words(column: pa.Array, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start) of every word: a longest run of bytes that ``in_word`` marks, A-Z lower-cased; start counts bytes in the column's own text."""
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(data):
        return none
    inside = in_word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    begins[heads] = inside[heads]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return none
    at = np.flatnonzero(inside)
    word = np.cumsum(begins)[at] - 1
    place = at - starts[word]
    value = _BYTES[_LOWER[data[at]]] * mix(np.arange(int(place.max()) + 1, dtype=np.uint64))[place]
    hashes = mix(np.add.reduceat(value, np.flatnonzero(begins[at])))
    row = np.searchsorted(offsets, starts, "right") - 1
    return hashes, row, starts - offsets[row]


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of equally long sequences of hashes, in order."""
    total = np.full(len(parts[0]), len(parts), np.uint64)
    for part in parts:
        total = mix(total * _M1 + part)
    return total


def shingles(hashes: np.ndarray, row: np.ndarray, n_rows: int, size: int) -> list[np.ndarray]:
    """The sorted distinct word n-grams of each row; a row of fewer words has its whole sequence as one."""
    counts = np.bincount(row, minlength=n_rows)
    ends = np.cumsum(counts)
    grams = combine([hashes[i : len(hashes) - size + 1 + i] for i in range(size)]) if len(hashes) >= size else np.zeros(0, np.uint64)
    out = []
    for count, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if count >= size:
            out.append(np.unique(grams[end - count : end - size + 1]))
        elif count:
            out.append(combine([hashes[end - count + i : end - count + i + 1] for i in range(count)]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
