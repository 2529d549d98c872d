"""k-mers of whole Arrow batches at a time, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from kinfold.functions.sequences import RESIDUES

_CODE = np.full(256, 255, np.uint8)
_CODE[np.frombuffer(RESIDUES.encode(), np.uint8)] = np.arange(len(RESIDUES), dtype=np.uint8)
BASE = len(RESIDUES)


def residues(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Residue codes of all texts of a string column without nulls, end to end,
    and the offsets at which each begins."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return _CODE[data[offsets[0] : offsets[-1]]], offsets - offsets[0]


def windows(codes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, position, code)`` of each k-mer, in order of row and position."""
    total = len(codes) - k + 1
    if total <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    code = np.zeros(total, np.int64)
    for i in range(k):
        code *= BASE
        code += codes[i : i + total]
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(lengths)), lengths)[:total]
    position = np.arange(total) - offsets[row]
    inside = position + k <= lengths[row]
    return row[inside], position[inside], code[inside]


def unique(x: np.ndarray) -> np.ndarray:
    """Sorted, without repeats; for mostly distinct integers faster than hashing."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def distinct_sets(row: np.ndarray, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, code)`` without repeats, sorted by both."""
    bits = (BASE**k - 1).bit_length()  # shifts are much faster than divisions
    key = unique((row << bits) | code)
    return key >> bits, key & ((1 << bits) - 1)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (fixed constants of the splitmix64 generator)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def common_counts(a: pa.Array, b: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of texts: sizes of both k-mer sets and of their intersection."""
    n = len(a)
    out = []
    keys = []
    for column in (a, b):
        row, _, code = windows(*residues(column), k)
        key = unique(row * BASE**k + code)
        keys.append(key)
        out.append(np.bincount(key // BASE**k, minlength=n)[:n] if n else np.zeros(0, np.int64))
    both = np.intersect1d(*keys, assume_unique=True)
    return out[0], out[1], np.bincount(both // BASE**k, minlength=n)[:n] if n else np.zeros(0, np.int64)
