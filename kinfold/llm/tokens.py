"""Sizes of texts, in tokens counted over whole Arrow batches.

A token is a match of ``[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\p{Z}\\p{C}]``: a run of letters,
digits and underscores, or one other visible character.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that are held as code points at once, or one text if longer.
SLICE_BYTES = 2_000_000
BREAKS = (0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0x2028, 0x2029)


def char_ranges(pattern: str) -> np.ndarray:
    """Which code points match a one-character pattern of the ``regex`` library."""
    import regex

    out = np.zeros(0x110000, bool)
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):
        for m in regex.finditer(f"(?:{pattern})+", "".join(map(chr, range(low, high)))):
            out[low + m.start() : low + m.end()] = True
    return out


@cache
def classes() -> np.ndarray:
    """By code point: 1 in words, 2 a token of its own, 0 no token."""
    word = char_ranges(r"[\p{L}\p{N}_]")
    return np.where(word, 1, np.where(char_ranges(r"[^\p{L}\p{N}_\p{Z}\p{C}]"), 2, 0)).astype(np.uint8)


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts (null as empty) end to end, and where each begins."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(data):
        return np.zeros(0, np.uint32), offsets
    points = np.frombuffer(bytes(data).decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(points) == len(data):
        return points, offsets
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    return points, heads[offsets]


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about SLICE_BYTES of text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    at, total = 0, np.cumsum(sizes)
    while at < batch.num_rows:
        base = total[at] - sizes[at]
        end = max(at + 1, int(np.searchsorted(total, base + SLICE_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def token_starts(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each code point, and which of them begin a token."""
    kind = classes()[points]
    word = kind == 1
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    heads = starts[:-1][starts[:-1] < len(points)]
    begins[heads] |= word[heads]
    return kind, begins | (kind == 2)


def sizes_of(batch: pa.RecordBatch, column: str = "text") -> np.ndarray:
    points, starts = code_points(batch.column(column))
    run = np.zeros(len(points) + 1, np.int64)
    np.cumsum(token_starts(points, starts)[1], out=run[1:])
    return np.diff(run[starts])


def text_sizes(documents: DataFrame) -> DataFrame:
    """``(doc_id, size)`` of ``documents(doc_id, text)``, a row per row; 0 for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes_of(part))], names=["doc_id", "size"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, size long")
