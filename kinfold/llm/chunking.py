"""Content-defined pieces of texts, cut at natural boundaries, with overlap.

A rolling hash over the last WINDOW tokens marks landmarks, places that depend on
nothing but the words around them. Each snaps to the strongest natural boundary
within SNAP tokens (the nearest of the strongest): the end of a paragraph, record,
line, sentence or word. A piece ends at the best landmark between its least and
greatest size: the strongest boundary, then the least hash. An edit thus moves the
cuts near it, and the pieces after them fall back into step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinfold.functions.kmers import mix
from kinfold.llm.tokens import BREAKS, code_points, slices, token_starts

PARAGRAPH, RECORD, LINE, SENTENCE, WORD, INSIDE = 5, 4, 3, 2, 1, 0
WINDOW, SNAP, SPACING = 4, 16, 24
_STOPS = [ord(c) for c in ".!?…。！？"]
#: What opens a record: FASTA headers, and marks of alignment blocks.
_OPENERS = [ord(c) for c in ">#/"]


def boundaries(points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Strength of the gap before each token but the first of all."""
    brk = np.isin(points, BREAKS)
    brk[1:] &= ~((points[1:] == 0x0A) & (points[:-1] == 0x0D))  # CR LF is one break
    run = np.r_[0, np.cumsum(brk)]
    lines = run[begin[1:]] - run[end[:-1]]
    strength = np.where(begin[1:] > end[:-1], WORD, INSIDE)
    strength[(strength == WORD) & np.isin(points[end[:-1] - 1], _STOPS)] = SENTENCE
    strength[lines == 1] = LINE
    strength[(lines >= 1) & np.isin(points[begin[1:]], _OPENERS)] = RECORD
    strength[lines >= 2] = PARAGRAPH
    return np.r_[PARAGRAPH, strength]


def token_hashes(points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each token's characters and their places in it."""
    length = end - begin
    at = np.repeat(begin - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())
    place = at - np.repeat(begin, length)
    letters = mix(points[at].astype(np.uint64) * np.uint64(1_000_003) + place.astype(np.uint64))
    return np.add.reduceat(letters, np.r_[0, np.cumsum(length)[:-1]]) if len(begin) else letters


def cuts(hashes: np.ndarray, strength: np.ndarray, least: int, most: int) -> list[int]:
    """Token places at which segments of ``least`` to ``most`` tokens begin (the last
    may be shorter); the first is 0."""
    n = len(hashes)
    if n <= most:
        return [0]
    rolling = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(WINDOW):
            rolling[i + 1 :] += mix(hashes[: n - i - 1], i + 11)
    rolling = mix(rolling)
    marks = np.flatnonzero(rolling % np.uint64(SPACING) == 0)
    marks = marks[marks > 0]
    spots: dict[int, int] = {}
    if len(marks):
        near = marks[:, None] + np.arange(-SNAP, SNAP + 1)[None, :]
        value = np.where((near > 0) & (near < n), strength[np.clip(near, 0, n - 1)], -1) * 1000 - np.abs(np.arange(-SNAP, SNAP + 1))
        for spot, h in zip(near[np.arange(len(marks)), value.argmax(axis=1)].tolist(), rolling[marks].tolist(), strict=True):
            spots[spot] = min(h, spots.get(spot, h))
    where = np.array(sorted(spots), np.int64)
    out = [0]
    while n - out[-1] > most:
        low, high = out[-1] + least, out[-1] + most
        some = where[np.searchsorted(where, low) : np.searchsorted(where, high, "right")]
        if len(some):
            out.append(max(some.tolist(), key=lambda p: (strength[p], -spots[p])))
        else:  # no landmark: the last of the strongest boundaries
            span = strength[low : high + 1]
            out.append(high - int(span[::-1].argmax()))
    return out


def split_texts(documents: DataFrame, limit: int, overlap: int, with_text: bool = True) -> DataFrame:
    """``(doc_id, piece, start_char, core_char, end_char, n_tokens[, text])``.

    No piece has more than ``limit`` tokens. Pieces follow each other from 0; the
    last ``overlap`` tokens of a piece are the first of the next. Offsets count code
    points: ``[start_char, end_char)`` is the piece, ``core_char`` where the part that
    it shares with the piece before it ends, so that the cores of all pieces put
    together are the text. A text within the limit, also an empty one, is one piece;
    a null text gives none. A row of the input is cut by itself: repeated ids give
    repeated pieces. Whole texts are read, whatever their length.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap is at least 0 and less than the limit")
    most = limit - overlap
    least = max(1, most // 4, min(overlap, most))
    fields = "doc_id long, piece int, start_char long, core_char long, end_char long, n_tokens long" + (", text string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                points, starts = code_points(part.column("text"))
                kind, opens = token_starts(points, starts)
                begin = np.flatnonzero(opens)
                edge = np.searchsorted(begin, starts)
                count = np.diff(edge)
                there = part.column("text").is_valid().to_numpy(zero_copy_only=False)
                texts = part.column("text").to_pylist() if with_text else None
                rows, cols = [], []
                short = np.flatnonzero(there & (count <= limit))
                rows.append(short)
                z = np.zeros(len(short), np.int64)
                cols.append((z, z, z, np.diff(starts)[short], count[short]))
                for r in np.flatnonzero(there & (count > limit)):
                    b = begin[edge[r] : edge[r + 1]]
                    text = points[starts[r] : starts[r + 1]]
                    b = b - starts[r]
                    e = _ends(kind[starts[r] : starts[r + 1]], b)
                    c = np.array(cuts(token_hashes(text, b, e), boundaries(text, b, e), least, most), np.int64)
                    first = np.r_[0, c[1:] - overlap]
                    last = np.r_[c[1:], len(b)]
                    core = np.r_[0, b[c[1:]]]
                    rows.append(np.full(len(c), r))
                    cols.append((np.arange(len(c)), np.r_[0, b[first[1:]]], core, np.r_[core[1:], len(text)], last - first))
                row = np.concatenate(rows)
                if not len(row):
                    continue
                piece, start, core, end, size = (np.concatenate([c[i] for c in cols]) for i in range(5))
                arrays = [part.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), *(pa.array(x.astype(np.int64)) for x in (start, core, end, size))]
                names = ["doc_id", "piece", "start_char", "core_char", "end_char", "n_tokens"]
                if with_text:
                    arrays.append(pa.array([texts[r][s:e] for r, s, e in zip(row.tolist(), start.tolist(), end.tolist(), strict=True)], pa.string()))
                    names.append("text")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return documents.select("doc_id", "text").mapInArrow(run, fields)


def _ends(kind: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Where each token ends: after the word's last letter, or the one character."""
    word = kind == 1
    stops = np.flatnonzero(word & ~np.r_[word[1:], False]) + 1
    end = begin + 1
    is_word = word[begin]
    end[is_word] = stops[np.searchsorted(stops, begin[is_word] + 1)]
    return end
