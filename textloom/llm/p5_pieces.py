"""Problem 5: splitting oversized items at natural boundaries.

Method: content-defined chunking. A rolling hash over the last characters marks landmarks; a
landmark between the minimum and the maximum size snaps to the best natural boundary near it, so
an edit moves only the cuts beside it. Pieces share up to ``overlap`` characters.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.common import map_batches, one_row_per, read

LIMIT, OVERLAP, MINIMUM = 1600, 160, 800
#: Window of the rolling hash, and its mask: one character in 64 is a landmark.
WINDOW, MASK = 16, 63
_POWERS = np.cumprod(np.full(WINDOW, 0x9E3779B97F4A7C15 | 1, dtype=np.uint64), dtype=np.uint64)[::-1]
#: Natural boundaries, best first; the cut is at a match's end.
BOUNDARIES = (
    re.compile(r"\n[^\S\n]*\n\s*"),  # paragraph
    re.compile(r"\n+"),  # line, list item, table row
    re.compile(r"[.!?][\"'”’)\]]*\s+|[。！？]\s*"),  # sentence
    re.compile(r"[,;:]\s+|[，；：、]"),  # clause
    re.compile(r"\s+"),  # word
)


def landmarks(text: str) -> np.ndarray:
    """Positions after which the rolling hash of the last WINDOW characters meets the mask.

    The hash depends on those characters only, never on where the text begins.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(codes) < WINDOW:
        return np.empty(0, dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(codes, WINDOW)
    with np.errstate(over="ignore"):
        h = (view * _POWERS).sum(axis=1, dtype=np.uint64)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.flatnonzero(((h >> np.uint64(32)) & np.uint64(MASK)) == 0) + WINDOW


def _cut(text: str, marks: np.ndarray, start: int, low: int, high: int) -> int:
    """The end of the piece from ``start``, in (low, high]: of the best rank of boundary there is
    in that range, the one nearest to the first landmark in it (the last, where none is)."""
    i = int(np.searchsorted(marks, low, side="right"))
    mark = int(marks[i]) if i < len(marks) and marks[i] <= high else None
    for kind in BOUNDARIES:
        ends = [m.end() for m in kind.finditer(text, max(start, low - 2), high) if low < m.end() <= high]
        if ends:
            return min(ends, key=lambda e: (abs(e - mark), e)) if mark is not None else ends[-1]
    return mark if mark is not None else high


def _begin(text: str, cut: int, start: int, overlap: int) -> int:
    """Where the next piece begins: the earliest natural boundary within ``overlap`` before ``cut``."""
    low = max(start + 1, cut - overlap)
    if overlap <= 0 or low >= cut:
        return cut
    for kind in BOUNDARIES:
        for m in kind.finditer(text, max(0, low - 1), cut):
            if low <= m.end() < cut:
                return m.end()
    return low


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP, minimum: int = MINIMUM) -> list[tuple[int, int]]:
    """(begin, end) of the pieces; a text of at most ``limit`` characters is one piece.

    Every character is in a piece, no piece is longer than ``limit`` or empty, and consecutive
    pieces share at most ``overlap`` characters. No piece is shorter than ``minimum`` where the limit
    is at least twice that: the last cut leaves enough for what follows. Needs 0 <= overlap < minimum
    < limit.
    """
    if not 0 <= overlap < minimum < limit:
        raise ValueError("0 <= overlap < minimum < limit")
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    marks = landmarks(text)
    out, start = [], 0
    while n - start > limit:
        high = min(start + limit, max(n - minimum, start + minimum + 1))
        end = _cut(text, marks, start, min(start + minimum, high - 1), high)
        out.append((start, end))
        start = _begin(text, end, start, overlap)
    out.append((start, n))
    return out


def split_oversized(df: DataFrame, key: str, group: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, minimum: int = MINIMUM) -> DataFrame:
    """(key, group, piece, begin, end, text): the ordered pieces of the items over ``limit``.

    One row per key is taken first, over the keys whose text is too long only. NULL keys and
    NULL texts give no row; items within the limit give none, as they need no split. ``begin``
    and ``end`` count code points from 0. Other columns are dropped, whatever their names.
    """
    own = df.select(F.col(key).alias("k"), F.col(group).alias("g"), F.col(text).alias("t"))
    # The length is read in the scan's stage, so only oversized texts are shuffled or leave the JVM.
    long = one_row_per(own.where(F.char_length("t") > limit), "k", ["g", "t"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows: list[tuple] = []
        for k, g, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            rows += [(k, g, i, b, e, t[b:e]) for i, (b, e) in enumerate(split(t, limit, overlap, minimum), 1)]
        if not rows:
            return None
        types = [batch.schema.field(0).type, batch.schema.field(1).type, pa.int32(), pa.int32(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["k", "g", "piece", "begin", "end", "text"])

    kinds = dict(long.dtypes)
    out = map_batches(long, run, f"k {kinds['k']}, g {kinds['g']}, piece int, begin int, end int, text string")
    return out.withColumnsRenamed({"k": key, "g": group})


def p5_pieces(spark, sf_dir: str) -> DataFrame:
    return split_oversized(read(spark, sf_dir, "chunk_embeddings"), "chunk_id", "source", "chunk_text")


def p5_found(spark, sf_dir: str) -> DataFrame:
    """The chunks that the operator had to cut: those with a first piece."""
    return p5_pieces(spark, sf_dir).where("piece = 1").select("chunk_id")


ORACLE = {"p5_found": "select distinct chunk_id from chunk_embeddings where length(chunk_text) > 1600"}
