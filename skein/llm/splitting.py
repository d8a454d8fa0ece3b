"""Problem 6: cutting oversized texts at natural boundaries.

Every place of a text has a boundary strength: after a blank line, a line
break, an end mark, a mark within a sentence, white space, or none. Only places
with a boundary are kept; a sparse table over them answers which cut is the
strongest in any window, the rightmost among equals, in constant time after
the window's first and last boundary are looked up. No window is wider than the
limit, so the table has as many levels as that needs, not the text. Pieces then follow each other: the strongest cut in the
permissible window, a step back by the overlap, and so on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space or these end a stretch without natural places.
ENDS = ".!?;。！？；।؟"
MIDDLE = ",:，、：،؛"
_SPACE = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288], np.uint32)


def strengths(text: str) -> np.ndarray:
    """Strength from 0 to 5 of a cut before each place 0 to len(text)."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(len(c) + 1, np.int8)
    space = np.isin(c, _SPACE)
    after = out[1:]
    after[np.isin(c, np.array([ord(x) for x in MIDDLE], np.uint32))] = 2
    after[space] = 1
    end = np.isin(c, np.array([ord(x) for x in ENDS], np.uint32))
    after[end] = 3
    after[1:][space[1:] & end[:-1]] = 3
    line = c == 10
    after[line] = 4
    # A blank line: a line break after another with nothing but white space between.
    if line.any():
        last = np.where(line | ~space, np.arange(len(c)), -1)
        last = np.maximum.accumulate(np.concatenate([[-1], last[:-1]]))
        blank = line & (last >= 0)
        blank[blank] = line[last[blank]]
        after[blank] = 5
    out[0] = 0
    return out


class RangeMaximum:
    """Sparse table over the boundaries of a text: the rightmost of the strongest in any window of at most `width` places."""

    def __init__(self, force: np.ndarray, width: int):
        self.places = np.nonzero(force)[0]
        self.force = force[self.places]
        self.rows = [np.arange(len(self.places), dtype=np.int32)]
        step = 1
        while 2 * step <= min(len(self.places), width):
            a = self.rows[-1]
            left, right = a[:-step], a[step:]
            self.rows.append(np.where(self.force[left] > self.force[right], left, right))
            step *= 2

    def best(self, lo: int, hi: int) -> int:
        """The place of the strongest boundary in ``[lo, hi)``, -1 if there is none."""
        a, b = np.searchsorted(self.places, (lo, hi))
        if a == b:
            return -1
        k = int(b - a).bit_length() - 1
        left, right = self.rows[k][a], self.rows[k][b - (1 << k)]
        return int(self.places[left if self.force[left] > self.force[right] else right])

    def longest_stretch(self, end: int) -> int:
        """The longest stretch up to place `end` without white space and end marks."""
        # A boundary of strength 2 follows a mark within a sentence; the mark before any other is no part of a stretch.
        stop = self.places[self.force != 2] - 1
        return int((np.diff(np.concatenate([[-1], stop, [end]])) - 1).max())


def cut(text: str, limit: int, overlap: int, table: RangeMaximum | None = None) -> list[tuple[int, int, int]]:
    """``(start, end, forced)`` of pieces of at most `limit` characters.

    Each piece begins `overlap` characters before the end of the one before; an
    overlap that leaves no room in a piece is taken as ``limit - 1``, a negative
    one as 0. The cut is the strongest in the second half of what is permissible, else
    in the first; a cut without any natural place is forced (1).
    """
    n = len(text)
    if n <= limit or limit < 1:
        return [(0, n, 0)]
    overlap = max(0, min(overlap, limit - 1))
    table = table or RangeMaximum(strengths(text), limit)
    out, start = [], 0
    while n - start > limit:
        end = table.best(start + max(overlap + 1, limit // 2), start + limit + 1)
        if end < 0:
            end = table.best(start + overlap + 1, start + limit + 1)
        forced = int(end < 0)
        end = start + limit if forced else end
        out.append((start, end, forced))
        start = end - overlap
    out.append((start, n, 0))
    return out


def split(texts: DataFrame) -> DataFrame:
    """``(id, piece, start, end, content, forced)`` of the texts that exceed their limit.

    `texts` holds ``id, text, limit, overlap``. ``forced`` of a row tells
    whether the text holds a stretch longer than the limit without white space
    or end mark, which must be cut within. Null texts and limits, and texts
    within the limit, give no row. Sizes and places are code points.
    """

    def run(batches):
        for b in batches:
            rows = []
            for i, t, m, o in zip(*(b.column(k).to_pylist() for k in ("id", "text", "limit", "overlap"))):
                if len(t) > m:
                    table = RangeMaximum(strengths(t), m)
                    forced = int(table.longest_stretch(len(t)) > m)
                    rows += [(i, k, s, e, t[s:e], forced) for k, (s, e, _) in enumerate(cut(t, m, o or 0, table))]
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["id", "piece", "start", "end", "content", "forced"])

    long = texts.filter("text IS NOT NULL AND limit >= 1 AND char_length(text) > limit")
    return long.select("id", "text", F.col("limit").cast("int"), F.col("overlap").cast("int")).mapInArrow(run, "id string, piece int, start bigint, end bigint, content string, forced bigint")
