"""Cutting oversized items into overlapping pieces by packing a structure tree.

A text is a tree: headings of each level, blocks parted by blank lines (with fenced
code and lists kept together), lines, sentences, words and, within words too long, stretches of
characters. Every node is a span and its children part it without a gap, so nothing is
lost. Sibling subtrees are merged bottom-up while they fit; only a node above the limit is
descended into, and its pieces are not merged with its siblings. A heading stays with what follows it. A piece after the first begins with the last ``overlap`` tokens of the text before
it, fewer only where the piece before is shorter.

The size of a text is the number of tokens: a run of characters other than blank, tab, CR, LF
and U+00A0 counts one for each started eight.

Defined cases: null texts, null limits and texts within the limit give no pieces; a limit below 1 counts as
1; an overlap is at most half the limit.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

_TOKEN = r"[^ \t\r\n ]{1,8}"
_RUN = re.compile("[^ \t\r\n ]+")
_HEADING = re.compile(r"^(#{1,6})\s+\S.*$|^(={2,6})\s*\S.*?\s*={2,6}\s*$", re.M)
_UNDERLINED = re.compile(r"^[^\n]{1,80}\n(={3,}|-{3,})[ \t]*$", re.M)
_FENCE = re.compile(r"^(```|~~~).*?^\1[ \t]*$", re.M | re.S)
_BLANK = re.compile(r"\n[ \t\r ]*\n\s*")
_LIST = re.compile(r"\n(?=[ \t]*(?:[-*+•]|\d+[.)])[ \t])")
_LINE = re.compile(r"\n")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"')\]”»]*\s+|(?<=[。！？۔।])\s*")
_CLAUSE = re.compile(r"(?<=[,;:、，])\s+|(?<=[、，])")
_WORD = re.compile("[ \t\r\n ]+")


def size_of(text: Column) -> Column:
    """The size as a column, computed in the JVM."""
    return F.regexp_count(text, F.lit(_TOKEN))


class Sizes:
    """Sizes of spans of one text in logarithmic time."""

    def __init__(self, text: str) -> None:
        self.begin, self.end, self.sum = [], [], [0]
        for m in _RUN.finditer(text):
            self.begin.append(m.start())
            self.end.append(m.end())
            self.sum.append(self.sum[-1] + (m.end() - m.start() + 7) // 8)

    def __call__(self, a: int, b: int) -> int:
        i, j = bisect_right(self.end, a), bisect_left(self.begin, b)
        if i >= j:
            return 0
        n = self.sum[j] - self.sum[i]
        if self.begin[i] < a or self.end[j - 1] > b:
            for r in {i, j - 1}:
                n += (min(self.end[r], b) - max(self.begin[r], a) + 7) // 8 - (self.end[r] - self.begin[r] + 7) // 8
        return n


class _Fences:
    """Whether a place lies within fenced code, in logarithmic time."""

    def __init__(self, text: str) -> None:
        spans = [m.span() for m in _FENCE.finditer(text)]
        self.begin, self.end = [a for a, _ in spans], [b for _, b in spans]

    def __call__(self, p: int, inner: bool = False) -> bool:
        """inner: the place before a fence's first character isn't within it."""
        i = (bisect_left if inner else bisect_right)(self.begin, p) - 1
        return i >= 0 and p < self.end[i]


def _sections(text: str, a: int, b: int, fences: _Fences) -> list[tuple[int, int, int]]:
    """(begin, end, level) of the headings of a span."""
    out = []
    for m in _HEADING.finditer(text, a, b):
        out.append((m.start(), m.end(), len(m.group(1) or m.group(2))))
    for m in _UNDERLINED.finditer(text, a, b):
        out.append((m.start(), m.end(), 1 if m.group(1)[0] == "=" else 2))
    return sorted(h for h in out if not fences(h[0]))


def _opening(text: str, a: int, heads: list[tuple[int, int, int]]) -> int:
    """The end of the headings that a span opens with, with nothing but white space before, between and after them; its begin if there are none."""
    at = a
    for p, end, _ in heads:
        if text[at:p].strip():
            break
        at = end
    return at


def _cut(pattern: re.Pattern, text: str, a: int, b: int, after: int, fences: _Fences | None) -> list[tuple[int, int]]:
    points = [a]
    for m in pattern.finditer(text, a, b):
        p = m.end()
        if points[-1] < p < b and text[after:p].strip() and not (fences and fences(p, True)):
            points.append(p)
            after = p - 1 if after < p - 1 else after
    points.append(b)
    return list(zip(points, points[1:]))


def children(text: str, a: int, b: int, level: int, fences: _Fences) -> tuple[list[tuple[int, int]], int]:
    """The next finer division of a span that has more than one part, and the level below it.

    The headings that a span opens with stay with what follows them, but for those too long for that.
    """
    heads = _sections(text, a, b, fences)
    opening = _opening(text, a, heads)
    while level < 7:
        if level == 0:
            inner = [(p, n) for p, _, n in heads if p > a and p >= opening and text[opening:p].strip()] if opening > a else [(p, n) for p, _, n in heads if p > a]
            if inner:
                top = min(n for _, n in inner)
                points = [a, *(p for p, n in inner if n == top), b]
                return list(zip(points, points[1:])), 0
        else:
            parts = _cut((_BLANK, _LIST, _LINE, _SENTENCE, _CLAUSE, _WORD)[level - 1], text, a, b, opening if level < 5 and opening > a else a, fences if level < 4 else None)
            if len(parts) > 1:
                return parts, level
        level += 1
    return [(p, min(p + 8, b)) for p in range(a, b, 8)], 7


def pack(text: str, limit: int, size: Sizes, a: int, b: int, level: int, fences: _Fences) -> list[tuple[int, int]]:
    """Spans within the limit that part [a, b): whole siblings merged while they fit; what an oversized one is parted into stands apart from its siblings."""
    if size(a, b) <= limit:
        return [(a, b)]
    parts, below = children(text, a, b, level, fences)
    out: list[tuple[int, int]] = []
    whole = False
    for x, y in parts:
        if size(x, y) > limit:
            out += pack(text, limit, size, x, y, below, fences)
            whole = False
        elif whole and size(out[-1][0], y) <= limit:
            out[-1] = (out[-1][0], y)
        else:
            out.append((x, y))
            whole = True
    return out


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(begin, begin of what is new, end) of each piece; one piece for a text within the limit."""
    limit = max(1, limit)
    overlap = max(0, min(overlap, limit // 2))
    size = Sizes(text)
    if size(0, len(text)) <= limit:
        return [(0, 0, len(text))]
    fences = _Fences(text)
    # room for the overlap; its last token may be part of a longer run
    spans = pack(text, max(1, limit - overlap), size, 0, len(text), 0, fences)
    out = [(spans[0][0], spans[0][0], spans[0][1])]
    for (pa_, _), (a, b) in zip(spans, spans[1:]):
        start = a
        if overlap:
            # back to the first place from which the end of the piece before counts the overlap
            j = bisect_left(size.begin, a)
            i = j
            while i > 0 and size.begin[i - 1] >= pa_ and size(size.begin[i - 1], a) <= overlap:
                i -= 1
            if i < j:
                start = size.begin[i]
            elif i > 0 and size.end[i - 1] > pa_:
                start = max(pa_, min(a, size.end[i - 1]) - 8 * overlap, size.begin[i - 1])
            while start < a and size(start, b) > limit:
                start += 8
        out.append((min(start, a), a, b))
    return out


def split(df: DataFrame, keys: list[str], text: str, limit: str, overlap: int) -> DataFrame:
    """(keys, piece_index INT, piece_start INT, new_from INT, piece_end INT, piece STRING) of the rows above their limit.

    Positions count code points. Rows repeated whole count once.
    """
    large = df.select(*keys, F.col(text).alias("_t"), F.greatest(F.col(limit).cast("int"), F.lit(1)).alias("_m")).where(F.col(limit).isNotNull() & (size_of(F.col("_t")) > F.col("_m"))).dropDuplicates(keys)
    schema = ", ".join(f"`{k}` {large.schema[k].dataType.simpleString()}" for k in keys)
    width = len(keys)

    def run(batches):
        for b in batches:
            rows, cols = [], [[], [], [], [], []]
            for r, (t, m) in enumerate(zip(b.column(width).to_pylist(), b.column(width + 1).to_pylist())):
                for n, (a, new, end) in enumerate(pieces(t, m, overlap)):
                    rows.append(r)
                    for c, v in zip(cols, (n, a, new, end, t[a:end])):
                        c.append(v)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(width)), *(pa.array(c, pa.int32()) for c in cols[:4]), pa.array(cols[4], pa.string())], [*keys, "piece_index", "piece_start", "new_from", "piece_end", "piece"])

    return large.mapInArrow(run, schema + ", piece_index int, piece_start int, new_from int, piece_end int, piece string")
