"""Splitting oversized items at natural boundaries (problem 3).

Agglomerative merging: an item is cut into atomic segments at every natural
boundary, from blank lines down to white space. Adjacent pairs wait in a heap
keyed by the strength of the boundary between them; the weakest boundary whose
two sides still fit (with the overlap that the piece will be given) is merged
first, so the cuts that remain are the strongest ones the limit allows. A
segment without any boundary that is too long by itself is cut at the limit.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

# Marks that count as natural boundaries.
MARKS = ".!?…。！？؟।；"
#: Boundary strengths, weakest first.
FORCED, WORD, CLAUSE, SENTENCE, LINE, HEADING, BLANK = range(7)
#: What a piece's end is called.
NAMES = ("forced", "word", "clause", "sentence", "line", "numbered", "blank")

_BLANK = re.compile(r"[^\S\n]*\r?\n(?:[^\S\n]*\r?\n)+\s*")
_LINE = re.compile(r"\r?\n|[\r\v\f\x85  ]")
_NUMBERED = re.compile(r"(?:#{1,6}\s|Article\s+\d|\(?[0-9IVXivx]{1,5}[.)]\s|[-*•|])")
_STOP = re.compile(rf"[{MARKS}]+[\"'”’»)\]」』]*(?:\s+|(?<=[。！？；])|$)|[;:,，、؛](?:\s+|(?<=[，、]))|\s+")


_DIVIDES = re.compile(rf"[\s{re.escape(MARKS)}]")


def atoms(text: str, core: int) -> tuple[list[int], list[int], int]:
    """(ends, strengths, longest): offsets where atomic segments end, the strength
    of the boundary there, and the longest stretch without any boundary among
    the segments of more than ``core`` characters.

    Segments stop at sentence level; only those longer than ``core`` are opened
    further, at clauses, then words, then single marks, then by force.
    """
    ends: list[int] = []
    strength: list[int] = []
    longest = 0
    marks: list[tuple[int, int]] = []
    seen = 0
    for m in _BLANK.finditer(text):
        _lines(text, seen, m.start(), marks)
        marks.append((m.end(), BLANK))
        seen = m.end()
    _lines(text, seen, len(text), marks)
    if not marks or marks[-1][0] != len(text):
        marks.append((len(text), BLANK))
    start = 0
    for end, s in marks:
        if end <= start:
            continue
        if end - start > core:
            longest = max(longest, _open(text, start, end, core, ends, strength))
        ends.append(end)
        strength.append(s)
        start = end
    return ends, strength, longest


def _lines(text: str, start: int, end: int, marks: list[tuple[int, int]]) -> None:
    for m in _LINE.finditer(text, start, end):
        _sentences(text, start, m.end(), marks)
        marks.append((m.end(), HEADING if _NUMBERED.match(text, m.end(), end) else LINE))
        start = m.end()
    _sentences(text, start, end, marks)


_SENTENCE = re.compile(rf"[{MARKS}]+[\"'”’»)\]」』]*(?:[^\S\n]+(?=[^a-z\s])|(?<=[。！？；]))")


def _sentences(text: str, start: int, end: int, marks: list[tuple[int, int]]) -> None:
    for m in _SENTENCE.finditer(text, start, end):
        if m.end() < end:
            marks.append((m.end(), SENTENCE))


def _open(text: str, start: int, end: int, core: int, ends: list[int], strength: list[int]) -> int:
    """Inner boundaries of one long segment, not the one at ``end``; the longest stretch that has none."""
    inner, longest = [], 0
    for m in _STOP.finditer(text, start, end):
        if start < m.end() < end:
            c = text[m.start()]
            inner.append((m.end(), CLAUSE if c in ";:,，、؛" or c in MARKS else WORD))
    at = start
    for stop, s in [*inner, (end, None)]:
        if stop - at > core:  # a single mark, then the limit
            longest = max(longest, *map(len, _DIVIDES.split(text[at:stop])))
            while stop - at > core:
                cut = max((text.rfind(c, at, at + core) for c in MARKS), default=-1) + 1
                kind = WORD
                if cut <= at:
                    cut, kind = at + core, FORCED
                ends.append(cut)
                strength.append(kind)
                at = cut
        if s is not None and stop > at:
            ends.append(stop)
            strength.append(s)
            at = stop
    return longest


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces, in order: each within ``limit`` characters and
    beginning ``overlap`` characters before the end of the one before it."""
    return [(a, b) for a, b, _ in cut(text, limit, overlap)[0]]


def cut(text: str, limit: int, overlap: int) -> tuple[list[tuple[int, int, int]], int]:
    """(pieces ``(start, end, strength of the boundary at the end)``, longest stretch without a boundary).

    What a piece adds to the one before has at most ``limit - overlap``
    characters: a word longer than that is cut by force although it may be
    within the limit. Stretches are told where they are longer than that.
    """
    if len(text) <= limit:
        return [(0, len(text), BLANK)], 0
    core = limit - overlap
    if core <= 0 or overlap < 0:
        raise ValueError("the overlap must be smaller than the limit")
    ends, strength, longest = atoms(text, core)
    at_end = dict(zip(ends, strength, strict=True))
    n = len(ends)
    starts = [0, *ends[:-1]]
    right = list(range(1, n + 1))
    left = list(range(-1, n - 1))
    alive = bytearray(b"\x01") * n
    # key: strength, size of the merged piece, place; equal boundaries fill small pieces first
    heap = [(strength[i], ends[i + 1] - starts[i], i, i + 1) for i in range(n - 1)]
    heapify(heap)
    while heap:
        s, size, i, j = heappop(heap)
        if not alive[i] or right[i] != j or j >= n or ends[j] - starts[i] != size:
            continue  # stale
        if size > (limit if starts[i] == 0 else core):
            continue  # sides only grow: it will never fit
        ends[i] = ends[j]
        alive[j] = 0
        right[i] = k = right[j]
        if k < n:
            left[k] = i
            heappush(heap, (strength_of(strength, k), ends[k] - starts[i], i, k))
        if (h := left[i]) >= 0:
            heappush(heap, (strength_of(strength, i), ends[i] - starts[h], h, i))
    out, i = [], 0
    while i < n:
        out.append((max(0, starts[i] - overlap) if out else 0, ends[i], at_end[ends[i]]))
        i = right[i]
    return out, longest


def strength_of(strength: list[int], right: int) -> int:
    """Strength of the boundary before segment ``right``, which is that at the end of the atom before it."""
    return strength[right - 1]


def split(df: DataFrame, key: str, text: str, limit: int, overlap: int, with_text: bool = True) -> DataFrame:
    """Pieces of the items of ``df`` whose ``text`` has more than ``limit`` characters.

    ``(item_id, piece, start, end, boundary, cut, text)``: offsets are code
    points; ``boundary`` is that at the piece's end, by name; ``cut`` is
    ``forced`` where a segment of the item without any boundary is longer than
    the limit, else ``natural``. Null, empty and short items give no row;
    repeated ids come once for each row. Only keys and texts of long items
    leave the JVM; no shuffle.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [], [])
            for k, t in zip(*batch.columns, strict=True):
                k, t = k.as_py(), t.as_py()
                found, longest = cut(t, limit, overlap)
                kind = "forced" if longest > limit else "natural"
                for i, (a, b, s) in enumerate(found):
                    for col, v in zip(cols, (k, i, a, b, NAMES[s] if b < len(t) else "end", kind, t[a:b] if with_text else None), strict=True):
                        col.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["item_id", "piece", "start", "end", "boundary", "cut", "text"])

    items = df.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).filter(F.char_length("t") > limit)
    return items.mapInArrow(run, "item_id bigint, piece int, start bigint, end bigint, boundary string, cut string, text string")


# The fields of size_limits and where they lie.
FIELDS = {
    "corpus_clean.text": ("corpus_clean", "doc_id", "text"),
    "chunks.page_content": ("chunks", "chunk_id", "page_content"),
    "chunks.parent_text": ("chunks", "chunk_id", "parent_text"),
}


def _all(spark: SparkSession, sf_dir: str, with_text: bool) -> DataFrame:
    out = None
    # size_limits has one row for each field (three)
    for r in table(spark, sf_dir, "size_limits").collect():
        name, key, text = FIELDS[r["item_field"]]
        one = split(table(spark, sf_dir, name, key, text), key, text, r["max_chars"], r["overlap_chars"], with_text)
        one = one.select(F.lit(r["item_field"]).alias("item_field"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir, True).dropDuplicates(["item_field", "item_id", "piece"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the splitter had to cut every oversized item, by its segments."""
    return _all(spark, sf_dir, False).select("item_field", "item_id", "cut").distinct()
