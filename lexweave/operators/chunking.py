"""Chunkers: one document in, chunks in order out.

What a pure expression can say (sentence packing, structural units, token
windows) stays in Catalyst. Splitters whose state runs along a document
(recursive merging, parent windows, semantic breaks, headings) run as one
Arrow-batched narrow stage.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .embedding import provider

# Forms whose units are numbered paragraphs, and those whose units are articles.
PARAGRAPH_FORMS = ["Judgment", "Opinion of the Advocate General", "Order"]
ARTICLE_FORMS = ["Directive", "Regulation", "Proposal for a directive", "Amended proposal for a directive", "Proposal for a regulation", "Consolidated text"]
# Separators of the recursive splitter, widest first.
SEPARATORS = ["\n\n", "\n", ". ", " ", ""]
SENTENCE_END = rf"(?<=[.!?])[{T.WS}]+"
#: Chunks of the exploratory strategies have at least so many words.
MIN_WORDS = 20


@cache
def tokenizer(path: str):
    """A public tokenizer's file, read once by each worker."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@dataclass(frozen=True)
class ChunkConfig:
    """Parameters of a chunking strategy.

    Lengths are counted by ``unit``: words, chars, or tokens of the tokenizer
    file ``tokens`` names. ``model``: whose vectors tell semantic breaks.
    """

    strategy: str = "fixed_size"
    chunk_size: int = 256
    chunk_overlap: int = 25
    unit: str = "words"
    tokens: str | None = None
    model: str = "hashed"
    parent_child: bool = False
    parent_size: int = 1024
    breakpoint_percentile: float = 95.0
    separators: tuple[str, ...] = field(default=tuple(SEPARATORS))

    def count(self, s: str) -> int:
        return len(tokenizer(self.tokens).encode(s, add_special_tokens=False).ids) if self.tokens else LENGTHS[self.unit](s)


_RUN = re.compile(r"\S+")
LENGTHS: dict[str, Callable[[str], int]] = {"words": lambda s: len(_RUN.findall(s)), "chars": len}


def pack_sentences(text: Column, target: int) -> Column:
    """Sentences packed greedily into chunks of at most ``target`` words, joined
    by a space; a sentence longer than that is a chunk by itself. No overlap."""
    counted = F.transform(F.split(text, SENTENCE_END, -1), lambda s: F.struct(s.alias("s"), T.word_count(s).alias("n")))
    sentences = F.filter(counted, lambda x: x["n"] > 0)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        s, words = x["s"], x["n"]
        full = acc["now"].isNotNull() & (acc["n"] + words > target)
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["now"])).otherwise(acc["done"]).alias("done"),
            F.when(full | acc["now"].isNull(), s).otherwise(F.concat(acc["now"], F.lit(" "), s)).alias("now"),
            F.when(full, words).otherwise(acc["n"] + words).alias("n"),
        )

    return F.aggregate(sentences, start, step, lambda acc: F.when(acc["now"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["now"])))


def structural_units(text: Column, form: Column) -> Column:
    """Numbered paragraphs or articles by the document's form; blocks between
    blank lines where it has another form or not more than one unit."""
    keep = lambda a: F.filter(a, lambda x: T.strip(x) != "")
    marked = F.when(form.isin(PARAGRAPH_FORMS), keep(F.split(text, rf"(?md)(?=^\p{{Nd}}+\.[{T.WS}])", -1))).when(form.isin(ARTICLE_FORMS), keep(F.split(text, rf"(?md)(?=^Article[{T.WS}]+\p{{Nd}}+)", -1)))
    blocks = keep(F.split(text, rf"\n[{T.WS}]*\n", -1))
    return F.when(F.coalesce(F.size(marked), F.lit(0)) > 1, marked).otherwise(blocks)


def token_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` words that begin ``size - overlap`` words apart."""
    words = T.words(text)
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, size), " "))


def bpe_windows(docs: DataFrame, path: str, size: int, overlap: int) -> DataFrame:
    """``(doc_id, window, start, end, n_tokens, page_content)``: windows of ``size``
    tokens of the tokenizer file ``path`` that begin ``size - overlap`` tokens apart.

    Offsets are characters; a character whose bytes two windows divide is in both.
    Null and empty texts have no window. One narrow stage over whole texts.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spans = tokenizer(path).encode(t or "", add_special_tokens=False).offsets
                for w, i in enumerate(range(0, len(spans), size - overlap)):
                    inside = spans[i : i + size]
                    a, b = inside[0][0], inside[-1][1]
                    out.append({"doc_id": k, "window": w, "start": a, "end": b, "n_tokens": len(inside), "page_content": t[a:b]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("window", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.int32()), ("page_content", pa.string())]))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, window int, start bigint, end bigint, n_tokens int, page_content string")


def recursive_split(text: str, cfg: ChunkConfig) -> list[str]:
    """Splits at the widest separator that occurs, opens what is too long with
    the next ones, and merges neighbours up to the size with the asked overlap."""
    length = cfg.count

    def merged(parts: list[tuple[str, int]]) -> Iterator[str]:
        window: list[tuple[str, int]] = []
        total = 0
        for part, n in parts:
            if window and total + n > cfg.chunk_size:
                yield "".join(p for p, _ in window)
                while window and (total > cfg.chunk_overlap or total + n > cfg.chunk_size):
                    total -= window.pop(0)[1]
            window.append((part, n))
            total += n
        if window:
            yield "".join(p for p, _ in window)

    def opened(s: str, separators: tuple[str, ...]) -> Iterator[str]:
        at = next((i for i, sep in enumerate(separators) if not sep or sep in s), len(separators))
        if at == len(separators):
            yield s
            return
        sep, rest = separators[at], separators[at + 1 :]
        found = s.split(sep) if sep else list(s)
        parts = [found[0], *(sep + x for x in found[1:])] if sep else found
        small: list[tuple[str, int]] = []
        for part in parts:
            if not part:
                continue
            n = length(part)
            if n <= cfg.chunk_size:
                small.append((part, n))
                continue
            yield from merged(small)
            small = []
            if rest:
                yield from opened(part, rest)
            else:
                yield part
        yield from merged(small)

    return [c for c in (x.strip() for x in opened(text, cfg.separators)) if c]


def windows(sizes: list[int], limit: int) -> list[tuple[int, int]]:
    """The units ``[low, high]`` around each unit that make its parent.

    A parent spreads to both sides alike, the right one first, as far as the sum
    of the sizes stays within ``limit``; where one side can't go on, the other
    does alone. Over prefix sums both reaches are found by bisection.
    """
    upto = [0, *accumulate(sizes)]
    last = len(sizes) - 1
    out = []
    for i in range(len(sizes)):
        both = range(1, min(i, last - i) + 1)
        t = bisect_right(both, limit, key=lambda d, i=i: upto[i + d + 1] - upto[i - d])
        low, high = i - t, i + t
        if high < last and upto[high + 2] - upto[low] <= limit:
            high = bisect_right(upto, upto[low] + limit) - 2
        elif low:
            low = min(low, bisect_left(upto, upto[high + 1] - limit))
        out.append((low, high))
    return out


def parent_window(units: list[str], sizes: list[int], i: int, limit: int) -> str:
    """The parent of unit ``i``."""
    low, high = windows(sizes, limit)[i]
    return "\n\n".join(units[low : high + 1])


def semantic_split(text: str, cfg: ChunkConfig) -> list[str]:
    """Breaks where consecutive sentences (each with its neighbours) are farther
    apart than the percentile of all such distances of the document."""
    import numpy as np

    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]
    if len(sentences) < 2:
        return sentences
    v = provider(cfg.model)()([" ".join(sentences[max(0, i - 1) : i + 2]) for i in range(len(sentences))])
    far = 1 - (v[:-1] * v[1:]).sum(1)
    cut = np.flatnonzero(far > np.percentile(far, cfg.breakpoint_percentile)) + 1
    edges = [0, *cut.tolist(), len(sentences)]
    return [" ".join(sentences[a:b]) for a, b in zip(edges, edges[1:])]


_HEADING = re.compile(r"^(#{1,6})[ \t]+(.*\S)[ \t]*$", re.M)


def heading_sections(text: str, deepest: int) -> list[dict]:
    """Sections between headings of level 1 to ``deepest``; the heading stays in the text."""
    out, open_, at = [], {}, 0
    title, level = None, None

    def add(a: int, b: int) -> None:
        if text[a:b].strip():
            out.append({"text": text[a:b].strip(), "title": title, "level": level, "breadcrumb": " > ".join(open_[k] for k in sorted(open_)) or None})

    for m in _HEADING.finditer(text):
        if len(m[1]) > deepest:
            continue
        add(at, m.start())
        at, title, level = m.start(), m[2], len(m[1])
        open_ = {k: v for k, v in open_.items() if k < level} | {level: title}
    add(at, len(text))
    return out


def _divisions(text: str, units: list[str] | None, cfg: ChunkConfig) -> Iterator[tuple[str, dict]]:
    """The natural parts of a text by strategy, each with the columns that its chunks share."""
    if cfg.strategy in ("fixed_size", "recursive"):
        yield text, {}
    elif cfg.strategy == "semantic":
        yield from ((s, {}) for s in semantic_split(text, cfg))
    elif cfg.strategy == "structural":
        units = units or []
        around = windows([cfg.count(u) for u in units], cfg.parent_size) if cfg.parent_child else [None] * len(units)
        yield from ((u, {"parent_text": w and "\n\n".join(units[w[0] : w[1] + 1])}) for u, w in zip(units, around, strict=True))
    else:
        crumb = "breadcrumb" if cfg.strategy == "markdown" else "title"
        for s in heading_sections(text, 6 if cfg.strategy == "markdown" else 1):
            yield s["text"], {"parent_text": s["text"], "section_title": s["title"], "section_level": s["level"], "breadcrumb": s[crumb]}


def _pieces(text: str, units: list[str] | None, cfg: ChunkConfig) -> Iterator[dict]:
    """Chunks in order: a part that fits is one as it is, others are opened; fixed sizes always are."""
    always = cfg.strategy in ("fixed_size", "recursive")
    for part, shared in _divisions(text, units, cfg):
        for c in recursive_split(part, cfg) if always or cfg.count(part) > cfg.chunk_size else [part]:
            yield {"page_content": c, **shared}


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("chunk_index", pa.int32()), ("page_content", pa.string()), ("parent_text", pa.string()), ("section_title", pa.string()), ("section_level", pa.int32()), ("breadcrumb", pa.string())])
_DDL = "doc_id bigint, chunk_index int, page_content string, parent_text string, section_title string, section_level int, breadcrumb string"
#: Strategies of the caller: a text and its configuration to chunks ``{page_content, ...}``.
SPLITTERS: dict[str, Callable[[str, ChunkConfig], Iterable[dict]]] = {}
STRATEGIES = ("fixed_size", "recursive", "sentence", "structural", "semantic", "markdown", "section")


def chunk(docs: DataFrame, cfg: ChunkConfig, min_words: int = 0) -> DataFrame:
    """Chunks of ``(doc_id, form, text)``; pieces of fewer than ``min_words`` words
    go before chunks are numbered. Null and empty texts have no chunk."""
    own = SPLITTERS.get(cfg.strategy)
    if own is None and cfg.strategy not in STRATEGIES:
        raise NotImplementedError(f"chunking strategy {cfg.strategy!r}")
    text = F.coalesce("text", F.lit(""))
    if cfg.strategy == "sentence":
        packed = docs.select("doc_id", F.posexplode(F.filter(pack_sentences(text, cfg.chunk_size), lambda c: T.word_count(c) >= min_words)).alias("chunk_index", "page_content"))
        empty = {c: F.lit(None).cast(t) for c, t in (("parent_text", "string"), ("section_title", "string"), ("section_level", "int"), ("breadcrumb", "string"))}
        return packed.withColumns(empty)
    units = structural_units(text, F.coalesce("form", F.lit(""))) if cfg.strategy == "structural" else F.lit(None).cast("array<string>")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, t, u in zip(*batch.columns, strict=True):
                i = 0
                for piece in own(t.as_py(), cfg) if own else _pieces(t.as_py(), u.as_py(), cfg):
                    if len(_RUN.findall(piece["page_content"])) >= min_words:
                        out.append({"doc_id": k.as_py(), "chunk_index": i, **piece})
                        i += 1
            yield pa.RecordBatch.from_pylist(out, _SCHEMA)

    return docs.select("doc_id", text.alias("text"), units.alias("units")).mapInArrow(run, _DDL)


def enrich(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Ids, position, totals, counts and content flags of chunks, with the document's columns."""
    flags = {k: F.coalesce(c, F.lit(False)) for k, c in T.flags(F.col("page_content")).items()}
    out = chunks.withColumn("chunk_total", F.count(F.lit(1)).over(W.partitionBy("doc_id")))
    counts = {"chunk_name": T.chunk_name(F.col("doc_id"), F.col("chunk_index")), "words": T.word_count(F.col("page_content")), "chars": F.char_length("page_content")}
    return out.withColumns(counts | flags).join(docs, "doc_id", "left")
