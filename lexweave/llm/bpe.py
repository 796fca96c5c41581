"""Byte-level BPE encoding with a public vocabulary (problem 6).

Merging runs on a *hierarchical-bitmap rank queue*: every merge rank owns a
bucket of linked-list positions, three levels of 64-bit words tell which
buckets hold anything, and find-first-set from the top word yields the next
rank in constant time. Entries whose pair has changed since they were queued
are skipped when their bucket is opened. A pre-token of n bytes costs O(n)
queue operations, so unbroken strings of hundreds of kilobytes are no worse per
byte than words.
"""

from __future__ import annotations

import base64
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder of the public vocabularies; a parameter of every operator that encodes.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Broadcast bound for a vocabulary file; rank files have a fixed number of entries.
VOCABULARY_BYTES = 16_000_000
#: Pre-tokens remembered by each worker; beyond it the memory is emptied, results stay the same.
REMEMBERED = 400_000


class RankQueue:
    """Positions by merge rank; ``pop`` gives the lowest rank that holds any."""

    __slots__ = ("buckets", "low", "mid", "top")

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        word, block = rank >> 6, rank >> 12
        self.low[word] |= 1 << (rank & 63)
        self.mid[block] |= 1 << (word & 63)
        self.top |= 1 << block

    def pop(self) -> tuple[int, list[int]] | None:
        top = self.top
        if not top:
            return None
        block = (top & -top).bit_length() - 1
        bits = self.mid[block]
        word = (block << 6) | ((bits & -bits).bit_length() - 1)
        bits = self.low[word]
        rank = (word << 6) | ((bits & -bits).bit_length() - 1)
        bits &= bits - 1
        self.low[word] = bits
        if not bits:
            self.mid[block] &= ~(1 << (word & 63))
            if not self.mid[block]:
                self.top &= ~(1 << block)
        return rank, self.buckets.pop(rank)


def _class(kinds: str, last: int) -> str:
    """A regex character class of the code points to ``last`` whose category begins with one of ``kinds``."""
    out, start = [], None
    for cp in range(last + 2):
        inside = cp <= last and unicodedata.category(chr(cp))[0] in kinds
        if inside and start is None:
            start = cp
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{cp - 1:08x}")
            start = None
    return "".join(out)


# White space of the pre-token pattern (Unicode White_Space).
_BEYOND = re.compile("[\U00010000-\U0010ffff]")
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _pattern(letters: str, numbers: str, space: str) -> re.Pattern:
    return re.compile(
        rf" ?[{letters}]+| ?[{numbers}]+|'(?:[stmd]|re|ve|ll)| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


class Encoder(dict):
    """Ids of text. As a mapping it remembers the ids of pre-tokens."""

    def __init__(self, vocabulary: bytes):
        super().__init__()
        self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in vocabulary.splitlines() if line)}
        self.spelling = {r: t for t, r in self.ranks.items()}
        self.byte = [self.ranks[bytes([b])] for b in range(256)]
        self.queue = RankQueue(max(self.spelling) + 1)
        self.pairs: dict[int, int] = {}
        self._ascii = _pattern("A-Za-z", "0-9", "\\t-\\r ")
        self._wide: dict[int, re.Pattern] = {}

    def pretokens(self, text: str) -> list[str]:
        """Pieces within which merges happen. Classes that end at the text's plane keep the matcher fast."""
        if text.isascii():
            return self._ascii.findall(text)
        last = sys.maxunicode if _BEYOND.search(text) else 0xFFFF
        if last not in self._wide:
            self._wide[last] = _pattern(_class("L", last), _class("N", last), _SPACE)
        return self._wide[last].findall(text)

    def _rank(self, a: int, b: int) -> int:
        key = a << 20 | b
        rank = self.pairs.get(key)
        if rank is None:
            rank = self.pairs[key] = self.ranks.get(self.spelling[a] + self.spelling[b], -1)
        return rank

    def merge(self, data: bytes) -> tuple[int, ...]:
        byte, known, rank_of, queue = self.byte, self.pairs.get, self._rank, self.queue
        push, pop = queue.push, queue.pop
        token: list[int] = [byte[b] for b in data]
        n = len(token)
        if n == 1:
            return (token[0],)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        left = token[0]
        for i in range(1, n):
            right = token[i]
            if (r := known(left << 20 | right)) is None:
                r = rank_of(left, right)
            if r >= 0:
                push(r, i - 1)
            left = right
        while queue.top:
            rank, positions = pop()
            if len(positions) > 1:
                positions.sort()
            for i in positions:
                left = token[i]
                if left < 0 or (j := after[i]) >= n or known(left << 20 | token[j]) != rank:
                    continue  # stale
                token[i], token[j] = rank, -1
                after[i] = k = after[j]
                if k < n:
                    before[k] = i
                    right = token[k]
                    if (r := known(rank << 20 | right)) is None:
                        r = rank_of(rank, right)
                    if r >= 0:
                        push(r, i)
                if (h := before[i]) >= 0:
                    left = token[h]
                    if (r := known(left << 20 | rank)) is None:
                        r = rank_of(left, rank)
                    if r >= 0:
                        push(r, h)
        return tuple([t for t in token if t >= 0])

    def __missing__(self, pretoken: str) -> tuple[int, ...]:
        data = pretoken.encode()
        whole = self.ranks.get(data)  # every entry merges to itself; the tests prove it for the vocabulary
        ids = self.merge(data) if whole is None else (whole,)
        if len(self) >= REMEMBERED:
            self.clear()
            self.pairs.clear()
        if len(pretoken) <= 64:
            self[pretoken] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of ``text``; null and empty texts have none. Special-token strings are ordinary text."""
        return list(chain.from_iterable(map(self.__getitem__, self.pretokens(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.__getitem__, self.pretokens(text)))) if text else 0


def vocabulary(tokenizer: str, folder: str | None = None) -> bytes:
    """Bytes of a rank file, refused above the broadcast bound."""
    path = os.path.join(folder or TOKENIZERS, f"{tokenizer}.tiktoken")
    if os.path.getsize(path) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {VOCABULARY_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


_ENCODERS: dict[str, Encoder] = {}


def encoder(tokenizer: str, shared) -> Encoder:
    """The worker's encoder for a broadcast vocabulary; built once in each worker."""
    if tokenizer not in _ENCODERS:
        _ENCODERS[tokenizer] = Encoder(shared.value)
    return _ENCODERS[tokenizer]


def encode(df: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``(key, ids ARRAY<INT>)`` for every row of ``df``.

    Null, empty: an empty list. Repeated texts and keys: one row each, as they
    come. Blank, control and broken text is encoded as it is. Other columns are
    not read, whatever their names. One narrow stage, no shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(tokenizer, folder))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, shared)
        for batch in batches:
            keys, texts = batch.columns
            flat, offsets = array("i"), array("i", [0])
            for text in texts:
                if s := text.as_py():
                    flat.extend(chain.from_iterable(map(enc.__getitem__, enc.pretokens(s))))
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.frombuffer(offsets, np.int32)), pa.array(np.frombuffer(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([keys, ids], names=["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def count_tokens(df: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``(key, n_tokens BIGINT)`` of every row; null and empty texts have 0."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(tokenizer, folder))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, shared)
        for batch in batches:
            keys, texts = batch.columns
            yield pa.RecordBatch.from_arrays([keys, pa.array([enc.count(t) for t in texts.to_pylist()], pa.int64())], names=["key", "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_tokens bigint").withColumnRenamed("key", key)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..session import table

    return encode(table(spark, sf_dir, "documents", "doc_id", "text"))
