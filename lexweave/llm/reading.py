"""Reading level of each document (problem 8).

A linear pairwise ranker is learnt from the graded reference passages: for every
two units (sentences) of passages of different level the harder one must score
higher (logistic loss on score differences, all pairs). Features are syntax
(length, clauses, passives, marks), word shape, and vocabulary. Isotonic
regression (pool adjacent violators) on the passages calibrates scores into
levels. A text's score is the mean of its sentences, each counting once, so that
a few long hard sentences don't outweigh many easy ones.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

#: Rows of the reference that are used at most (least passage_id); the table has 48.
FIT_PASSAGES = 5000
#: Pairs of units of different level that are used at most, drawn at random beyond.
FIT_PAIRS = 4_000_000
#: A document counts as English prose from this share of English function words
#: among its words, and of letters among its visible characters.
LEAST_FUNCTION_WORDS, LEAST_LETTERS, LEAST_WORDS = 0.145, 0.72, 60

#: Length of a sentence's vocabulary vector beside standardised syntax features.
VOCABULARY_WEIGHT = 2.0

# English function words.
FUNCTION_WORDS = set(
    "the of and to in is was that by which for with on not what did how who when does were under at from has had it be are an or as a you your we they he she can if this no my our i his her its their been but so do will may must have than then there these those us all me him them".split()
)
SUBORDINATORS = set("which that whether where whereby wherein if because since although though unless until when while notwithstanding insofar inasmuch irrespective albeit lest whereas who whom whose".split())
BE = set("is are was were be been being".split())
_PARTICIPLE = ("ed", "en", "wn", "ld", "ght")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff\x00-\x08\x0e-\x1f\u0300-\u036f]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_BREAK = re.compile(r"[.!?…”][^\S\n]+(?=[A-Z“\"]|[a-z][A-Z])|\n+")
# Abbreviations after which a sentence goes on.
ABBREVIATIONS = set("no nos art arts cf pp p mr mrs ms dr prof vol para paras fig approx co e.g i.e v sec al".split())
_MARKS = re.compile("[,;:(“?!]")
_DIGIT = re.compile(r"\d")
_VOWELS = re.compile(r"[aeiouy]+")


def _syllables(w: str) -> int:
    return max(1, len(_VOWELS.findall(w)) - (len(w) > 3 and w.endswith("e") and not w.endswith("le")))


def kind(text: str | None) -> str:
    """What a text's level rests on: ``prose`` (English, 60 words and more), ``short``
    (English, fewer), ``other`` (mostly other things than English words), ``empty`` (no letter)."""
    if not text:
        return "empty"
    spaced, words = text.split(), _WORD.findall(text)
    if not words:
        return "empty"
    long = len(spaced) >= LEAST_WORDS
    if long and len(words) < LEAST_WORDS // 2 or sum(map(len, words)) < LEAST_LETTERS * sum(map(len, spaced)):
        return "other"
    if sum(w.lower() in FUNCTION_WORDS for w in words) < LEAST_FUNCTION_WORDS * len(words):
        return "other"
    return "prose" if long else "short"


def english_prose(text: str | None) -> bool:
    """At least 60 words by white space, mostly letters, with the function words of English."""
    return kind(text) == "prose"


def _pairs(y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(harder, easier): all pairs of units of different level, or ``most`` of them drawn at random."""
    order = np.argsort(y, kind="stable")
    below = np.searchsorted(y[order], y[order])  # how many are easier
    ends = np.cumsum(below)
    n = int(ends[-1]) if len(ends) else 0
    at = np.arange(n) if n <= most else np.sort(np.random.default_rng(0).integers(0, n, most))
    i = np.searchsorted(ends, at, side="right")
    return order[i], order[at - (ends[i] - below[i])]


class _Known(dict):
    """What is kept of each word: letters, syllables, long, very long, function word, subordinator, pronoun, preposition."""

    def __missing__(self, w: str) -> tuple[int, ...]:
        got = (len(w), _syllables(w), len(w) > 6, len(w) > 9, w in FUNCTION_WORDS, w in SUBORDINATORS, w in ("you", "your", "we", "they", "my", "us"), w in ("of", "by", "to", "in", "upon", "between"))
        if len(self) > 300_000:
            self.clear()
        self[w] = got
        return got


class Model:
    """Starters, vocabulary, weights and calibration."""

    def __init__(self, passages: Iterable[tuple[str | None, int | None]], rounds: int = 400):
        passages = [(t, int(v)) for t, v in passages if t and v is not None]
        self.known = _Known()
        self.joint = None
        lower: Counter = Counter()
        starts: set[str] = set()
        for text, _ in passages:
            for s in self._sentences(_clean(text)):
                w = _WORD.findall(s)
                lower.update(x for x in w if x.islower())
                if w and w[0][0].isupper():
                    starts.add(w[0])
        starts = {w for w in starts if lower[w.lower()] or w.lower() in FUNCTION_WORDS or sum(w in t for t, _ in passages) > 2}
        self.lower = set(lower)
        if starts:  # where a sentence begins although no mark ends the one before it
            self.joint = re.compile(rf"(?<=[a-z0-9)]) (?=[A-Z])(?=(?:{'|'.join(sorted(map(re.escape, starts)))})\s)")
        units, y, of = [], [], []
        for i, (text, v) in enumerate(passages):
            for u in self.units(text):
                units.append(u)
                y.append(float(v))
                of.append(i)
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for u in units for w in self._words(u)} - {"@"}))}
        dense = np.array([self._syntax(u, self._words(u)) for u in units] or np.zeros((0, 16)))
        self.mean = dense.mean(0) if units else np.zeros(1)
        self.scale = dense.std(0) + 1e-6 if units else np.ones(1)
        x = np.zeros((len(units), dense.shape[1] + len(self.vocabulary)))
        for i, u in enumerate(units):
            x[i, : dense.shape[1]] = np.clip((dense[i] - self.mean) / self.scale, -3, 3)
            words = set(self._words(u)) & self.vocabulary.keys()
            for w in words:
                x[i, dense.shape[1] + self.vocabulary[w]] = VOCABULARY_WEIGHT / len(words) ** 0.5
        weights = self._rank(x, np.array(y), rounds)
        self.dense = weights[: dense.shape[1]]
        self.word = {w: float(weights[dense.shape[1] + i]) for w, i in self.vocabulary.items()}
        scores = x @ weights
        whole = np.array([scores[np.array(of) == i].mean() for i in sorted(set(of))])
        self._calibrate(whole, np.array([float(passages[i][1]) for i in sorted(set(of))]))

    def _sentences(self, text: str) -> list[str]:
        out, at = [], 0
        for m in _BREAK.finditer(text):
            i = m.start()
            if text[i] == ".":
                before = text[max(at, i - 7) : i].rpartition(" ")[2].lstrip("(“").lower()
                if before in ABBREVIATIONS or len(before) == 1 and text[i - 1].isupper():
                    continue
            out.append(text[at : i + 1])
            at = m.end()
        out.append(text[at:])
        return out

    def units(self, text: str) -> list[str]:
        """Sentences of at least three words, without headings; runs without marks are cut where a sentence opener stands."""
        out = []
        for s in self._sentences(_clean(text)):
            for u in self.joint.split(s) if self.joint else [s]:
                n = u.count(" ") + 1
                if n >= 3 and (n > 6 or u.rstrip()[-1:] in ".!?…”\"" or not u.strip()[:1].isupper()):
                    out.append(u)
        return out

    def _words(self, unit: str) -> list[str]:
        found = _WORD.findall(unit)
        if not found:
            return []
        out = [w if w.islower() else low if (low := w.lower()) in FUNCTION_WORDS else "@" for w in found]
        if out[0] == "@" and (low := found[0].lower()) in self.lower:
            out[0] = low
        return out

    def _syntax(self, unit: str, words: list[str]) -> list[float]:
        n = max(1, len(words))
        plain = [w for w in words if w != "@"]
        m = max(1, len(plain))
        letters, syllables, long, longer, function, sub, pronoun, prep = map(sum, zip(*map(self.known.__getitem__, plain))) if plain else (0,) * 8
        marks = _MARKS.findall(unit)
        commas, asks = marks.count(","), marks.count("?") + marks.count("!")
        passive = any(a in BE and (b.endswith(_PARTICIPLE) or b.endswith("ly")) for a, b in zip(words, words[1:]))
        return [
            log(n), letters / m, syllables / m, long / m, longer / m, function / m, sub / n, log(1 + sub), log(1 + commas), log(1 + len(marks) - commas - asks),
            float(passive), pronoun / n, prep / n, (n - len(plain)) / n, float(_DIGIT.search(unit) is not None), float(asks > 0),
        ]

    def score(self, text: str, english: bool = True) -> float:
        """Mean score of the English units of ``text``, each counting once.

        Of a text that isn't English all units count, by syntax and word shape only.
        """
        rows, words_part = [], []
        for u in self.units(text):
            words = self._words(u)
            if not english:
                rows.append(self._syntax(u, words)), words_part.append(0.0)
                continue
            known = [self.word[w] for w in set(words) if w in self.word]
            if len(known) * 4 < len(set(words)):
                continue  # not English, or no words
            rows.append(self._syntax(u, words))
            words_part.append(VOCABULARY_WEIGHT / len(known) ** 0.5 * sum(known))
        if not rows:
            words = self._words(_clean(text))
            rows, words_part = [self._syntax(text, words)], [0.0]
        dense = np.clip((np.array(rows) - self.mean) / self.scale, -3, 3) @ self.dense
        return float((dense + np.array(words_part)).mean())

    @staticmethod
    def _rank(x: np.ndarray, y: np.ndarray, rounds: int, shrink: float = 2e-3, most: int = FIT_PAIRS) -> np.ndarray:
        """Full-batch gradient descent with momentum on the mean logistic loss of pairs of different level."""
        w = np.zeros(x.shape[1])
        harder, easier = _pairs(y, most)
        if not len(harder):
            return w
        speed = np.zeros_like(w)
        apart = y[harder] - y[easier]
        for _ in range(rounds):
            s = x @ w
            g = apart / (1 + np.exp(np.clip(s[harder] - s[easier], -30, 30)))
            pull = np.bincount(harder, g, len(y)) - np.bincount(easier, g, len(y))
            speed = 0.9 * speed + x.T @ pull / apart.sum() - shrink * w
            w = w + speed
        return w

    def _calibrate(self, s: np.ndarray, y: np.ndarray) -> None:
        """Pool adjacent violators on the passages; between the pooled blocks levels are interpolated."""
        blocks: list[list[float]] = []  # level, weight, sum of scores
        for i in np.lexsort((y, s)):
            blocks.append([y[i], 1.0, s[i]])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                v, n, t = blocks.pop()
                a = blocks[-1]
                a[0] = (a[0] * a[1] + v * n) / (a[1] + n)
                a[1] += n
                a[2] += t
        self.knots = np.array([b[2] / b[1] for b in blocks] or [0.0])
        self.levels = np.array([b[0] for b in blocks] or [1.0])

    def level(self, text: str, english: bool = True) -> tuple[int, float]:
        """(level 1-4, calibrated score) of a text as a whole."""
        got = float(np.interp(self.score(text, english), self.knots, self.levels))
        return int(min(4, max(1, got + 0.5))), got


def _clean(text: str) -> str:
    return _INVISIBLE.sub("", text) if _INVISIBLE.search(text) else text


def fit(reference: DataFrame, passages: int = FIT_PASSAGES) -> Model:
    rows = reference.filter("text is not null and level is not null").orderBy("passage_id").limit(passages).select("text", "level").collect()
    return Model((r["text"], r["level"]) for r in rows)


def levels(df: DataFrame, model: Model, every: bool = False) -> DataFrame:
    """``(doc_id, level, score, basis)`` of every row whose text is English prose of 60 words or more.

    With ``every`` all rows are given and ``basis`` says what the level rests on
    (see ``kind``): short English texts are judged like long ones, other texts by
    syntax and word shape only; null texts and those without a letter have null
    level and score. Repeated rows are judged alike, one row each. Whole texts
    are read. One narrow stage; the model, bounded by the reference, is broadcast.
    """
    packed = df.sparkSession.sparkContext.broadcast(pickle.dumps(model.__dict__))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.__new__(Model)
        model.__dict__.update(pickle.loads(packed.value))
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for k, t in zip(*batch.columns, strict=True):
                text = t.as_py()
                basis = kind(text)
                if basis == "prose" or every:
                    level, score = (None, None) if basis == "empty" else model.level(text, basis != "other")
                    for col, v in zip(out, (k.as_py(), level, score, basis), strict=True):
                        col.append(v)
            arrays = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "level", "score", "basis"])

    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, level bigint, score double, basis string")


def _levels(spark: SparkSession, sf_dir: str, every: bool) -> DataFrame:
    return levels(table(spark, sf_dir, "documents", "doc_id", "text"), fit(table(spark, sf_dir, "reading_reference", "passage_id", "level", "text")), every)


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level of every document, and what it rests on."""
    return _levels(spark, sf_dir, True)


def p8_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and mean score by basis and level, all documents counted."""
    return p8_levels(spark, sf_dir).groupBy("basis", "level").agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("score"), 3).alias("mean_score"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir, False).select("doc_id", "level")
