"""Sentence boundaries across languages and scripts (problem 4).

A pushdown automaton reads the events of a text: terminators, quotation marks
and brackets, line breaks, and -- in scripts without sentence marks -- spaces.
Its stack holds the levels of lists, and above them the closing marks that are
still awaited. Marks are left where a paragraph, list item or table row ends;
only with none open can a terminator end a sentence. Levels are entered by an
item further in and left by one further out, by a line further out or by a
heading; a line that stands at the text column of the level on top goes on with
that item. Abbreviations are found by walking a trie of reversed spellings
back from the dot; what may stand before and after decides the rest.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare, settle, spread, table

# Abbreviations after which a sentence goes on, by language.
NEVER = (
    # English
    "mr mrs ms dr prof hon rev st messrs cf pp p no nos art arts para paras vol vols fig figs sec secs ch v vs "
    "e.g eg i.e ie viz approx ca al ed eds op cit ibid reg dir cl sch app ex jr sr gen col lt capt sgt "
    # German
    "abs nr vgl bzw z.b d.h u.a s.o s.u bsp mio mrd tsd sog ggf evtl bd hrsg dipl ing str lit rn rz rdnr anm "
    # French
    "m mm mme mlle mmes p.ex c.-à-d chap al n° no éd env av bd "
    # Spanish, Portuguese, Italian
    "sra srta dra núm págs pág p.ej art. ud uds vid cap apdo párr tel sig n.º sig.ra dott ecc. "
    # Greek
    "π.χ αριθ αρ άρθρ άρ παρ σελ κ κα κκ δηλ βλ πρβλ "
    # Russian
    "г гг ст стр рис табл см ср т.е т.д. им ул "
    # Hindi, Arabic
    "सं डॉ श्री प्रो क्र द أ د م ص رقم ج "
    # Dutch, Swedish, Polish
    "bijv blz nr. dvs bl.a ul pkt"
).split()
# Abbreviations that may also end a sentence.
MAYBE = "etc inc ltd co corp bros a.m p.m am pm usw u.s.w et.s ff plc kg gmbh s.a s.l s.r.l n.v b.v u.s u.k e.u κ.λπ κλπ κ.ά إلخ ecc enz osv m.fl np itd".split()
# Words after which a one- or two-digit number with a dot is an ordinal.
ORDINAL_BEFORE = set("am vom der dem den des zum zur ab im bis die das beim seit und den. nach ihrer seiner einer keiner jeder".split())
# Words after which a single capital letter or Roman number ends a sentence.
LABEL_BEFORE = set("annex part schedule class category table figure appendix group type section chapter title option anexo annexe anhang teil abschnitt".split())
# Words with which no line or sentence ends.
RUNS_ON = set("the a an of to and or in on by for with from at as that which is are was be its their under this between than not any each le la les des du de et ou à un une der die das und oder von mit für im den dem ein eine zu el los las y o en con por para del que".split())
# Legal forms, before which a capitalised brand keeps its exclamation mark.
BRAND_AFTER = set("Group GmbH Ltd Inc AB SA AG NV BV SARL SpA LLC Corp Co & KG plc".split())
# Thai words that go on with the clause before the space.
THAI_ON = ("และ", "หรือ", "แต่", "ซึ่ง", "เพราะ", "เนื่องจาก", "โดย", "เพื่อ", "ที่", "ว่า", "ต่อหน้า")
# Closing mark of each opening one.
CLOSES = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "［": "］", "【": "】", "〈": "〉", "《": "》"}
_CLOSERS = "”»›」』)]）］】〉》"
_QUOTES = "“„«‹「『”»›」』\""
_STOPS = ".!?…。！？؟।॥።։۔｡"
_WIDE = "。！？｡"

_EVENT = re.compile(
    r"\n"
    r"|[.…]+(?=[\s”“\"’'»›)\]」』）］】〉》!?。！？]|$|[^\W\d_])[.…!?。！？]*"
    r"|[!?。！？؟।॥።։۔｡]+[.…!?。！？]*"
    r"|(?<=[ऀ-ॣ०-ॿ])\|(?=\s|$)"
    r"|(?<=[Ͱ-Ͽ\d%])[;;](?=\s|$)"
    r"|[“”„«»‹›「」『』()\[\]（）［］【】〈〉《》\"]"
    r"|(?<=[ก-๛຀-໿ក-៿က-႟])[^\S\n]+(?=[ก-๛຀-໿ក-៿က-႟A-Z])"
)
_BLANK = re.compile(r"\n(?:[^\S\n]*\n)+")
_ITEM = re.compile(
    r"[^\S\n]*(?:\(?(?:\d{1,3}(?:\.\d{1,3})*|[ivxlcIVXLC]{1,6}|[^\W\d_])[.)]|\([^\W_]{1,5}\)|\d{1,3}(?:\.\d{1,3})+|[-–—•*·▪◦‣●○■]|§+[^\S\n]*\d+[a-z]?\.?|[०-९]{1,3}[.)]|[٠-٩]{1,3}[.)]|[（(][一二三四五六七八九十\d]{1,3}[）)]|[一二三四五六七八九十]{1,3}、|第[一二三四五六七八九十百\d]{1,4}[条條章節节])(?=[^\S\n]|$|\n|[^\x00-\x7f])"
)
_ROW = re.compile(r"[^\S\n]*\|")
_HEAD = re.compile(r"[^\S\n]*(?:#{1,6}[^\S\n]|(?:Article|Artikel|Artículo|Articolo|Annex|Chapter|Section|Title|Part|Άρθρο)[^\S\n]+[\dIVX]+[^\S\n]*$)", re.M)
_WORD = re.compile(r"\S+")
_LETTERS = re.compile(r"[^\W\d_]+|&")
_GREEK = re.compile(r"[Ͱ-Ͽἀ-῿]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿＀-￯]")


def _trie(words: Iterable[str], kind: int, root: dict) -> dict:
    for w in words:
        node = root
        for c in reversed(w.rstrip(".")):
            node = node.setdefault(c, {})
        node[""] = kind
    return root


_TRIE = _trie(MAYBE, 2, _trie(NEVER, 1, {}))


def _abbreviation(text: str, dot: int, start: int) -> int:
    """1: goes on, 2: may end, 0: no abbreviation before the dot at ``dot``."""
    node, i, best = _TRIE, dot - 1, 0
    while i >= start:
        c = text[i].lower()
        if c.isspace():
            if (spaced := node.get(".")) is None or not text[i - 1 : i] == ".":
                break
            i -= 1  # "z. B." is spelt like "z.B."
            node = spaced
        else:
            node = node.get(c)
            if node is None:
                break
        i -= 1
        if "" in node:
            before = text[i] if i >= start else " "
            if not (before.isalnum() or before in "_.'’" and before != "."):
                if before != "." or node[""] == 1:
                    best = node[""]
    return best


class _Layout:
    """Which line breaks a text's sentences may run over: lines broken at a fixed width.

    A break between two lines is explained by every width that has room for the
    first but not for the beginning of the second too. The width that explains
    most breaks is the text's, if it explains at least two of them, and more than
    speak against it: breaks after lines that it had room to go on with, and
    longer lines that it should have broken. Lines without a place to break
    don't tell.
    """

    def __init__(self, text: str):
        self.width = 0
        if "\n" not in text:
            return
        lines = [x.rstrip() for x in text.split("\n")]
        spans = [(len(a), len(a) + _first(b)) for a, b in zip(lines, lines[1:]) if b and len(a) >= 20 and not _ROW.match(a) and (" " in a.strip() or _CJK.search(a))]
        steps = Counter()
        for low, high in spans:
            steps[low] += 1
            steps[high + 1] -= 1
        explained = best = 0
        for w in sorted(steps):
            explained += steps[w]
            if explained >= max(best, 2):
                best, self.width = explained, w
        early = sum(low <= self.width for low, _ in spans) - best
        longer = sum(len(x) > self.width and not _ROW.match(x) and bool(" " in x[: self.width].strip() or _CJK.search(x, 0, self.width)) for x in lines)
        if best <= early + longer:
            self.width = 0

    def wraps(self, line: str, following: str) -> bool:
        return 0 < self.width < len(line.rstrip()) + 1 + _first(following)


def _first(line: str) -> int:
    """Length of a line's first unbreakable piece."""
    m = _WORD.search(line)
    if not m:
        return 0
    w = m.group()
    return 1 if _CJK.match(w) else len(w)


def _starts(text: str, i: int, end: int) -> str:
    """Kind of what begins at ``i``: U upper or caseless letter, l lower, d digit, o opener, '' nothing, x other."""
    if i >= end:
        return ""
    c = text[i]
    if c.isalpha():
        if c.islower():
            return "U" if i + 1 < end and text[i + 1].isupper() else "l"
        return "U"
    if c.isdigit():
        return "d"
    if c in "“„«‹「『(\"'‘[（¿¡":
        return "o"
    return "x"


def boundaries(text: str) -> list[int]:
    """Offsets after the last character of each sentence of ``text``, in order."""
    out: list[int] = []
    layout = _Layout(text)
    levels: list[Level] = []
    at = 0
    for m in _BLANK.finditer(text):
        _paragraph(text, at, m.start(), layout, levels, out)
        at = m.end()
    _paragraph(text, at, len(text), layout, levels, out)
    return out


class Level(NamedTuple):
    """A list level: columns of its markers and of its items' text, and its last number."""

    marker: int
    text: int
    number: int | None


def _number(marker: str) -> int | None:
    """What the marker of an item counts: a number or a letter."""
    m = _COUNTS.search(marker)
    return None if not m else int(m.group()) if m.group().isdigit() else ord(m.group().lower()) - ord("a") + 1


_COUNTS = re.compile(r"\d+(?=\D*$)|(?<![^\W\d_])[A-Za-z](?![^\W\d_])")


def _column(text: str, at: int) -> int:
    """Column of the first visible character of the line that begins at or holds ``at``."""
    line = text.rfind("\n", 0, at) + 1
    k = line
    while k < len(text) and text[k] in " \t\u00a0\u3000":
        k += 1
    return k - line


def _enter(text: str, start: int, end: int, levels: list[Level]) -> int:
    """Take the line of a sentence that begins at ``start`` onto the stack; the offset up to which its number or bullet goes."""
    item = _ITEM.match(text, start, end)
    here = _column(text, start)
    while levels and (levels[-1].marker > here or levels[-1].marker == here and item or not item and here < levels[-1].text):
        levels.pop()
    if not item:
        return start
    levels.append(Level(here, here + _skip(text, item.end(), _line_end(text, item.end(), end)) - start, _number(item.group())))
    return item.end()


#: Marks that open and close; those that may do either close only what is on top.
_EITHER = "“\""
_MARK = re.compile("[“”„«»‹›「」『』()\\[\\]（）［］【】〈〉《》\"]")


def _paired(text: str, begin: int, end: int) -> set[int]:
    """Places of the opening marks of a paragraph that have a closing one.

    A closing mark takes the nearest opening one that awaits it, however far;
    those opened in between are strays, as are those never closed.
    """
    awaited: list[tuple[str, int]] = []
    out: set[int] = set()
    for m in _MARK.finditer(text, begin, end):
        c = m.group()
        depth = next((d for d in range(len(awaited) - 1, -1, -1) if c in awaited[d][0]), -1)
        if depth >= 0 and (c not in _EITHER or depth == len(awaited) - 1):
            out.add(awaited[depth][1])
            del awaited[depth:]
        elif c in CLOSES or c == '"':
            awaited.append((CLOSES.get(c, '"'), m.start()))
    return out


def _emit(text: str, start: int, end: int, out: list[int]) -> None:
    while end > start and text[end - 1].isspace():
        end -= 1
    if end > start and not text[start:end].isspace():
        out.append(end)


def _skip(text: str, i: int, end: int) -> int:
    while i < end and text[i].isspace():
        i += 1
    return i


def _paragraph(text: str, begin: int, end: int, layout: _Layout, levels: list[Level], out: list[int]) -> None:
    stack: list[tuple[str, int]] = []  # closing marks awaited, place of the opening
    start = _skip(text, begin, end)  # of the sentence
    line = begin  # start of the line
    guard = _enter(text, start, end, levels)  # no boundary within a number or bullet
    opening = _paired(text, begin, end)
    pos = start
    find = _EVENT.search
    while (m := find(text, pos, end)) is not None:
        i, j = m.span()
        pos = j
        c = text[i]
        if c == "\n":
            if start >= i:  # the sentence before has ended already
                start = _skip(text, j, end)
                guard = _enter(text, start, end, levels)
                pos = max(pos, start)
                line = start
                continue
            if _line_ends(text, line, i, j, end, start, guard, stack, levels, layout):
                _emit(text, start, i, out)
                stack.clear()
                start = _skip(text, j, end)
                guard = _enter(text, start, end, levels)
                pos = max(pos, start)
            line = j
            continue
        if i < guard:
            continue
        if c.isspace():  # a space in a script without sentence marks
            if not stack and not text.startswith(THAI_ON, j):
                _emit(text, start, i, out)
                start = j
            continue
        if stack and c in stack[-1][0]:
            opened = stack.pop()[1]
            if not stack and _quote_ends(text, opened, i, j, start, end):
                _emit(text, start, j, out)
                start = pos = _skip(text, j, _line_end(text, j, end))
                guard = start
            continue
        if c in CLOSES or c == '"':
            if i in opening:
                stack.append((CLOSES.get(c, '"'), i))
            continue
        if c in _CLOSERS:
            continue  # closes nothing that is open
        if stack:
            continue
        cut = _stop_ends(text, i, j, start, end)
        if cut:
            _emit(text, start, cut, out)
            start = _skip(text, cut, _line_end(text, cut, end))
            guard = start
            pos = max(pos, cut)
    if start < end:
        _emit(text, start, end, out)


def _line_end(text: str, i: int, end: int) -> int:
    k = text.find("\n", i, end)
    return end if k < 0 else k


def _quote_ends(text: str, opened: int, i: int, j: int, start: int, end: int) -> bool:
    """Does the quotation or bracket closed at ``i`` end the sentence around it?"""
    k = i - 1
    while k > opened and text[k].isspace():
        k -= 1
    if text[k] not in _STOPS or k <= opened:
        return False
    bracket = text[i] in ")]）］】"
    if bracket and opened > start:
        return False
    n = _skip(text, j, end)
    if n >= end:
        return False  # the paragraph's end does it
    if n == j:  # nothing between: scripts without spaces, or punctuation
        before = text[opened - 1] if opened > start else ""
        return bool(_CJK.match(text[n])) and before in "：:" and before != ""
    kind = _starts(text, n, end)
    if kind == "U" and not _cased(text[n]):  # no capitals to tell a new sentence from the rest of this one
        return bool(_CJK.match(text[n])) and opened > start and text[opened - 1] in "：:"
    return kind in ("U", "o")


def _cased(c: str) -> bool:
    return c.lower() != c.upper()


def _stop_ends(text: str, i: int, j: int, start: int, end: int) -> int:
    """Offset after the sentence that the terminator ``[i, j)`` ends, or 0."""
    c = text[i]
    while j < end and text[j] in _CLOSERS + "’'\"" and not (text[j] in "'’\"" and j + 1 < end and text[j + 1].isalnum()):
        j += 1
    n = _skip(text, j, end)
    if n >= end:
        return 0
    last = text[j - 1]
    if last in _WIDE or text[i:j].strip("”’」』）")[-1:] in _WIDE:
        return j
    if c in "।॥።։۔؟":
        return j
    if c == "|":
        return j
    if c in ";;":
        return j if _greek(text, i, start) and _starts(text, n, end) in ("U", "o", "d") else 0
    kind = _starts(text, n, end)
    if c in "!?":
        if kind == "l":
            return 0
        if n == j and not (kind in "Uo" and text[i - 1].isalnum()):
            return 0
        if c == "!":
            w = _LETTERS.match(text, n, end)
            if w and w.group() in BRAND_AFTER and text[i - 1].isalpha() and _previous(text, i, start)[:1].isupper():
                return 0
        return j
    # dots
    if n == j and text[i:j].count("…") > 1 and _CJK.match(text[n]):
        return j
    if n == j:  # no white space: a missing space, an address or an abbreviation
        if j - i != 1 or kind != "U" or not (n + 1 < end and text[n + 1].islower()) or i <= start:
            return 0
        p = text[i - 1]
        if not (p.isdigit() or p in "%”»)’" or p.isalpha() and (p.islower() or not _cased(p))):
            return 0
        token = _token(text, i, start)
        if "/" in token or "@" in token or "." in token and not token.replace(".", "").isdigit() and not token[:1].isdigit() and "(" not in token:
            return 0
        return 0 if _abbreviation(text, i, start) else j
    if kind == "l":
        return 0
    if j - i > 1 and text[i : i + 2] in ("..", "…."):
        return j
    if c == "…":
        return j
    if i > start and j - i == 1:
        p = text[i - 1]
        if p.isalpha() or category(p)[0] == "M":
            single = p.isalpha() and (i - 2 < start or not text[i - 2].isalnum() and text[i - 2] not in "’'-" and category(text[i - 2])[0] != "M")
            if single and p.isupper() and i - 2 >= start and text[i - 2] != ".":
                before = _previous(text, i - 1, start).lower().strip("(,;:“„«")
                return j if before in LABEL_BEFORE else 0
            if single and text[n].isalpha() and text[n + 1 : n + 2] == ".":
                return 0  # "z. B."
            if single and not _cased(p) and not _CJK.match(p) and i - 2 >= start and text[i - 2].isspace():
                return 0
            ab = _abbreviation(text, i, start)
            if ab == 1:
                return 0
            if ab == 2:
                w = _WORD.match(text, n, end)
                word = w.group().rstrip(".,;:") if w else ""
                return 0 if word in ("KG", "OHG", "Ltd", "Inc", "&", "v") or kind == "d" and word[:1].isdigit() and text[i - 1] == "s" else j
            if single and text[i - 2 : i - 1] == ".":  # a dotted acronym
                return j if kind in ("U", "o") else 0
        elif p.isdigit():
            token = _token(text, i, start)
            if token.isdigit() and len(token) <= 2:
                before = _previous(text, i - len(token), start).lower()
                if before in ORDINAL_BEFORE and kind == "U":
                    return 0
    if kind == "x" and text[n] in ",;:)]}/=+<>%&":
        return 0
    return j


def _greek(text: str, i: int, start: int) -> bool:
    return bool(_GREEK.search(text, max(start, i - 40), i))


def _token(text: str, i: int, start: int) -> str:
    """What stands before ``i`` up to white space or an opening mark."""
    k = i
    while k > start and not text[k - 1].isspace() and text[k - 1] not in "“„«「『\"":
        k -= 1
    return text[k:i]


def _previous(text: str, i: int, start: int) -> str:
    """The word before ``i``; white space between is skipped, a word that ends at ``i`` counts."""
    k = i
    while k > start and text[k - 1].isspace():
        k -= 1
    e = k
    while k > start and not text[k - 1].isspace():
        k -= 1
    return text[k:e]


def _line_ends(text: str, line: int, i: int, j: int, end: int, start: int, guard: int, stack: list, levels: list[Level], layout: _Layout) -> bool:
    """Does the single line break at ``i`` end the sentence?"""
    nxt = _line_end(text, j, end)
    if _ROW.match(text, j, nxt) or _ROW.match(text, line, i) or _HEAD.match(text, j, nxt) or _HEAD.match(text, line, i):
        return True
    current, following = text[line:i], text[j:nxt]
    bare = current.rstrip()
    if guard > start and not text[guard:i].strip():
        return False  # a number alone belongs to what follows
    n = _skip(text, j, nxt)
    if n >= nxt:
        return True
    wrapped = layout.wraps(current, following)
    item = _ITEM.match(text, j, nxt)
    if item and (not wrapped or bare[-1:] in ";:.!?。！？…," and not stack):
        return True
    if item and not stack and (n := _number(item.group())) and any(x.number == n - 1 for x in levels):
        return True  # a wrapped line may begin with a number, but hardly with the next one
    n = _skip(text, j, nxt)
    if stack:
        return not (wrapped or text[n].islower())
    within = not item and bool(levels) and levels[-1].text == n - j > levels[-1].marker  # at the text column of the item on top
    k = len(bare)
    while k and bare[k - 1] in _CLOSERS + "\"'’“":
        k -= 1
    last = bare[k - 1 : k]
    if last in _STOPS and last:
        at = line + k - 1
        if last == "." and text[at - 1 : at] != ".":
            stop = _stop_ends(text, at, at + 1, start, end)
            if not stop and _abbreviation(text, at, start) == 1:
                return False
            return bool(stop) or not (wrapped or text[n].islower())
        return not (text[n].islower() and (last in "!?…" or k < len(bare)))
    if last in ";;" and last and _greek(text, i, start) and _starts(text, n, nxt) == "U":
        return True
    if last == "|" and k > 1 and "ऀ" <= bare[k - 2] <= "ॿ":
        return True
    if wrapped or within:
        # in a script without marks a wrapped line may also end a sentence; that space is judged like any other
        if "ก" <= last <= "๛" and "ก" <= text[n] <= "๛":
            return not text.startswith(THAI_ON, n)
        return False
    if text[n].islower() and last not in ";:":
        return False
    word = _previous(text, line + len(bare), line).lower()
    if word in RUNS_ON or last == ",":
        return False
    return True


def sentence_ends(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, ends ARRAY<INT>)`` of every row with text; offsets are code points.

    Null, empty and blank texts have no sentence and an empty list. Rows that
    come again are given again. One narrow stage; the text stays in its worker.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.columns
            ends = [np.asarray(boundaries(t), np.int32) if (t := x.as_py()) else np.zeros(0, np.int32) for x in texts]
            offsets = np.zeros(len(ends) + 1, np.int32)
            np.cumsum([len(e) for e in ends], out=offsets[1:])
            flat = np.concatenate(ends) if ends else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["key", "ends"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ends array<int>").withColumnRenamed("key", key)


def _kept(df: DataFrame) -> Column:
    """By what the one row of a repeated id is chosen: the least hash of its text."""
    return F.xxhash64("text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = table(spark, sf_dir, "corpus_clean", "doc_id", "text")
    ends = sentence_ends(corpus.withColumn("key", F.struct("doc_id", _kept(corpus).alias("h"))), key="key").select("key.*", "ends")
    once = ends.groupBy("doc_id").agg(F.min(F.struct("h", "ends")).alias("r"))
    return once.select("doc_id", F.explode("r.ends").alias("end")).select("doc_id", F.col("end").cast("bigint").alias("end_pos"))


def p4_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, sentence_no, start_pos, end_pos, sentence)``: every sentence in order.

    Texts are not shuffled: the rows of repeated ids that go are found by their
    places in the files, and left out of the scan by a join whose side is
    broadcast where it is small.
    """
    rows = prepare(spark).read.parquet(f"{sf_dir}/corpus_clean.parquet").select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    keyed = rows.select("doc_id", F.struct(_kept(rows).alias("h"), "file", "at").alias("row"))
    several = keyed.groupBy("doc_id").agg(F.min("row").alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1").withColumnRenamed("doc_id", "id")
    again = settle(keyed.join(several, F.col("doc_id").eqNullSafe(F.col("id"))).filter("row <> kept").select("row.file", "row.at"))
    corpus = spread(rows.join(again, ["file", "at"], "left_anti").select("doc_id", "text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, no, starts, ends, parts = [], [], [], [], []
            for k, t in zip(*batch.columns, strict=True):
                k, t, at = k.as_py(), t.as_py() or "", 0
                for n, e in enumerate(boundaries(t)):
                    at = _skip(t, at, e)
                    ids.append(k), no.append(n), starts.append(at), ends.append(e), parts.append(t[at:e])
                    at = e
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(no, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(parts, pa.string())], names=["doc_id", "sentence_no", "start_pos", "end_pos", "sentence"])

    return corpus.mapInArrow(run, "doc_id bigint, sentence_no int, start_pos bigint, end_pos bigint, sentence string")
