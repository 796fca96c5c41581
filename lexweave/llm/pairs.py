"""Broken prompt and response pairs (problem 1).

Each pair gets at most one defect, tried in this order:

* ``empty`` -- null, blank, or only a placeholder;
* ``refusal`` -- by refusal dictionaries, sentence by sentence outside
  quotations: the answerer declines and nothing else is said;
* ``copies_question`` -- response and prompt are compressed with each other as
  zstandard dictionaries: what either leaves of the other tells a copy from an
  answer, the words themselves where that leaves it open;
* ``other_language`` -- by scripts, function-word dictionaries, and word
  frequencies by language learnt from the pairs;
* ``truncated`` -- a response that does not end in a sentence mark is judged by
  its place in the contexts, where it is quoted from them, else by a
  terminal-context model: how often the last words (names and numbers as
  classes) end a response in the collection, how often they go on.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from math import log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle, table

#: Counters of a task are handed on at so many keys.
FLUSH = 200_000

# Placeholders that say nothing, in lower case without the marks around them.
PLACEHOLDERS = set(
    """null|none|nan|nil|n/a|n.a|na|#n/a|tbd|tbc|tba|todo|to do|undefined|unknown|empty|blank|no answer|no response|no reply|no data|
not available|not applicable|not answered|not provided|missing|pending|placeholder|answer|a|response|reply|output|reference|ans|text|string|
your answer here|insert answer here|answer here|to be determined|to be completed|to be added|lorem ipsum|xxx|xx|x|test|
antwort|keine antwort|keine angabe|k. a|k.a|entfällt|leer|réponse|sans réponse|pas de réponse|aucune réponse|s/o|vide|néant|
respuesta|sin respuesta|ninguna respuesta|vacío|s/d|n/d|nd|回答|答|答案|无|无答案|空|暂无|未填写|待定|なし|無し|無回答|回答なし|未回答|未定|該当なし|空欄""".replace("\n", "").split("|")
)

# What the answerer says to decline, by language.
REFUSALS = {
    "en": r"""\bi(?:['’]m| am)? (?:really |very |truly |so )?(?:sorry|afraid)\b(?! to (?:hear|say that the))|\b(?:i|we) (?:simply |just |really |regrettably |unfortunately )?(?:can['’]?t|cannot|can not|could not|couldn['’]t|won['’]t|will not|may not|shall not|must not|am not able to|are not able to|['’]m not able to|am unable to|are unable to|['’]m unable to|['’]re unable to|am not in a position to|am not permitted to|am not allowed to|['’]m not allowed to|['’]m not permitted to|do not feel able to|would rather not|['’]d rather not|prefer not to|must decline|have to decline|decline to|must refrain|refrain from|have no (?:way|means|basis|information|access|knowledge)|do not have (?:access|enough|sufficient|the|any)|don['’]t have (?:access|enough|sufficient|the|any)|lack (?:the|access|sufficient)|do not know|don['’]t know|apologi[sz]e|regret)\b|\b(?:unable|not able) to (?:comply|assist|help|answer)\b(?=.{0,40}$)|\bas an? (?:ai|language model|assistant|artificial)|\b(?:it )?(?:is|['’]s|isn['’]t|is not) (?:not |im)?possible for me\b|\bno (?:reply|answer|response) can be (?:generated|offered|given|provided)|\boutside (?:of )?what i (?:may|can|am)|\b(?:given|supplied|provided|available) to me\b|\bi (?:may|can) not\b|\b(?:beyond|outside) (?:my|the scope of (?:my|what i))\b|\bmy (?:guidelines|policies|instructions|training)\b|\b(?:the )?(?:context|passages?|documents?|material|text|excerpts?) (?:provided|supplied|given|above)? ?(?:does|do|is|are) (?:not |in)(?:contain |sufficient|enough|provide |allow )(?=.{0,60}(?:answer|question|reply|respond))|\b(?:cannot|can['’]t) be answered\b|\bnot enough information\b|\binsufficient (?:information|context)\b|\bthat request\b""",
    "de": r"""\b(?:kann|könnte|darf|möchte|will|werde) ich\b.{0,60}\b(?:nicht|keine?n?|leider)\b|\bich (?:kann|könnte|darf|möchte|will|werde|bin)\b.{0,60}\b(?:nicht|keine?n?|außerstande|leider|bedaure)\b|\btut mir leid\b|\bich bedau(?:e)?re\b|\bals (?:ki|sprachmodell|assistent)|\bentschuldigung\b|\b(?:ist|wäre) (?:es )?mir (?:leider )?nicht (?:möglich|erlaubt|gestattet)|\bmir (?:ist|liegen|fehl\w+)\b.{0,60}\b(?:nicht|keine|informationen|angaben|unterlagen)|\b(?:kontext|angaben|unterlagen|textstellen|auszüge?n?|material)\b.{0,50}\b(?:reich\w+|genüg\w+|lässt sich|lassen sich|erlaub\w+)\b.{0,40}\b(?:nicht|keine)\b|\bnicht (?:beantworten|beantwortet werden|beantwortbar)\b|\bkeine (?:auskunft|antwort)\b""",
    "fr": r"""\bdésolée?s?\b|\bje (?:ne |n['’]|regrette|m['’]excuse|suis dans l['’]impossibilité|préfère ne)|\bmodèle de langage\b|\bil m['’]est impossible\b|\bne me permet(?:tent)? pas\b|\bne peux pas\b|\ben tant qu(?:e |['’])(?:ia|assistant|modèle|intelligence)|\b(?:contexte|extraits?|documents?|éléments|passages?) fournis?\b.{0,40}\b(?:ne|n['’])|\bimpossible de (?:répondre|vous)\b|\bmalheureusement\b.{0,30}\bje\b""",
    "es": r"""\blo (?:siento|lamento)\b|\blamento\b|\bno (?:me es posible|puedo|podría|debo|dispongo|tengo acceso|estoy en condiciones|estoy autorizad|sé)\b|\bmodelo de lenguaje\b|\bcomo (?:ia|asistente|inteligencia)\b|\bno (?:ofrece|contiene|proporciona|aporta)\b.{0,40}\b(?:suficiente|necesari)|\bme (?:temo|resulta imposible|disculpo)\b|\bno es posible (?:responder|contestar)|\bprefiero no\b""",
    "zh": r"""抱歉|对不起|遗憾|语言模型|人工智能|我(?:无法|不能|不便|不会|没有|拒绝|不知道)|无法(?:回答|作答|提供|确定|协助)|不足以(?:作答|回答)|恕(?:我|难)|不便(?:回答|发表|透露)""",
    "ja": r"""申し訳|すみません|恐れ入り|言語モデル|ａｉ|aiと|(?:回答|お答え|応答|返答|お手伝い|対応|提供|判断)(?:は|を)?(?:いた)?(?:できません|できかね|出来ません|しかねます|できない)|お答えできま|控え(?:ます|させ)|わかりかねます|分かりません|わかりません""",
}
_REFUSAL = {k: re.compile(v) for k, v in REFUSALS.items()}  # of lower-case text
# Polite sentences that may stand around a refusal.
_FILLER = re.compile(
    r"^(?:thank|thanks|please|you may|you might|you could|could you|can you|would you|may i|is there|are there|let me know|feel free|hello|dear|hi\b|bitte|gerne|vielen dank|danke|wenden sie|könnten sie|kann ich|gibt es|n['’]hésitez|merci|veuillez|pourriez|souhaitez|avez-vous|vous pouvez|gracias|por favor|puede|podría|consulte|¿|请|谢谢|如需|您可以|ご|お|他に|詳し|弁護士)",
    re.I,
)

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is was that by which for with on not did what how who when does were under at from has had it be are an or as many must within".split(),
    "de": "der die das und ist nicht von wurde für auf den des dem mit ein eine im zu nach sich auch durch bei warum wie viele welchen welche hat vor am weil".split(),
    "fr": "le la les des est une dans pour par sur du au aux qui que pas ce cette il elle été fut ont pourquoi quel quelle et en un parce".split(),
    "es": "el los las una es por para que del con se fue su al como más pero este esta cuántos qué por qué y en un la lo sido entre".split(),
    "it": "il lo gli una è per che del della con non sono nel alla dei delle".split(),
    "pt": "o os uma é por para que do da com não foi seu ao dos das".split(),
    "nl": "de het een van is niet voor op met dat zijn aan door wordt".split(),
}
# Names of languages in prompts that ask for one.
LANGUAGE_NAMES = {
    "en": "english|englisch\\w*|anglais\\w*|inglés|英語|英文|英语",
    "de": "german|deutsch\\w*|allemand\\w*|alemán|ドイツ語|德文|德语",
    "fr": "french|französisch\\w*|français\\w*|francés|フランス語|法文|法语",
    "es": "spanish|spanisch\\w*|espagnol\\w*|español|castellano|スペイン語|西班牙文|西班牙语",
    "zh": "chinese|mandarin|chinesisch\\w*|chinois\\w*|chino|中国語|中文|汉语",
    "ja": "japanese|japanisch\\w*|japonais\\w*|japonés|日本語|日文|日语",
    "el": "greek|griechisch\\w*|grec\\w*|griego|ギリシャ語|希腊文|希腊语",
    "ar": "arabic|arabisch\\w*|arabe|árabe|アラビア語|阿拉伯文|阿拉伯语",
    "th": "thai|thailändisch\\w*|thaï|tailandés|タイ語|泰文|泰语",
    "hi": "hindi|ヒンディー語|印地文|印地语",
    "la": "latin\\w*|latein\\w*|latín|ラテン語|拉丁文|拉丁语",
    "it": "italian|italienisch\\w*|italien\\w*|italiano",
    "pt": "portuguese|portugiesisch\\w*|portugais\\w*|portugués",
    "ru": "russian|russisch\\w*|russe|ruso|ロシア語|俄文|俄语",
}
_ASKS = re.compile(r"\b(?:translat\w*|wording|version|text|in|into|to|auf|ins|en|au|al|traduc\w*|traduis\w*|übersetz\w*|rédig\w*|respond\w*|answer\w*|reply)\b|[に用译訳]", re.I)
_NAMED = {k: re.compile(rf"(?<!\w)(?:{v})(?!\w)" if v[0].isascii() else v, re.I) for k, v in LANGUAGE_NAMES.items()}
_SCRIPTS = (("ja", re.compile("[぀-ヿ]")), ("zh", re.compile("[㐀-鿿]")), ("th", re.compile("[฀-๿]")), ("ar", re.compile("[؀-ۿ]")), ("hi", re.compile("[ऀ-ॿ]")), ("el", re.compile("[Ͱ-Ͽἀ-῿]")), ("ru", re.compile("[Ѐ-ӿ]")), ("ko", re.compile("[가-힣]")), ("he", re.compile("[֐-׿]")))
_FOREIGN = re.compile("|".join(r.pattern for _, r in _SCRIPTS))
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]+(?:['’][A-Za-zÀ-ɏ]+)*")
_INVISIBLE = re.compile("[­​-‏ -‮⁠-⁤﻿\x00-\x08\x0e-\x1f]")
_TOKEN = re.compile(r"\d+(?:[.,]\d+)*(?:\(\w{1,3}\))*|[㐀-鿿぀-ヿ]|[^\W\d_]+|[^\w\s]")
_QUOTED = re.compile(r"[“„«\"「『].*?[”“»\"」』]", re.S)
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+(?![a-z]|(?:Group|GmbH|Ltd|Inc|AB|SA)\b)|(?<=[。！？])|\n+")
_PART = re.compile(r"[.!?]\s+(?![a-z])|[。！？]|\n+")  # roughly a sentence, to count words in
_END = re.compile(r"[.!?…。！？؟।][\"'”’»)\]」』）*_`\s]*$")
_HANGING = re.compile(r"[-–—,;:，、；：(\[“„«「/&+=][\s]*$")
_ABBREVIATED = re.compile(r"(?:\b(?:art|arts|no|nos|nr|para|paras|abs|pp?|cf|vgl|vol|fig|dr|mr|mrs|ms|e\.g|i\.e|approx|z\. ?b|bzw|mio|v|p\. ?ex|núm|pág|págs|sr|sra|sec)|(?<![A-Z]\.)\b[A-Z])\.$", re.I)


def visible(s: str | None) -> str:
    return _INVISIBLE.sub("", s or "").strip()


def is_empty(reference: str | None) -> bool:
    """Null, blank, marks only, or a placeholder with or without marks and tags around it."""
    s = visible(reference)
    s = re.sub(r"</?[a-zA-Z][^>]{0,40}>", " ", s).strip()
    if not any(c.isalnum() for c in s):
        return True
    core = re.sub(r"^[\W_]+|[\W_]+$", "", s.lower()) if not s.startswith("#") else s.lower()
    return len(core) < 40 and re.sub(r"\s+", " ", core) in PLACEHOLDERS


def is_refusal(s: str) -> bool:
    """Does some sentence decline, while no other says anything but polite filler?"""
    outside = _QUOTED.sub(" ", s)
    declined = other = False
    for part in _SENTENCE.split(outside):
        part = part.strip(" \t-–—*>")
        if not part:
            continue
        low = part.lower()
        if any(r.search(low) for r in _REFUSAL.values()):
            declined = True
        elif not _FILLER.match(part) and len(part) > 12 and _LATIN.search(part) or re.search(r"[㐀-鿿぀-ヿ]{6}", part) and not _FILLER.match(part):
            other = True
    return declined and not other


def novelty(question: str, reference: str) -> float:
    """Share of the response's compressed size that remains when the prompt is the dictionary.

    A copied response costs a handful of bytes for its matches; zstandard keeps
    matches of four bytes and more.
    """
    data, prompt = reference.encode(), question.encode()
    params = zstandard.ZstdCompressionParameters.from_level(3, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
    plain = len(zstandard.ZstdCompressor(compression_params=params).compress(data))
    dictionary = zstandard.ZstdCompressionDict(prompt, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    left = len(zstandard.ZstdCompressor(compression_params=params, dict_data=dictionary).compress(data))
    return max(0, left - 6) / max(1, plain - 6)


#: Share of a response that the prompt leaves unexplained, and of the prompt that
#: the response leaves: a copy below the first, none above the second.
COPIED, ANSWERED = 0.19, 0.5


def copies(question: str, reference: str) -> bool:
    """The response is the prompt again, once or more often, at most with marks, spaces, case, labels or a few letters changed.

    Both are taken as words, and compressed with each other as zstandard
    dictionaries. That decides unless something is left that may be a few
    changed letters or a word or two of its own; then the words are compared.
    """
    q, r = visible(question), visible(reference)
    a = [t for t in _TOKEN.findall(q.lower()) if t[0].isalnum()]
    b = [t for t in _TOKEN.findall(r.lower()) if t[0].isalnum()]
    while b and b[0] in _LABELS and b[0] != (a[0] if a else ""):
        b = b[1:]
    while b and b[-1] in _LABELS and b[-1] != (a[-1] if a else ""):
        b = b[:-1]
    if not a or not b:
        return q.lower() == r.lower() and bool(q)
    if {t for t in b if t[0].isdigit()} - {t for t in a if t[0].isdigit()}:
        return False  # a number of its own
    told = novelty(" ".join(a), " ".join(b))
    if told > ANSWERED:
        return False
    if max(told, novelty(" ".join(b), " ".join(a))) <= COPIED:
        return True
    return _same_words(a * max(1, round(len(b) / len(a))), b)


def _same_words(a: list[str], b: list[str]) -> bool:
    """Are the words of the response those of the prompt but for spelling and function words?"""
    if len(b) < 0.3 * len(a):
        return False
    cjk = sum(len(t) == 1 and not t.isascii() for t in a) > len(a) / 2
    if not cjk and SequenceMatcher(None, a[0], b[0], autojunk=False).ratio() < 0.6 and not _ASKING.intersection(b[:3]):
        return False  # a statement that takes up the words of the prompt
    if not cjk:  # function words may come and go
        a = [t for t in a if t not in _LIGHT] or a
        b = [t for t in b if t not in _LIGHT] or b
    left = right = 0.0
    for op, i1, i2, j1, j2 in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "equal":
            continue
        x, y = "".join(a[i1:i2]), "".join(b[j1:j2])
        if op == "replace" and SequenceMatcher(None, x, y, autojunk=False).ratio() >= 0.6:
            left += 0.25 * (i2 - i1)
        else:
            left += i2 - i1
            right += j2 - j1
    if not right and not cjk and len(b) >= 4:
        return True  # a part of the prompt, nothing else
    return right <= (1 if cjk else 0.06 * len(b)) and left <= (0.12 if cjk else 0.25) * len(a) and SequenceMatcher(None, "".join(a), "".join(b), autojunk=False).ratio() >= 0.85


# Labels before an answer.
_LABELS = set("a q answer question response reply antwort frage réponse question respuesta pregunta 问题 回答 答 问 質 問 re you asked your question is was user prompt assistant usuario benutzer utilisateur".split())


def script(s: str) -> str | None:
    """Language told by script, ``latin``, or None where there are no letters."""
    if not _FOREIGN.search(s):
        return "latin" if _LATIN.search(s) else None
    counts = {k: len(r.findall(s)) for k, r in _SCRIPTS}
    latin = sum(map(len, _LATIN.findall(s)))
    if counts["ja"]:
        counts["ja"] += counts["zh"]
        counts["zh"] = 0
    best = max(counts, key=lambda k: counts[k])
    weight = 2 if best in ("ja", "zh", "ko") else 1
    if counts[best] * weight > latin:
        return best
    return "latin" if latin else None


#: Between the tokens of a terminal context; ``visible`` leaves none in a text.
SEP = "\x1f"


class Open(NamedTuple):
    """A response that its terminal contexts must judge, most telling first."""

    keys: list[str]
    elliptical: bool
    long: bool


def tells(size: int, ends: int, inner: int) -> bool:
    """Is a terminal context of ``size`` tokens frequent enough to judge by?"""
    return ends + inner >= 4 if size > 1 else ends > 0 or inner > 1


def runs_on(several: bool, ends: int, inner: int, elliptical: bool, long: bool) -> bool:
    """Does a response break off, by the counts of the first terminal context that tells?"""
    n = ends + inner
    return several and n >= 20 and ends < 0.02 * n and long if elliptical else ends < 0.3 * n


class Model:
    """Word frequencies by language and endings of responses."""

    def __init__(self, rows: Iterable[tuple[str | None, str | None, list[str | None] | None]] = ()):
        rows = list(rows)
        self.learn_words(Counter(x for row in rows for x in self.word_keys(*row)))
        ends: Counter = Counter()
        inner: Counter = Counter()
        for _, reference, _ in rows:
            for key, final in self.contexts(reference):
                (ends if final else inner)[key] += 1
        self.endings = {SEP.join(k): (ends[k], inner[k]) for k in ends | inner if tells(len(k), ends[k], inner[k])}

    @classmethod
    def word_keys(cls, question: str | None, reference: str | None, contexts: list[str | None] | None) -> Iterator[tuple[str, str]]:
        """``(language, word)`` of the words in sentences whose language function words tell; language '' with every lower-case word."""
        for lang, words in cls.word_lists(question, reference, contexts):
            yield from ((lang, w) for w in words)

    @classmethod
    def word_lists(cls, question: str | None, reference: str | None, contexts: list[str | None] | None) -> Iterator[tuple[str, list[str]]]:
        """The same, the words of a sentence at once."""
        for text in (question, reference, *(contexts or ())):
            for sentence in _PART.split(text or ""):
                words = _LATIN.findall(sentence)
                if len(words) > 3:
                    found = [w.lower() for w in words]
                    if lang := cls._by_function_words(found):
                        yield lang, found
                if words:
                    yield "", [w for w in words if not w[0].isupper()]

    def learn_words(self, counts: dict[tuple[str, str], int]) -> None:
        """Take the counts of ``word_keys`` over all pairs."""
        self.known: Counter = Counter()
        self.words: dict[str, Counter] = {k: Counter() for k in FUNCTION_WORDS}
        self.votes: dict[str, tuple[float, ...] | None] = {}
        for (lang, w), n in counts.items():
            (self.words[lang] if lang else self.known)[w] = n
        self.spelled = sorted({w for c in self.words.values() for w, n in c.items() if n >= 10})
        self.total = {k: sum(c.values()) + 1 for k, c in self.words.items()}
        self.words = {k: Counter({w: n for w, n in c.items() if n > 1}) for k, c in self.words.items()}

    def contexts(self, reference: str | None) -> Iterator[tuple[tuple[str, ...], bool]]:
        """Terminal contexts of every token of a response, and whether a sentence or the response ends there."""
        tokens = self.tokens(visible(reference))
        for e in range(1, len(tokens) + 1):
            if tokens[e - 1] not in _STOPS:
                final = e == len(tokens) or tokens[e] in _STOPS
                for key in self.keys(tokens[max(0, e - 7) : e]):
                    yield key, final

    @staticmethod
    def keys(last: list[str]) -> list[tuple[str, ...]]:
        """Terminal contexts of the last tokens, most telling first; ``*`` stands for any last token."""
        n = len(last)
        out = [tuple(last[-k:]) for k in (7, 6, 5, 4) if n >= k]
        out += [tuple(last[-3:])] if n > 2 else []
        out += [(*last[-4:-1], "*")] if n > 3 else []
        out += [(*last[-3:-1], "*")] if n > 2 else []
        return [*out, tuple(last[-2:]), tuple(last[-1:])] if n > 1 else [*out, tuple(last)]

    @staticmethod
    def _by_function_words(words: list[str]) -> str | None:
        score = [0] * len(FUNCTION_WORDS)
        for w in words:
            for i in _SPOKEN.get(w, ()):
                score[i] += 1
        top = max(score)
        return _LANGUAGES[score.index(top)] if top >= 2 and score.count(top) == 1 else None

    def tokens(self, s: str) -> list[str]:
        """Tokens with numbers, and names of any length, as classes; ``^`` opens the response, ``<`` every later sentence."""
        out = ["^"]
        for t in _TOKEN.findall(_DOTTED.sub(lambda m: m[0].replace(".", "").replace(" ", ""), s)):
            if t[0].isdigit():
                out.append("0")
            elif t[0].isupper() and (t[0].isascii() or len(t) > 1) and not self.known[t.lower()] and self.words["en"][t.lower()] + self.words["de"][t.lower()] < 40 or out[-1] == "N" and (t[0].isupper() or t in ("&", "plc", "-", "’", "'")):
                if out[-1] != "N":
                    out.append("N")
            elif t in _STOPS:
                if out[-1] == "N" and t == "!":
                    continue  # a brand; at a sentence's end the next token tells
                out.append(t)
                out.append("<")
            else:
                out.append(t.lower())
        return out[:-1] if out[-1] == "<" else out

    def _vote(self, w: str) -> tuple[float, ...] | None:
        """What a word says for each language: 1 for the one it is most frequent in, less for others; None if unknown."""
        if w in self.votes:
            return self.votes[w]
        rates = [(self.words[k][w] + (30 if w in _FUNCTION[k] else 0)) / self.total[k] if self.total[k] > 500 else (1e-3 if w in _FUNCTION[k] else 0) for k in FUNCTION_WORDS]
        top = max(rates)
        vote = tuple(max(-1.5, min(0.0, log(v / top + 1e-3) / 4)) + 1 for v in rates) if top > 0 else None
        if len(self.votes) > 200_000:
            self.votes.clear()
        self.votes[w] = vote
        return vote

    def language(self, s: str, least: float = 3.0) -> str | None:
        """Language of ``s``, None where too little tells it."""
        kind = script(s)
        if kind != "latin":
            return kind
        words = [w.lower() for w in _LATIN.findall(_QUOTED.sub(" ", s)) if not w[0].isupper()]
        words += [w.lower() for w in _LATIN.findall(s)[:1]]
        votes = [v for v in map(self._vote, words) if v]
        score = dict(zip(FUNCTION_WORDS, map(sum, zip(*votes)), strict=True)) if votes else dict.fromkeys(FUNCTION_WORDS, 0.0)
        ranked = sorted(score, key=lambda k: -score[k])
        first, second = score[ranked[0]], score[ranked[1]]
        return ranked[0] if first >= least / 2 and first - second >= min(1.0, 0.3 * len(words)) else None

    def other_language(self, question: str, reference: str) -> bool:
        q = self.language(question, 1.0)
        r = self.language(reference)
        if r is None or q is None:
            # different scripts tell even where words do not
            a, b = script(question), script(reference)
            return bool(a and b and a != b and not (r is None and b == "latin") and not self._asked(question, b))
        if q == r:
            return False
        if {q, r} == {"ja", "zh"} and q == "ja" and not re.search("[的了在与和是为于被将该这们]", reference):
            return False  # a short answer in characters only
        return not self._asked(question, r)

    @staticmethod
    def _asked(question: str, language: str) -> bool:
        if not _ASKS.search(question):
            return False
        if language == "latin":
            return any(p.search(question) for k, p in _NAMED.items() if k in ("en", "de", "fr", "es", "la", "it", "pt"))
        return bool(_NAMED.get(language) and _NAMED[language].search(question))

    def truncated(self, question: str, reference: str, contexts: list[str | None] | None) -> bool:
        found = self.cut(question, reference, contexts)
        if isinstance(found, bool):
            return found
        for key in found.keys:
            if key in self.endings:
                return runs_on(SEP in key, *self.endings[key], found.elliptical, found.long)
        return False

    def cut(self, question: str, reference: str, contexts: list[str | None] | None) -> bool | Open:
        """Is the response cut, or which terminal contexts must tell?"""
        s = visible(reference)
        end = _END.search(s)
        if end and not (s.endswith(".") and _ABBREVIATED.search(s) and not s.endswith("..")) and not s.endswith(("...", "…")):
            return False
        unmarked = script(s) == "th"  # sentences end at spaces
        s = re.sub(r"[\s.…]*(?:\.\.|…)[\s.…]*$", "", s)
        if not end and _HANGING.search(s):
            return True
        for opening, closing in (("“", "”"), ("«", "»"), ("「", "」"), ("„", "“"), ("(", ")"), ("（", "）")):
            if s.count(opening) > s.count(closing) and not (opening == "“" and "„" in s):
                return True
        shown = " ".join(c for c in (contexts or ()) if c)
        around = f"{shown} {question}"
        words = _TOKEN.findall(s)
        last = words[-1] if words else ""
        # a piece of a word or number that the contexts hold only as part of a longer one
        if last[:1].isalpha() and script(last) == "latin":
            whole = re.search(rf"(?<!\w){re.escape(last)}(?!\w)", around, re.I)
            if not whole and not self.known[last] and re.search(rf"(?<!\w){re.escape(last)}\w", around, re.I):
                return True
            if not whole and len(words) > 1 and last[0].islower() and self.known[last] < 2 and not any(c[last] for c in self.words.values()):
                return True
            if not whole and len(last) > 2 and not any(c[last.lower()] for c in self.words.values()):
                at = bisect_left(self.spelled, last.lower())
                if at < len(self.spelled) and self.spelled[at].startswith(last.lower()):
                    return True
        if last[:1].isdigit() and re.search(rf"(?<![\d.,]){re.escape(last)}[\d.,]*\d", around) and not re.search(rf"(?<![\d.,]){re.escape(last)}(?![\d])(?![.,]\d)", around):
            return True
        if last.lower() in _RUNS_ON and not (len(words) > 1 and words[-2].lower() in ("y", "à")):
            return True
        part = re.split(r"[;；]\s*", _SENTENCE.split(s)[-1])[-1].strip()
        short = len([w for w in _TOKEN.findall(part) if w[0].isalnum()])
        elliptical = part[:1].islower() or part[:1].isdigit() or short <= 3 and part == s or "; " in s and part[:1] != part[:1].lower() and short <= 3
        if not elliptical and len(part) > 25 and (at := shown.find(part)) >= 0:
            after = shown[at + len(part) : at + len(part) + 2]
            return not re.match(r"\s*(?:$|[.!?…。！？;\n])|[.!?]" + (r"|\s" if unmarked else ""), after)
        if unmarked:
            return False  # terminal contexts are told by sentence marks
        return Open([SEP.join(k) for k in self.keys(self.tokens(s)[-7:])], elliptical, short > 3)


_FUNCTION = {k: set(v) for k, v in FUNCTION_WORDS.items()}
_LANGUAGES = list(FUNCTION_WORDS)
_SPOKEN = {w: tuple(i for i, v in enumerate(_FUNCTION.values()) if w in v) for w in set().union(*_FUNCTION.values())}
_ASKING = set("what who whom whose when where why how which warum wann wer wem was wie welche welchen welcher welches pourquoi quand qui quel quelle quels quelles combien qué quién quiénes cuándo cuál cuánto cuántos".split())
_LIGHT = {w for v in FUNCTION_WORDS.values() for w in v} - set("no not nicht ne pas non nein".split()) | set("a an do between under".split())
_STOPS = set(".!?。！？;；؟।")
_DOTTED = re.compile(r"\b(?:B\.V|Inc|Co|Ltd|Art|Arts|No|Nos|Nr|Abs|para|paras|cf|pp|p|vol|Fig|Dr|Mr|Mrs|Ms|Mme|M|e\.g|i\.e|approx|a\.m|p\.m|v|z\. ?B|bzw|vgl|Mio|p\. ?ex|art|núm|págs?|Sra?|al|[A-Z])\.")
# Words that no finished response ends with.
_RUNS_ON = set(
    "the a an in of to and or by for with from at as that which be their its than nor le la les des du de et ou une der die das und oder von mit für im den dem ein eine einer zu zur zum los las y o del que dass weil parce because whether between whose par pour sur am wurde hat ist sind war was were is are has had been must when".split()
)


def judged(model: Model, question: str | None, reference: str | None, contexts: list[str | None] | None) -> str | Open | None:
    """Kind of defect of a pair, None, or the terminal contexts that must tell whether it is truncated.

    A pair without question can only be empty, a refusal or truncated."""
    if is_empty(reference):
        return "empty"
    q, r = visible(question), visible(reference)
    if q and copies(q, r):
        return "copies_question"
    if is_refusal(r):
        return "refusal"
    if q and model.other_language(q, r):
        return "other_language"
    found = model.cut(q, r, contexts)
    return found if isinstance(found, Open) else "truncated" if found else None


def distinct_pairs(df: DataFrame) -> DataFrame:
    """``(user_input, reference, reference_contexts)`` of every qa_id once: repeats must not count twice."""
    row = F.struct("user_input", "reference", "reference_contexts")
    return df.filter("qa_id is not null").groupBy("qa_id").agg(F.min_by(row, F.xxhash64(row)).alias("r")).select("r.*")


def word_counts(pairs: DataFrame) -> DataFrame:
    """``(lang, word, n)`` over all pairs; see ``Model.word_keys``. A task hands its counters on at ``FLUSH`` words."""

    def table_of(counts: dict[str, Counter]) -> pa.RecordBatch:
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for lang, words in Model.word_lists(*row):
                    counts[lang].update(words)
            if sum(map(len, counts.values())) >= FLUSH:
                yield table_of(counts)
        yield table_of(counts)

    return pairs.mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(pairs: DataFrame) -> Model:
    """The word model of distinct pairs. The driver holds the vocabulary, one count for each language and word."""
    model = Model()
    model.learn_words({(r[0], r[1]): r[2] for r in word_counts(pairs).collect()})
    return model


def _hash(tokens: list[str], held: dict[str, int]) -> np.ndarray:
    """64-bit hashes of tokens; ``held`` remembers them."""
    out = np.empty(len(tokens), np.uint64)
    for i, t in enumerate(tokens):
        h = held.get(t)
        if h is None:
            if len(held) > 300_000:
                held.clear()
            h = held[t] = xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"))
        out[i] = h
    return out


def _onto(h: np.ndarray, last: np.ndarray | np.uint64) -> np.ndarray:
    """Hash of a context that ``last`` is put after."""
    with np.errstate(over="ignore"):
        x = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + last
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_ANY = np.uint64(xxhash.xxh64_intdigest(b"*"))


def key_hash(key: tuple[str, ...]) -> int:
    """The 64 bits by which a terminal context is counted."""
    h = np.full(1, len(key), np.uint64)
    for t in key:
        h = _onto(h, _ANY if t == "*" and len(key) > 1 else _hash([t], {}))
    return int(h.view(np.int64)[0])


def hashed_contexts(responses: list[list[str]], held: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, ends, inner) of all terminal contexts of tokenized responses, each hash once: ``Model.contexts`` in arrays."""
    size = np.array([len(r) for r in responses], np.int64)
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)  # in its response
    flat = [t for r in responses for t in r]
    h = _hash(flat, held)
    stop = np.fromiter((t in _STOPS for t in flat), bool, len(flat))
    final = np.append(stop[1:], True) if len(flat) else stop
    final = final | (place == np.repeat(size, size) - 1)

    def chained(k: int, starred: bool) -> np.ndarray:
        """Contexts of ``k`` tokens that end at each place, wrong where the response has no so many before."""
        x = np.full(len(h), k, np.uint64)
        for back in range(k - 1, -1, -1):
            x = _onto(x, _ANY if starred and not back else np.roll(h, back))
        return x

    found, last = [], []
    for k, starred in ((7, False), (6, False), (5, False), (4, False), (3, False), (4, True), (3, True), (2, False), (1, False)):
        at = np.flatnonzero(~stop & (place >= k - 1))
        found.append(chained(k, starred)[at])
        last.append(final[at])
    if not len(h):
        return h, np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, where = np.unique(np.concatenate(found), return_inverse=True)
    ends = np.bincount(where, np.concatenate(last), len(keys)).astype(np.int64)
    return keys, ends, np.bincount(where, minlength=len(keys)) - ends


def context_counts(pairs: DataFrame, packed: Broadcast) -> DataFrame:
    """``(key, ends, inner)``, counts of a task's batches: how often a terminal
    context ends a sentence or response, and how often it goes on. Contexts are
    known by 64-bit hashes; two of ``n`` are taken for one with a chance of ``n / 2^64`` each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(packed.value)
        held: dict[str, int] = {}
        for batch in batches:
            keys, ends, inner = hashed_contexts([model.tokens(visible(r)) for r in batch.column(0).to_pylist()], held)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ends), pa.array(inner)], names=["key", "ends", "inner"])

    return pairs.select("reference").mapInArrow(run, "key bigint, ends bigint, inner bigint")


def defects(df: DataFrame) -> DataFrame:
    """``(qa_id, defect)`` of every defective row: qa_id, user_input, reference, reference_contexts.

    Null or blank references are ``empty``; a null prompt or null contexts leave
    out what needs them. Repeated rows are judged alike and come once for each;
    an empty table gives no row. All pairs are counted: words first, which are
    broadcast (bounded by the vocabulary), then the terminal contexts that some
    response must be judged by, a table that meets those responses in a join.
    """
    df = df.select("qa_id", "user_input", "reference", "reference_contexts")
    once = settle(distinct_pairs(df))
    packed = df.sparkSession.sparkContext.broadcast(pickle.dumps(fit(once)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(packed.value)
        for batch in batches:
            out = []
            for k, q, r, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                kind = judged(model, q, r, c)
                if isinstance(kind, Open):
                    keys = [x.split(SEP) for x in kind.keys]
                    out.append({"qa_id": k, "defect": None, "keys": [{"key": key_hash(x), "several": len(x) > 1} for x in keys], "elliptical": kind.elliptical, "long": kind.long})
                elif kind:
                    out.append({"qa_id": k, "defect": kind, "keys": None, "elliptical": None, "long": None})
            yield pa.RecordBatch.from_pylist(out, _JUDGED)

    rows = settle(df.mapInArrow(run, "qa_id bigint, defect string, keys array<struct<key: bigint, several: boolean>>, elliptical boolean, long boolean").withColumn("row", F.monotonically_increasing_id()))
    asked = rows.filter("defect is null").select("row", "qa_id", "elliptical", "long", F.posexplode("keys").alias("at", "k")).select("*", "k.*").drop("k")
    counts = context_counts(once, packed).join(asked.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.sum("ends").alias("ends"), F.sum("inner").alias("inner"))
    n = F.col("ends") + F.col("inner")
    tells = F.when(F.col("several"), n >= 4).otherwise((F.col("ends") > 0) | (F.col("inner") > 1))
    first = asked.join(counts, "key").filter(tells).groupBy("row").agg(F.min(F.struct("at", "qa_id", "several", "ends", "inner", "elliptical", "long")).alias("f")).select("f.*")
    cut = F.when(F.col("elliptical"), F.col("several") & (n >= 20) & (F.col("ends") < 0.02 * n) & F.col("long")).otherwise(F.col("ends") < 0.3 * n)
    return rows.filter("defect is not null").select("qa_id", "defect").unionByName(first.filter(cut).select("qa_id", F.lit("truncated").alias("defect")))


_JUDGED = pa.schema([("qa_id", pa.int64()), ("defect", pa.string()), ("keys", pa.list_(pa.struct([("key", pa.int64()), ("several", pa.bool_())]))), ("elliptical", pa.bool_()), ("long", pa.bool_())])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = table(spark, sf_dir, "gold_dataset", "qa_id", "user_input", "reference", "reference_contexts")
    return defects(gold).groupBy("qa_id").agg(F.min("defect").alias("defect"))
