"""Scalar text functions as Column expressions; everything stays in Catalyst."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode text processing knows it, for use inside a character class.
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# Document families by the sector character of a CELEX number.
SECTOR_FAMILY = {"0": "LEGISLATIVE", "1": "LEGISLATIVE", "2": "LEGISLATIVE", "4": "LEGISLATIVE", "6": "JUDICIAL", "8": "JUDICIAL", "9": "POLICY"}
# Type codes of sector 3 and of sector 5 that make a document POLICY.
SECTOR3_POLICY = ["H", "C", "XC", "SC", "K"]
SECTOR5_POLICY = ["SC", "XC", "AE", "IP", "IE"]
# Forms of sector 5 that make a document POLICY.
POLICY_FORMS = [
    "Communication",
    "Recommendation",
    "Opinion",
    "Staff working document",
    "Impact assessment",
    "Report",
    "Resolution",
    "Information",
    "Own-initiative resolution",
    "Own-initiative opinion",
    "Green Paper",
    "Evaluation",
    "Written question",
    "Legislative resolution",
    "Opinion not proposing amendment",
    "Opinion proposing amendment",
    "Council conclusions",
]
# Patterns of the six content flags.
FLAG_PATTERNS = {
    "has_table": r"(?m)^\|.+\||^\+[-+]{3,}\+",
    "has_steps": r"(?m)^\s*\d+[.):]\s+\S",
    "has_roles": r"(?i)\b(responsable|perfil|rol|cargo|supervisor|director|jefe|gerente)\b",
    "has_definitions": r"(?i)(se entiende por|se define|significa que|es decir)",
    "has_requirements": r"(?i)\b(obligatorio|deber[aá]|debe|prohibido|es necesario|se requiere|han de)\b",
    "has_exceptions": r"(?i)(excepto|a excepci[oó]n de|salvo que|salvo|no aplica)",
}


def strip(c: Column) -> Column:
    # the look-behind keeps long runs of white space linear
    return F.regexp_replace(c, rf"\A[{WS}]++|(?<![{WS}])[{WS}]++\z", "")


def plain_space(c: Column) -> Column:
    """White space beyond ASCII, and separators, as spaces: what follows can use the fast classes of the matcher."""
    return F.regexp_replace(c, r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]", " ")


def words(c: Column) -> Column:
    """Words by Unicode white space, in order."""
    return F.regexp_extract_all(plain_space(c), F.lit(r"\S+"), F.lit(0))


def word_count(c: Column) -> Column:
    """Number of words; 0 for empty text, null for null."""
    return F.regexp_count(plain_space(c), F.lit(r"\S+"))


def words_estimate(c: Column) -> Column:
    """A fifth of the characters, cut to an integer."""
    return (F.char_length(c) / 5).cast("int")


# The patterns of the cleaning steps below, which define what is cleaned.


def drop_header(c: Column) -> Column:
    """From the first line that looks like content; unchanged where none does."""
    lines = F.split(c, "\n", -1)
    # more than 15 characters between the first and the last visible one, and no markup first
    first = F.array_position(F.transform(lines, lambda x: x.rlike(rf"(?s)\A[{WS}]*+[^{WS}|#\[*\-!].{{14,}}[^{WS}]")), True)
    return F.when(first > 0, F.array_join(F.slice(lines, first.cast("int"), F.size(lines)), "\n")).otherwise(c)


def drop_footnotes(c: Column) -> Column:
    return F.regexp_replace(c, r"\[\([*\d]+\)\]\(#nt[rc][^)]*\)", "")


def drop_top_link(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\[Top\]\(#[^)]*\)", ""), rf"(?<![{WS}])(?:[{WS}]*+---)+[{WS}]*+\z", "")


def drop_links(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"!\[[^\]]*\]\([^)]*\)", ""), r"\[([^\]]+)\]\([^)]*\)", "$1")


def drop_markup(c: Column) -> Column:
    steps = [(r"\*\*([^*]+)\*\*", "$1"), (r"(?<!\*)\*([^*\n]+)\*(?!\*)", "$1"), (r"`([^`]+)`", "$1"), (r"(?md)^#{1,6}[ \t]+", "")]
    return reduce(lambda x, s: F.regexp_replace(x, *s), steps, c)


def flatten_tables(c: Column) -> Column:
    """Rows of two columns become their text; empty head and rule rows go; wider rows stay."""
    cell = r"[ \t]*([^|\n]+?)[ \t]*"
    steps = [(r"(?md)^\|[ \t]*\|[ \t]*\|[ \t]*$", ""), (r"(?md)^\|[ \t]*-+[ \t]*\|[ \t]*-+[ \t]*\|[ \t]*$", ""), (rf"(?md)^\|{cell}\|{cell}\|[ \t]*$", "$1 $2")]
    return reduce(lambda x, s: F.regexp_replace(x, *s), steps, c)


def tidy_space(c: Column) -> Column:
    steps = [("\u00a0", " "), (r"(?md)^[ \t]+$", ""), (rf"(?md)(?:^---[{WS}]*$\n*){{2,}}", "---\n"), (r"\n{3,}", "\n\n")]
    return reduce(lambda x, s: F.regexp_replace(x, *s), steps, c)


def clean(c: Column) -> Column:
    """The whole cleaning chain, in its fixed order."""
    return strip(reduce(lambda x, f: f(x), (drop_header, drop_footnotes, drop_top_link, drop_links, drop_markup, flatten_tables, tidy_space), c))


def family(celex: Column, form: Column) -> Column:
    """Document family of a CELEX number; a number without type code has the code ''."""
    celex, form = F.coalesce(celex, F.lit("")), F.coalesce(form, F.lit(""))
    sector, code = F.substring(celex, 1, 1), F.regexp_extract(celex, r"\A.{5}([A-Z]+)", 1)
    out = F.when(celex == "", "OTHER")
    for s, f in SECTOR_FAMILY.items():
        out = out.when(sector == s, f)
    out = out.when(sector == "3", F.when(code.isin(SECTOR3_POLICY), "POLICY").otherwise("LEGISLATIVE"))
    return out.when((sector == "5") & (code.isin(SECTOR5_POLICY) | form.isin(POLICY_FORMS)), "POLICY").otherwise("OTHER")


def date_part(c: Column) -> Column:
    """Before the first semicolon, stripped; null gives ''."""
    return strip(F.coalesce(F.regexp_extract(c, r"(?s)\A([^;]*)", 1), F.lit("")))


def date_kind(c: Column) -> Column:
    """After the first semicolon, stripped; '' without one."""
    return strip(F.coalesce(F.regexp_extract(c, r"(?s)\A[^;]*;(.*)\z", 1), F.lit("")))


def year(c: Column) -> Column:
    """Characters 7 to 10 of a DD/MM/YYYY date as a number; null where that fails."""
    part = F.substring(c, 7, 4)
    return F.when((F.char_length(c) >= 10) & part.rlike(r"\A[0-9]{4}\z"), part.cast("int"))


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(w)) for w in words])


def drop_control(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def head(c: Column, n: int) -> Column:
    """First ``n`` characters (code points)."""
    return F.substring(c, 1, n)


def document_code(code: Column, file_name: Column) -> Column:
    return F.coalesce(F.nullif(code, F.lit("")), F.regexp_replace(F.coalesce(file_name, F.lit("unknown")), r"(?i)\.(odt|docx)?\.?md\z", ""))


def flags(c: Column) -> dict[str, Column]:
    out = {k: c.rlike(p) for k, p in FLAG_PATTERNS.items()}
    out["has_steps"] = F.regexp_count(c, F.lit(FLAG_PATTERNS["has_steps"])) >= 3
    return out


def model_slug(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.element_at(F.split(c, "/", -1), -1), r"[^a-zA-Z0-9]+", ""))


def metric_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[^0-9A-Za-z_./ -]", "_"), r"\A_+|_+\z", "")


def mapped(c: Column, values: dict[str, str]) -> Column:
    """Dictionary lookup; null where nothing is found."""
    out = F.lit(None).cast("string")
    return reduce(lambda acc, kv: F.when(c == kv[0], kv[1]).otherwise(acc), values.items(), out)


def typed(c: Column, kind: str, default: object = None) -> Column:
    """Cast where that works, else ``default``."""
    return F.coalesce(c.try_cast(kind), F.lit(default).cast(kind))


def chunk_name(doc: Column, i: Column) -> Column:
    return F.format_string("%s_chunk_%03d", doc.cast("string"), i.cast("int"))


def list_lines(c: Column, n: int) -> Column:
    """Entries of a numbered or dashed list in a model's answer: the first ``n`` that aren't blank."""
    lines = F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]", -1)
    bare = F.transform(lines, lambda x: strip(F.regexp_replace(strip(x), rf"\A[{WS}]*(?:\d+[.)]|[-*•])[{WS}]*", "")))
    return F.slice(F.filter(bare, lambda x: x != ""), 1, n)


def json_spec(c: Column, schema: str) -> Column:
    """The JSON object within a model's answer; null where there is none or it is malformed."""
    return F.from_json(F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit("")), schema)


def numbers(c: Column) -> Column:
    """All runs of digits as numbers, in order; those too long for a number are left out."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())


def shown_context(parent_text: Column, page_content: Column) -> Column:
    """The parent's text where there is one, else the chunk's own."""
    return F.coalesce(F.nullif(parent_text, F.lit("")), page_content)


def fill(template: str, **values: Column) -> Column:
    """A prompt from its template; ``{{`` and ``}}`` are braces."""
    out = F.lit(template.replace("{{", "\x01").replace("}}", "\x02"))
    for k, v in values.items():
        out = F.replace(out, F.lit(f"{{{k}}}"), v)
    return F.translate(out, "\x01\x02", "{}")
