"""Text functions over the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import table

WS = T.WS
#: A raw document made of a clean one, so that there is markup to remove.
RAW_SQL = r"""concat('| nav | x |', chr(10), '# ', coalesce(title, ''), chr(10), 'short', chr(10), '[', coalesce(celex, ''), '](http://e.example/', doc_id, ')', chr(10),
 coalesce(text, ''), chr(10), '## **', coalesce(form, ''), '** and *', coalesce(family, ''), '* in `', coalesce(celex, ''), '`', chr(10),
 'see [link ', doc_id, '](http://e.example/a) ![img](u)[(1)](#ntr1-L)[(*2)](#ntc*2-L)', chr(10), '|  |  |', chr(10), '| --- | --- |', chr(10),
 '| (', doc_id, ') | ', coalesce(author, '?'), ' |', chr(10), '| a | b | c |', chr(10), '  ', chr(10), chr(10), chr(10), '---', chr(10), '---', chr(10), 'x', chr(10), '---', chr(10), '[Top](#document1)', chr(10))"""


def _corpus(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "corpus_clean", *columns)


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir, "doc_id", "ingested_at", "title", "celex", "form", "family", "author", "text").select("doc_id", "ingested_at", F.expr(RAW_SQL.replace("chr(", "char(")).alias("raw"))


def _on_raw(f):
    return lambda spark, sf_dir: _raw(spark, sf_dir).select("doc_id", "ingested_at", f(F.col("raw")).alias("out"))


def _on(columns: str, **outs):
    """A projection of corpus columns; ``outs`` are name -> function of nothing."""
    names = columns.split()

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _corpus(spark, sf_dir, "doc_id", "ingested_at", *names).select("doc_id", "ingested_at", *(f().alias(k) for k, f in outs.items()))

    return query


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '\A[{WS}]+|[{WS}]+\z', '', 'g')"


def words_sql(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[^{WS}]+'))"


_LINE_SQL = f"(length({strip_sql('x')}) > 15 AND left({strip_sql('x')}, 1) NOT IN ('|', '#', '[', '*', '-', '!'))"


def header_sql(t: str) -> str:
    lines = f"string_split({t}, chr(10))"
    first = f"coalesce(list_position(list_transform({lines}, lambda x: {_LINE_SQL}), true), 0)"
    return f"CASE WHEN {first} > 0 THEN array_to_string({lines}[{first}:], chr(10)) ELSE {t} END"


def _chain(x: str, *steps: tuple[str, str]) -> str:
    for pattern, to in steps:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return x


# The same patterns as those of the cleaning steps, in SQL.


def footnotes_sql(x: str) -> str:
    return _chain(x, (r"\[\([*\d]+\)\]\(#nt[rc][^)]*\)", ""))


def top_sql(x: str) -> str:
    return _chain(x, (r"\[Top\]\(#[^)]*\)", ""), (rf"(?:[{WS}]*---[{WS}]*)+\z", ""))


def links_sql(x: str) -> str:
    return _chain(x, (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]+)\]\([^)]*\)", r"\1"))


def markup_sql(x: str) -> str:
    # the pattern language has no look-around: an italic run takes its neighbours along
    return _chain(x, (r"\*\*([^*]+)\*\*", r"\1"), (r"(^|[^*])\*([^*\n]+)\*([^*]|$)", r"\1\2\3"), (r"`([^`]+)`", r"\1"), (r"(?m)^#{1,6}[ \t]+", ""))


def tables_sql(x: str) -> str:
    cell = r"[ \t]*([^|\n]+?)[ \t]*"
    return _chain(x, (r"(?m)^\|[ \t]*\|[ \t]*\|[ \t]*$", ""), (r"(?m)^\|[ \t]*-+[ \t]*\|[ \t]*-+[ \t]*\|[ \t]*$", ""), (rf"(?m)^\|{cell}\|{cell}\|[ \t]*$", r"\1 \2"))


def space_sql(x: str) -> str:
    x = f"replace({x}, chr(160), ' ')"
    x = _chain(x, (r"(?m)^[ \t]+$", ""))
    x = f"regexp_replace({x}, '(?m)(?:^---[{WS}]*$\\n*){{2,}}', '---' || chr(10), 'g')"
    return f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"


def _raw_query(expression: str) -> str:
    return f"SELECT doc_id, ingested_at, {expression} AS out FROM (SELECT doc_id, ingested_at, {RAW_SQL} AS raw FROM corpus_clean)"


def nested_sql(q: str, keep: str = "doc_id, ingested_at") -> str:
    """The chain over ``q(..., raw)`` in stages, so that the text of each step is not repeated in the next."""
    for f in (header_sql, footnotes_sql, top_sql, links_sql, markup_sql, tables_sql, space_sql, strip_sql):
        q = f"SELECT {keep}, {f('raw')} AS raw FROM ({q})"
    return q


def _sql(**outs: str) -> str:
    return "SELECT doc_id, ingested_at, " + ", ".join(f"{x} AS {k}" for k, x in outs.items()) + " FROM corpus_clean"


def _in(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


FAMILY_SQL = f"""CASE WHEN coalesce(celex, '') = '' THEN 'OTHER' {" ".join(f"WHEN left(celex, 1) = '{s}' THEN '{f}'" for s, f in T.SECTOR_FAMILY.items())}
 WHEN left(celex, 1) = '3' THEN CASE WHEN regexp_extract(celex, '^.{{5}}([A-Z]+)', 1) IN ({_in(T.SECTOR3_POLICY)}) THEN 'POLICY' ELSE 'LEGISLATIVE' END
 WHEN left(celex, 1) = '5' AND (regexp_extract(celex, '^.{{5}}([A-Z]+)', 1) IN ({_in(T.SECTOR5_POLICY)}) OR coalesce(form, '') IN ({_in(T.POLICY_FORMS)})) THEN 'POLICY' ELSE 'OTHER' END"""

YEAR_SQL = "CASE WHEN length(date) >= 10 AND regexp_full_match(substring(date, 7, 4), '[0-9]{4}') THEN CAST(substring(date, 7, 4) AS INTEGER) END"
_DATED = "concat(date, CASE WHEN date_type = '' THEN '' ELSE ';  ' || date_type END)"
_METRICS = {"PERFECT_GRAMMAR": "Perfect", "MISSPELLED": "Misspelled", "POOR_GRAMMAR": "Poor", "WEB_SEARCH_LIKE": "Web"}

QUERIES = {
    "strip_header": _on_raw(T.drop_header),
    "clean_footnotes": _on_raw(T.drop_footnotes),
    "clean_top_link": _on_raw(T.drop_top_link),
    "clean_links": _on_raw(T.drop_links),
    "clean_markup": _on_raw(T.drop_markup),
    "clean_tables": _on_raw(T.flatten_tables),
    "clean_whitespace": _on_raw(T.tidy_space),
    "clean_text": _on_raw(T.clean),
    "classify_family": _on("celex form", derived=lambda: T.family(F.col("celex"), F.col("form"))),
    "split_date": _on("date date_type", day=lambda: T.date_part(F.expr(_DATED)), kind=lambda: T.date_kind(F.expr(_DATED))),
    "parse_year": _on("date", year=lambda: T.year(F.col("date"))),
    "word_counts": _on("text", words=lambda: T.word_count(F.col("text")), chars=lambda: F.char_length("text"), estimate=lambda: T.words_estimate(F.col("text")), log_chars=lambda: F.round(F.log10(F.char_length("text") + 1), 6)),
    "title_keywords": _on("title", hit=lambda: F.coalesce(T.contains_any(F.col("title"), ["copyright", "related right", "neighbouring right", "computer program", "software"]), F.lit(False))),
    "sanitize_control": _on("text", out=lambda: T.drop_control(F.concat(F.char(F.lit(7)), F.coalesce("text", F.lit("")), F.char(F.lit(11))))),
    "truncate_preview": _on("text", preview=lambda: T.head(F.col("text"), 400), listing=lambda: T.head(F.col("text"), 500), embedded=lambda: T.head(F.col("text"), 6000)),
    "document_codes": _on("celex title", code=lambda: T.document_code(F.col("celex"), F.concat(F.col("title"), F.lit(".ODT.md")))),
    "semantic_flags": _on("text", **{k: (lambda k=k: F.coalesce(T.flags(F.col("text"))[k], F.lit(False))) for k in T.FLAG_PATTERNS}),
    "model_slug": _on("celex form", slug=lambda: T.model_slug(F.concat_ws("/", "celex", "form"))),
    "metric_names": _on("form", name=lambda: T.metric_name(F.concat(F.coalesce("form", F.lit("x")), F.lit("(mode=relevant)")))),
    "typed_default": _on("pages", n=lambda: T.typed(F.col("pages"), "int", -1)),
    "clean_projection": _on("celex title form family author latest pages url", **{c: (lambda c=c: F.coalesce(F.col(c), F.lit(""))) for c in "celex form family author latest pages url".split()}, title=lambda: F.replace(F.coalesce("title", F.lit("")), F.lit("\u00a0"), F.lit(" "))),
}

SQL = {
    "strip_header": _raw_query(header_sql("raw")),
    "clean_footnotes": _raw_query(footnotes_sql("raw")),
    "clean_top_link": _raw_query(top_sql("raw")),
    "clean_links": _raw_query(links_sql("raw")),
    "clean_markup": _raw_query(markup_sql("raw")),
    "clean_tables": _raw_query(tables_sql("raw")),
    "clean_whitespace": _raw_query(space_sql("raw")),
    "clean_text": f"SELECT doc_id, ingested_at, raw AS out FROM ({nested_sql(f'SELECT doc_id, ingested_at, {RAW_SQL} AS raw FROM corpus_clean')})",
    "classify_family": _sql(derived=FAMILY_SQL),
    "split_date": f"SELECT doc_id, ingested_at, coalesce({strip_sql("split_part(d, ';', 1)")}, '') AS day, CASE WHEN contains(d, ';') THEN {strip_sql("substring(d, strpos(d, ';') + 1)")} ELSE '' END AS kind FROM (SELECT doc_id, ingested_at, CASE WHEN date IS NULL OR date_type IS NULL THEN NULL ELSE {_DATED} END AS d FROM corpus_clean)",
    "parse_year": _sql(year=YEAR_SQL),
    "word_counts": _sql(words=words_sql("text"), chars="length(text)", estimate="CAST(floor(length(text) / 5) AS INTEGER)", log_chars="round(log10(length(text) + 1), 6)"),
    "title_keywords": _sql(hit="coalesce(" + " OR ".join(f"contains(lower(title), '{w}')" for w in ("copyright", "related right", "neighbouring right", "computer program", "software")) + ", false)"),
    "sanitize_control": _sql(out=r"regexp_replace(chr(7) || coalesce(text, '') || chr(11), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')"),
    "truncate_preview": _sql(preview="left(text, 400)", listing="left(text, 500)", embedded="left(text, 6000)"),
    "document_codes": _sql(code=r"coalesce(nullif(celex, ''), regexp_replace(coalesce(title || '.ODT.md', 'unknown'), '(?i)\.(odt|docx)?\.?md$', ''))"),
    "semantic_flags": "SELECT doc_id, ingested_at, "
    + ", ".join(f"coalesce(len(regexp_extract_all(t, '{p}')) >= 3, false) AS {k}" if k == "has_steps" else f"coalesce(regexp_matches(t, '{p}'), false) AS {k}" for k, p in T.FLAG_PATTERNS.items())
    + " FROM (SELECT doc_id, ingested_at, text AS t FROM corpus_clean)",
    "model_slug": _sql(slug="lower(regexp_replace(list_extract(string_split(concat_ws('/', celex, form), '/'), -1), '[^a-zA-Z0-9]+', '', 'g'))"),
    "metric_names": _sql(name="trim(regexp_replace(coalesce(form, 'x') || '(mode=relevant)', '[^0-9A-Za-z_./ -]', '_', 'g'), '_')"),
    "typed_default": _sql(n=f"CASE WHEN regexp_full_match(trim(pages), '[+-]?[0-9]+') THEN CAST(trim(pages) AS INTEGER) ELSE -1 END"),
    "clean_projection": _sql(**{c: f"coalesce({c}, '')" for c in "celex form family author latest pages url".split()}, title="replace(coalesce(title, ''), chr(160), ' ')"),
}
