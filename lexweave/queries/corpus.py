"""Selection, sampling and exploration of the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from ..session import table
from .scalars import FAMILY_SQL, YEAR_SQL, nested_sql, strip_sql, words_sql

FAMILIES = ", ".join(f"count(*) FILTER (family = '{f}') AS \"{f}\"" for f in C.FAMILIES)


def _docs(spark, sf_dir, *columns, **derived):
    """Distinct documents of the corpus, last delivery. What is derived from the
    text is derived before the shuffle, so that texts themselves stay out of it."""
    needs = {"w": "text", "chars": "text"}
    read = dict.fromkeys(["doc_id", "ingested_at", *columns, *(needs.get(k, "text") for k in derived)])
    return C.latest(table(spark, sf_dir, "corpus_clean", *read).select("doc_id", "ingested_at", *columns, *(c.alias(k) for k, c in derived.items())))


def W():
    return T.word_count(F.col("text"))


def N():
    return F.char_length("text")


#: The same in SQL.
DOCS = "(SELECT * FROM corpus_clean QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ingested_at DESC) = 1)"


def _in(values):
    return ", ".join(f"'{v}'" for v in values)


def _any(words, c="title"):
    return "(" + " OR ".join(f"contains(lower({c}), '{w}')" for w in words) + ")"


def select_corpus(spark, sf_dir):
    return C.select_documents(_docs(spark, sf_dir, "title", "form", words=W()), words="words").select("doc_id", "title", "form", "words")


def doc_id_seq(spark, sf_dir):
    docs = _docs(spark, sf_dir, "celex").select(F.col("doc_id").alias("file_pos"), "celex")
    return C.number_rows(docs, "file_pos", "seq").select("seq", "celex")


def ingest_documents(spark, sf_dir):
    raw = _docs(spark, sf_dir, "celex", "title", "form", "author", "date", "latest", "pages", "url", "text")
    meta = F.struct("celex", "title", "form", "author", "date", "latest", "pages", F.col("url").alias("source"))
    return C.clean_documents(raw.select(F.col("text").alias("content"), meta.alias("metadata"), F.col("doc_id").alias("file_pos"))).select("doc_id", "celex", "title", "family", "date", "url", F.char_length("text").alias("chars"))


def stratified_sample(spark, sf_dir):
    return C.stratified_sample(_docs(spark, sf_dir, w=W()), words="w").select("doc_id", "stratum", "pick")


def stratum_report(spark, sf_dir):
    return C.stratum_report(_docs(spark, sf_dir, w=W()), words="w")


def sample_per_family(spark, sf_dir):
    """One document of each family, of the longer ones where it has any (more than 2,000 characters)."""
    docs = _docs(spark, sf_dir, "family", chars=N()).select("doc_id", F.coalesce("family", F.lit("")).alias("family"), (F.coalesce("chars", F.lit(0)) > 2000).alias("long"))
    some = docs.groupBy("family").agg(F.max("long").alias("any_long"))
    pool = docs.join(some, "family").filter("long = any_long")
    return C.take_by_key(pool, ["family"], F.lit(1), "doc_id", 1).select("family", "doc_id")


def head_rows(spark, sf_dir):
    return _docs(spark, sf_dir, "celex").select("doc_id", "celex").orderBy("doc_id").limit(25)


def subtopic_matrix(spark, sf_dir):
    return C.subtopics(_docs(spark, sf_dir, "title", "family"))


def filter_scenarios(spark, sf_dir):
    return C.filter_scenarios(_docs(spark, sf_dir, "form", "family", w=W()), words="w")


def value_counts_pct(spark, sf_dir):
    return C.value_counts(_docs(spark, sf_dir, "form"), "form")


def top_forms(spark, sf_dir):
    return C.value_counts(_docs(spark, sf_dir, "form"), "form").orderBy(F.desc("n"), F.asc_nulls_last("form")).limit(15)


def crosstab(spark, sf_dir):
    return C.crosstab(_docs(spark, sf_dir, "form", "family"), "form", "family", C.FAMILIES)


def family_reindexed(spark, sf_dir):
    domain = spark.createDataFrame([(f,) for f in [*C.FAMILIES, "TREATY"]], "family string")
    n = _docs(spark, sf_dir, "family").groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    return domain.join(n, "family", "left").select("family", F.coalesce("n", F.lit(0)).alias("n"))


def distinct_counts(spark, sf_dir):
    d = _docs(spark, sf_dir, "celex", "form", "family", "title", chars=N())
    complete = F.col("title").isNotNull() & F.col("chars").isNotNull() & F.col("form").isNotNull()
    return d.agg(*[F.count_distinct(c).alias(c) for c in ("celex", "form", "family")], F.count_if(F.col("title").isNull()).alias("null_titles"), F.count_if(complete).alias("complete"))


def length_stats(spark, sf_dir):
    n = _docs(spark, sf_dir, n=N())
    return n.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 4).alias("mean"), F.median("n").alias("median"), F.round(F.stddev_samp("n"), 4).alias("std"))


def length_percentiles(spark, sf_dir):
    n = _docs(spark, sf_dir, n=N())
    p = [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
    return n.agg(*[F.round(F.percentile("n", F.lit(x)), 4).alias(f"p{int(x * 100)}") for x in p])


def length_buckets(spark, sf_dir):
    """Short, empty and very long texts, and by threshold for judicial notices and the rest."""
    d = _docs(spark, sf_dir, "form", chars=N()).select(F.when(F.col("form") == "Judicial information", "notice").otherwise("substantive").alias("subtype"), F.coalesce("chars", F.lit(0)).alias("n"))
    bounds = [F.count_if(F.col("n") < x).alias(f"below_{x}") for x in (500, 1000, 2000, 3000, 5000)]
    return d.groupBy("subtype").agg(*bounds, F.count_if(F.col("n") == 0).alias("empty"), F.count_if(F.col("n") > 500000).alias("very_long"))


def family_lengths(spark, sf_dir):
    d = _docs(spark, sf_dir, "family", w=W())
    return d.groupBy("family").agg(F.median("w").cast("int").alias("median"), F.avg("w").cast("int").alias("mean"), F.stddev_samp("w").cast("int").alias("std"), F.count("w").alias("n"))


def having_min_n(spark, sf_dir):
    d = _docs(spark, sf_dir, "form", w=W())
    return d.groupBy("form").agg(F.median("w").alias("median"), F.count(F.lit(1)).alias("n")).filter("n >= 3")


def mode_by_group(spark, sf_dir):
    return _docs(spark, sf_dir, "form", "family").groupBy("family").agg(F.mode("form", True).alias("form"))


def year_counts(spark, sf_dir):
    d = _docs(spark, sf_dir, "date", "family").select(T.year(F.col("date")).alias("year"), "family").filter("year is not null")
    return C.crosstab(d, "year", "family", C.FAMILIES)


def flag_prevalence(spark, sf_dir):
    flags = _docs(spark, sf_dir, **{k: F.coalesce(c, F.lit(False)) for k, c in T.flags(F.col("text")).items()})
    one = flags.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(k).alias(k) for k in T.FLAG_PATTERNS])
    rows = [F.struct(F.lit(k).alias("flag"), F.col(k).alias("n"), F.round(F.col(k) / F.col("n") * 100, 2).alias("percent")) for k in T.FLAG_PATTERNS]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def context_counts(spark, sf_dir):
    g = table(spark, sf_dir, "gold_dataset", "qa_id", "reference_contexts", "synthesizer_name").dropDuplicates(["qa_id"])
    n = g.select("synthesizer_name", F.coalesce(F.array_size("reference_contexts"), F.lit(0)).alias("n"))
    return n.groupBy("synthesizer_name").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"), F.count(F.lit(1)).alias("pairs"))


QUERIES = {
    f.__name__: f
    for f in (
        select_corpus, doc_id_seq, ingest_documents, stratified_sample, stratum_report, sample_per_family, head_rows, subtopic_matrix, filter_scenarios, value_counts_pct, top_forms,
        crosstab, family_reindexed, distinct_counts, length_stats, length_percentiles, length_buckets, family_lengths, having_min_n, mode_by_group, year_counts, flag_prevalence, context_counts,
    )
}

_W = words_sql("text")
_STRATUM = "CASE " + " ".join(f"WHEN w >= {a}" + (f" AND w < {b}" if b else "") + f" THEN {i}" for i, (a, b, _) in enumerate(C.STRATA)) + " END"
_QUOTA = "CASE stratum " + " ".join(f"WHEN {i} THEN {n}" for i, (*_, n) in enumerate(C.STRATA)) + " END"
_STRATA = f"(SELECT doc_id, {_STRATUM} AS stratum FROM (SELECT doc_id, {_W} AS w FROM {DOCS}))"
_SCENARIO = {
    "no filter": "true",
    "forms": f"form IN ({_in(C.SCENARIO_FORMS)})",
    **{f"forms, {n} words": f"form IN ({_in(C.SCENARIO_FORMS)}) AND w >= {n}" for n in (100, 200, 300)},
    "forms, 300 to 20000 words": f"form IN ({_in(C.SCENARIO_FORMS)}) AND w BETWEEN 300 AND 20000",
}
_FLAGS = {k: f"regexp_matches(text, '{p}')" for k, p in T.FLAG_PATTERNS.items()}
_FLAGS["has_steps"] = f"len(regexp_extract_all(text, '{T.FLAG_PATTERNS['has_steps']}')) >= 3"

SQL = {
    "select_corpus": f"SELECT doc_id, title, form, {_W} AS words FROM {DOCS} WHERE {_any(C.KEYWORDS)} AND form IN ({_in(C.FORMS)}) AND {_W} >= {C.MIN_WORDS}",
    "doc_id_seq": f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS seq, celex FROM {DOCS}",
    "ingest_documents": f"""SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, celex, title, family, date, url, length(raw) AS chars FROM ({nested_sql(
        f"SELECT doc_id, coalesce(celex, '') AS celex, replace(coalesce(title, ''), chr(160), ' ') AS title, {FAMILY_SQL} AS family, {strip_sql("split_part(coalesce(date, ''), ';', 1)")} AS date, coalesce(url, '') AS url, coalesce(text, '') AS raw FROM {DOCS}",
        "doc_id, celex, title, family, date, url")})""",
    "stratified_sample": f"SELECT doc_id, stratum, pick FROM (SELECT doc_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || doc_id), doc_id) AS pick FROM {_STRATA} WHERE stratum IS NOT NULL) WHERE pick <= {_QUOTA}",
    "stratum_report": f"SELECT stratum, count(doc_id) AS pool, least(count(doc_id), n) AS sampled FROM (VALUES {', '.join(f'({i}, {n})' for i, (*_, n) in enumerate(C.STRATA))}) d(stratum, n) LEFT JOIN {_STRATA} USING (stratum) GROUP BY stratum, n",
    "sample_per_family": f"""SELECT family, doc_id FROM (SELECT *, max(long) OVER (PARTITION BY family) AS any_long FROM (SELECT doc_id, coalesce(family, '') AS family, coalesce(length(text), 0) > 2000 AS long FROM {DOCS}))
        WHERE long = any_long QUALIFY row_number() OVER (PARTITION BY family ORDER BY md5('42:' || doc_id), doc_id) = 1""",
    "head_rows": f"SELECT doc_id, celex FROM {DOCS} ORDER BY doc_id LIMIT 25",
    "subtopic_matrix": " UNION ALL ".join(
        f"SELECT '{t}' AS topic, count(*) FILTER ({_any(k)}) AS total, " + ", ".join(f"count(*) FILTER ({_any(k)} AND family = '{f}') AS \"{f}\"" for f in C.FAMILIES) + f", round(count(*) FILTER ({_any(k)}) / count(*) * 100, 1) AS percent FROM {DOCS}"
        for t, k in C.TOPICS.items()
    ),
    "filter_scenarios": f"WITH d AS (SELECT family, form, {_W} AS w FROM {DOCS}) " + " UNION ALL ".join(f"SELECT '{k}' AS scenario, count(*) AS total, {FAMILIES} FROM d WHERE {c}" for k, c in _SCENARIO.items()),
    "value_counts_pct": f"SELECT form, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 2) AS percent FROM {DOCS} GROUP BY form",
    "top_forms": f"SELECT form, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 2) AS percent FROM {DOCS} GROUP BY form ORDER BY n DESC, form NULLS LAST LIMIT 15",
    "crosstab": f"SELECT form, {FAMILIES} FROM {DOCS} GROUP BY form",
    "family_reindexed": f"SELECT family, count(doc_id) AS n FROM (VALUES {', '.join(f"('{f}')" for f in [*C.FAMILIES, 'TREATY'])}) d(family) LEFT JOIN {DOCS} USING (family) GROUP BY family",
    "distinct_counts": f"SELECT count(DISTINCT celex) AS celex, count(DISTINCT form) AS form, count(DISTINCT family) AS family, count(*) FILTER (title IS NULL) AS null_titles, count(*) FILTER (title IS NOT NULL AND text IS NOT NULL AND form IS NOT NULL) AS complete FROM {DOCS}",
    "length_stats": f"SELECT min(n) AS least, max(n) AS most, round(avg(n), 4) AS mean, median(n) AS median, round(stddev_samp(n), 4) AS std FROM (SELECT length(text) AS n FROM {DOCS})",
    "length_percentiles": "SELECT " + ", ".join(f"round(quantile_cont(n, {x}), 4) AS p{int(x * 100)}" for x in (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) + f" FROM (SELECT length(text) AS n FROM {DOCS})",
    "length_buckets": "SELECT CASE WHEN form = 'Judicial information' THEN 'notice' ELSE 'substantive' END AS subtype, "
    + ", ".join(f"count(*) FILTER (coalesce(length(text), 0) < {x}) AS below_{x}" for x in (500, 1000, 2000, 3000, 5000))
    + f", count(*) FILTER (coalesce(length(text), 0) = 0) AS empty, count(*) FILTER (length(text) > 500000) AS very_long FROM {DOCS} GROUP BY 1",
    "family_lengths": f"SELECT family, CAST(trunc(median(w)) AS INTEGER) AS median, CAST(trunc(avg(w)) AS INTEGER) AS mean, CAST(trunc(stddev_samp(w)) AS INTEGER) AS std, count(w) AS n FROM (SELECT family, {_W} AS w FROM {DOCS}) GROUP BY family",
    "having_min_n": f"SELECT form, median(w) AS median, count(*) AS n FROM (SELECT form, {_W} AS w FROM {DOCS}) GROUP BY form HAVING count(*) >= 3",
    "mode_by_group": f"SELECT family, form FROM (SELECT family, form, count(*) AS n FROM {DOCS} WHERE form IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY family ORDER BY n DESC, form) = 1",
    "year_counts": f"SELECT year, {FAMILIES} FROM (SELECT {YEAR_SQL} AS year, family FROM {DOCS}) WHERE year IS NOT NULL GROUP BY year",
    "flag_prevalence": " UNION ALL ".join(f"SELECT '{k}' AS flag, count(*) FILTER ({c}) AS n, round(count(*) FILTER ({c}) / count(*) * 100, 2) AS percent FROM {DOCS}" for k, c in _FLAGS.items()),
    "context_counts": "SELECT synthesizer_name, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, count(*) AS pairs FROM (SELECT synthesizer_name, coalesce(len(reference_contexts), 0) AS n FROM gold_dataset QUALIFY row_number() OVER (PARTITION BY qa_id) = 1) GROUP BY 1",
}
