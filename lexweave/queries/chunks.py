"""Chunkers over the whole corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as K
from ..session import table
from .corpus import DOCS, _in
from .scalars import strip_sql, words_sql

WS = T.WS


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "corpus_clean", "doc_id", "form", "text", "ingested_at").dropDuplicates(["doc_id"])


def chunk_sentences(spark, sf_dir):
    return K.chunk(_docs(spark, sf_dir), K.ChunkConfig("sentence", 100)).select("doc_id", "chunk_index", "page_content")


def structural_units(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", K.structural_units(F.coalesce("text", F.lit("")), F.coalesce("form", F.lit(""))).alias("u"))
    return d.select("doc_id", F.posexplode("u").alias("unit", "page_content"))


def chunk_fixed_tokens(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.posexplode(K.token_windows(F.col("text"), 256, 32)).alias("window", "page_content"))
    return d.filter(T.word_count(F.col("page_content")) >= K.MIN_WORDS)


def _plain(cfg, min_words=0):
    def query(spark, sf_dir):
        return K.chunk(_docs(spark, sf_dir), cfg, min_words)

    return query


#: Where public tokenizers lie.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def chunk_bpe_windows(spark, sf_dir):
    return K.bpe_windows(_docs(spark, sf_dir), TOKENIZER, 256, 25)


def chunk_markdown(spark, sf_dir):
    """Headings are made of the short lines of the corpus, which has no marks for them."""
    d = _docs(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"(?md)^([A-Z][A-Za-z ]{3,40})$", "## $1"))
    return K.chunk(d, K.ChunkConfig("markdown", 450, 50), K.MIN_WORDS)


def chunk_section(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"(?md)^([A-Z][A-Za-z ]{3,40})$", "# $1"))
    return K.chunk(d, K.ChunkConfig("section", 450, 50), K.MIN_WORDS)


def chunk_enriched(spark, sf_dir):
    chunks = table(spark, sf_dir, "chunks", "chunk_id", "doc_id", "chunk_index", "page_content").dropDuplicates(["chunk_id"])
    docs = table(spark, sf_dir, "corpus_clean", "doc_id", "family", "ingested_at").groupBy("doc_id").agg(F.max_by("family", "ingested_at").alias("family"))
    return K.enrich(chunks, docs).drop("page_content")


def chunk_word_stats(spark, sf_dir):
    w = table(spark, sf_dir, "chunks", "chunk_id", "page_content").dropDuplicates(["chunk_id"]).select(T.word_count(F.col("page_content")).alias("w"))
    return w.agg(F.min("w").alias("least"), F.max("w").alias("most"), F.round(F.avg("w"), 4).alias("mean"), F.median("w").alias("median"), F.count("w").alias("n"))


QUERIES = {
    "chunk_sentences": chunk_sentences,
    "structural_units": structural_units,
    "chunk_fixed_tokens": chunk_fixed_tokens,
    "chunk_fixed_size": _plain(K.ChunkConfig("fixed_size", 256, 25)),
    "chunk_fixed_size_tokens": _plain(K.ChunkConfig("fixed_size", 256, 25, tokens=TOKENIZER)),
    "chunk_bpe_windows": chunk_bpe_windows,
    "chunk_recursive_words": _plain(K.ChunkConfig("recursive", 200, 25), K.MIN_WORDS),
    "chunk_structural": _plain(K.ChunkConfig("structural", 512, 50)),
    "parent_window": _plain(K.ChunkConfig("structural", 512, 50, parent_child=True)),
    "chunk_semantic": _plain(K.ChunkConfig("semantic", 512, 50)),
    "chunk_markdown": chunk_markdown,
    "chunk_section": chunk_section,
    "chunk_enriched": chunk_enriched,
    "chunk_word_stats": chunk_word_stats,
}

_UNITS = lambda marker: f"list_filter(string_split(regexp_replace(text, '(?m)^({marker})', chr(31) || '\\1', 'g'), chr(31)), lambda x: {strip_sql('x')} <> '')"
_BLOCKS = f"list_filter(string_split(regexp_replace(text, '\\n[{WS}]*\\n', chr(31), 'g'), chr(31)), lambda x: {strip_sql('x')} <> '')"
_FLAGS = ", ".join(f"coalesce(len(regexp_extract_all(page_content, '{p}')) >= 3, false) AS {k}" if k == "has_steps" else f"coalesce(regexp_matches(page_content, '{p}'), false) AS {k}" for k, p in T.FLAG_PATTERNS.items())
_CHUNKS = "(SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id) = 1)"

SQL = {
    "chunk_sentences": f"""WITH RECURSIVE s AS (
          SELECT doc_id, i, l[i] AS s, {words_sql('l[i]')} AS n FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM
            (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])[{WS}]+', '\\1' || chr(31), 'g'), chr(31)), lambda x: {strip_sql('x')} <> '') AS l FROM {DOCS} WHERE text IS NOT NULL))),
        r AS (SELECT doc_id, i, n AS t, 0 AS c FROM s WHERE i = 1
          UNION ALL SELECT s.doc_id, s.i, CASE WHEN r.t + s.n > 100 THEN s.n ELSE r.t + s.n END, CASE WHEN r.t + s.n > 100 THEN r.c + 1 ELSE r.c END FROM r JOIN s ON s.doc_id = r.doc_id AND s.i = r.i + 1)
        SELECT doc_id, c AS chunk_index, string_agg(s, ' ' ORDER BY i) AS page_content FROM r JOIN s USING (doc_id, i) GROUP BY doc_id, c""",
    "structural_units": f"""SELECT doc_id, unnest(range(0, len(u))) AS unit, unnest(u) AS page_content FROM (SELECT doc_id, CASE WHEN len(coalesce(m, [])) > 1 THEN m ELSE b END AS u FROM
        (SELECT doc_id, CASE WHEN form IN ({_in(K.PARAGRAPH_FORMS)}) THEN {_UNITS(rf'\p{{Nd}}+\.[{WS}]')} WHEN form IN ({_in(K.ARTICLE_FORMS)}) THEN {_UNITS(rf'Article[{WS}]+\p{{Nd}}+')} END AS m, {_BLOCKS} AS b FROM {DOCS} WHERE text IS NOT NULL))""",
    "chunk_fixed_tokens": f"""SELECT doc_id, i // 224 AS window, array_to_string(l[i + 1:i + 256], ' ') AS page_content FROM (SELECT doc_id, l, unnest(range(0, len(l), 224)) AS i FROM
        (SELECT doc_id, regexp_extract_all(text, '[^{WS}]+') AS l FROM {DOCS})) WHERE len(l[i + 1:i + 256]) >= {K.MIN_WORDS}""",
    "chunk_enriched": f"""SELECT c.chunk_id, c.doc_id, c.chunk_index, count(*) OVER (PARTITION BY c.doc_id) AS chunk_total, printf('%s_chunk_%03d', c.doc_id::VARCHAR, c.chunk_index) AS chunk_name,
        {words_sql('page_content')} AS words, length(page_content) AS chars, {_FLAGS}, d.family FROM {_CHUNKS} c LEFT JOIN {DOCS} d ON d.doc_id = c.doc_id""",
    "chunk_word_stats": f"SELECT min(w) AS least, max(w) AS most, round(avg(w), 4) AS mean, median(w) AS median, count(w) AS n FROM (SELECT {words_sql('page_content')} AS w FROM {_CHUNKS})",
}
