"""Whole experiments: what each variant inherits, and searches by resolved configuration."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import bm25, generation
from ..operators import chunking as K
from ..operators import corpus as C
from ..operators.embedding import embed
from ..operators.fusion import SPEC_FILTERS
from ..plans import variants as V
from ..session import once, settle, table
from .retrieval import _QUESTIONS, PROMPT, _questions, search_sql

WINNERS = ("BAAI/bge-m3", {"strategy": "fixed_size", "chunk_size": 256, "chunk_overlap": 25}, {"strategy": "mmr", "top_k": 10, "fetch_k": 30})


def _chunked(spark, sf_dir, chunking):
    """``(chunk_id, page_content)`` of the whole corpus; ids are ``doc_id * 2^20 + chunk_index``."""
    docs = C.latest(table(spark, sf_dir, "corpus_clean", "doc_id", "form", "text", "ingested_at"))
    pieces = K.chunk(docs, V.chunk_config(chunking))
    return pieces.select((F.coalesce("doc_id", F.lit(-1)) * (1 << 20) + F.col("chunk_index")).alias("chunk_id"), "page_content")


def _stored(spark, sf_dir):
    """``(chunk_id, page_content, family, form)`` of the chunks table."""
    c = table(spark, sf_dir, "chunks", "chunk_id", "page_content", "metadata").dropDuplicates(["chunk_id"])
    return c.select("chunk_id", "page_content", *(F.col(f"metadata.{f}").alias(f) for f in SPEC_FILTERS))


def _spec(qid):
    """Stand-in for a model's answer to a self-query: family, family and form, no restriction, no object at all."""
    turn = F.floor(qid / 100) % 4
    family = F.when(turn == 0, "LEGISLATIVE").when(turn == 1, "JUDICIAL")
    spec = F.to_json(F.struct(F.col("text").alias("query"), family.alias("family"), F.when(turn == 1, "Judgment").alias("form")))
    return F.when(turn == 3, F.lit("no object")).otherwise(F.concat(F.lit("Sure: "), spec))


def _corpus(spark, sf_dir, cfg, builds):
    """A variant that builds its index chunks all documents; the others search the chunks that are there.

    Chunks, vectors and postings are built once for all variants that declare the same.
    """
    model, batch = cfg["embedding"]["model"], cfg["embedding"].get("batch_size")
    source, key = ("corpus_clean", json.dumps(cfg["chunking"], sort_keys=True)) if builds else ("chunks", "stored")
    chunks = once(spark, sf_dir, source, ("chunks", key), lambda: settle(_chunked(spark, sf_dir, cfg["chunking"]) if builds else _stored(spark, sf_dir)))
    vectors = once(spark, sf_dir, source, ("vectors", key, model), lambda: settle(embed(chunks, "chunk_id", "page_content", model, batch=batch)))

    def answers(queries, kind):
        text = F.col("text")
        made = F.lit("[2, 0, 1]") if kind == "rank" else _spec(F.col("qid")) if kind == "selfquery" else F.concat(F.lit("1. about "), text, F.lit("\n2. "), text, F.lit(" licence"))
        return queries.select("qid", text.alias("question"), made.alias("answer"))

    found = once(spark, sf_dir, source, ("corpus", key, model), lambda: V.Corpus(chunks, vectors, lambda df, key, text: embed(df, key, text, model, query=True, batch=batch), answers))
    found.postings = found.postings or (once(spark, sf_dir, source, ("postings", key), lambda: bm25.build(chunks)) if cfg["retrieval"]["strategy"] in ("bm25", "hybrid") else None)
    return found


def _experiment(variant):
    def query(spark, sf_dir):
        q = _questions(spark, sf_dir).select("qid", "text")
        cfg = V.resolved(variant, *WINNERS)
        return V.plan(_corpus(spark, sf_dir, cfg, V.builds_index(variant)), q, cfg)

    return query


def run_answers(spark, sf_dir):
    """The reranked winner to its end: search, contexts, prompt, answer."""
    q = _questions(spark, sf_dir).select("qid", "text")
    cfg = V.resolved("exp5b__rerank_ce_k10", *WINNERS)
    c = _corpus(spark, sf_dir, cfg, False)
    return generation.generate(V.prompts(c, q, V.plan(c, q, cfg), PROMPT))


def variant_registry(spark, sf_dir):
    rows = [(v, V.builds_index(v), ",".join(V.inherits(v)), i) for i, v in enumerate(V.VARIANTS)]
    return spark.createDataFrame(rows, "variant string, builds_index boolean, inherits string, declared int")


QUERIES = {"variant_registry": variant_registry, "run_answers": run_answers} | {f"run_{v.lower()}": _experiment(v) for v in V.VARIANTS}

# The declared variants: name, builds an index of its own, what it takes from winners.
REGISTRY_SQL = """
exp0|true|
exp1__snowflake_arctic_l|true|
exp1__bge_m3|true|
exp1__qwen3_8b|true|
exp2__fixed_512|true|embedding
exp2__sentence|true|embedding
exp2__structural|true|embedding
exp2__structural_pc|true|embedding
exp2__semantic|true|embedding
exp3__dense_k10|false|embedding,chunking
exp3__mmr_k5|false|embedding,chunking
exp3__mmr_k10|false|embedding,chunking
exp3__bm25_k5|false|embedding,chunking
exp3__bm25_k10|false|embedding,chunking
exp3__hybrid_k5|false|embedding,chunking
exp3__hybrid_k10|false|embedding,chunking
exp4a__hyde|false|embedding,chunking,retrieval
exp4b__multiquery|false|embedding,chunking,retrieval
exp4c__rag_fusion|false|embedding,chunking,retrieval
exp4d__rewrite|false|embedding,chunking,retrieval
exp4e__stepback|false|embedding,chunking,retrieval
exp4f__decomposition|false|embedding,chunking,retrieval
exp4g__selfquery|false|embedding,chunking,retrieval
exp5a__rerank_ce_k5|false|embedding,chunking,retrieval
exp5b__rerank_ce_k10|false|embedding,chunking,retrieval
exp5c__rerank_llm_k5|false|embedding,chunking,retrieval
exp5d__rerank_llm_k10|false|embedding,chunking,retrieval
expSOTA|true|
"""
SQL = {
    "variant_registry": f"""SELECT f[1] AS variant, CAST(f[2] AS BOOLEAN) AS builds_index, f[3] AS inherits, CAST(declared AS INTEGER) AS declared FROM
        (SELECT string_split(l, '|') AS f, declared FROM (SELECT unnest(ls) AS l, unnest(range(0, len(ls))) AS declared FROM (SELECT string_split(trim('{REGISTRY_SQL}', chr(10)), chr(10)) AS ls)))""",
} | {f"run_exp3__bm25_k{k}": f"WITH {search_sql('SELECT qid, text FROM ' + _QUESTIONS, k)} SELECT qid, rank0, chunk_id FROM ranked" for k in (5, 10)}
