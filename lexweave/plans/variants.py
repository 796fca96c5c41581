"""Declared experiments, what each inherits, and the plan that each becomes."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bm25, dense, fusion
from ..operators.chunking import ChunkConfig
from ..operators.selection import resolve

# The declared variants. Empty fields come from the winners of earlier stages.
_FIXED = {"strategy": "fixed_size", "chunk_size": 256, "chunk_overlap": 25}
_CHUNKED = {"chunk_size": 512, "chunk_overlap": 50}
_COSINE5 = {"strategy": "cosine", "top_k": 5}
VARIANTS: dict[str, dict] = {
    "exp0": {"chunking": _FIXED, "embedding": {"model": "BAAI/bge-base-en-v1.5", "batch_size": 32}, "retrieval": _COSINE5},
    "exp1__snowflake_arctic_l": {"chunking": _FIXED, "embedding": {"model": "Snowflake/snowflake-arctic-embed-l-v2.0", "batch_size": 32}, "retrieval": _COSINE5},
    "exp1__bge_m3": {"chunking": _FIXED, "embedding": {"model": "BAAI/bge-m3", "batch_size": 32}, "retrieval": _COSINE5},
    "exp1__qwen3_8b": {"chunking": _FIXED, "embedding": {"model": "Qwen/Qwen3-Embedding-8B", "batch_size": 16}, "retrieval": _COSINE5},
    "exp2__fixed_512": {"chunking": {"strategy": "fixed_size", **_CHUNKED}, "retrieval": _COSINE5},
    "exp2__sentence": {"chunking": {"strategy": "sentence", **_CHUNKED}, "retrieval": _COSINE5},
    "exp2__structural": {"chunking": {"strategy": "structural", **_CHUNKED, "parent_child": False}, "retrieval": _COSINE5},
    "exp2__structural_pc": {"chunking": {"strategy": "structural", **_CHUNKED, "parent_child": True, "parent_size": 1024}, "retrieval": _COSINE5},
    "exp2__semantic": {"chunking": {"strategy": "semantic", **_CHUNKED, "breakpoint_type": "percentile"}, "retrieval": _COSINE5},
    "exp3__dense_k10": {"retrieval": {"strategy": "cosine", "top_k": 10}},
    "exp3__mmr_k5": {"retrieval": {"strategy": "mmr", "top_k": 5, "fetch_k": 30}},
    "exp3__mmr_k10": {"retrieval": {"strategy": "mmr", "top_k": 10, "fetch_k": 30}},
    "exp3__bm25_k5": {"retrieval": {"strategy": "bm25", "top_k": 5}},
    "exp3__bm25_k10": {"retrieval": {"strategy": "bm25", "top_k": 10}},
    "exp3__hybrid_k5": {"retrieval": {"strategy": "hybrid", "top_k": 5}},
    "exp3__hybrid_k10": {"retrieval": {"strategy": "hybrid", "top_k": 10}},
    "exp4a__hyde": {"query_transform": {"type": "hyde"}},
    "exp4b__multiquery": {"query_transform": {"type": "multiquery", "n_queries": 4}},
    "exp4c__rag_fusion": {"query_transform": {"type": "rag_fusion", "n_queries": 4}},
    "exp4d__rewrite": {"query_transform": {"type": "rewrite"}},
    "exp4e__stepback": {"query_transform": {"type": "stepback"}},
    "exp4f__decomposition": {"query_transform": {"type": "decomposition", "n_queries": 3}},
    "exp4g__selfquery": {"query_transform": {"type": "selfquery"}},
    "exp5a__rerank_ce_k5": {"rerank": {"type": "cross_encoder", "pool": 50, "fetch_k": 20, "top_k": 5}},
    "exp5b__rerank_ce_k10": {"rerank": {"type": "cross_encoder", "pool": 50, "fetch_k": 20, "top_k": 10}},
    "exp5c__rerank_llm_k5": {"rerank": {"type": "llm", "pool": 50, "fetch_k": 20, "top_k": 5}},
    "exp5d__rerank_llm_k10": {"rerank": {"type": "llm", "pool": 50, "fetch_k": 20, "top_k": 10}},
    "expSOTA": {
        "chunking": {"strategy": "semantic", **_CHUNKED, "breakpoint_type": "percentile"},
        "embedding": {"model": "Qwen/Qwen3-Embedding-8B", "batch_size": 16},
        "retrieval": {"strategy": "hybrid", "top_k": 10},
        "query_transform": {"type": "rag_fusion", "n_queries": 4},
        "rerank": {"type": "llm", "fetch_k": 20, "top_k": 10},
    },
}
STAGES = ("embedding", "chunking", "retrieval", "query_transform", "rerank")


def inherits(variant: str) -> list[str]:
    """What a variant takes from earlier winners; later stages never feed back."""
    return [k for k in ("embedding", "chunking", "retrieval") if not VARIANTS[variant].get(k)]


def builds_index(variant: str) -> bool:
    """Does it chunk and embed, or only search an index that is there?"""
    return "chunking" in VARIANTS[variant]


def resolved(variant: str, embedding: str, chunking: dict, retrieval: dict) -> dict:
    return resolve(VARIANTS[variant], embedding, chunking, retrieval)


def chunk_config(chunking: dict) -> ChunkConfig:
    """The chunker of a resolved configuration."""
    if chunking.get("breakpoint_type", "percentile") != "percentile":
        raise NotImplementedError(f"breakpoints {chunking['breakpoint_type']!r}")
    known = {f.name for f in fields(ChunkConfig)}
    if other := set(chunking) - known - {"breakpoint_type"}:
        raise NotImplementedError(f"chunking parameters {sorted(other)}")
    return ChunkConfig(**{k: v for k, v in chunking.items() if k in known})


@dataclass
class Corpus:
    """What searches run over: chunks ``(chunk_id, page_content)``, for self-queries with ``family`` and ``form``, their vectors, and the
    stand-ins for models: ``embed(df, key, text)``, ``answers(queries, kind)``."""

    chunks: DataFrame
    vectors: DataFrame
    embed: object
    answers: object
    score: str = "overlap"  # one of fusion.SCORERS
    postings: bm25.Index | None = None  # built on the first search that needs it

    def sparse(self) -> bm25.Index:
        self.postings = self.postings or bm25.build(self.chunks)
        return self.postings


def filtered_search(c: Corpus, queries: DataFrame, retrieval: dict, k: int) -> DataFrame:
    """``(qid, rank0, chunk_id, score)`` of self-queries ``(qid, text, family, form)``: always MMR,
    among the chunks that have the family and form asked for."""
    filters = list(fusion.SPEC_FILTERS)
    q = c.embed(queries, "qid", "text").join(queries.select("qid", *filters), "qid")
    index = c.vectors.join(c.chunks.select("chunk_id", *filters), "chunk_id")
    return dense.mmr(q, index, k, retrieval.get("fetch_k", 30), filters=filters)


def base_search(c: Corpus, queries: DataFrame, retrieval: dict, k: int, pool: int | None = None) -> DataFrame:
    """``(qid, rank0, chunk_id, score)`` of queries ``(qid, text)`` by a retrieval strategy."""
    kind = retrieval["strategy"]
    if kind == "bm25":
        return bm25.search(queries, c.sparse(), k)
    if kind not in ("cosine", "mmr", "hybrid"):
        raise NotImplementedError(f"retrieval strategy {kind!r}")
    q = c.embed(queries, "qid", "text")
    if kind == "cosine":
        return dense.topk(q, c.vectors, k)
    if kind == "mmr":
        return dense.mmr(q, c.vectors, k, pool or retrieval.get("fetch_k", 30))
    fetch = fusion.fetch_size(k)
    return fusion.hybrid(dense.topk(q, c.vectors, fetch), bm25.search(queries, c.sparse(), fetch), k)


def plan(c: Corpus, queries: DataFrame, cfg: dict) -> DataFrame:
    """The search that a resolved configuration stands for.

    Transformation and reranking: the transformation delivers the reranker's
    candidates. Reranking alone: candidates of the strategy, out of a pool for
    MMR. Transformation alone, or neither: the strategy's own size.
    """
    retrieval, change, again = cfg["retrieval"], cfg.get("query_transform"), cfg.get("rerank")
    k = again["fetch_k"] if again else retrieval["top_k"]
    pool = again.get("pool") if again and not change else None
    if change:
        kind, n = change["type"], change.get("n_queries", 4)
        v = fusion.variants(c.answers(queries, kind), kind, n).withColumn("v", F.xxhash64("qid", "list_id"))
        search = filtered_search if kind == "selfquery" else base_search
        lists = search(c, v.drop("qid", "list_id").withColumnRenamed("v", "qid"), retrieval, k).withColumnRenamed("qid", "v").join(v.select("v", "qid", "list_id"), "v")
        hits = fusion.FUSION[kind](lists, k, "chunk_id") if kind in fusion.FUSION else lists
        hits = hits.select("qid", "rank0", "chunk_id")
    else:
        hits = base_search(c, queries, retrieval, k, pool).select("qid", "rank0", "chunk_id")
    if not again:
        return hits
    if again["type"] not in ("cross_encoder", "llm"):
        raise NotImplementedError(f"reranker {again['type']!r}")
    candidates = hits.join(queries.select("qid", F.col("text").alias("question")), "qid").join(c.chunks.select("chunk_id", "page_content"), "chunk_id")
    if again["type"] == "llm":
        return fusion.listwise(candidates, c.answers(queries, "rank").select("qid", "answer"), again["top_k"]).select("qid", "rank0", "chunk_id")
    score: Column = fusion.SCORERS[c.score](F.col("question"), F.col("page_content"))
    return fusion.rerank(candidates, again["top_k"], score).select("qid", "rank0", "chunk_id")


def prompts(c: Corpus, queries: DataFrame, hits: DataFrame, template: str) -> DataFrame:
    """``(qid, prompt)`` of every query: its hits' contents in their order as context."""
    shown = hits.join(c.chunks.select("chunk_id", "page_content"), "chunk_id").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank0", "page_content"))).getField("page_content").alias("found"))  # top k of a query
    context = F.array_join(F.coalesce("found", F.array().cast("array<string>")), "\n\n---\n\n")
    return queries.join(shown, "qid", "left").select("qid", T.fill(template, context=context, question=F.coalesce("text", F.lit(""))).alias("prompt"))
