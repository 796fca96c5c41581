"""Retrieval, fusion, transformation and reranking.

Query sets of searches are the rows whose id is divisible by 100, against all rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bm25, dense, fusion, generation
from ..operators.embedding import embed
from ..session import once, settle, table
from .scalars import strip_sql

WS = T.WS
K, FETCH, POOL = 10, 30, 50


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").select(F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").cast("string").alias("label"))


def _vector_queries(spark, sf_dir, label=False):
    v = _vectors(spark, sf_dir).filter("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "qid")
    return v if label else v.drop("label")


def _chunks(spark, sf_dir):
    return table(spark, sf_dir, "chunks", "chunk_id", "page_content").dropDuplicates(["chunk_id"])


def _bm25(spark, sf_dir):
    """The index of all chunks, shared by every search of the session."""
    return once(spark, sf_dir, "chunks", ("bm25",), lambda: bm25.build(_chunks(spark, sf_dir)))


def _chunk_vectors(spark, sf_dir):
    return once(spark, sf_dir, "chunks", ("vectors", "hashed"), lambda: settle(embed(_chunks(spark, sf_dir), "chunk_id", "page_content")))


def _questions(spark, sf_dir):
    g = table(spark, sf_dir, "gold_dataset", "qa_id", "user_input", "reference").filter("qa_id % 100 = 0").dropDuplicates(["qa_id"])
    return g.select(F.col("qa_id").alias("qid"), F.col("user_input").alias("text"), "reference")


def _answers(spark, sf_dir):
    """Stand-in for a model's list of query variants."""
    q = _questions(spark, sf_dir)
    return q.select("qid", F.col("text").alias("question"), F.concat(F.lit("1. "), F.coalesce("reference", F.lit("")), F.lit("\n\n- what about "), "text", F.lit("\n3) "), "text", F.lit(" licence")).alias("answer"))


def _results(spark, sf_dir, *columns):
    return table(spark, sf_dir, "rag_results", "result_id", "variant", "qa_id", *columns)


def _lists(spark, sf_dir):
    """The ranked lists of a question: one for each variant that ran, by name."""
    r = _results(spark, sf_dir, "retrieved_chunk_ids").groupBy("qa_id", "variant").agg(F.min_by("retrieved_chunk_ids", "result_id").alias("ids"))
    return r.select(F.col("qa_id").alias("qid"), F.col("variant").alias("list_id"), F.posexplode("ids").alias("rank0", "chunk_id")).filter("chunk_id is not null")


def _candidates(spark, sf_dir):
    r = _results(spark, sf_dir, "user_input", "retrieved_contexts")
    return r.select(F.col("result_id").alias("qid"), "user_input", F.posexplode("retrieved_contexts").alias("rank0", "content"))


def dense_topk(spark, sf_dir):
    return dense.topk(_vector_queries(spark, sf_dir), _vectors(spark, sf_dir).drop("label"), K)


def dense_topk_cells(spark, sf_dir):
    """Approximate: out of the cells nearest to the query."""
    cells = once(spark, sf_dir, "embeddings", ("cells",), lambda: dense.build_cells(_vectors(spark, sf_dir)))
    return dense.topk_cells(_vector_queries(spark, sf_dir), cells, K)


def dense_topk_all_cells(spark, sf_dir):
    """The same index with all cells probed: exact."""
    cells = once(spark, sf_dir, "embeddings", ("cells",), lambda: dense.build_cells(_vectors(spark, sf_dir)))
    return dense.topk_cells(_vector_queries(spark, sf_dir), cells, K, probes=len(cells.centroids))


def hybrid_vectors(spark, sf_dir):
    """Hybrid search with given vectors: ids of embeddings stand for chunks and questions."""
    q, fetch = _questions(spark, sf_dir), fusion.fetch_size(K)
    near = dense.topk(_vector_queries(spark, sf_dir).join(q.select("qid"), "qid", "left_semi"), _vectors(spark, sf_dir).drop("label"), fetch)
    return fusion.hybrid(near, bm25.search(q, _bm25(spark, sf_dir), fetch), K)


def dense_topk_filtered(spark, sf_dir):
    return dense.topk(_vector_queries(spark, sf_dir, True), _vectors(spark, sf_dir), K, filters=["label"])


def mmr_topk(spark, sf_dir):
    return dense.mmr(_vector_queries(spark, sf_dir), _vectors(spark, sf_dir).drop("label"), K, FETCH)


def mmr_filtered(spark, sf_dir):
    return dense.mmr(_vector_queries(spark, sf_dir, True), _vectors(spark, sf_dir), K, FETCH, filters=["label"])


def bm25_index(spark, sf_dir):
    return bm25.postings(_chunks(spark, sf_dir)).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def bm25_topk(spark, sf_dir):
    return bm25.search(_questions(spark, sf_dir), _bm25(spark, sf_dir), K)


def hybrid_topk(spark, sf_dir):
    q, fetch = _questions(spark, sf_dir), fusion.fetch_size(K)
    near = dense.topk(embed(q, "qid", "text", query=True), _chunk_vectors(spark, sf_dir), fetch)
    return fusion.hybrid(near, bm25.search(q, _bm25(spark, sf_dir), fetch), K)


def rrf_fuse(spark, sf_dir):
    return fusion.rrf(_lists(spark, sf_dir), K, "chunk_id")


def interleave_fuse(spark, sf_dir):
    return fusion.interleave(_lists(spark, sf_dir), K, "chunk_id")


def rerank_cross(spark, sf_dir):
    out = fusion.rerank(_candidates(spark, sf_dir), 5, fusion.overlap_score(F.col("user_input"), F.col("content")))
    return out.select("qid", "rank0", "base_rank", "score")


def rerank_listwise(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    answers = _results(spark, sf_dir).select(F.col("result_id").alias("qid"), F.concat(F.lit("["), F.col("result_id") % 7, F.lit(", 2, 2, 99999999999999999999, "), F.col("result_id") % 3, F.lit("] best first")).alias("answer"))
    return fusion.listwise(c, answers, 5).select("qid", "rank0", "base_rank")


def cascade(spark, sf_dir):
    """MMR candidates out of a larger pool, then reranked by similarity."""
    pool = dense.mmr(_vector_queries(spark, sf_dir), _vectors(spark, sf_dir).drop("label"), 20, POOL)
    return fusion.rerank(pool.withColumnRenamed("score", "similarity"), K, F.col("similarity")).select("qid", "rank0", "base_rank", "chunk_id", "score")


def _expanded(kind):
    def query(spark, sf_dir):
        v = fusion.variants(_answers(spark, sf_dir), kind, 4)
        keyed = v.withColumn("v", F.xxhash64("qid", "list_id"))
        base = bm25.search(keyed.select(F.col("v").alias("qid"), "text"), _bm25(spark, sf_dir), K).withColumnRenamed("qid", "v")
        lists = base.join(keyed.select("v", "qid", "list_id"), "v").select("qid", "list_id", "rank0", "chunk_id")
        if kind in fusion.FUSION:
            return fusion.FUSION[kind](lists, K, "chunk_id").select("qid", "rank0", "chunk_id")
        return lists.select("qid", "rank0", "chunk_id")

    return query


def parse_lines(spark, sf_dir):
    a = _answers(spark, sf_dir)
    return a.select("qid", F.posexplode(T.list_lines(F.col("answer"), 3)).alias("at", "line"))


def self_query(spark, sf_dir):
    """The specification within a model's answer; a malformed one falls back to the question."""
    g = table(spark, sf_dir, "gold_dataset", "qa_id", "user_input").dropDuplicates(["qa_id"])
    answer = F.when(F.col("qa_id") % 3 == 0, F.lit("no object")).when(F.col("qa_id") % 3 == 1, F.lit('Sure: {"query": "fees", "family": "JUDICIAL", "form": null} done')).otherwise('{"query": ')
    spec = T.json_spec(answer, "query string, family string, form string")
    return g.select("qa_id", F.coalesce(spec["query"], F.col("user_input")).alias("query"), spec["family"].alias("family"), spec["form"].alias("form"))


def contexts_joined(spark, sf_dir):
    r = _results(spark, sf_dir, "retrieved_contexts")
    return r.select("result_id", F.array_join(F.coalesce("retrieved_contexts", F.array().cast("array<string>")), "\n\n---\n\n").alias("context"))


def parent_contexts(spark, sf_dir):
    c = table(spark, sf_dir, "chunks", "chunk_id", "parent_text", "page_content").dropDuplicates(["chunk_id"])
    return c.select("chunk_id", T.shown_context(F.col("parent_text"), F.col("page_content")).alias("shown"))


PROMPT = "Answer the question using only the context.\n\nContext:\n{context}\n\nQuestion: {question}\n\nFormat: {{}}"


def prompt_render(spark, sf_dir):
    r = _results(spark, sf_dir, "user_input", "retrieved_contexts")
    context = F.array_join(F.coalesce("retrieved_contexts", F.array().cast("array<string>")), "\n\n---\n\n")
    return r.select("result_id", F.md5(T.fill(PROMPT, context=context, question=F.coalesce("user_input", F.lit("")))).alias("prompt"))


def _prompts(spark, sf_dir):
    r = _results(spark, sf_dir, "user_input", "retrieved_contexts")
    context = F.array_join(F.coalesce("retrieved_contexts", F.array().cast("array<string>")), "\n\n---\n\n")
    return r.select(F.col("result_id").alias("qid"), T.fill(PROMPT, context=context, question=F.coalesce("user_input", F.lit(""))).alias("prompt"))


def generate_answers(spark, sf_dir):
    """An answer to every question from its contexts, by the offline generator."""
    return generation.generate(_prompts(spark, sf_dir))


def bm25_precision_recall(spark, sf_dir):
    """End to end: search all chunks for every hundredth question; a hit is relevant
    if it is one of the question's contexts. Precision at rank, recall and their sum."""
    from ..operators import metrics

    hits = bm25.search(_questions(spark, sf_dir), _bm25(spark, sf_dir), K)
    gold = table(spark, sf_dir, "gold_dataset", "qa_id", "reference_contexts").filter("qa_id % 100 = 0").dropDuplicates(["qa_id"]).select(F.col("qa_id").alias("qid"), F.coalesce("reference_contexts", F.array().cast("array<string>")).alias("gold"))
    judged = hits.join(_chunks(spark, sf_dir), "chunk_id").join(gold, "qid").withColumn("v", F.array_contains("gold", F.col("page_content")).cast("int"))
    precision = metrics.context_precision(judged.select("qid", "rank0", "v"))
    recall = judged.filter("v = 1").groupBy("qid").agg(F.count_distinct("page_content").alias("got"))
    size = F.size(F.array_distinct(F.filter("gold", lambda x: T.strip(x) != "")))
    out = precision.join(gold, "qid").join(recall, "qid", "left").select("qid", "context_precision", F.round(F.coalesce(F.coalesce("got", F.lit(0)) / F.nullif(size, F.lit(0)), F.lit(0.0)), 6).alias("context_recall"))
    return out.withColumn("p_plus_r", F.round(F.col("context_precision") + F.col("context_recall"), 6))


QUERIES = {
    f.__name__: f
    for f in (
        dense_topk, dense_topk_cells, dense_topk_all_cells, hybrid_vectors, dense_topk_filtered, mmr_topk, mmr_filtered, bm25_index, bm25_topk, hybrid_topk, rrf_fuse, interleave_fuse, rerank_cross, rerank_listwise, cascade,
        parse_lines, self_query, contexts_joined, parent_contexts, prompt_render, generate_answers, bm25_precision_recall,
    )
} | {f"expand_{k}": _expanded(k) for k in ("rewrite", "hyde", "stepback", "multiquery", "rag_fusion", "decomposition", "selfquery")}

_CHUNKS = "(SELECT chunk_id, page_content FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id) = 1)"
_QUESTIONS = "(SELECT qa_id AS qid, user_input AS text, reference FROM gold_dataset WHERE qa_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY qa_id) = 1)"
_TERMS = f"regexp_extract_all(lower({{}}), '[^{WS.replace('{', '{{').replace('}', '}}')}]+')"


def search_sql(queries: str, k: int = K) -> str:
    """CTEs of a search: ``ranked(qid, rank0, chunk_id, score)``."""
    return f"""ch AS MATERIALIZED (SELECT chunk_id, page_content, {_TERMS.format("page_content")} AS ts FROM {_CHUNKS}),
      po AS MATERIALIZED (SELECT chunk_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, len(ts) AS dl, unnest(ts) AS term FROM ch) GROUP BY ALL),
      si AS (SELECT count(*) AS n, avg(coalesce(len(ts), 0)) AS avgdl FROM ch),
      ra AS MATERIALIZED (SELECT term, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM po, si GROUP BY term, n),
      fl AS (SELECT avg(raw) * {bm25.EPSILON} AS floor FROM ra),
      q AS MATERIALIZED ({queries}),
      qt AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest({_TERMS.format("text")}) AS term FROM q) GROUP BY ALL),
      sc AS MATERIALIZED (SELECT qid, chunk_id, round(sum(times * CASE WHEN raw < 0 THEN floor ELSE raw END * tf * {bm25.K1 + 1} / (tf + {bm25.K1} * (1 - {bm25.B} + {bm25.B} * dl / avgdl))), 6) AS score
        FROM qt JOIN ra USING (term) JOIN po USING (term), si, fl GROUP BY ALL),
      al AS (SELECT qid, chunk_id, score FROM sc UNION ALL SELECT qid, chunk_id, 0.0 FROM q, (SELECT chunk_id FROM ch ORDER BY chunk_id LIMIT {2 * k}) s WHERE NOT EXISTS (SELECT 1 FROM sc WHERE sc.qid = q.qid AND sc.chunk_id = s.chunk_id)),
      ranked AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) - 1 AS rank0, chunk_id, score FROM al QUALIFY rank0 < {k})"""


_ANSWERS = f"(SELECT qid, text AS question, '1. ' || coalesce(reference, '') || chr(10) || chr(10) || '- what about ' || text || chr(10) || '3) ' || text || ' licence' AS answer FROM {_QUESTIONS})"


def _lines_sql(n: int) -> str:
    bare = f"{strip_sql(f"regexp_replace({strip_sql('x')}, '\\A[{WS}]*(?:[0-9]+[.)]|[-*•])[{WS}]*', '')")}"
    return f"list_filter(list_transform(regexp_split_to_array(answer, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: {bare}), lambda x: x <> '')[1:{n}]"


_TEXTS = {
    "rewrite": f"[{strip_sql('answer')}]",
    "hyde": f"[{strip_sql('answer')}]",
    "stepback": f"[question, {strip_sql('answer')}]",
    "multiquery": f"list_concat([question], {_lines_sql(4)})",
    "rag_fusion": f"list_concat([question], {_lines_sql(4)})",
    "decomposition": f"CASE WHEN len({_lines_sql(4)}) > 0 THEN {_lines_sql(4)} ELSE [question] END",
    "selfquery": "[question]",
}
_RRF = "round(sum(1 / (61 + rank0)), 9) AS score, min({'a': list_id, 'b': rank0}) AS first"


def _expand_sql(kind: str) -> str:
    variants = f"SELECT qid * 1000 + list_id AS qid, qid AS question_id, list_id, text FROM (SELECT qid, unnest(range(0, len(t))) AS list_id, unnest(t) AS text FROM (SELECT qid, {_TEXTS[kind]} AS t FROM {_ANSWERS}))"
    lists = "li AS (SELECT question_id AS qid, list_id, rank0, chunk_id FROM ranked JOIN q USING (qid))"
    if kind == "multiquery":
        tail = f"SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY first, chunk_id) - 1 AS rank0, chunk_id FROM (SELECT qid, chunk_id, min({{'a': rank0, 'b': list_id}}) AS first FROM li GROUP BY ALL) QUALIFY rank0 < {K}"
    elif kind in fusion.FUSION:
        tail = f"SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first, chunk_id) - 1 AS rank0, chunk_id FROM (SELECT qid, chunk_id, {_RRF} FROM li GROUP BY ALL) QUALIFY rank0 < {K}"
    else:
        tail = "SELECT qid, rank0, chunk_id FROM li"
    return f"WITH {search_sql(variants)}, {lists} {tail}"


_LISTS = "(SELECT qa_id AS qid, variant AS list_id, unnest(range(0, len(ids))) AS rank0, unnest(ids) AS chunk_id FROM (SELECT qa_id, variant, arg_min(retrieved_chunk_ids, result_id) AS ids FROM rag_results WHERE retrieved_chunk_ids IS NOT NULL GROUP BY ALL))"
_CANDIDATES = "(SELECT result_id AS qid, user_input, unnest(range(0, len(retrieved_contexts))) AS rank0, unnest(retrieved_contexts) AS content FROM rag_results)"
_NUMBERS = "list_filter(list_transform(regexp_extract_all(answer, '[0-9]+'), lambda x: TRY_CAST(x AS BIGINT)), lambda x: x IS NOT NULL)"
_CONTEXT = "coalesce(array_to_string(retrieved_contexts, chr(10) || chr(10) || '---' || chr(10) || chr(10)), '')"


def _dense_sql(condition: str = "true") -> str:
    return f"""SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) - 1 AS rank0, chunk_id, score FROM
      (SELECT q.vec_id AS qid, x.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], x.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings x WHERE q.vec_id % 100 = 0 AND {condition}) QUALIFY rank0 < {K}"""


def _mmr_sql(condition: str = "true", k: int = K, fetch: int = FETCH) -> str:
    """The pool of each query as lists of relevance and of similarities, chosen from step by step."""
    cosine = "list_cosine_similarity({}::DOUBLE[], {}::DOUBLE[])"
    return f"""WITH RECURSIVE p AS MATERIALIZED (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS pos, chunk_id, score, rel, v FROM
        (SELECT q.vec_id AS qid, x.vec_id AS chunk_id, {cosine.format("q.embedding", "x.embedding")} AS rel, round(rel, 6) AS score, x.embedding AS v FROM embeddings q, embeddings x WHERE q.vec_id % 100 = 0 AND {condition}) QUALIFY pos <= {fetch}),
      m AS MATERIALIZED (SELECT qid, list(chunk_id ORDER BY pos) AS ids, list(score ORDER BY pos) AS scores, list(rel ORDER BY pos) AS rel FROM p GROUP BY qid),
      s AS MATERIALIZED (SELECT qid, list(near ORDER BY pos) AS sim FROM (SELECT a.qid, a.pos, list({cosine.format("a.v", "b.v")} ORDER BY b.pos) AS near FROM p a JOIN p b USING (qid) GROUP BY ALL) GROUP BY qid),
      r AS (SELECT qid, 0 AS step, []::BIGINT[] AS chosen FROM m
        UNION ALL SELECT qid, step + 1, list_append(chosen, list_position(worth, list_max(worth))) FROM
          (SELECT qid, step, chosen, list_transform(range(1, len(rel) + 1), lambda i: CASE WHEN list_contains(chosen, i) THEN -9.0 ELSE round(0.5 * rel[i] - 0.5 * coalesce(list_max(list_transform(chosen, lambda j: sim[i][j])), 0), 9) END) AS worth
           FROM r JOIN m USING (qid) JOIN s USING (qid) WHERE step < least({k}, len(rel))))
      SELECT qid, CAST(unnest(range(0, len(chosen))) AS INTEGER) AS rank0, ids[unnest(chosen)] AS chunk_id, scores[unnest(chosen)] AS score FROM r JOIN m USING (qid) WHERE step = least({k}, len(rel))"""


def _hybrid_sql() -> str:
    fetch = fusion.fetch_size(K)
    return f"""WITH {search_sql('SELECT qid, text FROM ' + _QUESTIONS, fetch)},
      de AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) - 1 AS rank0, chunk_id FROM
        (SELECT q.vec_id AS qid, x.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], x.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings x WHERE q.vec_id IN (SELECT qid FROM q)) QUALIFY rank0 < {fetch}),
      li AS (SELECT qid, 0 AS list_id, rank0, chunk_id FROM de UNION ALL SELECT qid, 1, rank0, chunk_id FROM ranked)
      SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first, chunk_id) - 1 AS rank0, chunk_id, score FROM (SELECT qid, chunk_id, {_RRF} FROM li GROUP BY ALL) QUALIFY rank0 < {K}"""


SQL = {
    "dense_topk": _dense_sql(),
    "dense_topk_all_cells": _dense_sql(),
    "mmr_topk": _mmr_sql(),
    "mmr_filtered": _mmr_sql("x.label = q.label"),
    "cascade": f"SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, base_rank) - 1 AS rank0, base_rank, chunk_id, score FROM (SELECT qid, rank0 AS base_rank, chunk_id, score FROM ({_mmr_sql(k=20, fetch=POOL)})) QUALIFY rank0 < {K}",
    "hybrid_vectors": _hybrid_sql(),
    "dense_topk_filtered": _dense_sql("x.label = q.label"),
    "bm25_index": f"SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS cf FROM (SELECT chunk_id, unnest({_TERMS.format('page_content')}) AS term FROM {_CHUNKS}) GROUP BY term",
    "bm25_topk": f"WITH {search_sql('SELECT qid, text FROM ' + _QUESTIONS)} SELECT * FROM ranked",
    "rrf_fuse": f"SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first, chunk_id) - 1 AS rank0, chunk_id, score FROM (SELECT qid, chunk_id, {_RRF} FROM {_LISTS} WHERE chunk_id IS NOT NULL GROUP BY ALL) QUALIFY rank0 < {K}",
    "interleave_fuse": f"SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY first, chunk_id) - 1 AS rank0, chunk_id FROM (SELECT qid, chunk_id, min({{'a': rank0, 'b': list_id}}) AS first FROM {_LISTS} WHERE chunk_id IS NOT NULL GROUP BY ALL) QUALIFY rank0 < {K}",
    "rerank_cross": f"""SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, base_rank) - 1 AS rank0, base_rank, score FROM (SELECT qid, rank0 AS base_rank,
        coalesce(round(len(list_intersect(list_distinct({_TERMS.format("user_input")}), {_TERMS.format("content")})) / nullif(len(list_distinct({_TERMS.format("user_input")})), 0), 6), 0) AS score FROM {_CANDIDATES}) QUALIFY rank0 < 5""",
    "rerank_listwise": f"""WITH c AS {_CANDIDATES}, a AS (SELECT result_id AS qid, '[' || result_id % 7 || ', 2, 2, 99999999999999999999, ' || result_id % 3 || '] best first' AS answer FROM rag_results),
        n AS (SELECT qid, rank0, min(pos) AS pos FROM (SELECT qid, unnest(range(0, len(l))) AS pos, unnest(l) AS rank0 FROM (SELECT qid, {_NUMBERS} AS l FROM a)) GROUP BY ALL)
        SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY pos NULLS LAST, rank0) - 1 AS rank0, rank0 AS base_rank FROM c LEFT JOIN n USING (qid, rank0) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY pos NULLS LAST, c.rank0) <= 5""",
    "parse_lines": f"SELECT qid, unnest(range(0, len(l))) AS at, unnest(l) AS line FROM (SELECT qid, {_lines_sql(3)} AS l FROM {_ANSWERS})",
    "self_query": "SELECT qa_id, CASE WHEN qa_id % 3 = 1 THEN 'fees' ELSE user_input END AS query, CASE WHEN qa_id % 3 = 1 THEN 'JUDICIAL' END AS family, NULL::VARCHAR AS form FROM gold_dataset QUALIFY row_number() OVER (PARTITION BY qa_id) = 1",
    "contexts_joined": f"SELECT result_id, {_CONTEXT} AS context FROM rag_results",
    "parent_contexts": "SELECT chunk_id, coalesce(nullif(parent_text, ''), page_content) AS shown FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id) = 1",
    "prompt_render": f"SELECT result_id, md5('Answer the question using only the context.' || chr(10) || chr(10) || 'Context:' || chr(10) || {_CONTEXT} || chr(10) || chr(10) || 'Question: ' || coalesce(user_input, '') || chr(10) || chr(10) || 'Format: {{}}') AS prompt FROM rag_results",
    "generate_answers": f"SELECT result_id AS qid, coalesce(nullif({strip_sql(f"split_part({_CONTEXT}, chr(10), 1)")}, ''), 'The context does not say.') AS answer FROM rag_results",
    "bm25_precision_recall": f"""WITH {search_sql('SELECT qid, text FROM ' + _QUESTIONS)},
      g AS (SELECT qa_id AS qid, coalesce(reference_contexts, []) AS gold FROM gold_dataset WHERE qa_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY qa_id) = 1),
      j AS (SELECT qid, rank0, page_content, gold, CAST(list_contains(gold, page_content) AS INTEGER) AS v FROM ranked JOIN ch USING (chunk_id) JOIN g USING (qid)),
      p AS (SELECT qid, v, sum(v) OVER (PARTITION BY qid ORDER BY rank0) / (rank0 + 1) AS pk FROM j),
      m AS (SELECT qid, round(coalesce(sum(pk * v) / nullif(sum(v), 0), 0), 6) AS context_precision FROM p GROUP BY qid),
      r AS (SELECT qid, round(coalesce(count(DISTINCT CASE WHEN v = 1 THEN page_content END) / nullif(len(list_distinct(list_filter(any_value(gold), lambda x: {strip_sql('x')} <> ''))), 0), 0), 6) AS context_recall FROM j GROUP BY qid)
      SELECT qid, context_precision, context_recall, round(context_precision + context_recall, 6) AS p_plus_r FROM m JOIN r USING (qid)""",
} | {f"expand_{k}": _expand_sql(k) for k in _TEXTS}
SQL["prompt_render"] = SQL["prompt_render"].replace("{{}}", "{}")
