"""Fusion, transformation and reranking of ranked lists.

A ranked list is a set of rows ``(qid, list_id, rank0, content, ...)``; all
queries and lists are fused at once.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .bm25 import terms

RRF_C = 60
# Metadata that a self-query restricts.
SPEC_FILTERS = ("family", "form")


def rrf(lists: DataFrame, k: int, content: str = "content", c: int = RRF_C, digits: int = 9) -> DataFrame:
    """``(qid, rank0, content, score)``: sum of ``1 / (c + rank0 + 1)`` by content; a
    repetition within one list counts again; ties go to what was seen first."""
    fused = lists.groupBy("qid", content).agg(F.round(F.sum(1 / (c + F.col("rank0") + 1)), digits).alias("score"), F.min(F.struct("list_id", "rank0")).alias("first"))
    w = W.partitionBy("qid").orderBy(F.desc("score"), "first", content)
    return fused.withColumn("rank0", F.row_number().over(w) - 1).filter(F.col("rank0") < k).select("qid", "rank0", content, "score")


def interleave(lists: DataFrame, k: int, content: str = "content") -> DataFrame:
    """``(qid, rank0, content)``: round robin by rank, then list; each content once."""
    first = lists.groupBy("qid", content).agg(F.min(F.struct("rank0", "list_id")).alias("first"))
    w = W.partitionBy("qid").orderBy("first", content)
    return first.withColumn("rank0", F.row_number().over(w) - 1).filter(F.col("rank0") < k).select("qid", "rank0", content)


def fetch_size(k: int) -> int:
    """How many hits each side of a hybrid search fetches."""
    return max(4 * k, 20)


def hybrid(dense: DataFrame, sparse: DataFrame, k: int, content: str = "chunk_id") -> DataFrame:
    """Fusion of two ranked lists, each of ``fetch_size(k)`` hits; the dense one comes first in ties."""
    both = dense.select("qid", F.lit(0).alias("list_id"), "rank0", content).unionByName(sparse.select("qid", F.lit(1).alias("list_id"), "rank0", content))
    return rrf(both, k, content)


def overlap_score(query: Column, passage: Column) -> Column:
    """Share of the query's distinct words that the passage has; 0 for a query without words."""
    q = F.array_distinct(terms(query))
    return F.coalesce(F.round(F.size(F.array_intersect(q, terms(passage))) / F.nullif(F.size(q), F.lit(0)), 6), F.lit(0.0))


def rerank(candidates: DataFrame, k: int, score: Column) -> DataFrame:
    """Candidates ``(qid, rank0, ...)`` ordered by a score, ties by their rank; the first ``k``."""
    scored = candidates.withColumnRenamed("rank0", "base_rank").withColumn("score", score)
    w = W.partitionBy("qid").orderBy(F.desc("score"), "base_rank")
    return scored.withColumn("rank0", F.row_number().over(w) - 1).filter(F.col("rank0") < k)


#: Pair scorers by name: a question and a passage to a score, as expressions.
SCORERS: dict[str, Callable[[Column, Column], Column]] = {"overlap": overlap_score}


def cross_encoder(score: Callable[[list[str], list[str]], list[float]]) -> Callable[[Column, Column], Column]:
    """A pair scorer as an Arrow-batched expression; the scorer's model is made in its worker."""

    @F.pandas_udf("double")
    def scored(q: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series(score(q.fillna("").tolist(), p.fillna("").tolist()))

    return scored


def listwise(candidates: DataFrame, answers: DataFrame, k: int) -> DataFrame:
    """Order by a model's answer ``(qid, answer)``: the indices it names, each once
    and within range, then the rest in base order."""
    size = candidates.groupBy("qid").agg(F.count(F.lit(1)).alias("size"))
    named = answers.select("qid", F.posexplode(T.numbers(F.col("answer"))).alias("at", "rank0"))
    named = named.join(size, "qid").filter("rank0 < size").groupBy("qid", F.col("rank0").cast("int").alias("rank0")).agg(F.min("at").alias("at"))
    both = candidates.join(named, ["qid", "rank0"], "left").withColumnRenamed("rank0", "base_rank")
    w = W.partitionBy("qid").orderBy(F.asc_nulls_last("at"), "base_rank")
    return both.withColumn("rank0", F.row_number().over(w) - 1).filter(F.col("rank0") < k).drop("at")


def variants(answers: DataFrame, kind: str, n: int = 4) -> DataFrame:
    """``(qid, list_id, text)``: the texts that a query transformation retrieves with.

    ``answers``: ``(qid, question, answer)``. rewrite, hyde: the answer alone;
    stepback: question and answer; multiquery, rag_fusion: question and the
    answer's first ``n`` lines; decomposition: the lines alone, the question
    where there are none; selfquery: the query of the answer's JSON object, the
    question where that is missing or malformed, with the object's ``family``
    and ``form`` as further columns, null where they restrict nothing.
    """
    question, answer = F.col("question"), F.coalesce("answer", F.lit(""))
    lines = T.list_lines(answer, n)
    spec = T.json_spec(answer, "query string, family string, form string")
    texts = {
        "rewrite": F.array(T.strip(answer)),
        "hyde": F.array(T.strip(answer)),
        "stepback": F.array(question, T.strip(answer)),
        "multiquery": F.concat(F.array(question), lines),
        "rag_fusion": F.concat(F.array(question), lines),
        "decomposition": F.when(F.size(lines) > 0, lines).otherwise(F.array(question)),
        "selfquery": F.array(F.coalesce(F.nullif(spec["query"], F.lit("")), question)),
    }
    if kind not in texts:
        raise NotImplementedError(f"query transformation {kind!r}")
    restricted = [F.nullif(spec[f], F.lit("")).alias(f) for f in SPEC_FILTERS] if kind == "selfquery" else []
    return answers.select("qid", F.posexplode(texts[kind]).alias("list_id", "text"), *restricted)


FUSION = {"stepback": rrf, "rag_fusion": rrf, "decomposition": rrf, "multiquery": interleave}
