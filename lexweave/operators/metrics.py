"""Answer and retrieval metrics: arithmetic over verdict tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NAMES = ["context_precision", "context_recall", "context_entity_recall", "faithfulness", "answer_relevancy", "noise_sensitivity"]


def context_precision(verdicts: DataFrame) -> DataFrame:
    """``(qid, rank0, v)`` to the mean of precision at the ranks of relevant hits; 0 without any."""
    w = W.partitionBy("qid").orderBy("rank0").rowsBetween(W.unboundedPreceding, 0)
    at = verdicts.withColumn("p", F.sum("v").over(w) / (F.col("rank0") + 1))
    return at.groupBy("qid").agg(F.round(F.coalesce(F.sum(F.col("p") * F.col("v")) / F.nullif(F.sum("v"), F.lit(0)), F.lit(0.0)), 6).alias("context_precision"))


def share(verdicts: DataFrame, name: str) -> DataFrame:
    """Mean verdict of each question: recall of claims, faithfulness; null without a claim."""
    return verdicts.groupBy("qid").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias(name))


def entity_recall(reference: Column, context: Column) -> Column:
    """Share of the reference's distinct entities that the context has; null without any."""
    return F.round(F.size(F.array_intersect(reference, context)) / F.nullif(F.size(F.array_distinct(reference)), F.lit(0)), 6)


def noise_sensitivity(claims: DataFrame) -> DataFrame:
    """``(qid, correct, attributable)`` to the share of claims that are wrong and come from the context; lower is better."""
    bad = (~F.col("correct") & F.col("attributable")).cast("double")
    return claims.groupBy("qid").agg(F.round(F.avg(bad), 6).alias("noise_sensitivity"))


def answer_relevancy(pairs: DataFrame) -> DataFrame:
    """``(qid, q, v, evasive)``, vectors of the question and of one made from the answer: mean cosine, 0 if evasive."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    cosine = dot("q", "v") / F.sqrt(dot("q", "q") * dot("v", "v"))
    return pairs.groupBy("qid").agg(F.round(F.avg(cosine) * F.min(F.when(F.col("evasive"), 0.0).otherwise(1.0)), 6).alias("answer_relevancy"))


def factual_correctness(claims: DataFrame) -> DataFrame:
    """``(qid, side, v)`` to the F1 of claims: those of the response (side 0) that the
    reference has are hits, the others false; those of the reference (side 1) that
    the response lacks are missed. 0 without a hit; a question without claims has no row."""
    count = lambda c: F.count_if(c)
    hit, false, missed = count((F.col("side") == 0) & F.col("v")), count((F.col("side") == 0) & ~F.col("v")), count((F.col("side") == 1) & ~F.col("v"))
    return claims.groupBy("qid").agg(F.round(F.coalesce(2 * hit / F.nullif(2 * hit + false + missed, F.lit(0)), F.lit(0.0)), 6).alias("factual_correctness"))


def word_counts_cosine(a: Column, b: Column) -> Column:
    """Cosine of the word counts of two lists of words; 0 where one is empty. The stand-in for an embedder's similarity."""
    times = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    dot = F.aggregate(F.array_intersect(a, b), F.lit(0.0), lambda s, w: s + times(a, w) * times(b, w))
    square = lambda x: F.aggregate(F.array_distinct(x), F.lit(0.0), lambda s, w: s + times(x, w) * times(x, w))
    return F.coalesce(dot / F.nullif(F.sqrt(square(a) * square(b)), F.lit(0.0)), F.lit(0.0))


def mean_skipping_nan(c: str) -> Column:
    return F.avg(F.nanvl(F.col(c), F.lit(None).cast("double")))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``old`` whose key ``new`` doesn't have, and all of ``new``; missing columns are null."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)
