"""Winners, carry-over of their configuration, and reports over metric tables."""

from __future__ import annotations

import copy

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def p_plus_r() -> Column:
    return F.col("context_precision") + F.col("context_recall")


def ranked(candidates: DataFrame, stage: str = "stage") -> DataFrame:
    """Candidates of each stage by precision plus recall; ties go to the one declared first (``declared``)."""
    w = W.partitionBy(stage).orderBy(F.desc(F.round(p_plus_r(), 9)), "declared")
    return candidates.withColumn("p_plus_r", F.round(p_plus_r(), 9)).withColumn("place", F.row_number().over(w))


def best(candidates: DataFrame, stage: str = "stage") -> DataFrame:
    return ranked(candidates, stage).filter("place = 1").drop("place")


def best_strategy(candidates: DataFrame) -> DataFrame:
    """``(strategy, top_k, mean_score)``: strategies by the mean over their runs with
    k of 5 and 10; the winner's configuration is that of k = 10 where it has one."""
    runs = candidates.filter(F.col("top_k").isin(5, 10)).withColumn("s", p_plus_r())
    means = runs.groupBy("strategy").agg(F.round(F.avg("s"), 9).alias("mean_score"), F.max("top_k").alias("top_k"), F.min("declared").alias("declared"))
    return means.withColumn("place", F.row_number().over(W.orderBy(F.desc("mean_score"), "declared"))).filter("place = 1").select("strategy", "top_k", "mean_score")  # one row for each strategy


def progression(steps: DataFrame) -> DataFrame:
    """``(step, label, p_plus_r)`` with the gain over the step before, 0 at the first."""
    before = F.lag("p_plus_r").over(W.orderBy("step"))  # a handful of decision steps
    return steps.withColumn("gain", F.round(F.coalesce(F.col("p_plus_r") - before, F.lit(0.0)), 4))


def by_decision(steps: DataFrame, metrics: list[str]) -> DataFrame:
    """Metrics of each decision in long form, with the change from the decision before."""
    long = steps.unpivot(["step", "label"], metrics, "metric", "value")
    return long.withColumn("change", F.round(F.coalesce(F.col("value") - F.lag("value").over(W.partitionBy("metric").orderBy("step")), F.lit(0.0)), 4))


def resolve(params: dict, embedding: str, chunking: dict | None = None, retrieval: dict | None = None) -> dict:
    """A copy of ``params`` in which what is absent or empty is filled with the winners; what is given stays."""
    out = copy.deepcopy(params)
    if not (out.get("embedding") or {}).get("model"):
        out["embedding"] = {**(out.get("embedding") or {}), "model": embedding}
    for k, winner in (("chunking", chunking), ("retrieval", retrieval)):
        if winner and not out.get(k):
            out[k] = copy.deepcopy(winner)
    return out
