"""Filling fixed-capacity containers with documents (problem 7).

Vector best-fit: a container has three residual capacities -- tokens, number of
documents, and attention cost (sum of squared piece lengths) -- and an item
demands some of each. Items come in falling length; among the open containers
that can take an item under *every* constraint the one with the smallest
weighted residual norm after placing it is chosen (``rule="norm"``), or the one
whose residual has the largest weighted dot product with the demand
(``rule="dot"``). A document is split only if it alone exceeds a container.

Items are spread over packing shards by a hash of their id; a shard is packed
by one task, so the waste is at most the last few open containers of a shard.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from math import inf, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle, table
from .bpe import count_tokens

#: Items of one shard on average; memory and time of a packing task follow it.
SHARD_ITEMS = 20_000
#: Weights of tokens, documents and attention cost in the choice of a container.
WEIGHTS = (1.0, 0.05, 0.05)


def vector_best_fit(lengths: np.ndarray, capacity: int, max_docs: int, max_cost: float, rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS) -> np.ndarray:
    """Container number of each item; ``lengths`` are all within every capacity.

    Open containers are indexed by their token residual: the search begins at the
    first that has room (norm) or at the emptiest (dot) and ends where the token
    term alone rules the others out. Ties go to the container opened first;
    containers that can take nothing any more leave the index.
    """
    out = np.empty(len(lengths), np.int64)
    wt, wd, wc = (np.asarray(weights) / np.array([capacity, max_docs, max_cost], float) ** 2).tolist()
    docs: list[float] = []
    cost: list[float] = []
    residual: list[tuple[float, int]] = []  # (tokens, container), rising
    least = float(lengths.min()) if len(lengths) else 0.0
    for i in np.argsort(-lengths, kind="stable").tolist():
        x = float(lengths[i])
        first = bisect_left(residual, (x, -1))
        best, at = (inf, -1), -1
        if rule == "norm":
            for j in range(first, len(residual)):
                t, k = residual[j]
                value = wt * (t - x) ** 2
                if value > best[0]:
                    break
                if docs[k] >= 1 and cost[k] >= x * x:
                    best, at = min((best, at), ((value + wd * (docs[k] - 1) ** 2 + wc * (cost[k] - x * x) ** 2, k), j))
        else:
            rest = wd * max_docs + wc * max_cost * x * x
            for j in range(len(residual) - 1, first - 1, -1):
                t, k = residual[j]
                if -(wt * t * x + rest) > best[0]:
                    break
                if docs[k] >= 1 and cost[k] >= x * x:
                    best, at = min((best, at), ((-(wt * t * x + wd * docs[k] + wc * cost[k] * x * x), k), j))
        if at < 0:
            t, k = float(capacity), len(docs)
            docs.append(max_docs)
            cost.append(max_cost)
        else:
            t, k = residual.pop(at)
        docs[k] -= 1
        cost[k] -= x * x
        out[i] = k
        if t - x >= least and docs[k] >= 1 and cost[k] >= least * least:
            insort(residual, (t - x, k))
    return out


def place_empty(bins: np.ndarray, items: int, max_docs: int) -> np.ndarray:
    """Containers of ``items`` items without tokens: those opened first that may hold more documents, then new ones."""
    room = max_docs - np.bincount(bins) if len(bins) else np.zeros(0, np.int64)
    have = np.repeat(np.arange(len(room)), np.minimum(room, items))[:items]
    return np.append(have, len(room) + np.arange(items - len(have)) // max_docs)


def pack(items: DataFrame, capacity: int, max_docs: int | None = None, max_cost: float | None = None, key: str = "doc_id", size: str = "n_tokens", rule: str = "norm", shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``(shard, bin, doc_id, piece, n_pieces, start, end)`` of items ``(key, size)``.

    ``start``/``end`` are token offsets within the document. An item larger than
    the container (in tokens, or in attention cost) is cut into full pieces and
    a rest; all others stay whole. Items of null or no size are one empty piece
    in a container that may hold another document. Ids must be distinct.
    ``max_docs`` is the capacity unless given, ``max_cost`` its square. Every
    shard is a task of its own, however few bytes it has: its cost is packing.
    """
    max_docs = max_docs or capacity
    max_cost = float(max_cost or capacity**2)
    largest = min(capacity, isqrt(int(max_cost)))
    items = items.select(F.col(key).cast("bigint").alias("doc_id"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("n"))
    shards = max(1, -(-items.count() // shard_items))

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("doc_id")
        ids, n = group.column("doc_id").to_numpy(), group.column("n").to_numpy()
        parts = np.maximum(1, -(-n // largest))
        at = np.repeat(np.arange(len(ids)), parts)
        piece = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = piece * largest
        end = np.minimum(start + largest, n[at])
        bins, some = np.empty(len(at), np.int64), end > start
        bins[some] = vector_best_fit((end - start)[some].astype(np.float64), capacity, max_docs, max_cost, rule)
        bins[~some] = place_empty(bins[some], int((~some).sum()), max_docs)
        shard = group.column("shard")[0].as_py() if len(ids) else 0
        return pa.table({"shard": pa.array(np.full(len(at), shard, np.int64)), "bin": bins, "doc_id": ids[at], "piece": piece.astype(np.int32), "n_pieces": parts[at].astype(np.int32), "start": start, "end": end})

    sharded = items.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards))).repartition(2 * shards, "shard")
    return sharded.groupBy("shard").applyInArrow(run, "shard bigint, bin bigint, doc_id bigint, piece int, n_pieces int, start bigint, end bigint")


def _sizes(spark: SparkSession, sf_dir: str, tokenizer: str) -> DataFrame:
    """Tokens of every document, kept for all packs that use the tokenizer."""
    return settle(count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer=tokenizer))


def _targets(spark: SparkSession, sf_dir: str) -> Iterator[tuple[int, int, str]]:
    # a fixed table of a few rows
    for r in table(spark, sf_dir, "pack_targets").orderBy("pack_id").collect():
        yield r["pack_id"], r["capacity_tokens"], r["tokenizer"]


def p7_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes: dict[str, DataFrame] = {}
    out = None
    for pack_id, capacity, tokenizer in _targets(spark, sf_dir):
        if tokenizer not in sizes:
            sizes[tokenizer] = _sizes(spark, sf_dir, tokenizer)
        one = pack(sizes[tokenizer], capacity).select(F.lit(pack_id).alias("pack_id"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and share of room used of each pack."""
    bins = p7_bins(spark, sf_dir).groupBy("pack_id", "shard", "bin").agg(F.sum(F.col("end") - F.col("start")).alias("tokens"), F.count(F.lit(1)).alias("pieces"))
    capacity = table(spark, sf_dir, "pack_targets", "pack_id", "capacity_tokens")
    report = bins.join(capacity, "pack_id").groupBy("pack_id", "capacity_tokens")
    return report.agg(F.count(F.lit(1)).alias("bins"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.round(F.sum("tokens") / (F.count(F.lit(1)) * F.first("capacity_tokens")), 4).alias("filled"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the packing with the largest containers had to split."""
    pack_id, capacity, tokenizer = max(_targets(spark, sf_dir), key=lambda t: t[1])
    return pack(_sizes(spark, sf_dir, tokenizer), capacity).filter("piece > 0").select("doc_id").distinct()
