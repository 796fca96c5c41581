"""Dense retrieval, exact and by cells, and maximal marginal relevance.

Index and queries are packed into numpy blocks; every pair of an index block
and a query block is one matrix product whose top k leave the task. Block
counts follow the data, so neither side is ever broadcast whole or collected.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settle

INDEX_BLOCK, QUERY_BLOCK = 8192, 1024


def _packed(df: DataFrame, key: str, vector: str, rows: int, prefix: str, filters: list[str] = ()) -> DataFrame:
    """One row for each block of about ``rows`` vectors: ids and a float64 matrix."""
    blocks = max(1, -(-df.count() // rows))

    def pack(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by("k")
        m = np.array(t.column("v").to_pylist(), np.float64)
        norm = np.sqrt((m * m).sum(1, keepdims=True))
        m = m / np.where(norm == 0, 1, norm)
        return pa.table({f"{prefix}_ids": [t.column("k").to_pylist()], f"{prefix}_m": pa.array([m.tobytes()], pa.binary()), f"{prefix}_dim": pa.array([m.shape[1]], pa.int32()), **{f"{prefix}_{f}": [t.column(f).to_pylist()] for f in filters}})

    named = df.filter(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("k"), F.col(vector).cast("array<double>").alias("v"), *filters)
    ddl = f"{prefix}_ids array<bigint>, {prefix}_m binary, {prefix}_dim int" + "".join(f", {prefix}_{f} array<string>" for f in filters)
    return named.withColumn("b", F.pmod(F.xxhash64("k"), F.lit(blocks))).groupBy("b").applyInArrow(lambda t: pack(t.drop_columns(["b"])), ddl)


def _best(s: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` greatest of every row, ties by place: those that reach the k-th value, then sorted."""
    if s.shape[1] <= k:
        return np.argsort(-s, axis=1, kind="stable")
    least = np.partition(s, -k, axis=1)[:, -k]
    out = np.empty((len(s), k), np.int64)
    for i, row in enumerate(s):
        some = np.flatnonzero(row >= least[i])
        out[i] = some[np.argsort(-row[some], kind="stable")][:k]
    return out


def topk(queries: DataFrame, index: DataFrame, k: int, query_key: str = "qid", key: str = "chunk_id", vector: str = "embedding", filters: list[str] = (), digits: int = 6) -> DataFrame:
    """``(qid, rank0, chunk_id, score)``: the k most similar of every query by
    cosine, rounded; ties by id. A zero vector has similarity 0 with all.

    ``filters``: columns that a hit must share with the query where the query's isn't null.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):  # a block at a time
                q = np.frombuffer(r["q_m"], np.float64).reshape(-1, r["q_dim"])
                x = np.frombuffer(r["x_m"], np.float64).reshape(-1, r["x_dim"])
                s = np.round(q @ x.T, digits) + 0.0
                for f in filters:
                    have, want = np.array([v or "" for v in r[f"x_{f}"]]), r[f"q_{f}"]
                    for i, v in enumerate(want):
                        if v is not None:
                            s[i, have != v] = -np.inf
                ids = np.array(r["x_ids"])  # rising
                order = _best(s, k)
                qid = np.repeat(np.array(r["q_ids"]), order.shape[1])
                score = np.take_along_axis(s, order, 1).ravel()
                keep = np.isfinite(score)
                yield pa.RecordBatch.from_arrays([pa.array(qid[keep]), pa.array(ids[order].ravel()[keep]), pa.array(score[keep])], names=["qid", "chunk_id", "score"])

    q, x = _packed(queries, query_key, vector, QUERY_BLOCK, "q", filters), _packed(index, key, vector, INDEX_BLOCK, "x", filters)
    found = q.crossJoin(x).mapInArrow(run, "qid bigint, chunk_id bigint, score double")  # blocks, not rows
    w = W.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank0", F.row_number().over(w) - 1).filter(F.col("rank0") < k).select("qid", "rank0", "chunk_id", "score")


#: Vectors on which the cells of an approximate index are fitted (least hash of the id).
FIT_VECTORS = 20_000


@dataclass(frozen=True)
class Cells:
    """An approximate index: vectors in blocks by their nearest of some centroids."""

    blocks: DataFrame
    centroids: np.ndarray


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(norm == 0, 1, norm)


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from evenly spaced rows of the sample; a cell left empty keeps its centroid."""
    x = _unit(sample)
    c = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)] if len(x) else x
    for _ in range(rounds if len(x) else 0):
        at = np.argmax(x @ c.T, 1)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        has = np.bincount(at, minlength=len(c)) > 0
        c = np.where(has[:, None], _unit(total), c)
    return c


def _vectors_of(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def build_cells(index: DataFrame, cells: int | None = None, key: str = "chunk_id", vector: str = "embedding") -> Cells:
    """The approximate index of all vectors, a written table.

    Centroids (the square root of the rows, at most 4,096) are fitted on
    ``FIT_VECTORS`` vectors; every vector is put into a cell. A cell of any size
    becomes blocks of about ``INDEX_BLOCK``.
    """
    rows = index.filter(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("k"), F.col(vector).cast("array<double>").alias("v"))
    n = rows.count()
    cells = cells or min(4096, max(1, isqrt(n)))
    sample = rows.orderBy(F.xxhash64("k"), "k").limit(FIT_VECTORS).select("v").toArrow().column(0).combine_chunks()
    c = fit_centroids(_vectors_of(sample) if n else np.zeros((0, 1)), cells)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.argmax(_unit(_vectors_of(b.column(1))) @ c.T, 1) if b.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at.astype(np.int32))], names=["k", "v", "cell"])

    placed = rows.mapInArrow(assign, "k bigint, v array<double>, cell int")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / INDEX_BLOCK).alias("parts"))  # one row for each cell
    spread = placed.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("k"), "parts"))

    def pack(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by("k")
        return pa.table({"cell": t.column("cell")[:1], "ids": pa.array([t.column("k").to_numpy().tobytes()], pa.binary()), "m": pa.array([_unit(_vectors_of(t.column("v").combine_chunks())).tobytes()], pa.binary())})

    return Cells(settle(spread.groupBy("cell", "part").applyInArrow(pack, "cell int, ids binary, m binary")), c)


def topk_cells(queries: DataFrame, index: Cells, k: int, probes: int | None = None, query_key: str = "qid", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """``(qid, rank0, chunk_id, score)`` out of the ``probes`` cells nearest to each query (a quarter of them unless given).

    Queries meet the blocks of their cells in an equi-join; only a block's k best
    leave its task. With as many probes as cells it is the exact search.
    """
    c = index.centroids
    probes = min(len(c), probes or max(1, -(-len(c) // 4)))

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q = _unit(_vectors_of(b.column(1)))
                cells = np.argpartition(-(q @ c.T), probes - 1, axis=1)[:, :probes] if probes < len(c) else np.tile(np.arange(len(c)), (len(q), 1))
                at = np.repeat(np.arange(len(q)), cells.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel().astype(np.int32)), b.column(0).take(pa.array(at)), pa.array([q[i].tobytes() for i in at], pa.binary())], names=["cell", "qid", "q"])

    rows = queries.filter(F.col(vector).isNotNull()).select(F.col(query_key).cast("bigint").alias("qid"), F.col(vector).cast("array<double>").alias("v"))
    asked = rows.mapInArrow(near, "cell int, qid bigint, q binary")
    asked = asked.groupBy("cell", F.pmod(F.xxhash64("qid"), F.lit(max(1, -(-queries.count() // QUERY_BLOCK)))).alias("part")).agg(F.collect_list(F.struct("qid", "q")).alias("qs"))  # about QUERY_BLOCK of them

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):  # a block at a time
                ids = np.frombuffer(r["ids"], np.int64)
                m = np.frombuffer(r["m"], np.float64).reshape(len(ids), -1)
                s = np.round(np.stack([np.frombuffer(q["q"], np.float64) for q in r["qs"]]) @ m.T, digits) + 0.0
                order = _best(s, k)  # ids rise
                qid = np.repeat(np.array([q["qid"] for q in r["qs"]]), order.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(ids[order].ravel()), pa.array(np.take_along_axis(s, order, 1).ravel())], names=["qid", "chunk_id", "score"])

    found = index.blocks.join(asked, "cell").select("ids", "m", "qs").mapInArrow(run, "qid bigint, chunk_id bigint, score double")
    w = W.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank0", F.row_number().over(w) - 1).filter(F.col("rank0") < k).select("qid", "rank0", "chunk_id", "score")


def mmr_order(query: np.ndarray, vectors: np.ndarray, k: int, weight: float = 0.5) -> list[int]:
    """Greedy choice by ``weight * similarity to the query - (1 - weight) * greatest similarity to a chosen one``.

    Values are rounded, ties go to the more similar: where the query itself was
    chosen all others are worth the same."""
    relevance = vectors @ query
    chosen: list[int] = []
    nearest = np.full(len(vectors), -np.inf)
    while len(chosen) < min(k, len(vectors)):
        value = np.round(weight * relevance - (1 - weight) * (nearest if chosen else 0.0), 9)
        value[chosen] = -np.inf
        best = int(np.argmax(value))
        chosen.append(best)
        nearest = np.maximum(nearest, vectors @ vectors[best])
    return chosen


def mmr(queries: DataFrame, index: DataFrame, k: int, fetch_k: int, query_key: str = "qid", key: str = "chunk_id", vector: str = "embedding", weight: float = 0.5, filters: list[str] = ()) -> DataFrame:
    """``(qid, rank0, chunk_id, score)``: ``k`` diverse hits of the ``fetch_k`` most similar; rank is the order of choice."""
    pool = topk(queries, index, fetch_k, query_key, key, vector, filters)
    with_vectors = pool.join(index.select(F.col(key).alias("chunk_id"), F.col(vector).alias("v")), "chunk_id").join(queries.select(F.col(query_key).alias("qid"), F.col(vector).alias("q")), "qid")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank0").reset_index(drop=True)
        v, q = np.stack(pdf["v"]).astype(float), np.asarray(pdf["q"].iloc[0], float)
        norm = np.sqrt((v * v).sum(1, keepdims=True))
        order = mmr_order(q / (np.sqrt(q @ q) or 1), v / np.where(norm == 0, 1, norm), k, weight)
        return pd.DataFrame({"qid": pdf["qid"].iloc[order].values, "rank0": np.arange(len(order)), "chunk_id": pdf["chunk_id"].iloc[order].values, "score": pdf["score"].iloc[order].values})

    return with_vectors.groupBy("qid").applyInPandas(choose, "qid bigint, rank0 int, chunk_id bigint, score double")
