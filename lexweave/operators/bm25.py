"""BM25 (Okapi): postings in blocks, built once; all queries at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import settle

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Chunks of a block of the index, and queries that meet it at a time.
BLOCK, QUERIES = 8192, 1024


def terms(c: Column) -> Column:
    """Lower-case words by white space, with repetitions."""
    return T.words(F.lower(c))


def postings(chunks: DataFrame, key: str = "chunk_id", text: str = "page_content") -> DataFrame:
    """``(chunk_id, term, tf, dl)``; a chunk without words has no posting."""
    words = chunks.select(F.col(key).alias("chunk_id"), terms(F.col(text)).alias("ts")).withColumn("dl", F.size("ts"))
    return words.select("chunk_id", "dl", F.explode("ts").alias("term")).groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


@dataclass(frozen=True)
class Index:
    """Postings in blocks of chunks, ``(term, idf)``, and the mean length.

    A block holds up to ``BLOCK`` chunks by rising id: its terms, where the
    postings of each begin, and of each posting the chunk's place, the term's
    count and the chunk's length. Blocks and terms are written tables, built in
    one pass over the chunks that shuffles the terms of blocks only.
    """

    blocks: DataFrame
    idf: DataFrame
    avgdl: float


def build(chunks: DataFrame, key: str = "chunk_id", text: str = "page_content") -> Index:
    """The index of all chunks; null and empty ones count as chunks without words."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = pa.Table.from_batches([batch.slice(i, BLOCK)]).sort_by("chunk_id").combine_chunks()
                words = part.column("ts").combine_chunks()
                dl = np.diff(words.offsets.to_numpy())
                coded = words.flatten().dictionary_encode()
                codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                both, tf = np.unique(codes * len(dl) + np.repeat(np.arange(len(dl)), dl), return_counts=True)
                starts = np.searchsorted(both, np.arange(len(coded.dictionary) + 1) * len(dl))
                at = both % max(1, len(dl))
                raw = [part.column("chunk_id").to_numpy().astype(np.int64), starts.astype(np.int32), at.astype(np.int32), tf.astype(np.int32), dl.astype(np.int32)]
                terms_ = pa.array([coded.dictionary.to_pylist()], pa.list_(pa.string()))
                df_ = pa.array([np.diff(starts)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(pa.array([x.tobytes()], pa.binary()) for x in raw), terms_, df_, pa.array([len(dl)], pa.int64()), pa.array([int(dl.sum())], pa.int64())], names=["ids", "starts", "at", "tf", "dl", "terms", "df", "n", "words"])

    words = chunks.select(F.col(key).cast("bigint").alias("chunk_id"), F.coalesce(terms(F.col(text)), F.array().cast("array<string>")).alias("ts"))
    blocks = settle(words.mapInArrow(pack, "ids binary, starts binary, at binary, tf binary, dl binary, terms array<string>, df array<bigint>, n bigint, words bigint"))
    total = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    counts = blocks.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy("t.terms").agg(F.sum("t.df").alias("df"))
    raw = settle(counts.select(F.col("terms").alias("term"), F.log((F.lit(total["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("raw")))
    floor = raw.agg(F.avg("raw")).first()[0] or 0.0
    return Index(blocks, raw.select("term", F.when(F.col("raw") < 0, floor * EPSILON).otherwise(F.col("raw")).alias("idf")), total["words"] / total["n"] if total["n"] else 1.0)


def search(queries: DataFrame, index: Index | DataFrame, k: int, query_key: str = "qid", query_text: str = "text", key: str = "chunk_id", text: str = "page_content", digits: int = 6) -> DataFrame:
    """``(qid, rank0, chunk_id, score)``: always ``k`` hits where there are as many
    chunks, those of score 0 by id among the rest. Scores are rounded; ties by id.

    ``index``: a built one, or the chunks. Queries meet the index block by block;
    only the k best of a block leave its task. A null query matches nothing.
    """
    built = index if isinstance(index, Index) else build(index, key, text)
    asked = queries.select(F.col(query_key).alias("qid"), F.explode_outer(terms(F.col(query_text))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))
    weighed = asked.join(built.idf, "term", "left").groupBy("qid").agg(F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("term", (F.col("times") * F.col("idf")).alias("w")))).alias("terms"))  # the words of one query
    packs = weighed.groupBy(F.pmod(F.xxhash64("qid"), F.lit(max(1, -(-queries.count() // QUERIES)))).alias("p")).agg(F.collect_list(F.struct("qid", "terms")).alias("queries"))  # about QUERIES of them

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):  # a block at a time
                ids, starts, at, tf, dl = (np.frombuffer(r[c], t) for c, t in (("ids", np.int64), ("starts", np.int32), ("at", np.int32), ("tf", np.int32), ("dl", np.int32)))
                gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[at] / built_avgdl))
                place = {t: i for i, t in enumerate(r["terms"])}
                qids, hits, scores = [], [], []
                for q in r["queries"]:
                    s = np.zeros(len(ids))
                    for x in q["terms"]:
                        if (i := place.get(x["term"])) is not None:
                            a, b = starts[i], starts[i + 1]
                            s[at[a:b]] += x["w"] * gain[a:b]
                    s = np.round(s, digits) + 0.0
                    some = np.flatnonzero(s >= np.partition(s, -k)[-k]) if len(s) > k else np.arange(len(s))
                    some = some[np.argsort(-s[some], kind="stable")][:k]
                    qids.append(np.full(len(some), q["qid"])), hits.append(ids[some]), scores.append(s[some])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(t)) for x, t in ((qids, np.int64), (hits, np.int64), (scores, np.float64))], names=["qid", "chunk_id", "score"])

    built_avgdl = built.avgdl or 1.0
    found = built.blocks.crossJoin(packs).mapInArrow(run, "qid bigint, chunk_id bigint, score double")  # blocks, not rows
    best = W.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank0", F.row_number().over(best) - 1).filter(F.col("rank0") < k).select("qid", "rank0", "chunk_id", "score")
