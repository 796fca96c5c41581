"""Incremental ingest: the same cleaning expressions over a stream of raw documents.

The reference has no streams; this is the batch ingest for corpora that arrive
in files over time. Re-deliveries within the watermark are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..sources.io import RAW_SCHEMA


def raw_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(RAW_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)


def cleaned(raw: DataFrame, delay: str = "7 days") -> DataFrame:
    m = lambda c: F.coalesce(F.col(f"metadata.{c}"), F.lit(""))
    out = raw.select(
        m("celex").alias("celex"),
        F.replace(m("title"), F.lit(" "), F.lit(" ")).alias("title"),
        m("form").alias("form"),
        T.family(m("celex"), m("form")).alias("family"),
        T.date_part(m("date")).alias("date"),
        T.clean(F.coalesce("content", F.lit(""))).alias("text"),
        F.current_timestamp().alias("ingested_at"),
    )
    key = F.xxhash64("celex", "title", "text")
    return out.withColumn("content_key", key).withWatermark("ingested_at", delay).dropDuplicatesWithinWatermark(["content_key"])


def run(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Everything that is there now, once; call again for what comes later."""
    return cleaned(raw_stream(spark, source)).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
