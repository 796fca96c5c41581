"""Sources and sinks: JSON lines and arrays, text scalars, CSV, graphs, an
idempotent vector index, run logs, YAML configuration."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.embedding import embed, provider, with_retries
from ..operators.metrics import upsert

RAW_SCHEMA = "content string, metadata struct<celex: string, title: string, form: string, author: string, date: string, latest: string, pages: string, source: string>"
CLEAN_SCHEMA = "doc_id bigint, celex string, title string, form string, family string, author string, date string, date_type string, latest string, pages string, url string, text string"
GOLD_SCHEMA = "user_input string, reference string, reference_contexts array<string>, persona_name string, query_style string, query_length string, synthesizer_name string"
RESULT_SCHEMA = "user_input string, retrieved_contexts array<string>, response string, reference string"


def read_json_lines(spark: SparkSession, path: str, schema: str = CLEAN_SCHEMA) -> DataFrame:
    """One JSON object a line; blank lines are skipped, malformed ones raise."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_raw_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Raw documents with a position that follows file name and place in it."""
    raw = read_json_lines(spark, path, RAW_SCHEMA)
    return raw.withColumn("file_pos", F.struct(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")))


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one JSON array or object."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_scalar(spark: SparkSession, value: str, path: str) -> None:
    spark.createDataFrame([(value,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_scalar(spark: SparkSession, path: str) -> str:
    row = spark.read.option("wholetext", True).text(path).first()
    return row[0].strip() if row else ""


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def list_literal(c: Column) -> Column:
    """A list of strings written as a literal, in single or double quotes, as an array; null where it isn't one."""
    found = F.regexp_extract_all(c, F.lit(r"'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\""), F.lit(0))
    return F.when(c.rlike(r"(?s)\A\s*\[.*\]\s*\z"), F.transform(found, lambda x: F.regexp_replace(F.substring(x, F.lit(2), F.char_length(x) - 2), r"\\(.)", "$1")))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def config_hash(cfg: dict) -> str:
    return hashlib.sha256(json.dumps(cfg, sort_keys=True, default=str).encode()).hexdigest()[:16]


def variant_path(base: str, experiment: str, what: str) -> str:
    """Where a dataset of an experiment lies."""
    return f"{base}/{experiment}/{what}"


def probe(model: str) -> int:
    """How long a model's vectors are, told by embedding one word."""
    return len(provider(model)()(["probe"])[0])


def build_index(chunks: DataFrame, base: str, cfg: dict, key: str = "chunk_id", text: str = "page_content", batches: int = 1) -> DataFrame:
    """The embedded chunks of a configuration, built once.

    An index is reused if its marker is there and its rows are as many as the
    chunks. Otherwise it is written in ``batches`` (by hash of the key), each
    tried again after transient failures; batches that an earlier attempt
    completed for the same number of chunks stay. The vector length is probed
    before anything is written, and a vector of another length fails its batch.
    """
    spark = chunks.sparkSession
    path, n = f"{base}/index-{config_hash(cfg)}", chunks.count()
    if complete(spark, path, n):
        return spark.read.parquet(path).drop("batch")
    settings = cfg.get("embedding") or {}
    model = settings.get("model", "hashed")
    length = probe(model)
    for b in range(batches):
        part = chunks.filter(F.pmod(F.xxhash64(key), F.lit(batches)) == b)
        if batches > 1 and complete(spark, f"{path}/batch={b}", part.count()):
            continue
        vectors = embed(part, key, text, model, batch=settings.get("batch_size"))
        right = F.when(F.size("embedding") == length, F.col("embedding")).otherwise(F.raise_error(F.lit(f"a vector of another length than {length}")).cast("array<double>"))
        rows = part.join(vectors, key).withColumn("embedding", right)
        with_retries(lambda rows=rows, b=b: rows.write.mode("overwrite").parquet(path if batches == 1 else f"{path}/batch={b}"))
    if batches > 1:
        jvm = spark._jvm
        done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        done.getFileSystem(spark._jsc.hadoopConfiguration()).create(done, True).close()
    return spark.read.parquet(path).drop("batch")


def complete(spark: SparkSession, path: str, rows: int) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(p)) and spark.read.parquet(path).count() == rows


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A stage's result, written once and read again on later runs."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def log_run(runs: DataFrame | None, new: DataFrame, key: str = "variant") -> DataFrame:
    """The run log with ``new`` in place of older rows of the same runs."""
    return new if runs is None else upsert(runs, new, key)


def load_config(base: str, environment: str = "local") -> dict:
    """``base/*.yml``, overridden key by key by those of ``environment``; PyYAML where it is installed, else JSON files."""
    out: dict = {}
    for env in ("base", environment):
        for p in sorted(Path(base, env).glob("*")):
            if p.suffix in (".yml", ".yaml"):
                import yaml

                out |= yaml.safe_load(p.read_text()) or {}
            elif p.suffix == ".json":
                out |= json.loads(p.read_text())
    return out


def credentials(values: dict[str, str]) -> None:
    """Environment variables that aren't set yet."""
    for k, v in values.items():
        os.environ.setdefault(k, v)
