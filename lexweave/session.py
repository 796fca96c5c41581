"""Session helpers: table access, worker imports, lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable in the Python workers.

    Workers started from a shared file system find it by path; elsewhere the
    package is submitted with ``--py-files``. Safe to call again.
    """
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)
    return spark


#: Columns whose processing is worth a task of its own for every core.
LONG = {"text", "page_content", "parent_text", "reference_contexts", "retrieved_contexts"}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One of the Parquet tables, pruned to ``columns`` where any are given.

    A file of one row group is one task however many cores there are; texts of
    such a table are spread first. Larger tables are scanned as they lie.
    """
    df = prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df.select(*columns)) if columns and LONG.intersection(columns) else df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """At least as many partitions as the session has cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() * 2 > cores else df.repartition(cores)


#: File system and path of every table that this process has settled.
_WRITTEN: list[tuple] = []


def release() -> None:
    """Delete the tables that ``settle`` has written; results that still read them can't be read any more.

    Runs by itself when the driver ends.
    """
    _SHARED.clear()
    while _WRITTEN:
        fs, path = _WRITTEN.pop()
        try:
            fs.delete(path, True)
        except Exception:  # noqa: BLE001 - the JVM or the folder is gone already
            return


atexit.register(release)


_SHARED: dict[tuple, object] = {}


def fingerprint(spark: SparkSession, path: str) -> str:
    """Length and time of change of the files under ``path``: another text, another fingerprint."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    return "|".join(sorted(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}" for f in found))


def once(spark: SparkSession, sf_dir: str, name: str, key: tuple, make: Callable[[], T]) -> T:
    """What ``make`` builds (and settles) from a table, built once for each content of the table and ``key``."""
    full = (spark.sparkContext.applicationId, fingerprint(spark, f"{sf_dir}/{name}.parquet"), key)
    if full not in _SHARED:
        _SHARED[full] = make()
    return _SHARED[full]


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: ``df`` as a table written once in the cluster's shared folder.

    The folder is the session's ``spark.checkpoint.dir``; only where that is
    unset and the master is local, as in tests, is a temporary folder used. A
    written table is computed once, where ``checkpoint()`` computes twice, and
    outlives the loss of any executor.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="lexweave-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        sc.setCheckpointDir(shared)
    path = f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    _WRITTEN.append((where.getFileSystem(spark._jsc.hadoopConfiguration()), where))
    return spark.read.schema(df.schema).parquet(path)
