"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .queries import chunks, corpus, evaluation, plans, retrieval, scalars

_MODULES = (retrieval, scalars, corpus, chunks, evaluation, plans)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
SQL: dict[str, str] = {k: s for m in _MODULES for k, s in m.SQL.items()}
FLAGSHIP = "dense_topk"
