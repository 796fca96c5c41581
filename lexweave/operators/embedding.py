"""Text embedding behind a provider interface.

The default provider is a deterministic hashing embedder: signed word counts in
``dim`` buckets, L2-normalised; blank text is the zero vector. Providers run in
Arrow batches, one model for each worker, with their own retries.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 64
Provider = Callable[[list[str]], np.ndarray]
_SLOTS: dict[str, int] = {}


def _slot(w: str) -> int:
    h = _SLOTS.get(w)
    if h is None:
        if len(_SLOTS) > 500_000:
            _SLOTS.clear()
        h = _SLOTS[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
    return h


def hashed(texts: list[str], dim: int = DIM, salt: int = 0) -> np.ndarray:
    out = np.zeros((len(texts), dim))
    for i, t in enumerate(texts):
        for w in (t or "").lower().split():
            h = _slot(w)
            if salt:
                h = (h ^ salt) * 0x9E3779B97F4A7C15 % 2**64
                h ^= h >> 29
            out[i, h % dim] += 1.0 if h >> 63 else -1.0
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(norm == 0, 1, norm)


# Model names, their vector length, batch size and query prefix.
MODELS = {
    "BAAI/bge-base-en-v1.5": (768, 32, ""),
    "BAAI/bge-m3": (1024, 32, ""),
    "Snowflake/snowflake-arctic-embed-l-v2.0": (1024, 32, ""),
    "Qwen/Qwen3-Embedding-8B": (4096, 16, "Instruct: Given a web search query, retrieve relevant passages that answer the query\nQuery: "),
}
PROVIDERS: dict[str, Callable[[], Provider]] = {"hashed": lambda: hashed}


def provider(name: str) -> Callable[[], Provider]:
    """Factory of a registered provider.

    A public model has an offline stand-in until a real one is registered under
    its name: words hashed into ``DIM`` buckets of its own, so that no two
    models give the same vectors.
    """
    if name in PROVIDERS:
        return PROVIDERS[name]
    if name in MODELS:
        salt = xxhash.xxh64_intdigest(name.encode())
        return lambda: lambda texts: hashed(texts, salt=salt)
    raise NotImplementedError(f"embedding model {name!r}")


class Limited(Exception):
    """The service takes no more calls for a while."""


#: Batches after which a worker makes its model anew, which frees what a local model has gathered.
RELOAD = 100


def with_retries(call: Callable, tries: int = 6, wait: float = 1.0, transient: tuple = (TimeoutError, ConnectionError), waits: dict[type, float] | None = None):
    """``call()`` again after transient failures, waiting longer each time.

    ``waits``: kinds of failure that have a wait of their own, by default ``Limited``.
    """
    waits = {Limited: 10 * wait} if waits is None else waits
    for n in range(tries):
        try:
            return call()
        except (*transient, *waits) as failure:
            if n == tries - 1:
                raise
            time.sleep(next((w for kind, w in waits.items() if isinstance(failure, kind)), wait) * (n + 1))


def embed(df: DataFrame, key: str, text: str, model: str = "hashed", query: bool = False, batch: int | None = None, pause: float = 0.0, reload: int = RELOAD) -> DataFrame:
    """``(key, embedding ARRAY<DOUBLE>)`` of every row; null text is embedded as empty.

    ``pause``: seconds between the calls of a task, for services that ask for
    it; ``reload``: calls after which the model is made anew.
    """
    make, size = provider(model), batch or MODELS.get(model, (0, 32, ""))[1]
    prefix = MODELS.get(model, (0, 0, ""))[2] if query else ""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, calls = None, 0
        for b in batches:
            texts = [prefix + (t or "") for t in b.column(1).to_pylist()]
            vectors: list = []
            for i in range(0, len(texts), size):
                if calls % reload == 0:
                    f = make()
                elif pause:
                    time.sleep(pause)
                calls += 1
                vectors += with_retries(lambda i=i: f(texts[i : i + size])).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors, pa.list_(pa.float64()))], names=["key", "embedding"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, embedding array<double>").withColumnRenamed("key", key)
