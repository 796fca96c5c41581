"""Answers to prompts behind a provider interface, with retries."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .embedding import Limited, with_retries

Generator = Callable[[str], str]


def first_line(prompt: str) -> str:
    """Offline stand-in for a model: the first line of the prompt's context."""
    line = prompt.partition("Context:\n")[2].partition("\n")[0].strip()
    return line or "The context does not say."


GENERATORS: dict[str, Callable[[], Generator]] = {"first_line": lambda: first_line}


def generate(prompts: DataFrame, model: str = "first_line", key: str = "qid", tries: int = 6, wait: float = 1.0) -> DataFrame:
    """``(key, answer)`` of ``(key, prompt)``; a null prompt has a null answer.

    A generator is made once for each task. A call that fails for a while is
    made again, after longer waits where the service limits its calls; when
    ``tries`` are used up the task fails, and with it the job: no answer is lost
    silently. Where a cluster retries tasks, calls of a failed task are repeated.
    """
    if model not in GENERATORS:
        raise NotImplementedError(f"generator {model!r}")
    make = GENERATORS[model]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            answers = [None if p is None else with_retries(lambda p=p: f(p), tries, wait, waits={Limited: 10 * wait}) for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(answers, pa.string())], names=["key", "answer"])

    kind = prompts.schema[key].dataType.simpleString()
    return prompts.select(F.col(key).alias("key"), "prompt").mapInArrow(run, f"key {kind}, answer string").withColumnRenamed("key", key)
