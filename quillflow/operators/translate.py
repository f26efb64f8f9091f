"""Translating claimed blocks by a function from outside, and settling their jobs by what comes back.

The translator maps protected markup to markup and may be slow or fail: rows of an Arrow batch go to it
from a bounded number of threads, a call that raises is tried again after a pause, and a block whose calls
all fail, or whose answer doesn't fit, has an error in place of a result. No block ends the task of another.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame

from .. import schemas as S
from . import queue
from .fragments import check, protect, restore

Translator = Callable[[str], str]


def _answer(row: dict, translator: Translator | None, tries: int, pause: float) -> tuple[str | None, str | None, int]:
    """result, error, and how often the translator was asked."""
    asked = 0
    try:
        protected, markers = protect(row["source"] or "", row["id"])
        while True:
            asked += 1
            try:
                translated = protected if translator is None else translator(protected)
                break
            except Exception as e:
                if asked >= tries:
                    return None, f"translator: {e}"[: S.ERROR_LIMIT], asked
                time.sleep(pause * 2 ** (asked - 1))
        result = restore((translated or "").strip(), markers)
        check(row["source"], result)
        return result, None, asked
    except ValueError as e:
        return None, str(e)[: S.ERROR_LIMIT], asked


def translated(claims: DataFrame, translator: Translator | None = None, threads: int = 4, tries: int = 3, pause: float = 0.5) -> DataFrame:
    """claims (id, source, ...) with result or error, and calls. Without a translator every block stays as it is."""
    given = claims.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in claims.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                rows = [{"id": i, "source": s} for i, s in zip(batch.column("id").to_pylist(), batch.column("source").to_pylist())]
                answers = list(pool.map(lambda row: _answer(row, translator, tries, pause), rows))
                made = [pa.array([a[k] for a in answers], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in given), *made], [*given, "result", "error", "calls"])

    return claims.mapInArrow(run, f"{schema}, result string, error string, calls int")


def settled(jobs: DataFrame, answers: DataFrame) -> DataFrame:
    """jobs after the answers (run_id, id, worker_id, lease_token, result, error): done where there is a result, else failed."""
    after, _ = queue.complete(jobs, answers.where("error is null"))
    after, _ = queue.fail(after, answers.where("error is not null"))
    return after
