"""Runs and jobs as versioned tables in a folder: each step writes the next version, whole or not at all.

A version's tables lie in a folder of their own, and the version is there once a marker file of its
number names that folder. The marker is created without overwriting, which file systems with a
consistent create let only one of several writers do; nothing is renamed. One writer at a time: a
version that another writer has just taken makes the step fail, and the caller applies it again to
what is there now. The last KEPT versions stay; older ones and what lost a conflict are deleted.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import schemas as S
from ..operators import queue
from ..operators.summary import summary


#: Versions that stay readable.
KEPT = 8


class Conflict(RuntimeError):
    """Another writer took the version."""


class RunStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._root = jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = self._root.getFileSystem(spark._jsc.hadoopConfiguration())
        self._path = jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        if not self._files.exists(self._root):
            return []
        names = [x.getPath().getName() for x in self._files.listStatus(self._root)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())

    def read(self) -> tuple[DataFrame, DataFrame]:
        """jobs and runs as of the last version; empty tables before the first."""
        found = self.versions()
        if not found:
            return self.spark.createDataFrame([], S.JOBS), self.spark.createDataFrame([], S.RUNS)
        at = self._folder(found[-1])
        return self.spark.read.schema(S.JOBS).parquet(f"{at}/jobs"), self.spark.read.schema(S.RUNS).parquet(f"{at}/runs")

    def _folder(self, version: int) -> str:
        stream = self._files.open(self._path(f"{self.path}/v{version}"))
        try:
            return f"{self.path}/{self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, 'UTF-8')}"
        finally:
            stream.close()

    def commit(self, jobs: DataFrame, runs: DataFrame, after: int) -> int:
        """Write the version that follows after."""
        name = f"data-{uuid.uuid4().hex}"
        jobs.write.parquet(f"{self.path}/{name}/jobs")
        runs.write.parquet(f"{self.path}/{name}/runs")
        try:
            marker = self._files.create(self._path(f"{self.path}/v{after + 1}"), False)
        except Exception as e:
            self._files.delete(self._path(f"{self.path}/{name}"), True)
            raise Conflict(f"version {after + 1} exists") from e
        marker.write(bytearray(name.encode()))
        marker.close()
        for old in [v for v in self.versions() if v <= after + 1 - KEPT]:
            self._files.delete(self._path(self._folder(old)), True)
            self._files.delete(self._path(f"{self.path}/v{old}"), False)
        return after + 1

    def step(self, change: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame, DataFrame | None]]) -> list:
        """Apply change(jobs, runs) -> (jobs, runs, outcome) and commit; the outcome's rows, which requests bound."""
        before = (self.versions() or [0])[-1]
        jobs, runs, outcome = change(*self.read())
        answers = outcome.collect() if outcome is not None else []
        self.commit(jobs, runs, before)
        return answers

    # ---- the transitions, as steps

    def create_run(self, run_id: str, config: dict[str, object], now: int | None = None) -> None:
        row = self.spark.createDataFrame([(run_id, tuple(config.get(k) for k in S.CONFIG_FIELDS))], f"run_id string, config {S.CONFIG}")
        self.step(lambda jobs, runs: (jobs, queue.create_run(runs, row, _now(now)), None))

    def add_jobs(self, new: DataFrame) -> None:
        self.step(lambda jobs, runs: (queue.add_jobs(jobs, new), runs, None))

    def claim(self, run_id: str, workers: str | list[str], now: int | None = None) -> list:
        names = [workers] if isinstance(workers, str) else workers
        waiting = self.spark.createDataFrame([(run_id, w, k) for k, w in enumerate(names)], "run_id string, worker_id string, turn int")

        def change(jobs: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
            queue.config(runs, run_id)
            after, claims = queue.claim(jobs, runs, waiting, _now(now), len(names))
            return after, runs, claims

        return self.step(change)

    def _request(self, run_id: str, job_id: int, worker: str, token: str, **more: str) -> DataFrame:
        names = "".join(f", {k} string" for k in more)
        return self.spark.createDataFrame([(run_id, job_id, worker, token, *more.values())], f"run_id string, id bigint, worker_id string, lease_token string{names}")

    def _answer(self, f: Callable[[DataFrame], tuple[DataFrame, DataFrame]], now: int | None, touch: bool) -> bool:
        def change(jobs: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
            after, outcome = f(jobs)
            return after, queue.touch(runs, outcome, _now(now)) if touch else runs, outcome

        return self.step(change)[0]["accepted"]

    def heartbeat(self, run_id: str, job_id: int, worker: str, token: str, now: int | None = None) -> bool:
        request = self._request(run_id, job_id, worker, token)
        return self._answer(lambda jobs: queue.heartbeat(jobs, request, _now(now)), now, False)

    def complete(self, run_id: str, job_id: int, worker: str, token: str, result: str, now: int | None = None) -> bool:
        request = self._request(run_id, job_id, worker, token, result=result)
        return self._answer(lambda jobs: queue.complete(jobs, request), now, True)

    def fail(self, run_id: str, job_id: int, worker: str, token: str, error: str, now: int | None = None) -> bool:
        request = self._request(run_id, job_id, worker, token, error=error)
        return self._answer(lambda jobs: queue.fail(jobs, request), now, True)

    def update_run(self, run_id: str, now: int | None = None, **values: object) -> None:
        self.step(lambda jobs, runs: (jobs, queue.update_run(runs, run_id, _now(now), **values), None))

    def request_cancel(self, run_id: str, now: int | None = None) -> None:
        self.step(lambda jobs, runs: (jobs, queue.request_cancel(runs, run_id, _now(now)), None))

    def clear_cancel(self, run_id: str, now: int | None = None) -> None:
        self.step(lambda jobs, runs: (jobs, queue.clear_cancel(runs, run_id, _now(now)), None))

    def mark_failed(self, run_id: str, error: str, now: int | None = None) -> None:
        self.step(lambda jobs, runs: (jobs, queue.mark_failed(runs, run_id, error, _now(now)), None))

    def retry_failed(self, run_id: str, ids: list[int] | None = None, now: int | None = None) -> int:
        counted = []

        def change(jobs: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame, None]:
            jobs, runs, n = queue.retry_failed(jobs, runs, run_id, _now(now), ids or ())
            counted.append(n)
            return jobs, runs, None

        self.step(change)
        return counted[-1]

    def try_claim_merge(self, run_id: str, worker: str, now: int | None = None) -> bool:
        asking = self.spark.createDataFrame([(run_id, worker, 0)], "run_id string, worker_id string, turn int")

        def change(jobs: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
            runs, outcome = queue.try_claim_merge(jobs, runs, asking, _now(now))
            return jobs, runs, outcome

        return self.step(change)[0]["accepted"]

    def summary(self, run_id: str) -> dict:
        found = summary(*self.read()).where(f"run_id = '{run_id}'").first()
        if found is None:
            raise ValueError("run has not been created")
        return found.asDict()


def _now(now: int | None) -> int:
    return int(time.time()) if now is None else now
