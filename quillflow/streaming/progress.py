"""Counts and progress of runs as their lease stream goes on.

summaries() is a second stateful operator behind the lease stream's outcomes: it keeps each run's counts by
the changes that outcomes tell, reads no job, and in update mode gives one row for each run that a batch
touched, equal to operators.summary over the tables as they would be then. progress() adds what doesn't
change, a run's settings and start, by a join with the runs' table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import schemas as S
from ..functions import text as X
from ..operators.queue import attempts_limit

COUNTS = "state string, merge_state string, cancel_requested boolean, total bigint, done bigint, leased bigint, failed bigint, pending bigint, retryable bigint, at bigint"
NAMES = [x.split()[0] for x in COUNTS.split(", ")]
SUMMARIES = f"run_id string, {COUNTS}"


class Summaries(StatefulProcessor):
    """State: one row of counts for each run."""

    def __init__(self, max_attempts: int = S.DEFAULT_MAX_ATTEMPTS):
        self.max_attempts = max_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", COUNTS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        told = dict(zip(NAMES, self.counts.get())) if self.counts.exists() else dict.fromkeys(NAMES, 0)
        latest = -1  # frames come in any order: the run is as after the last step of all
        for frame in rows:
            last = frame.iloc[int(frame["step"].to_numpy().argmax())]
            if last["step"] > latest:
                latest = last["step"]
                told |= {"state": last["run_state"], "merge_state": last["merge_state"], "cancel_requested": bool(last["cancelled"])}
            told["at"] = max(told["at"], int(frame["at"].max()))
            moved = frame[frame["accepted"].astype(bool) & frame["job_id"].notna()]
            for names, by in ((["was", "was_attempts"], -1), (["state", "attempts"], 1)):
                for (state, attempts), n in moved.groupby(names).size().items():
                    self._moved(told, state, attempts, by * int(n))
        self.counts.update(tuple(told[n] for n in NAMES))
        yield pd.DataFrame([{"run_id": key[0], **told}])

    def _moved(self, told: dict, state: str | None, attempts: float, by: int) -> None:
        if state in S.JOB_STATES:
            told["total"] += by
            told[state] += by
            told["retryable"] += by * (state == S.FAILED and attempts < self.max_attempts)

    def close(self) -> None:
        pass


def summaries(outcomes: DataFrame, max_attempts: int = S.DEFAULT_MAX_ATTEMPTS) -> DataFrame:
    """Counts of each run that a batch of lease_stream's outcomes touched. Write them in update mode."""
    return outcomes.groupBy("run_id").transformWithStateInPandas(Summaries(max_attempts), SUMMARIES, "update", "none")


def progress(counts: DataFrame, runs: DataFrame, now_ms: int | None = None) -> DataFrame:
    """counts with the settings and start of their runs (run_id, config, started_at), and the line to show.

    Without now_ms the line is as of the last outcome.
    """
    fixed = runs.select("run_id", F.col("config.model").alias("model"), F.coalesce("config.thinking", F.lit("high")).alias("thinking"), F.coalesce("config.workers", F.lit(1)).alias("workers"), attempts_limit().alias("max_attempts"), "started_at")
    return counts.join(fixed, "run_id").withColumn("line", X.progress_line(F.lit(now_ms) if now_ms is not None else F.col("at") * 1000))
