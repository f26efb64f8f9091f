"""A run's counts and settings in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X
from .queue import attempts_limit


def state_counts(jobs: DataFrame, group: list[str], state: str = "state", states: tuple[str, ...] = S.JOB_STATES) -> DataFrame:
    """group, total and a count for each state, zero where there is none."""
    return jobs.groupBy(*group).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(state) == s).alias(s) for s in states])


def summary(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """One row for each run."""
    limits = runs.select("run_id", attempts_limit().alias("_limit"))
    retryable = jobs.where(F.col("state") == S.FAILED).join(limits, "run_id").groupBy("run_id").agg(F.count_if(F.col("attempts") < F.col("_limit")).alias("retryable"))
    joined = runs.join(state_counts(jobs, ["run_id"]), "run_id", "left").join(retryable, "run_id", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select(
        "run_id", "state", "merge_state", F.col("config.model").alias("model"), F.coalesce("config.thinking", F.lit("high")).alias("thinking"), F.coalesce("config.workers", F.lit(1)).alias("workers"), attempts_limit().alias("max_attempts"),
        *map(count, ("total", *S.JOB_STATES, "retryable")), "started_at", "cancel_requested", "output_path", "error",
    )


#: Names of the summary's fields where it leaves as JSON.
JSON_NAMES = {"merge_state": "mergeState", "max_attempts": "maxAttempts", "started_at": "startedAt", "cancel_requested": "cancelRequested", "output_path": "outputPath"}


def summary_json(summaries: DataFrame) -> DataFrame:
    """run_id and the summary as JSON text."""
    fields = [F.col(c).alias(JSON_NAMES.get(c, c)) for c in summaries.columns if c != "run_id"]
    return summaries.select("run_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def progress(summaries: DataFrame, now_ms: int) -> DataFrame:
    return summaries.select("run_id", X.progress_line(F.lit(now_ms)).alias("line"))
