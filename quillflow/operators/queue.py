"""The leased work queue as transitions of two tables, runs and jobs.

Every transition takes the tables' state and requests, and returns the state after it and the
outcome of each request. now is given, tokens follow from run, job, attempt and now: a step that is
run again gives the same rows. One writer applies steps in turn (see plans.store); workers compete
only for jobs, and one step deals any number of waiting workers distinct jobs.

What the queue allows on purpose: an expired lease may still complete until it is claimed anew; an
expired lease is claimed without a limit on attempts, a failed job only below its run's limit; a
failed run still deals jobs; a merge lease never expires.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import schemas as S
from ..functions import text as X
from ..scratch import staged
from .numbering import numbered


def none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def attempts_limit() -> Column:
    return F.coalesce("config.max_attempts", F.lit(S.DEFAULT_MAX_ATTEMPTS))


def claimable(now: int | Column, limit: Column) -> Column:
    expired = (F.col("state") == S.LEASED) & (F.col("lease_until") < now)
    return (F.col("state") == S.PENDING) | expired | ((F.col("state") == S.FAILED) & (F.col("attempts") < limit))


def fenced() -> Column:
    """Whether a job, joined to a request (worker, token), is leased to just that worker under that token."""
    return F.coalesce((F.col("state") == S.LEASED) & (F.col("worker_id") == F.col("_worker")) & (F.col("lease_token") == F.col("_token")), F.lit(False))


def _update(rows: DataFrame, guard: Column, **values: Column | str | int | bool | None) -> DataFrame:
    kinds = dict(rows.dtypes)
    return rows.withColumns({k: F.when(guard, (v if isinstance(v, Column) else F.lit(v)).cast(kinds[k])).otherwise(F.col(k)) for k, v in values.items()})


# ---- claims


def claim(jobs: DataFrame, runs: DataFrame, waiting: DataFrame, now: int, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Deal jobs, by id, to waiting workers (run_id, worker_id, turn); a cancelled run deals none.

    Returns jobs and the claims: job and run fields of every worker that got one. most bounds the
    workers of one run, and is counted if it isn't given.
    """
    most = most or waiting.groupBy("run_id").count().agg(F.max("count")).first()[0] or 0
    open_runs = runs.where(~F.col("cancel_requested")).select("run_id", "config", attempts_limit().alias("_limit"))
    turns = W.partitionBy("run_id").orderBy("id")
    free = jobs.join(open_runs, "run_id").where(claimable(now, F.col("_limit"))).select("run_id", "id", "config").withColumn("_n", F.row_number().over(turns)).where(F.col("_n") <= most)
    asking = waiting.select("run_id", F.col("worker_id").alias("_worker"), F.row_number().over(W.partitionBy("run_id").orderBy("turn", "worker_id")).alias("_n"))
    # staged, so that jobs meet a table of known size, and aren't shuffled for a few claims
    dealt = staged(free.join(asking, ["run_id", "_n"]).select("run_id", "id", "_worker", F.col("config").alias("_config")), "dealt")
    joined = jobs.join(dealt, ["run_id", "id"], "left")
    got = F.col("_worker").isNotNull()
    token = X.lease_token(F.col("run_id"), F.col("id"), F.col("attempts") + 1, F.lit(now))
    after = _update(joined, got, lease_token=token)
    after = _update(after, got, state=S.LEASED, worker_id=F.col("_worker"), lease_until=now + S.LEASE_SECONDS, attempts=F.col("attempts") + 1, error=None)
    names = ("backend", "model", "thinking", "target_language", "target_language_code", "glossary_path")
    claims = after.where(got).select("run_id", "id", "xhtml_path", "locator", "source", "worker_id", "lease_token", "lease_until", "attempts", *[F.coalesce(f"_config.{c}", F.lit("")).alias(c) for c in names])
    return after.select(*jobs.columns), claims


def _answered(jobs: DataFrame, requests: DataFrame, guard: Column, more: Iterable[str] = (), **values: Column | str | int | None) -> tuple[DataFrame, DataFrame]:
    """Apply values where a request (run_id, id, worker_id, lease_token) meets its guard."""
    asked = requests.select("run_id", "id", F.col("worker_id").alias("_worker"), F.col("lease_token").alias("_token"), *[F.col(c).alias(f"_{c}") for c in more])
    # requests are settled first, of several for one job that meet the guard the least; jobs then meet a table of known size
    first = F.min(F.struct("_worker", "_token", *[f"_{c}" for c in more])).alias("_met")
    met = staged(jobs.join(asked, ["run_id", "id"]).where(guard).groupBy("run_id", "id").agg(first).select("run_id", "id", "_met.*"), "met")
    after = _update(jobs.join(met.withColumn("_ok", F.lit(True)), ["run_id", "id"], "left"), F.col("_ok").isNotNull(), **values).select(*jobs.columns)
    accepted = met.select("run_id", "id", "_worker", "_token", F.lit(True).alias("accepted"))
    outcome = asked.join(accepted, ["run_id", "id", "_worker", "_token"], "left")
    return after, outcome.select("run_id", "id", F.col("_worker").alias("worker_id"), F.col("_token").alias("lease_token"), F.coalesce("accepted", F.lit(False)).alias("accepted"))


def heartbeat(jobs: DataFrame, requests: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    return _answered(jobs, requests, fenced() & (F.col("lease_until") >= now), lease_until=now + S.LEASE_SECONDS)


def complete(jobs: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests have result too. Expiry alone doesn't matter."""
    return _answered(jobs, requests, fenced(), ["result"], state=S.DONE, result=F.col("_result"), worker_id=None, lease_token=None, lease_until=None, error=None)


def fail(jobs: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests have error too."""
    return _answered(jobs, requests, fenced(), ["error"], state=S.FAILED, error=F.left(F.col("_error"), F.lit(S.ERROR_LIMIT)), worker_id=None, lease_token=None, lease_until=None)


def touch(runs: DataFrame, outcome: DataFrame, now: int) -> DataFrame:
    """runs whose jobs accepted something are as of now."""
    touched = outcome.where("accepted").select("run_id").distinct().withColumn("_hit", F.lit(True))
    return _update(runs.join(touched, "run_id", "left"), F.col("_hit").isNotNull(), updated_at=now).select(*runs.columns)


# ---- runs


def create_run(runs: DataFrame, config: DataFrame, now: int) -> DataFrame:
    """runs and those of config (run_id, config). A run that exists already is an error."""
    if not runs.join(config, "run_id", "left_semi").isEmpty():
        raise ValueError("run exists already")
    limited = config.select("run_id", F.col("config").withField("max_attempts", F.coalesce("config.max_attempts", F.lit(S.DEFAULT_MAX_ATTEMPTS))).cast(S.CONFIG).alias("config"))
    new = limited.select("run_id", "config", F.lit(S.RUNNING).alias("state"), F.lit(False).alias("cancel_requested"), F.lit(S.PENDING).alias("merge_state"), none("string").alias("merge_worker_id"), F.lit(now).cast("bigint").alias("started_at"), F.lit(now).cast("bigint").alias("updated_at"), none("string").alias("output_path"), none("string").alias("error"))
    return runs.unionByName(new)


def add_jobs(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """jobs and new ones (run_id, xhtml_path, locator, source, and doc_order): ids go on from each run's last.

    A place (xhtml_path, locator) that comes twice in a run is an error.
    """
    key = ["run_id", "xhtml_path", "locator"]
    new = staged(new, "new-jobs")  # it is gone through for the check, for the ranges of numbers and for the rows
    if not jobs.select(*key).unionByName(new.select(*key)).groupBy(*key).count().where("count > 1").isEmpty():
        raise ValueError("a job's place must be unique in its run")
    last = jobs.groupBy("run_id").agg(F.max("id").alias("_last"))
    order = (["doc_order"] if "doc_order" in new.columns else []) + ["xhtml_path", "locator"]
    made = numbered(new, ["run_id"], order, "_n").join(last, "run_id", "left")
    made = made.select("run_id", (F.coalesce("_last", F.lit(0)) + F.col("_n")).cast("bigint").alias("id"), "xhtml_path", "locator", "source", none("string").alias("result"), F.lit(S.PENDING).alias("state"), none("string").alias("worker_id"), none("string").alias("lease_token"), none("bigint").alias("lease_until"), F.lit(0).alias("attempts"), none("string").alias("error"))
    return jobs.unionByName(made)


def update_run(runs: DataFrame, run_id: str, now: int, **values: object) -> DataFrame:
    if unknown := sorted(set(values) - set(S.UPDATABLE)):
        raise ValueError(f"unknown run fields: {', '.join(unknown)}")
    return _update(runs, F.col("run_id") == run_id, updated_at=now, **values) if values else runs


def request_cancel(runs: DataFrame, run_id: str, now: int) -> DataFrame:
    return update_run(runs, run_id, now, cancel_requested=True)


def clear_cancel(runs: DataFrame, run_id: str, now: int) -> DataFrame:
    return update_run(runs, run_id, now, cancel_requested=False, state=S.RUNNING, error=None)


def mark_failed(runs: DataFrame, run_id: str, error: str, now: int) -> DataFrame:
    kept = F.when(F.col("merge_state") == S.LEASED, F.col("merge_state")).otherwise(S.FAILED)
    return update_run(runs, run_id, now, state=S.FAILED, merge_state=kept, error=error[: S.ERROR_LIMIT])


def retry_failed(jobs: DataFrame, runs: DataFrame, run_id: str, now: int, ids: Iterable[int] = ()) -> tuple[DataFrame, DataFrame, int]:
    """Failed jobs, of ids or all, are pending again without attempts; and how many there were."""
    hit = (F.col("run_id") == run_id) & (F.col("state") == S.FAILED)
    if ids := list(ids):
        hit &= F.col("id").isin(ids)
    count = jobs.where(hit).count()
    merge = F.when(F.col("merge_state") == S.COMPLETED, F.col("merge_state")).otherwise(S.PENDING)
    runs = update_run(runs, run_id, now, cancel_requested=False, state=S.RUNNING, error=None, merge_state=merge)
    return _update(jobs, F.coalesce(hit, F.lit(False)), attempts=0, error=None, state=S.PENDING), runs, count


def merge_ready(jobs: DataFrame) -> DataFrame:
    """run_id, ready: whether all of a run's jobs are done."""
    return jobs.groupBy("run_id").agg(F.bool_and(F.col("state") == S.DONE).alias("ready"))


def try_claim_merge(jobs: DataFrame, runs: DataFrame, asking: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Lease the merge of each run to one of asking (run_id, worker_id, turn): the first, if all jobs are done."""
    first = asking.groupBy("run_id").agg(F.min(F.struct("turn", "worker_id")).alias("_a")).select("run_id", F.col("_a.worker_id").alias("_worker"))
    joined = runs.join(merge_ready(jobs), "run_id", "left").join(first, "run_id", "left")
    wins = ~F.col("cancel_requested") & (F.col("merge_state") == S.PENDING) & F.coalesce("ready", F.lit(True)) & F.col("_worker").isNotNull()
    joined = joined.withColumn("_wins", F.coalesce(wins, F.lit(False)))
    after = _update(joined, F.col("_wins"), merge_state=S.LEASED, merge_worker_id=F.col("_worker"), updated_at=now)
    won = after.where("_wins").select("run_id", F.col("merge_worker_id").alias("worker_id"), F.lit(True).alias("_won"))
    outcome = asking.join(won, ["run_id", "worker_id"], "left").select("run_id", "worker_id", F.coalesce("_won", F.lit(False)).alias("accepted"))
    return after.select(*runs.columns), outcome


def job(jobs: DataFrame, run_id: str, job_id: int) -> DataFrame:
    found = jobs.where((F.col("run_id") == run_id) & (F.col("id") == job_id))
    if found.isEmpty():
        raise ValueError(f"job not found: {job_id}")
    return found


def config(runs: DataFrame, run_id: str) -> DataFrame:
    found = runs.where(F.col("run_id") == run_id).select("config.*")
    if found.isEmpty():
        raise ValueError("run has not been created")
    return found
