"""Registered queries that run the lease machine as a stream over the events, and their DuckDB SQL.

Every event is a job of its user's run; views ask for one, purchases complete and errors fail the job
that they are, if it has been dealt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalogue as C
from . import scratch
from . import schemas as S
from .functions import text as X
from .streaming import leases, progress

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.readStream.schema("event_id bigint, user_id bigint, event_type string").parquet(f"{sf_dir}/events.parquet*")
    e = events.select(F.concat(F.lit("r"), (F.col("user_id") % C.RUNS).cast("string")).alias("run_id"), "event_id", "event_type")
    token = X.lease_token(F.col("run_id"), F.col("event_id"), F.lit(1), F.lit(2))

    def message(kind: str, at: int, worker: bool, job: bool, when: str | None = None) -> F.Column:
        made = F.struct(F.lit(kind).alias("kind"), F.lit("w" if worker else None).cast("string").alias("worker_id"), F.col("event_id").alias("job_id") if job else F.lit(None).cast("bigint").alias("job_id"), (token if worker and job else F.lit(None).cast("string")).alias("lease_token"), F.lit(None).cast("string").alias("payload"), F.lit(at).cast("bigint").alias("at"))
        return F.when(F.col("event_type") == when, made) if when else made

    sent = F.array(message("add", 1, False, True), message("claim", 2, True, False, "view"), message("complete", 3, True, True, "purchase"), message("fail", 4, True, True, "error"))
    return e.select("run_id", F.explode(F.filter(sent, lambda m: m.isNotNull())).alias("m")).select("run_id", "m.*")


def _ran(spark: SparkSession, made: Callable[[], DataFrame], mode: str, schema: str) -> DataFrame:
    """What a stream over all there is gives, read back; the state store's setting as it was."""
    at, before = scratch.folder(spark, "stream"), spark.conf.get(_PROVIDER)
    write = lambda rows, batch: rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{at}/rows")
    try:
        query = made().writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
    return spark.read.schema(f"{schema}, batch bigint").parquet(f"{at}/rows")


def lease_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every job's messages came to, and which jobs were dealt."""
    rows = _ran(spark, lambda: leases.lease_stream(_messages(spark, sf_dir)), "append", leases.OUTCOMES)
    return rows.where("job_id is not null").select("run_id", "kind", "job_id", "accepted", "state", "attempts")


def live_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last counts of each run, kept by changes behind the lease stream."""
    rows = _ran(spark, lambda: progress.summaries(leases.lease_stream(_messages(spark, sf_dir))), "update", progress.SUMMARIES)
    last = rows.groupBy("run_id").agg(F.max_by(F.struct("state", "merge_state", "cancel_requested", "total", *S.JOB_STATES, "retryable"), "batch").alias("s"))
    return last.select("run_id", "s.*")


QUERIES = {f.__name__: f for f in (lease_outcomes, live_summaries)}

_DEALT_SQL = f"""WITH jobs AS (SELECT 'r' || CAST(user_id % {C.RUNS} AS VARCHAR) AS run_id, event_id, event_type FROM events),
dealt AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY event_id) <= count(*) FILTER (event_type = 'view') OVER (PARTITION BY run_id) AS dealt FROM jobs),
ends AS (SELECT *, CASE WHEN NOT dealt THEN 'pending' WHEN event_type = 'purchase' THEN 'done' WHEN event_type = 'error' THEN 'failed' ELSE 'leased' END AS state FROM dealt)"""
ORACLES = {
    "lease_outcomes": f"""{_DEALT_SQL}
SELECT run_id, 'add' AS kind, event_id AS job_id, true AS accepted, 'pending' AS state, 0 AS attempts FROM ends
UNION ALL SELECT run_id, 'claim', event_id, true, 'leased', 1 FROM ends WHERE dealt
UNION ALL SELECT run_id, CASE event_type WHEN 'purchase' THEN 'complete' ELSE 'fail' END, event_id, dealt, state, CAST(dealt AS INTEGER) FROM ends WHERE event_type IN ('purchase', 'error')""",
    "live_summaries": f"""{_DEALT_SQL}
SELECT run_id, 'running' AS state, 'pending' AS merge_state, false AS cancel_requested, count(*) AS total, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'leased') AS leased,
       count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'failed') AS retryable FROM ends GROUP BY run_id""",
}
