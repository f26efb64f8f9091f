"""Registered queries of the document operators over the driver's tables, and their DuckDB SQL.

The tables hold no packaged books, so events stand in for jobs (their type for a state, a number in
their properties for attempts), documents for book documents and pages for markup.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import schemas as S
from . import scratch
from .functions import text as X
from .operators import candidates, fragments, numbering, queue, sampling, scope, summary
from .sources import archive

#: A moment inside the events' month, in epoch seconds.
NOW = 1_705_000_000
#: Jobs of events whose time is so many seconds back are still leased.
RUNS = 7


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    state = F.when(F.col("event_type") == "view", S.LEASED).when(F.col("event_type") == "purchase", S.DONE).when(F.col("event_type") == "error", S.FAILED).otherwise(S.PENDING)
    leased = F.col("event_type") == "view"
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.concat(F.lit("r"), (F.col("user_id") % RUNS).cast("string")).alias("run_id"),
        F.col("event_id").alias("id"),
        F.concat(F.lit("doc"), F.col("user_id").cast("string")).alias("xhtml_path"),
        F.array((F.col("user_id") % 11).cast("int"), k).alias("locator"),
        F.col("props").alias("source"),
        F.when(state == S.DONE, F.col("event_type")).alias("result"),
        state.alias("state"),
        F.when(leased, F.concat(F.lit("w"), (F.col("user_id") % 5).cast("string"))).alias("worker_id"),
        F.when(leased, F.md5(F.col("event_id").cast("string").cast("binary"))).alias("lease_token"),
        F.when(leased, F.unix_seconds(F.col("ts").cast("timestamp"))).alias("lease_until"),
        (k % 5).alias("attempts"),
        F.when(state == S.FAILED, F.col("event_type")).alias("error"),
    )


_JOBS_SQL = f"""
jobs AS (
  SELECT 'r' || CAST(user_id % {RUNS} AS VARCHAR) AS run_id, event_id AS id,
         CASE event_type WHEN 'view' THEN 'leased' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'pending' END AS state,
         CASE WHEN event_type = 'view' THEN 'w' || CAST(user_id % 5 AS VARCHAR) END AS worker_id,
         CASE WHEN event_type = 'view' THEN md5(CAST(event_id AS VARCHAR)) END AS lease_token,
         CASE WHEN event_type = 'view' THEN CAST(floor(epoch(ts)) AS BIGINT) END AS lease_until,
         CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS attempts, event_id, user_id
  FROM events)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each run_id of jobs: r3 is cancelled, r5 lets a job fail once only, r6 has no limit set."""
    users = _table(spark, sf_dir, "events").select(F.concat(F.lit("r"), (F.col("user_id") % RUNS).cast("string")).alias("run_id")).distinct()
    limit = F.when(F.col("run_id") == "r5", 1).when(F.col("run_id") != "r6", 4)
    fields = {"max_attempts": limit, "model": F.concat(F.lit("test/"), F.col("run_id")), "workers": F.when(F.col("run_id") == "r2", 4)}
    config = F.struct(*[(fields.get(k, F.lit(None))).cast(v).alias(k) for k, v in S.CONFIG_FIELDS.items()])
    none = lambda kind: F.lit(None).cast(kind)
    return users.select("run_id", config.alias("config"), F.lit(S.RUNNING).alias("state"), (F.col("run_id") == "r3").alias("cancel_requested"), F.lit(S.PENDING).alias("merge_state"), none("string").alias("merge_worker_id"), F.lit(NOW - 3725).cast("long").alias("started_at"), F.lit(NOW).cast("long").alias("updated_at"), none("string").alias("output_path"), none("string").alias("error"))


_LIMIT_SQL = "CASE run_id WHEN 'r5' THEN 1 WHEN 'r6' THEN 3 ELSE 4 END"
_FREE_SQL = f"(state = 'pending' OR (state = 'leased' AND lease_until < {NOW}) OR (state = 'failed' AND attempts < {_LIMIT_SQL}))"


# ---- candidates and text


def candidate_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.glossary_candidates(_table(spark, sf_dir, "documents"), document="doc_id")


_TOKENS_SQL = r"regexp_extract_all(regexp_replace(coalesce(text, ''), 'https?://\S+|www\.\S+', ' ', 'gi'), '[\p{L}\p{N}]+(?:[''’\-][\p{L}\p{N}]+)*')"
_STOP_SQL = ", ".join(f"'{w}'" for w in X.STOPWORDS)


def candidates_sql(docs: str, group: str | None, limit: int, least: int) -> str:
    """Ranked phrases of the relation docs (doc_id, text), of each group if one is named."""
    g, by = (f"{group}, ", f"PARTITION BY {group} ") if group else ("", "")
    shown = f"frequency, (SELECT count(*) FROM docs d WHERE d.{group} = r.{group}) AS documents, {group}" if group else "frequency, frequency AS document_count"
    return rf"""
WITH docs AS MATERIALIZED (SELECT * FROM {docs}),
toks AS (SELECT {g}doc_id, {_TOKENS_SQL} AS t FROM docs),
words AS (SELECT {g}doc_id, t, unnest(generate_series(1, len(t) - 1)) AS i FROM toks),
flags AS (
  SELECT {g}doc_id, i, n, list_slice(t, i, i + n - 1) AS w FROM words, (SELECT unnest([2, 3, 4]) AS n) WHERE i + n - 1 <= len(t)),
fine AS (
  SELECT {g}doc_id, i, n, array_to_string(w, ' ') AS phrase FROM flags
  WHERE len(list_filter(w, lambda x: (lower(x) IN ({_STOP_SQL}) AND length(x) > 1) OR regexp_matches(x, '^\p{{Nd}}+$') OR NOT regexp_matches(x, '^\p{{Lu}}'))) = 0),
once AS (SELECT {g}doc_id, replace(replace(lower(phrase), 'ß', 'ss'), 'ς', 'σ') AS key, arg_min(phrase, i * 10 + n) AS phrase FROM fine GROUP BY ALL),
ranked AS (
  SELECT {g}key, count(*) AS frequency, arg_min(phrase, doc_id) AS term, list_slice(list(phrase ORDER BY doc_id), 1, 3) AS contexts FROM once GROUP BY {g}key HAVING count(*) >= {least})
SELECT CAST(row_number() OVER ({by}ORDER BY frequency DESC, len(string_split(term, ' ')) DESC, replace(replace(lower(term), 'ß', 'ss'), 'ς', 'σ')) AS INTEGER) AS place,
       term, {shown}, contexts
FROM ranked r QUALIFY place <= {limit}"""


def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.tokens(F.coalesce("text", F.lit("")))
    return _table(spark, sf_dir, "documents").withColumn("t", t).select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


def text_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", X.normal_text(F.col("text"), 1000).alias("sample"))


def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \t\n\r]+"), lambda x: x != "")
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(X.ordered_distinct(words), " ").alias("words"))


def safe_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", X.safe_name(F.coalesce("text", F.lit(""))).alias("name"))


def language_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.when(F.col("lang") == "en", " English (United States) ").when(F.col("lang") == "fr", "French, Canada").when(F.col("lang") == "de", "GERMAN").otherwise(F.col("lang"))
    code = X.language_code(names)
    return _table(spark, sf_dir, "documents").select("doc_id", code.alias("code"), X.normal_language_code(F.concat(F.upper(F.col("lang")), F.lit("-latn-"), F.col("lang"))).alias("normal"))


def json_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"), X.loose_json(F.concat(F.lit("reply: "), F.col("props"), F.lit(" end"))).alias("found"))


# ---- sampling and scope


def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.even_sample(_table(spark, sf_dir, "documents").select("doc_id", "lang"), 6, "doc_id", "lang")


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "source")
    read = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path")).distinct().withColumn("_read", F.lit(True))
    return docs.join(read, "path", "left").select("path", F.col("_read").isNotNull().alias("in_spine"), (F.col("source") == "src1").alias("is_nav"))


def unknown_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"))
    return sampling.unknown_paths(labels, _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path")))


def selected_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return sampling.selected(_table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), labels, "doc_id")


def member_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("lang").alias("book"), F.col("source").alias("member"))
    other = docs.where("book <> 'de' and member not in ('src1', 'src2')").unionByName(_table(spark, sf_dir, "labels").select(F.concat(F.lit("q"), F.col("quality").cast("string")).alias("book"), F.concat(F.lit("t"), F.col("toxic").cast("string")).alias("member")))
    return archive.member_differences(docs, other)


def scope_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    wanted, kept = labels.where("toxic = 1").select(F.col("doc_id").alias("path")), labels.where("quality = 1").select(F.col("doc_id").alias("path"))
    return scope.assign_scope(_flagged(spark, sf_dir), wanted, kept).select("path", "scope")


# ---- the work queue


def state_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.summary(jobs(spark, sf_dir), runs(spark, sf_dir)).select("run_id", "state", "merge_state", "model", "thinking", "workers", "max_attempts", "total", "done", "leased", "failed", "pending", "retryable", "cancel_requested")


def _waiting(spark: SparkSession, sf_dir: str, workers: int) -> DataFrame:
    return runs(spark, sf_dir).select("run_id", F.explode(F.sequence(F.lit(0), F.lit(workers - 1))).alias("turn")).select("run_id", F.concat(F.lit("worker"), F.col("turn")).alias("worker_id"), "turn")


def _claims(spark: SparkSession, sf_dir: str, workers: int) -> DataFrame:
    _, claims = queue.claim(jobs(spark, sf_dir), runs(spark, sf_dir), _waiting(spark, sf_dir, workers), NOW, workers)
    return claims.select("run_id", "id", "worker_id", "lease_token", "lease_until", "attempts", "model")


def claim_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir, 1)


def claim_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir, 25)


def _claims_sql(workers: int) -> str:
    return f"""WITH {_JOBS_SQL},
free AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY id) AS n FROM jobs WHERE run_id <> 'r3' AND {_FREE_SQL})
SELECT run_id, id, 'worker' || CAST(n - 1 AS VARCHAR) AS worker_id,
       left(sha256(run_id || '|' || CAST(id AS VARCHAR) || '|' || CAST(attempts + 1 AS VARCHAR) || '|{NOW}'), 32) AS lease_token,
       CAST({NOW + S.LEASE_SECONDS} AS BIGINT) AS lease_until, attempts + 1 AS attempts, 'test/' || run_id AS model
FROM free WHERE n <= {workers}"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leased job's own request; of every third the token is stale, of every fifth the worker wrong."""
    leased = jobs(spark, sf_dir).where(F.col("state").isin(S.LEASED, S.DONE))
    token = F.when(F.col("id") % 3 == 0, "stale").otherwise(F.md5(F.col("id").cast("string").cast("binary")))
    worker = F.when(F.col("id") % 5 == 0, "nobody").otherwise(F.coalesce("worker_id", F.lit("w0")))
    return leased.select("run_id", "id", worker.alias("worker_id"), token.alias("lease_token"), F.lit("<p/>").alias("result"), F.lit("bad").alias("error"))


def fenced_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    after, _ = queue.complete(jobs(spark, sf_dir), _requests(spark, sf_dir))
    return after.select("run_id", "id", "state", "worker_id", "lease_until", "attempts")


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, outcome = queue.heartbeat(jobs(spark, sf_dir), _requests(spark, sf_dir), NOW)
    return outcome


_FENCE_SQL = "state = 'leased' AND id % 3 <> 0 AND id % 5 <> 0"
_HEARTBEAT_SQL = f"""WITH {_JOBS_SQL}
SELECT run_id, id, CASE WHEN id % 5 = 0 THEN 'nobody' ELSE coalesce(worker_id, 'w0') END AS worker_id,
       CASE WHEN id % 3 = 0 THEN 'stale' ELSE md5(CAST(id AS VARCHAR)) END AS lease_token,
       coalesce({_FENCE_SQL} AND lease_until >= {NOW}, false) AS accepted
FROM jobs WHERE state IN ('leased', 'done')"""


def failed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    after, _ = queue.fail(jobs(spark, sf_dir), _requests(spark, sf_dir))
    return after.select("run_id", "id", "state", "error")


def retry_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    after, _, _ = queue.retry_failed(jobs(spark, sf_dir), runs(spark, sf_dir), "r1", NOW)
    return after.select("run_id", "id", "state", "attempts", "error")


def merge_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("run_id"), F.when(F.col("l_linestatus") == "F", S.DONE).otherwise(S.PENDING).alias("state"))
    return queue.merge_ready(lines)


def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return scope.latest(e, ["user_id"], "ts").select("user_id", "event_id")


def sequential_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbering.numbered(_table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "id")


def elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", X.elapsed(F.unix_seconds(F.col("ts").cast("timestamp")), F.lit(NOW * 1000)).alias("elapsed"))


def progress_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.progress(summary.summary(jobs(spark, sf_dir), runs(spark, sf_dir)), NOW * 1000)


# ---- archives


def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive for each lang and source, with a member for each document, built and read again."""
    docs = _table(spark, sf_dir, "documents")
    book = F.concat_ws("-", F.coalesce("lang", F.lit("none")), F.coalesce("source", F.lit("none")))
    members = docs.select(book.alias("book"), F.concat(F.lit("text/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".txt")).alias("member"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    marks = members.select("book").distinct().select("book", F.lit("mimetype").alias("member"), F.lit("application/epub+zip").cast("binary").alias("content"))
    folder = scratch.folder(spark, "members")
    # as files are named: any characters that a book's name has
    archive.write_archives(members.unionByName(marks).withColumn("book", F.concat(F.url_encode("book"), F.lit(".epub"))), folder)
    name = F.url_decode(F.regexp_extract("book", r"([^/]*)\.epub$", 1))
    return archive.scan(spark, folder).select(name.alias("book"), "member", "ordinal", "stored", F.length("content").cast("long").alias("n_bytes"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (candidate_terms, tokenize_counts, text_sample, ordered_distinct, safe_name, language_code, json_config, even_sample, unknown_paths, selected_documents, member_set_diff, scope_assignment, state_summary, claim_next, claim_batch, fenced_complete, heartbeats, failed_jobs, retry_reset, merge_ready, latest_run, sequential_ids, elapsed, progress_line, archive_members)
}

_FLAGS_SQL = "SELECT d.doc_id AS path, d.doc_id IN (SELECT doc_id FROM labels) AS in_spine, d.source = 'src1' AS is_nav FROM documents d"
_COUNTS_SQL = f"""WITH {_JOBS_SQL}
SELECT run_id, count(*) AS total, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'leased') AS leased,
       count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'pending') AS pending,
       count(*) FILTER (state = 'failed' AND attempts < {_LIMIT_SQL}) AS retryable FROM jobs GROUP BY run_id"""
_ELAPSED_SQL = "CASE WHEN s >= 3600 THEN CAST(s // 3600 AS VARCHAR) || 'h ' || CAST(s % 3600 // 60 AS VARCHAR) || 'm ' || CAST(s % 60 AS VARCHAR) || 's' WHEN s >= 60 THEN CAST(s // 60 AS VARCHAR) || 'm ' || CAST(s % 60 AS VARCHAR) || 's' ELSE CAST(s AS VARCHAR) || 's' END"

ORACLES: dict[str, str] = {
    "candidate_terms": candidates_sql("documents", None, 200, 1),
    "tokenize_counts": f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_distinct FROM (SELECT doc_id, {_TOKENS_SQL} AS t FROM documents)",
    "text_sample": r"SELECT doc_id, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 1000) AS sample FROM documents",
    "ordered_distinct": r"""
SELECT conv_id, turn, coalesce(string_agg(w, ' ' ORDER BY i), '') AS words FROM (
  SELECT conv_id, turn, w, min(i) AS i FROM (
    SELECT conv_id, turn, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM (SELECT conv_id, turn, string_split_regex(coalesce(text, ''), '[ \t\n\r]+') AS t FROM conversations))
  GROUP BY ALL) WHERE w <> '' GROUP BY conv_id, turn""",
    "safe_name": r"SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}._-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'book') AS name FROM documents",
    "language_code": "SELECT doc_id, CASE lang WHEN 'en' THEN 'en-US' WHEN 'fr' THEN 'fr' WHEN 'de' THEN 'de' END AS code, lang || '-latn-' || upper(lang) AS normal FROM documents",
    "json_config": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, props AS found FROM events",
    "even_sample": """
WITH n AS (SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS k FROM documents)
SELECT doc_id, lang FROM n WHERE n <= 6 OR k IN (SELECT CAST(round_even(i * (n - 1) / 5.0, 0) AS INTEGER) FROM (SELECT unnest([0, 1, 2, 3, 4, 5]) AS i))""",
    "unknown_paths": "SELECT DISTINCT doc_id AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "selected_documents": "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "member_set_diff": """
WITH a AS (SELECT DISTINCT lang AS book, source AS member FROM documents),
b AS (SELECT lang AS book, source AS member FROM documents WHERE lang <> 'de' AND source NOT IN ('src1', 'src2')
      UNION SELECT 'q' || CAST(quality AS VARCHAR), 't' || CAST(toxic AS VARCHAR) FROM labels)
SELECT book, member, 'left' AS side FROM a ANTI JOIN b USING (book, member) UNION ALL SELECT book, member, 'right' AS side FROM b ANTI JOIN a USING (book, member)""",
    "scope_assignment": f"""
SELECT path, CASE WHEN path IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'translate' WHEN path IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'keep'
       WHEN in_spine OR is_nav THEN 'translate' ELSE 'keep' END AS scope FROM ({_FLAGS_SQL})""",
    "state_summary": f"""
SELECT run_id, 'running' AS state, 'pending' AS merge_state, 'test/' || run_id AS model, 'high' AS thinking, CASE run_id WHEN 'r2' THEN 4 ELSE 1 END AS workers,
       {_LIMIT_SQL} AS max_attempts, total, done, leased, failed, pending, retryable, run_id = 'r3' AS cancel_requested FROM ({_COUNTS_SQL})""",
    "claim_next": _claims_sql(1),
    "claim_batch": _claims_sql(25),
    "fenced_complete": f"""WITH {_JOBS_SQL}
SELECT run_id, id, CASE WHEN {_FENCE_SQL} THEN 'done' ELSE state END AS state, CASE WHEN NOT ({_FENCE_SQL}) THEN worker_id END AS worker_id,
       CASE WHEN NOT ({_FENCE_SQL}) THEN lease_until END AS lease_until, attempts FROM jobs""",
    "heartbeats": _HEARTBEAT_SQL,
    "failed_jobs": f"WITH {_JOBS_SQL} SELECT run_id, id, CASE WHEN {_FENCE_SQL} THEN 'failed' ELSE state END AS state, CASE WHEN {_FENCE_SQL} THEN 'bad' WHEN state = 'failed' THEN 'error' END AS error FROM jobs",
    "retry_reset": f"WITH {_JOBS_SQL} SELECT run_id, id, CASE WHEN run_id = 'r1' AND state = 'failed' THEN 'pending' ELSE state END AS state, CASE WHEN run_id = 'r1' AND state = 'failed' THEN 0 ELSE attempts END AS attempts, CASE WHEN run_id <> 'r1' AND state = 'failed' THEN 'error' END AS error FROM jobs",
    "merge_ready": "SELECT CAST(l_orderkey AS VARCHAR) AS run_id, bool_and(l_linestatus = 'F') AS ready FROM lineitem GROUP BY l_orderkey",
    "latest_run": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "sequential_ids": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS id FROM events",
    "elapsed": f"SELECT event_id, {_ELAPSED_SQL} AS elapsed FROM (SELECT event_id, greatest(0, {NOW} - CAST(floor(epoch(ts)) AS BIGINT)) AS s FROM events)",
    "progress_line": f"""
SELECT run_id, CASE WHEN run_id = 'r3' THEN 'EPUB cancellation requested · ' || done || '/' || total
       ELSE 'EPUB translating · ' || done || '/' || total || ' complete · ' || leased || ' active · ' || failed || ' failed · 1h 2m 5s' END AS line FROM ({_COUNTS_SQL})""",
    "archive_members": """
WITH m AS (
  SELECT coalesce(lang, 'none') || '-' || coalesce(source, 'none') AS book, 'text/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.txt' AS member, strlen(coalesce(text, '')) AS n FROM documents),
a AS (SELECT book, member, n FROM m UNION ALL SELECT DISTINCT book, 'mimetype', 20 FROM m)
SELECT book, member, CAST(row_number() OVER (PARTITION BY book ORDER BY member <> 'mimetype', member) - 1 AS INTEGER) AS ordinal, member = 'mimetype' AS stored, n AS n_bytes FROM a""",
}
