"""The commands over archives and stored runs; each gives a DataFrame, a dict or a plain value."""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import candidates as C
from ..operators import fragments, sampling
from ..operators.inspect import inspect
from ..operators.queue import job as find_job
from ..operators.summary import summary, summary_json
from ..operators.translate import translated as translate
from ..scratch import staged
from ..sources import archive
from .store import RunStore


def inspect_epub(spark: SparkSession, path: str) -> DataFrame:
    return inspect(archive.scan(spark, path), archive.package_members(spark, path))


def sample_epub(spark: SparkSession, path: str, paths: list[str], k: int = sampling.SAMPLE) -> DataFrame:
    return sampling.sample_documents(inspect_epub(spark, path), _paths(spark, paths), k)


def candidates(spark: SparkSession, samples: list[str], limit: int = C.LIMIT) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(samples)), "doc_index int, text string")
    return C.glossary_candidates(rows, limit)


def _paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.createDataFrame([(p, k) for k, p in enumerate(dict.fromkeys(paths))], "path string, doc_order int")


def prepare(spark: SparkSession, store_path: str, run_id: str, epub: str, config: dict[str, object], paths: list[str], now: int | None = None) -> dict:
    """A run with a job for each block of the selected documents; the archive's members and the glossary are kept beside it."""
    members = archive.members(spark, epub)
    if not paths:
        raise ValueError("at least one XHTML document must be selected")
    wanted = _paths(spark, paths)
    missing = sampling.unknown_paths(inspect(members), wanted).agg(F.min("path")).first()[0]
    if missing is not None:
        raise ValueError(f"selected document not found: {missing}")
    docs = members.join(F.broadcast(wanted), members["member"] == wanted["path"]).select("book", "path", "content", "doc_order")
    bad = fragments.malformed(docs).agg(F.min(F.concat_ws(": ", "xhtml_path", "error"))).first()[0]
    if bad is not None:
        raise ValueError(bad)
    blocks = fragments.extract(docs).join(wanted.withColumnRenamed("path", "xhtml_path"), "xhtml_path")
    new = blocks.select(F.lit(run_id).alias("run_id"), "xhtml_path", "locator", "source", "doc_order")
    if new.isEmpty():
        raise ValueError("no translatable XHTML blocks found")
    store = RunStore(spark, store_path)
    at = f"{store.path}/source-{run_id}"
    members.write.parquet(f"{at}/members")
    glossary = f"{at}/glossary"
    spark.createDataFrame([(str(config.get("glossary_text") or ""),)], "text string").write.parquet(glossary)
    store.create_run(run_id, {**config, "glossary_path": glossary, "selected_paths": list(dict.fromkeys(paths))}, now)
    store.add_jobs(new)
    return store.summary(run_id)


def run_summary(store: RunStore, run_id: str) -> DataFrame:
    return summary_json(summary(*store.read()).where(F.col("run_id") == run_id))


def claim(store: RunStore, run_id: str, workers: str | list[str], now: int | None = None) -> list[dict]:
    """Claimed jobs with their protected source and the glossary."""
    claims = [r.asDict() for r in store.claim(run_id, workers, now)]
    for c in claims:
        c["source"], _ = fragments.protect(c["source"], c["id"])
        c["glossary"] = store.spark.read.parquet(c["glossary_path"]).first()["text"] if c["glossary_path"] else ""
    return claims


def complete(store: RunStore, run_id: str, job_id: int, worker: str, token: str, translated: str, now: int | None = None) -> dict:
    source = find_job(store.read()[0], run_id, job_id).first()["source"]
    _, markers = fragments.protect(source, job_id)
    result = fragments.restore(translated.strip(), markers)
    fragments.check(source, result)
    return {"accepted": store.complete(run_id, job_id, worker, token, result, now), "job_id": job_id}


def merge(store: RunStore, run_id: str, now: int | None = None) -> str:
    """Put all results in place, build and verify the archive, and complete the run. An error fails the run."""
    try:
        return _merge(store, run_id, now)
    except Exception as e:
        store.mark_failed(run_id, str(e), now)
        raise


def _merge(store: RunStore, run_id: str, now: int | None) -> str:
    spark, (jobs, runs) = store.spark, store.read()
    counts = store.summary(run_id)
    if counts["cancel_requested"]:
        raise ValueError("run was cancelled")
    if not counts["total"] or counts["done"] != counts["total"]:
        raise ValueError("unfinished jobs")
    config = runs.where(F.col("run_id") == run_id).select("config.*").first()
    members = spark.read.parquet(f"{store.path}/source-{run_id}/members")
    name = members.select("book").first()["book"]
    results = jobs.where((F.col("run_id") == run_id) & (F.col("state") == "done")).select(F.lit(name).alias("book"), "xhtml_path", "locator", "result")
    changed = results.select("book", F.col("xhtml_path").alias("member")).distinct()
    docs = members.join(changed, ["book", "member"]).withColumnRenamed("member", "path")
    merged = staged(fragments.reassemble(docs, results, config["target_language_code"]).withColumnRenamed("path", "member"), "merged")
    bad = merged.where("error is not null").agg(F.min(F.concat_ws(": ", "member", "error"))).first()[0]
    if bad is not None:
        raise ValueError(bad)
    output = config["output_path"] or f"{store.path}/output-{run_id}/output.epub"
    folder, _, file = output.rpartition("/")
    whole = members.select("book", "member", "content").join(changed, ["book", "member"], "left_anti").unionByName(merged.drop("error"))
    archive.write_archives(whole.withColumn("book", F.lit(file)), folder or ".")
    checked = archive.verified_files(spark, output, members.select(F.lit(file).alias("name"), "member")).first()
    if checked is None or checked["error"] is not None:
        raise ValueError(checked["error"] if checked else "invalid EPUB archive")
    store.update_run(run_id, now, state="completed", merge_state="completed", output_path=output, error=None)
    return output


COMMANDS = ("inspect", "inspect-epub", "sample-epub", "sample", "candidates", "prepare", "summary", "claim", "heartbeat", "complete", "fail", "fail-run", "cancel", "clear-cancel", "retry", "claim-merge", "merge")


def run_command(spark: SparkSession, command: str, **given: object) -> str:
    """A command's outcome as one JSON value; an error as {"error": ...}."""
    try:
        return json.dumps(_outcome(spark, command, given), ensure_ascii=False, default=str)
    except Exception as e:
        return json.dumps({"error": str(e)}, ensure_ascii=False)


def _outcome(spark: SparkSession, command: str, g: dict) -> object:
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    if command in ("inspect", "inspect-epub"):
        return rows(inspect_epub(spark, g["epub"]).orderBy("book", "pos"))
    if command in ("sample", "sample-epub"):
        return rows(sample_epub(spark, g["epub"], g["paths"], g.get("count", sampling.SAMPLE)).orderBy("book", "pos"))
    if command == "candidates":
        return rows(candidates(spark, g["samples"], g.get("limit", C.LIMIT)))
    if command == "prepare":
        return prepare(spark, g["store"], g["run"], g["epub"], g["config"], g["paths"], g.get("now"))
    store, run, now = RunStore(spark, g["store"]), g["run"], g.get("now")
    if command == "summary":
        return json.loads(run_summary(store, run).first()["json"])
    if command == "claim":
        found = claim(store, run, g["worker"], now)
        return found[0] if found else None
    if command == "heartbeat":
        return {"accepted": store.heartbeat(run, g["job"], g["worker"], g["token"], now)}
    if command == "complete":
        return complete(store, run, g["job"], g["worker"], g["token"], g["translated"], now)
    if command == "fail":
        return {"accepted": store.fail(run, g["job"], g["worker"], g["token"], g["error"], now)}
    if command == "fail-run":
        return store.mark_failed(run, g["error"], now)
    if command == "cancel":
        return store.request_cancel(run, now)
    if command == "clear-cancel":
        return store.clear_cancel(run, now)
    if command == "retry":
        return {"reset": store.retry_failed(run, g.get("jobs"), now)}
    if command == "claim-merge":
        return {"accepted": store.try_claim_merge(run, g["worker"], now)}
    if command == "merge":
        return {"output": merge(store, run, now)}
    raise ValueError(f"unknown command: {command}")


def main(args: list[str]) -> int:
    """python -m quillflow.plans.commands COMMAND '{"argument": ...}'"""
    out = run_command(SparkSession.builder.getOrCreate(), args[0], **json.loads(args[1] if len(args) > 1 else "{}"))
    print(out)
    return int('"error"' in out[:9])


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
