"""Translators that are slow, fail now and then, or answer nonsense."""

import threading
import time

from quillflow import schemas as S
from quillflow.operators import queue, translate

CLAIMS = "run_id string, id bigint, source string, worker_id string, lease_token string"


def claims(spark, sources, parts=2):
    return spark.createDataFrame([("r", k, s, "w", f"t{k}") for k, s in enumerate(sources, 1)], CLAIMS).repartition(parts)


def moody(markup):
    """Says no to b for ever, to c once in each process, and answers d wrongly."""
    if ">b<" in markup:
        raise RuntimeError("no " * 3000)
    if ">c<" in markup and not hasattr(threading, "_moody"):
        threading._moody = True
        raise TimeoutError("later")
    return "<q/>" if ">d<" in markup else markup.replace(">a<", ">A<")


def test_a_failing_block_fails_alone(spark):
    rows = claims(spark, ["<p>a</p>", "<p>b</p>", "<p>c</p>", "<p>d</p>", "<p", None], 1)
    got = {r["id"]: r for r in translate.translated(rows, moody, tries=3, pause=0.0).collect()}
    assert [got[k]["result"] for k in range(1, 7)] == ["<p>A</p>", None, "<p>c</p>", None, None, None]
    assert got[2]["error"].startswith("translator: no no") and len(got[2]["error"]) == S.ERROR_LIMIT and got[2]["calls"] == 3 and got[3]["calls"] == 2
    assert [got[k]["error"] for k in (4, 5)] == ["structure changed", "unclosed token: line 1, column 0"] and got[6]["error"] and got[1]["lease_token"] == "t1"


def test_jobs_are_settled_by_the_answers(spark):
    jobs = spark.createDataFrame([("r", k, "x", [k], s, None, S.LEASED, "w", f"t{k}", 10**6, 1, None) for k, s in enumerate(["<p>a</p>", "<p>b</p>"], 1)] + [("r", 3, "x", [3], "<p>c</p>", None, S.PENDING, None, None, None, 0, None)], S.JOBS)
    answers = translate.translated(claims(spark, ["<p>a</p>", "<p>b</p>"]), moody, tries=1)
    after = {r["id"]: (r["state"], r["result"], (r["error"] or "")[:13]) for r in translate.settled(jobs, answers).collect()}
    assert after == {1: (S.DONE, "<p>A</p>", ""), 2: (S.FAILED, None, "translator: n"), 3: (S.PENDING, None, "")}
    stale = answers.selectExpr("run_id", "id", "worker_id", "'old' as lease_token", "result", "error")
    assert {r["state"] for r in translate.settled(jobs, stale).where("id < 3").collect()} == {S.LEASED}


def slow(markup):
    time.sleep(0.1)
    return markup


def test_calls_run_side_by_side_within_a_bound(spark):
    rows = claims(spark, ["<p>x</p>"] * 40, 1)
    translate.translated(rows.limit(1)).collect()
    began = time.time()
    assert translate.translated(rows, slow, threads=8).where("result is not null").count() == 40
    assert 0.5 <= time.time() - began < 3.5  # 4 seconds one by one
