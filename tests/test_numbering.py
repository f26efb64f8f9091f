"""Numbers within groups, large groups among small ones."""

import collections
import statistics

import pytest
from pyspark.sql import functions as F

from quillflow import schemas as S
from quillflow.operators import numbering, queue, sampling


@pytest.fixture
def many_ranges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def skewed(spark, n=6000):
    """Nine in ten rows are of one group; a null group and many small ones."""
    return spark.range(n).select(F.when(F.col("id") % 10 != 0, "big").when(F.col("id") % 20 == 0, F.concat(F.lit("s"), F.col("id") % 140)).alias("g"), (F.xxhash64("id") % 1000).alias("k"), "id", F.lit(7).alias("_n"))


def plain(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["g"]].append((r["k"], r["id"]))
    return {(g, i): n for g, x in by.items() for n, (_, i) in enumerate(sorted(x), 1)}


def test_numbers_in_skewed_groups(many_ranges):
    rows = skewed(many_ranges)
    got = numbering.numbered(rows, ["g"], ["k", "id"], "place").collect()
    assert {(r["g"], r["id"]): r["place"] for r in got} == plain(rows.collect()) and len(got) == 6000
    assert got[0].asDict().keys() == {"g", "k", "id", "_n", "place"}


def test_no_range_holds_a_large_group(many_ranges, monkeypatch):
    laid = {}
    real = numbering.staged
    monkeypatch.setattr(numbering, "staged", lambda df, label: laid.setdefault(label, real(df, label)))
    numbering.numbered(skewed(many_ranges, 60_000), ["g"], ["k", "id"], "place")
    sizes = [r["count"] for r in laid["ranges"].groupBy(F.shiftright("_at", 33)).count().collect()]
    assert len(sizes) == 12 and max(sizes) < 2 * statistics.median(sizes)
    assert laid["pieces"].count() <= 2 * len(sizes)


def test_numbers_without_groups_and_of_nothing(many_ranges):
    rows = skewed(many_ranges, 500)
    assert [r["id"] for r in numbering.numbered(rows.select("k"), [], ["k"]).orderBy("id").collect()] == list(range(1, 501))
    assert numbering.numbered(rows.limit(0), ["g"], ["k"], "n").collect() == [] and numbering.numbered(rows.limit(0), [], ["k"], "n").collect() == []
    one = numbering.numbered(rows.select(F.lit(1).alias("g"), F.lit(2).alias("k")), ["g"], ["k"])  # all alike
    assert sorted(r["id"] for r in one.collect()) == list(range(1, 501))


def test_jobs_of_a_run_with_nearly_all_rows(many_ranges):
    new = many_ranges.range(3000).select(F.when(F.col("id") % 10 == 0, F.concat(F.lit("r"), F.col("id") % 7)).otherwise("big").alias("run_id"), F.lit("d").alias("xhtml_path"), F.array(F.lit(1), F.col("id").cast("int")).alias("locator"), F.lit("s").alias("source"))
    made = queue.add_jobs(many_ranges.createDataFrame([], S.JOBS), new).collect()
    by = collections.defaultdict(list)
    for r in made:
        by[r["run_id"]].append((r["locator"], r["id"]))
    assert all([i for _, i in sorted(x)] == list(range(1, len(x) + 1)) for x in by.values()) and len(by["big"]) == 2700


def test_even_samples_of_all_rows_and_of_null_groups(many_ranges):
    docs = many_ranges.range(100).select(F.col("id").alias("pos"), F.when(F.col("id") < 20, "a").alias("book"))
    assert sorted(r["pos"] for r in sampling.even_sample(docs, 3).collect()) == [0, 50, 99]
    assert sorted((r["book"] or "", r["pos"]) for r in sampling.even_sample(docs, 2, group="book").collect()) == [("", 20), ("", 99), ("a", 0), ("a", 19)]


def exchanges(rows):
    """The shuffles of a plan, as text."""
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "Exchange" in x and "BroadcastExchange" not in x]


def test_rows_of_few_groups_move_once(many_ranges, monkeypatch):
    rows = skewed(many_ranges)
    assert exchanges(numbering.numbered(rows, ["g"], ["k", "id"], "place")) == []  # past the staged ranges
    monkeypatch.setattr(numbering, "FEW", 3)
    got = numbering.numbered(rows, ["g"], ["k", "id"], "place")
    assert exchanges(got) and {(r["g"], r["id"]): r["place"] for r in got.collect()} == plain(rows.collect())


def test_jobs_do_not_move_for_a_few_claims_and_answers(many_ranges, tmp_path):
    new = many_ranges.range(400).select(F.concat(F.lit("r"), F.col("id") % 3).alias("run_id"), F.lit("d").alias("xhtml_path"), F.array(F.col("id").cast("int")).alias("locator"), F.lit("s").alias("source"))
    queue.add_jobs(many_ranges.createDataFrame([], S.JOBS), new).write.parquet(f"{tmp_path}/jobs")
    jobs = many_ranges.read.schema(S.JOBS).parquet(f"{tmp_path}/jobs")
    runs = many_ranges.createDataFrame([(f"r{k}", False) for k in range(3)], "run_id string, cancel_requested boolean").withColumn("config", F.lit(None).cast(S.CONFIG))
    waiting = many_ranges.createDataFrame([(f"r{k}", f"w{n}", n) for k in range(3) for n in range(2)], "run_id string, worker_id string, turn int")
    after, claims = queue.claim(jobs, runs, waiting, 100, 2)
    assert exchanges(after) == exchanges(claims) == []
    answers = claims.select("run_id", "id", "worker_id", "lease_token", F.lit("x").alias("result"))
    twice = answers.unionByName(answers.withColumn("result", F.lit("b"))).unionByName(answers.withColumn("lease_token", F.lit("other")))
    done, outcome = queue.complete(after, twice)
    assert exchanges(done) == []
    rows = done.collect()
    assert len(rows) == 400 and sorted((r["run_id"], r["id"], r["result"]) for r in rows if r["state"] == S.DONE) == [(f"r{k}", n, "b") for k in range(3) for n in (1, 2)]
    assert sorted((r["lease_token"] != "other", r["accepted"]) for r in outcome.collect()) == [(False, False)] * 6 + [(True, True)] * 12
