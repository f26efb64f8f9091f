"""The jobs: growing input, reruns, lost commits, settings and command lines."""

import collections
import hashlib
import json
import os
import re
import subprocess
import sys
from pathlib import Path

import pytest

from jobs import block_backlog, queries, term_bases
from jobs.common import default_config, read_config

ROOT = Path(__file__).resolve().parents[1]
SCHEMA = "doc_id long, text string, lang string, extra string, block string"
FIRST = [(4, "One line\n\n  one   LINE \nOne\tline ", "en"), (2, "One line\nDeux", "en"), (3, "One line", "fr"), (1, None, None), (None, "No id\n***\n42", " ")]
SECOND = [(1, "One line\nThree lines\nThree lines", "en"), (6, "Neu", "de"), (7, "One line", "fr"), (8, "", "en")]


def put(spark, folder, rows, parts=1):
    spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(parts).write.mode("append").parquet(folder)


def blocks_of(rows):
    found = collections.defaultdict(list)
    for doc_id, text, lang in rows:
        for line in (text or "").split("\n"):
            block = re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ")
            if re.search(r"[^\W_]", block):
                found[((lang or "").strip() or "und", block)].append(doc_id)
    return found


def seen(spark, at):
    return sorted((r["batch"], r["lang"], r["block"], r["first_doc"], r["copies"]) for r in block_backlog.read(spark, f"{at}/backlog").collect())


def go(spark, at, **settings):
    return block_backlog.run(spark, f"{at}/documents", f"{at}/backlog", f"{at}/checkpoint", default_config("block_backlog") | settings)


def expected(batch, rows, known=()):
    return [(batch, lang, block, min((d for d in ids if d is not None), default=None), len(ids)) for (lang, block), ids in blocks_of(rows).items() if (lang, block) not in known]


def test_backlog_takes_only_what_is_new(spark, tmp_path):
    put(spark, f"{tmp_path}/documents", FIRST, 2)
    assert go(spark, tmp_path) == 1
    first = sorted(expected(0, FIRST))
    assert seen(spark, tmp_path) == first
    assert go(spark, tmp_path) == 0 and seen(spark, tmp_path) == first
    put(spark, f"{tmp_path}/documents", SECOND)
    assert go(spark, tmp_path) == 1
    both = sorted(first + expected(1, SECOND, blocks_of(FIRST)))
    assert seen(spark, tmp_path) == both and go(spark, tmp_path) == 0
    ids = {r["block"]: r["block_id"] for r in block_backlog.read(spark, f"{tmp_path}/backlog").collect()}
    assert all(hashlib.sha256(b.encode()).hexdigest() == i for b, i in ids.items())


def test_a_batch_whose_commit_was_lost_is_written_again_alike(spark, tmp_path):
    put(spark, f"{tmp_path}/documents", FIRST)
    go(spark, tmp_path)
    put(spark, f"{tmp_path}/documents", SECOND)
    go(spark, tmp_path)
    before = seen(spark, tmp_path)
    for lost in (tmp_path / "checkpoint/commits").glob("*1*"):
        lost.unlink()
    assert go(spark, tmp_path) == 1 and seen(spark, tmp_path) == before


def test_division_into_batches_changes_no_block(spark, tmp_path):
    put(spark, f"{tmp_path}/documents", FIRST + SECOND, 4)
    assert go(spark, tmp_path, max_files_per_batch=1) > 1
    assert sorted((x[1], x[2]) for x in seen(spark, tmp_path)) == sorted(blocks_of(FIRST + SECOND))


def test_backlog_settings_and_nothing_to_read(spark, tmp_path):
    put(spark, f"{tmp_path}/documents", [(1, None, "en"), (2, " \n", "de")])
    assert go(spark, tmp_path) == 1 and seen(spark, tmp_path) == []
    put(spark, f"{tmp_path}/documents", FIRST + SECOND)
    go(spark, tmp_path, languages=["en"], least_words=2)
    assert [x[1:3] for x in seen(spark, tmp_path)] == sorted(k for k in blocks_of(FIRST + SECOND) if k[0] == "en" and " " in k[1])


TEXTS = [
    (1, "We saw New York and Old Town in May", "en"),
    (2, "New York is far from Old Town", "en"),
    (3, "new york, New York", "en"),
    (4, "Bad Words Here and New York", "en"),
    (5, "Im Alten Land, Neue Welt", "de"),
    (6, "Neue Welt", "de"),
    (7, None, None),
    (7, "Sin Idioma", None),
]


def terms(spark, at, **settings):
    term_bases.run(spark, f"{at}/documents", f"{at}/terms", f"{at}/labels", default_config("term_bases") | settings)
    return sorted((r["lang"], r["place"], r["term"], r["frequency"], r["documents"], tuple(r["contexts"])) for r in term_bases.read(spark, f"{at}/terms").collect())


def test_term_bases(spark, tmp_path):
    put(spark, f"{tmp_path}/documents", TEXTS, 3)
    spark.createDataFrame([(4, 1), (4, 0), (1, 0), (99, 1), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels")
    got = terms(spark, tmp_path)
    assert got == [("de", 1, "Neue Welt", 2, 2, ("Neue Welt",) * 2), ("en", 1, "New York", 3, 3, ("New York",) * 3), ("en", 2, "Old Town", 2, 3, ("Old Town",) * 2)]
    assert terms(spark, tmp_path) == got
    files = {str(p) for p in (tmp_path / "terms/lang=de").glob("*.parquet")}
    # other languages stay as they are; all documents count where toxic ones aren't skipped
    again = terms(spark, tmp_path, languages=["en"], skip_toxic=False, limit=1)
    assert again == [got[0], ("en", 1, "New York", 4, 4, ("New York",) * 3)]
    assert files == {str(p) for p in (tmp_path / "terms/lang=de").glob("*.parquet")}
    assert ("und", 1, "Sin Idioma", 1, 2, ("Sin Idioma",)) in terms(spark, tmp_path, least_documents=1)


def test_registered_jobs_leave_settings_alone(spark, tmp_path):
    put(spark, f"{tmp_path}/documents.parquet", TEXTS)
    spark.createDataFrame([(4, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    before = spark.sparkContext.getConf().getAll(), {r["key"]: r["value"] for r in spark.sql("SET").collect()}
    rows = [queries.QUERIES[name](spark, str(tmp_path)).count() for name in ("job1_block_backlog", "job1_block_backlog", "job2_term_bases")]
    assert rows == [len(blocks_of(TEXTS))] * 2 + [3]
    assert (spark.sparkContext.getConf().getAll(), {r["key"]: r["value"] for r in spark.sql("SET").collect()}) == before
    assert set(queries.QUERIES) == set(queries.ORACLES)


def test_unknown_settings_are_errors(spark, tmp_path):
    (tmp_path / "c.json").write_text('{\n "least_wards": 2}')
    with pytest.raises(ValueError, match="least_wards"):
        read_config(spark, "block_backlog", f"file://{tmp_path}/c.json")


@pytest.mark.parametrize("job", ["block_backlog", "term_bases"])
def test_command_lines(spark, tmp_path, job):
    put(spark, f"{tmp_path}/documents", FIRST + TEXTS)
    (tmp_path / "config.json").write_text(json.dumps({"languages": ["en"]}))
    out = {"block_backlog": ["--backlog", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/checkpoint"], "term_bases": ["--terms", f"{tmp_path}/out"]}[job]
    env = {**os.environ, "PYTHONPATH": str(ROOT), "SPARK_LOCAL_IP": "127.0.0.1"}
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", "--documents", f"{tmp_path}/documents", *out, "--config", f"{tmp_path}/config.json"], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert re.search(r"read \d+ documents.* wrote [1-9]\d* ", done.stderr)
    assert {p.name for p in (tmp_path / "out").rglob("lang=*")} == {"lang=en"}


def test_phrases_by_runs_are_those_of_all_words(spark):
    """What is cut into words are runs in upper case only; what a document repeats is one before it is folded."""
    from pyspark.sql import functions as F

    from quillflow.functions import text as X
    from quillflow.operators.candidates import phrases

    texts = ["Alpha Beta--Gamma d'Eau L'Eau-Vive X", "a-Bee Cee. Dee 7Up Up-7\nÉtat Ünder \U00010400\U00010401 \U00010400b", "see https://A.com/B Cee WWW.Dee Eff Gee", "The Old The Man OF War", "Ⅳ Ⅴ Roman Ⓐ Circled -Dash 'Quote ’Tick", "Red Fox RED FOX Red Fox", "x’Y Zed ’Y Zed--", None, "", "One", "ǅur Ǆur Ab9c Ⅷ9 9A Bb"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_index int, text string")
    words = rows.select("doc_index", X.tokens(F.col("text")).alias("t")).select("doc_index", "t", F.transform("t", lambda t: ~X.blocks_term(t)).alias("ok")).where("t is not null").collect()
    first = {}
    for r in words:
        for i in range(len(r["t"])):
            for n in (2, 3, 4):
                if i + n <= len(r["t"]) and all(r["ok"][i : i + n]):
                    phrase = " ".join(r["t"][i : i + n])
                    first.setdefault((r["doc_index"], phrase.casefold()), phrase)
    made = phrases(rows)
    assert {(r["document"], r["key"]): r["phrase"] for r in made.collect()} == first and len(first) > 15
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan  # sorts of all places, before
