"""The jobs as registered queries: each run twice over the whole tables into a new folder, then its output.

The SQL says what the output holds after any number of runs over the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobs import block_backlog, term_bases
from jobs.common import default_config
from quillflow import catalogue, scratch


def job1_block_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch.folder(spark, "job1")
    source = f"{sf_dir}/documents.parquet*"  # a pattern: streams take a single file by nothing else
    for _ in range(2):
        block_backlog.run(spark, source, f"{at}/backlog", f"{at}/checkpoint", default_config("block_backlog"))
    return block_backlog.read(spark, f"{at}/backlog")


def job2_term_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch.folder(spark, "job2")
    for _ in range(2):
        term_bases.run(spark, f"{sf_dir}/documents.parquet", f"{at}/terms", f"{sf_dir}/labels.parquet", default_config("term_bases"))
    return term_bases.read(spark, f"{at}/terms")


QUERIES = {f.__name__: f for f in (job1_block_backlog, job2_term_bases)}

_LANG = "coalesce(nullif(trim(lang), ''), 'und')"
_BACKLOG_SQL = rf"""
WITH lines AS (SELECT doc_id, {_LANG} AS lang, unnest(string_split(text, chr(10))) AS line FROM documents),
once AS (
  SELECT lang, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')) AS block, min(doc_id) AS first_doc, count(*) AS copies FROM lines GROUP BY ALL HAVING block <> ''),
sized AS (SELECT *, CAST(len(t) AS INTEGER) AS n_words FROM (SELECT *, {catalogue._TOKENS_SQL.replace("coalesce(text, '')", "block")} AS t FROM once))
SELECT sha256(block) AS block_id, block, n_words, first_doc, copies, CAST(0 AS BIGINT) AS batch, lang FROM sized WHERE n_words >= 1"""

_TERMS_SQL = catalogue.candidates_sql(f"(SELECT doc_id, text, {_LANG} AS lang FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL))", "lang", 100, 2)
ORACLES = {"job1_block_backlog": _BACKLOG_SQL, "job2_term_bases": _TERMS_SQL}
