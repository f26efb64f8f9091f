"""From raw documents to packed token sequences: five stages, each written and read again.

Every stage but the last returns the columns of documents.

1. language_id: documents whose language the models reject go: those without a letter, and those
   further from every language than its own texts lie.
2. simhash: of each group of near-duplicates the document of least doc_id stays; rows of the group
   that share that doc_id all stay. A doc_id with several texts loses only the rows whose own group
   has a smaller one. Documents with a null doc_id stay.
3. suffix_dedup: passages of 50 bytes and more that an earlier document has are cut out; n_chars
   follows. A document of which nothing is left goes.
4. mix_sources: each row comes as often as the mix takes it.
5. pack: token sequences of at most 4096 ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillflow.llm import lang_id, mixing, packing, simhash, suffix_dedup
from quillflow.llm.common import documents, staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = lang_id.learn(docs.select("doc_id", "text", "lang"))
    return lang_id.identify(docs, model, COLUMNS).where("not rejected").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named = staged(simhash.near_duplicates(docs), "pipeline-fingerprints")
    ids = named.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.expr("doc_id <> component_id")).alias("gone"), F.max(F.expr("doc_id = component_id")).alias("stays"))
    left = docs.join(ids.where("gone"), "doc_id", "left_anti").select(*COLUMNS)
    both = staged(ids.where("gone and stays").select("doc_id"), "pipeline-both")  # ids whose rows differ in their fate
    if both.isEmpty():
        return left
    rows = simhash.fingerprints(docs.join(both, "doc_id"), keep=COLUMNS[1:])
    own = named.where("doc_id = component_id").join(both, "doc_id").select("doc_id", "fp").distinct()
    return left.unionByName(rows.join(own, ["doc_id", "fp"]).select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.repeats(docs, keep=("lang", "source"), with_text=True)
    return cut.where("n_bytes = 0 or n_removed < n_bytes").select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("simhash", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("mix_sources", target_mix),
    ("pack", pack),
]

#: Language models, fingerprints and token ids are not for SQL: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
