"""Term bases: for each language of a collection, ranked glossary candidates to agree on before translating.

    python -m jobs.term_bases --documents PATH --terms FOLDER [--labels PATH] [--config FILE]

Documents (doc_id, text, lang) are read whole, those that labels (doc_id, toxic) call toxic left out.
Each language's capitalised phrases of two to four words are counted, ranked and written with their
first contexts, as terms (lang), one partition a language. A run replaces the partitions of the
languages that it finds, by dynamic overwrite, and leaves others; run again on the same documents it
writes the same rows.

A null or blank lang counts as und; null texts bring nothing; of documents that share an id a phrase
counts once.

Settings: limit, terms of a language; least_documents that hold a term; languages, all if empty; skip_toxic.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, read_config, session, written
from quillflow.operators.candidates import glossary_candidates
from quillflow.operators.sampling import excluded

TERMS = "place int, term string, frequency bigint, documents bigint, contexts array<string>, lang string"


def run(spark: SparkSession, documents: str, terms: str, labels: str | None, config: dict) -> None:
    docs = spark.read.parquet(documents).select("doc_id", "text", F.coalesce(F.nullif(F.trim("lang"), F.lit("")), F.lit("und")).alias("lang"))
    if config["languages"]:
        docs = docs.where(F.col("lang").isin(config["languages"]))
    if labels and config["skip_toxic"]:
        docs = excluded(docs, spark.read.parquet(labels).where("toxic = 1"), "doc_id")
    sizes = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"))
    found = glossary_candidates(docs, config["limit"], "doc_id", group=["lang"], least_documents=config["least_documents"])
    rows = found.join(sizes, "lang").select("place", "term", "frequency", "documents", "contexts", "lang")
    rows.repartition("lang").sortWithinPartitions("lang", "place").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lang").parquet(terms)
    log.info("read %d documents of %s, wrote %d terms to %s", docs.count(), documents, read(spark, terms).count(), terms)


def read(spark: SparkSession, terms: str) -> DataFrame:
    return written(spark, terms, TERMS)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("documents", "terms"):
        parser.add_argument(f"--{name}", required=True)
    for name in ("labels", "config"):
        parser.add_argument(f"--{name}")
    given = parser.parse_args()
    spark = session("term-bases")
    try:
        run(spark, given.documents, given.terms, given.labels, read_config(spark, "term_bases", given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
