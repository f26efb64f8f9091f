"""A backlog of distinct text blocks to translate, kept up as documents arrive.

    python -m jobs.block_backlog --documents FOLDER --backlog FOLDER --checkpoint FOLDER [--config FILE]

Documents (doc_id, text, lang) are Parquet files in a folder, or under a pattern, that grow in number. Each run takes the files that
are new since the last one, cuts their texts into blocks (lines, white space collapsed), and adds those
that the backlog doesn't have: a block that stands in many books is translated once. A block's id is the
digest of its text, so neither the order of files nor their division into runs changes which blocks
there are. first_doc and copies are those of the batch that brought the block.

The high-water mark is the stream's checkpoint. A batch writes its own partitions (batch, lang) by
dynamic overwrite and looks for known blocks in earlier batches only: one that is run again, because it
was lost before the checkpoint knew of it, writes the same rows in the same place.

A null or blank lang counts as und; null texts and blocks without a word bring nothing.

Settings: least_words, of a block that counts; languages, all if empty; max_files_per_batch, no limit if 0.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, read_config, session, written
from quillflow.functions import text as X

DOCUMENTS = "doc_id bigint, text string, lang string"
BACKLOG = "block_id string, block string, n_words int, first_doc bigint, copies bigint, batch bigint, lang string"
_SPACE = r"[\x20\x09-\x0D]+"


def blocks(docs: DataFrame, config: dict) -> DataFrame:
    """lang, block_id, block, n_words, first_doc, copies of each distinct block of docs."""
    lang = F.coalesce(F.nullif(F.trim("lang"), F.lit("")), F.lit("und"))
    line = F.explode(F.split("text", r"\n"))
    rows = docs.select("doc_id", lang.alias("lang"), line.alias("line"))
    if config["languages"]:
        rows = rows.where(F.col("lang").isin(config["languages"]))
    rows = rows.select("doc_id", "lang", F.trim(F.regexp_replace("line", _SPACE, " ")).alias("block")).where("block <> ''")
    once = rows.groupBy("lang", "block").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"))
    sized = once.withColumn("n_words", F.size(X.tokens(F.col("block")))).where(F.col("n_words") >= max(1, config["least_words"]))
    return sized.withColumn("block_id", F.sha2("block", 256))


def take(batch: DataFrame, batch_id: int, backlog: str, config: dict) -> None:
    """Add what a batch of documents brings."""
    new = blocks(batch, config)
    if batch_id:
        known = read(batch.sparkSession, backlog).where(F.col("batch") < batch_id)
        new = new.join(known.select("lang", "block_id"), ["lang", "block_id"], "left_anti")
    rows = new.select("block_id", "block", "n_words", "first_doc", "copies", F.lit(batch_id).cast("bigint").alias("batch"), "lang")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "lang").parquet(backlog)
    wrote = read(batch.sparkSession, backlog).where(F.col("batch") == batch_id)
    log.info("batch %d: read %d documents, wrote %d new blocks to %s", batch_id, batch.count(), wrote.count(), backlog)  # both by files' row counts


def run(spark: SparkSession, documents: str, backlog: str, checkpoint: str, config: dict) -> int:
    """Take all documents that are new, in one batch or several, and end; the number of batches."""
    source = spark.readStream.schema(DOCUMENTS)
    if config["max_files_per_batch"]:
        source = source.option("maxFilesPerTrigger", config["max_files_per_batch"])
    took = []

    def each(batch: DataFrame, batch_id: int) -> None:
        take(batch, batch_id, backlog, config)
        took.append(batch_id)

    query = source.parquet(documents).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("documents of %s: %d new batches", documents, len(took))
    return len(took)


def read(spark: SparkSession, backlog: str) -> DataFrame:
    return written(spark, backlog, BACKLOG)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("documents", "backlog", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config")
    given = parser.parse_args()
    spark = session("block-backlog")
    try:
        run(spark, given.documents, given.backlog, given.checkpoint, read_config(spark, "block_backlog", given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
