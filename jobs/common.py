"""What the jobs share: configs, the log and the session of a command line."""

from __future__ import annotations

import json
import logging
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("quillflow.jobs")


def default_config(job: str) -> dict:
    return json.loads(Path(__file__).with_name(f"{job}.json").read_text())


def read_config(spark: SparkSession, job: str, path: str | None) -> dict:
    """The job's own config, with the values of the one at path in place of its own."""
    found = default_config(job)
    if path:
        given = json.loads("\n".join(r["value"] for r in spark.read.text(path).collect()))
        if unknown := sorted(set(given) - set(found)):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        found |= given
    return found


def written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A job's output; empty where nothing has been written yet, and so there is no folder."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def session(name: str) -> SparkSession:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).getOrCreate()
