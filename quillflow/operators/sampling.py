"""Evenly spaced samples and selections of documents, in document order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import numbered

SAMPLE = 6


def even_positions(n: Column, k: int) -> Column:
    """The k positions, from 0, that spread evenly over n; halves round to even."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (n - 1) / (k - 1)).cast("int"))


def even_sample(docs: DataFrame, k: int = SAMPLE, order: str = "pos", group: str | None = None) -> DataFrame:
    """All documents of a group if there are k or fewer, else k evenly spaced ones.

    k must be 2 or more: a single sample has no spacing.
    """
    if k < 2:
        raise ValueError("a sample takes two documents or more")
    by = [group] if group else []
    placed = numbered(docs, by, [order], "_at")
    sizes = placed.groupBy(*by).agg(F.max("_at").alias("_n"))
    same = F.col(f"d.{group}").eqNullSafe(F.col(f"s.{group}")) if group else F.col("d._one") == F.col("s._one")
    joined = placed.withColumn("_one", F.lit(1)).alias("d").join(sizes.withColumn("_one", F.lit(1)).alias("s"), same)
    kept = joined.where((F.col("s._n") <= k) | F.array_contains(even_positions(F.col("s._n"), k).cast("array<bigint>"), F.col("d._at") - 1))
    return kept.select(*[F.col(f"d.{c}") for c in docs.columns])


def selected(docs: DataFrame, paths: DataFrame, path: str = "path") -> DataFrame:
    """Documents whose path is among paths."""
    return docs.join(paths.select(path), path, "left_semi")


def excluded(docs: DataFrame, paths: DataFrame, path: str = "path") -> DataFrame:
    """Documents whose path is not among paths."""
    return docs.join(paths.select(path), path, "left_anti")


def unknown_paths(docs: DataFrame, paths: DataFrame, path: str = "path") -> DataFrame:
    """Paths that no document has."""
    return paths.select(path).join(docs.select(path), path, "left_anti").distinct()


def sample_documents(docs: DataFrame, paths: DataFrame, k: int = SAMPLE) -> DataFrame:
    """k documents of each book, or all of a book that has k or fewer."""
    wanted = paths.select("path").distinct()
    return even_sample(selected(docs, wanted), k, group="book")
