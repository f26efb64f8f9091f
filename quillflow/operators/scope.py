"""Which documents to translate and which to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

TRANSLATE, KEEP = "translate", "keep"


def assign_scope(docs: DataFrame, translate: DataFrame, keep: DataFrame, path: str = "path") -> DataFrame:
    """docs with scope: translate wins over keep; the rest is translated if in the spine or navigation.

    Paths of the analysis that no document has are ignored.
    """
    wanted = translate.select(path, F.lit(True).alias("_t")).distinct()
    kept = keep.select(path, F.lit(True).alias("_k")).distinct()
    rest = F.when(F.coalesce("in_spine", F.lit(False)) | F.coalesce("is_nav", F.lit(False)), TRANSLATE).otherwise(KEEP)
    return docs.join(wanted, path, "left").join(kept, path, "left").withColumn("scope", F.when(F.col("_t"), TRANSLATE).when(F.col("_k"), KEEP).otherwise(rest)).drop("_t", "_k")


def scope_lists(scoped: DataFrame, group: str, order: str = "pos", path: str = "path") -> DataFrame:
    """group, translate, keep: one book's paths in document order."""
    own = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("scope") == s, F.struct(order, path)))), lambda x: x[path]).alias(s)
    return scoped.groupBy(group).agg(own(TRANSLATE), own(KEEP))


def scope_summary(language: Column, code: Column, translate: Column, keep: Column) -> Column:
    count = lambda label, paths: F.concat(F.lit(f"{label} "), F.size(paths), F.lit(": "), X.preview(paths))
    total = F.concat(F.lit("AI classified "), F.size(translate) + F.size(keep), F.lit(" XHTML documents; scope can be edited as one list."))
    return F.concat_ws("\n", F.concat(F.lit("Target: "), language, F.lit(" ("), code, F.lit(")")), count("Translate", translate), count("Keep", keep), total)


def edited_scope(edited: Column, known: Column, before: Column) -> Column:
    """The edited lines if all are known paths, else the selection as before."""
    paths = X.lines(edited)
    return F.when(F.size(F.array_except(paths, known)) > 0, before).otherwise(paths)


def first_unknown(edited: Column, known: Column) -> Column:
    """The first edited line that is no known path; null if all are."""
    return F.get(F.filter(X.lines(edited), lambda p: ~F.array_contains(known, p)), F.lit(0))


def latest(rows: DataFrame, group: list[str], at: str) -> DataFrame:
    """The row of each group with the greatest value of at; ties by all columns."""
    rest = [c for c in rows.columns if c not in group]
    best = rows.groupBy(*group).agg(F.max(F.struct(at, *[c for c in rest if c != at])).alias("_r")) if group else rows.agg(F.max(F.struct(at, *[c for c in rest if c != at])).alias("_r"))
    return best.select(*group, *[F.col(f"_r.{c}").alias(c) for c in rest])


def resolve_runs(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """asked (explicit, current, ...) with run: the explicit one, else the current one, else the stored one modified last.

    stored: run, modified. error says where an explicit run isn't stored.
    """
    known = stored.select(F.col("run").alias("explicit")).distinct().withColumn("_known", F.lit(True))
    last = stored.agg(F.max(F.struct("modified", "run")).alias("_last")).select(F.lit(1).alias("_one"), F.col("_last.run").alias("_last"))  # one row
    joined = asked.join(known, "explicit", "left").withColumn("_one", F.lit(1)).join(F.broadcast(last), "_one", "left")
    missing = F.col("explicit").isNotNull() & F.col("_known").isNull()
    run = F.when(~missing, F.coalesce("explicit", "current", "_last"))
    return joined.withColumn("run", run).withColumn("error", F.when(missing, F.concat(F.lit("no run at "), F.col("explicit")))).drop("_known", "_one", "_last")
