"""Ascending numbers within groups of any size, without a window over a large group.

Rows are dealt into ranges of group and order, and sorted there. A group inside one range is small, and
numbered by a window. A group that goes over several ranges has each row's place in its range and the rows
of the ranges before it: at most two such groups touch a range, so what is broadcast has at most two rows
for each range, whatever the table's size. Where all groups together have at most FEW pieces they are all
numbered so, and no row moves again.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import staged


#: Pieces (group and range) that are broadcast at most.
FEW = 200_000


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "id") -> DataFrame:
    """rows with their number, from 1, in the order of order within each group; without a group, of all rows.

    Equal places get different numbers, in no stated order. Null is a group.
    """
    spark = rows.sparkSession
    keys = [F.col(c) for c in (*group, *order)]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    laid = staged(laid, "ranges").withColumn("_range", F.shiftright("_at", 33))
    pieces = laid.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    whole = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wide = pieces.withColumn("_before", before).withColumn("_pieces", F.count(F.lit(1)).over(whole))
    wide = staged(wide, "pieces")
    few = not group or wide.count() <= FEW
    wide = wide if few else wide.where(F.col("_pieces") > 1)  # at most two rows a range
    told = wide.select(F.col("_range").alias("_own_range"), *[F.col(c).alias(f"_own_{c}") for c in group], "_from", "_before")
    same = functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"_own_{c}")) for c in group], F.col("_range") == F.col("_own_range"))
    large = laid.join(F.broadcast(told), same).withColumn(name, F.col("_at") - F.col("_from") + F.col("_before") + 1).select(*rows.columns, name)
    if few:
        return large
    small = laid.join(F.broadcast(told), same, "left_anti")
    return large.unionByName(small.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy("_at")).cast("long")).select(*rows.columns, name))
