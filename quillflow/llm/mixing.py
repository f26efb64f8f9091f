"""Mix sources to target weights by hash-threshold histograms, without sorting documents.

Each row gets a 60-bit hash of its id and text, and of its number among equal rows of its source. A
source's budget is met by a threshold on that hash: sizes are summed by (source, bucket of the hash's
first bits), the running sum over buckets names the bucket in which the budget is crossed, and only
that boundary bucket is refined by the next bits. Below the threshold a row is taken once more than
above. Thresholds of a larger budget keep all that a smaller one takes, so mixes nest. DataFrame
operations only.

Rows are numbered by the part of the table that they lie in, so equal rows meet in one place only so
far as one part holds them; which of equal rows has which number makes no difference.

Nulls and edges: a null text has size 0 and counts as empty; a null source is a source of its own,
last in order; a null id hashes as the empty text. Rows that share an id, or have none, are taken each
for itself. A source without words has target 0. An empty table gives an empty result. A text of any
length is one row of fixed width after it is hashed and counted. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD_GAP, documents, staged

#: Weights dealt to the sources in code-point order, over and over.
WEIGHTS = (5, 2, 1)
#: A source, and a document, is taken this many times at most.
MOST_REPEATS = 3
#: Bits of the hash in each refinement; four of them use up its 60 bits.
LEVEL_BITS = (12, 16, 16, 16)
_HASH_BITS = 60


def n_words(text: Column) -> Column:
    """Words of a text: separators' runs plus one, less the empty ends."""
    trimmed = F.regexp_replace(text, f"^{WORD_GAP}|{WORD_GAP}$", "")
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit(0)).otherwise(F.regexp_count(trimmed, F.lit(WORD_GAP)) + 1).cast("long")


def _bits(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def row_hash(key: Column, text: Column) -> Column:
    """60 bits of md5 of the id's decimal text and the text's md5."""
    return _bits(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


def numbered(rows: DataFrame) -> DataFrame:
    """rows (source, h, part) with hash: h for the first of equal rows, bits of h and the row's number for the others."""
    own, among = W.partitionBy("source", "h", "part"), W.partitionBy("source", "h").orderBy("part")
    counts = rows.groupBy("source", "h", "part").agg(F.count(F.lit(1)).alias("_n"))
    later = counts.withColumn("_base", F.sum("_n").over(among) - F.col("_n")).where("_base > 0")
    later = later.select(F.col("source").alias("_s"), F.col("h").alias("_h"), F.col("part").alias("_p"), "_base")
    local = rows.withColumn("_k", F.row_number().over(own.orderBy("part")) - 1)
    joined = local.join(later, F.col("source").eqNullSafe(F.col("_s")) & (F.col("h") == F.col("_h")) & (F.col("part") == F.col("_p")), "left")
    number = F.col("_k") + F.coalesce("_base", F.lit(0))
    hashed = F.when(number == 0, F.col("h")).otherwise(_bits(F.concat_ws("|", F.col("h").cast("string"), number.cast("string"))))
    return joined.withColumn("hash", hashed).drop("_k", "_base", "_s", "_h", "_p")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, target: shares by weight of all sizes, none above most times its size.

    Sources fill up in order of cap to weight; with the first k full, the others get
    (total - their caps) / (their weights) for each unit of weight, which decides who is full.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((place - 1) % len(weights) + 1).cast("int"))
    ranked = sums.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    fill = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, everyone = fill.rowsBetween(W.unboundedPreceding, -1), fill.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    rate = left / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    filled = ranked.withColumn("rate", rate).withColumn("turn", F.row_number().over(fill))
    open_ = F.when(F.col("cap") > F.col("rate") * F.col("weight"), F.struct("turn", "rate"))
    filled = filled.withColumn("first", F.min(open_).over(W.partitionBy()))  # the first that isn't full sets the rate
    full = F.coalesce(F.col("turn") < F.col("first.turn"), F.lit(True))
    return filled.select("source", "source_size", F.when(full, F.col("cap").cast("double")).otherwise(F.col("first.rate") * F.col("weight")).alias("target"))


def thresholds(sized: DataFrame, wanted: DataFrame, bits: tuple[int, ...] = LEVEL_BITS) -> DataFrame:
    """source, target, source_size, repeats, threshold: a document's copies are repeats, and one more below threshold."""
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = wanted.withColumn("repeats", repeats.cast("long"))
    state = state.withColumn("budget", F.col("target") - F.col("repeats") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long")).withColumn("taken", F.lit(0).cast("long"))
    used = 0
    for level, b in enumerate(bits):
        shift = _HASH_BITS - used - b
        rows = sized.select("source", "size", F.shiftright("hash", shift).alias("bucket"))
        if level:  # only what lies in the boundary bucket of its source
            edge = state.select(F.col("source").alias("s"), F.col("prefix").alias("p"))
            rows = rows.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("bucket", b) == F.col("p"))).drop("s", "p")
        sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
        below = F.sum("size").over(W.partitionBy("source").orderBy("bucket")) - F.col("size")
        sums = sums.withColumn("below", below).select(F.col("source").alias("s"), "bucket", "size", "below")
        met = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").where("bucket is null or taken + below <= budget")
        last = F.max(F.struct("bucket", F.col("below").alias("below"), "size")).alias("last")
        state = met.groupBy("source", "target", "source_size", "repeats", "budget", "prefix", "taken").agg(last)
        state = state.select("source", "target", "source_size", "repeats", "budget", F.coalesce("last.bucket", F.shiftleft("prefix", b)).alias("prefix"), (F.col("taken") + F.coalesce("last.below", F.lit(0))).alias("taken"), F.coalesce("last.size", F.lit(0)).alias("edge"))
        state = staged(state, "mix-level")  # one row a source
        used += b
    over = F.col("taken") + F.col("edge") - F.col("budget") < F.col("budget") - F.col("taken")
    return state.select("source", "target", "source_size", "repeats", F.shiftleft(F.col("prefix") + F.when(over, 1).otherwise(0), _HASH_BITS - used).alias("threshold"))


def _sized(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), row_hash(F.col(key), F.col(text)).alias("h"), F.spark_partition_id().alias("part"))
    return staged(numbered(staged(rows, "mix-rows")), "mix-sizes")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, h, hash of every row."""
    sized = _sized(docs, key, text, source)
    cuts = thresholds(sized, targets(sized, weights)).withColumnRenamed("source", "s")
    copies = F.col("repeats") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)
    return sized.join(cuts, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "h", "hash", "source_size", "target", "repeats", "threshold", copies.alias("copies"))


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs' rows, each as often as the mix takes it. Only rows that have equals are shuffled with their texts."""
    names = docs.columns
    sized = _sized(docs, key, text, source)
    cuts = staged(thresholds(sized, targets(sized, weights)), "mix-cuts").select(F.col("source").alias("_cut"), "repeats", "threshold")
    several = staged(sized.groupBy("source", "h").count().where("count > 1"), "mix-several").select(F.col("source").alias("_several"), F.col("h").alias("_h"))
    marked = docs.select("*", F.col(source).alias("_source"), row_hash(F.col(key), F.col(text)).alias("_own"), F.spark_partition_id().alias("_part"))
    apart = F.col("_source").eqNullSafe(F.col("_several")) & (F.col("_own") == F.col("_h"))
    alone = marked.join(several, apart, "left_anti").withColumn("_hash", F.col("_own"))
    equal = marked.join(several, apart, "left_semi").select(F.struct(*names).alias("_row"), F.col("_source").alias("source"), F.col("_own").alias("h"), F.col("_part").alias("part"))
    equal = numbered(staged(equal, "mix-equal")).select("_row.*", F.col("source").alias("_source"), F.col("hash").alias("_hash"))
    rows = alone.select(*names, "_source", "_hash").unionByName(equal).join(cuts, F.col("_source").eqNullSafe(F.col("_cut")))
    copies = (F.col("repeats") + F.when(F.col("_hash") < F.col("threshold"), 1).otherwise(0)).cast("int")
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*names)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: The same thresholds in one step: the running sum over the whole hash, cut where it comes nearest.
OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, size, CASE WHEN number = 0 THEN h ELSE CAST(('0x' || substr(md5(h || '|' || number), 1, 15)) AS BIGINT) END AS hash
  FROM (SELECT *, row_number() OVER (PARTITION BY source, h) - 1 AS number FROM (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
           CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 15)) AS BIGINT) AS h
    FROM documents))),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, 3 * source_size AS cap,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM sums),
filled AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS turn, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS rate
  FROM ranked WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
told AS (SELECT min(turn) AS turn, arg_min(rate, turn) AS rate FROM filled WHERE cap > rate * weight),
targets AS (
  SELECT source, source_size, CASE WHEN coalesce(f.turn < t.turn, true) THEN CAST(cap AS DOUBLE) ELSE t.rate * weight END AS target
  FROM filled f CROSS JOIN told t),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS repeats FROM targets),
running AS (
  SELECT source, hash, sum(size) AS size, sum(sum(size)) OVER (PARTITION BY source ORDER BY hash) AS upto FROM sized GROUP BY source, hash),
edges AS (
  SELECT b.source, max(CASE WHEN r.upto - r.size <= b.target - b.repeats * b.source_size THEN r.hash END) AS edge
  FROM budgets b JOIN running r ON r.source IS NOT DISTINCT FROM b.source GROUP BY b.source),
cuts AS (
  SELECT b.*, e.edge + CASE WHEN r.upto - (b.target - b.repeats * b.source_size) < (b.target - b.repeats * b.source_size) - (r.upto - r.size) THEN 1 ELSE 0 END AS threshold
  FROM budgets b JOIN edges e ON e.source IS NOT DISTINCT FROM b.source
  JOIN running r ON r.source IS NOT DISTINCT FROM b.source AND r.hash = e.edge)
SELECT s.doc_id, s.size, c.source_size, c.target,
       s.size * (c.repeats + CASE WHEN s.hash < c.threshold THEN 1 ELSE 0 END) AS taken
FROM sized s JOIN cuts c ON c.source IS NOT DISTINCT FROM s.source
"""
