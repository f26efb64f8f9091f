"""Importance resampling towards a target distribution of hashed n-grams.

Each Spark partition counts its own texts in DuckDB: SQL unnests the words, windows them into
n-grams and hashes those by a registered zlib CRC. The counts of each document's buckets are spilled
to Parquet; Spark sums them over all documents and over the target's texts, gains follow from the two
sums, and a second look at the spilled counts scores every document. The best scores, each with
Gumbel noise of its id, are drawn.

Nulls and edges: a null or empty text has no features and weight 0. A null id hashes as empty text and
loses ties to all others. Rows of one id are separate draws; of equal scores and ids those of fewer
features go first, and equal rows are interchangeable. An empty table gives an empty result; an empty
target gives gains by the documents alone. Other columns are ignored. A text is counted whole, in
memory that grows with that text only.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, small_batches, staged, trimmed

LONGEST, BUCKETS = 1, 10_000
#: Documents of fewer words are never drawn.
LEAST_WORDS = 20
#: Share of the others that is drawn.
PERCENT = 10
SEED = "2024"
#: Text that DuckDB counts at once, but for a longer document.
SLICE_BYTES = 4 << 20
#: Accuracy of the quantile that leaves most rows out of the sort; the draw itself is exact.
ACCURACY = 10_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_COUNTED = pa.schema([("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])


def _grams(n: int) -> str:
    """SQL of all runs of n words of the relation words (r, i, w)."""
    if n == 1:
        return "SELECT r, w AS f FROM words"
    run = ", ".join(["w", *(f"lead(w, {k}) OVER turns" for k in range(1, n))])
    return f"SELECT r, f FROM (SELECT r, concat_ws(' ', {run}) AS f, lead(w, {n - 1}) OVER turns AS last FROM words WINDOW turns AS (PARTITION BY r ORDER BY i)) WHERE last IS NOT NULL"


def _count_sql(longest: int, buckets: int) -> str:
    """n_words, n_features, buckets and counts of each row of the relation part (r, text)."""
    return rf"""
WITH split AS (SELECT r, regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{_WORD}') AS x FROM part),
words AS (SELECT r, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM split),
counts AS (SELECT r, f, count(*) AS n FROM ({" UNION ALL ".join(map(_grams, range(1, longest + 1)))}) GROUP BY r, f),
codes AS (SELECT f, CAST(zlib_crc32(f) % {buckets} AS INTEGER) AS b FROM (SELECT DISTINCT f FROM counts)),
summed AS (SELECT r, b, CAST(sum(n) AS BIGINT) AS n FROM counts JOIN codes USING (f) GROUP BY r, b),
lists AS (SELECT r, list(b ORDER BY b) AS b, list(n ORDER BY b) AS n, CAST(sum(n) AS BIGINT) AS total FROM summed GROUP BY r)
SELECT CAST(coalesce(len(x), 0) AS BIGINT) AS n_words, coalesce(total, 0) AS n_features, coalesce(b, []) AS buckets, coalesce(n, []) AS counts
FROM split LEFT JOIN lists USING (r) ORDER BY r"""


def _crc32(features: pa.Array) -> pa.Array:
    return pa.array([zlib.crc32(f) for f in features.cast(pa.binary()).to_pylist()], pa.uint32())


def bucket_counts(texts: DataFrame, keep: Sequence[str] = (), longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """keep, n_words, n_features, and the text's hash buckets with their counts."""
    small_batches(texts.sparkSession)
    sql, most = _count_sql(longest, buckets), SLICE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1})
        con.execute("SET temp_directory = ''")  # nothing goes to a machine's own disk
        con.create_function("zlib_crc32", _crc32, ["VARCHAR"], "UINTEGER", type="arrow")
        for batch in batches:
            for part in slices(batch, "text", most):
                con.register("part", pa.table({"r": pa.array(range(part.num_rows), pa.int64()), "text": part.column("text")}))
                found = con.sql(sql).to_arrow_table().cast(_COUNTED).combine_chunks()
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(c.combine_chunks() for c in found.columns)], [*keep, *_COUNTED.names])

    kinds = dict(texts.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_words bigint, n_features bigint, buckets array<int>, counts array<bigint>"])
    return texts.select(*keep, "text").mapInArrow(trimmed(run), schema)


def _totals(counted: DataFrame) -> dict[int, int]:
    """Features in each bucket; at most as many entries as there are buckets."""
    rows = counted.select(F.inline(F.arrays_zip("buckets", "counts"))).groupBy("buckets").agg(F.sum("counts").alias("n"))
    return {r["buckets"]: r["n"] for r in rows.collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """What one feature of each bucket adds to a weight."""
    s_all, t_all = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s_all / ((source.get(b, 0) + 1.0) * t_all))) for b in range(buckets)]


def _fixed(values: Sequence[int]) -> Column:
    """An array of constants, which the optimizer folds into one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def scored(counted: DataFrame, gain: Sequence[int], seed: str = SEED) -> DataFrame:
    """counted (doc_id, n_words, n_features, buckets, counts) with weight and score for the lists."""
    each = F.zip_with("buckets", "counts", lambda b, n: n * F.get(_fixed(gain), b))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    weighed = counted.select("doc_id", "n_words", "n_features", F.aggregate(each, F.lit(0).cast("long"), lambda s, x: s + x).alias("weight"))
    return weighed.withColumn("score", F.col("weight") + noise)


def _cut(rows: DataFrame, wanted: int, of: int) -> int | None:
    """A score that at least the wanted rows reach, and few others; None if there is no such guide."""
    at = max(0.0, 1 - wanted / of - 2 / ACCURACY)
    score = rows.agg(F.percentile_approx("score", F.lit(at), ACCURACY)).first()[0]
    return score if rows.where(F.col("score") >= score).count() >= wanted else None


def drawn(scores: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """scores (doc_id, n_words, n_features, weight, score) with rank; null for rows that aren't drawn.

    Only rows above a quantile are sorted, in ranges; ranks are places in a range and the sizes of those
    before it. The last drawn row then divides all rows, so nothing is joined.
    """
    rows = staged(scores.withColumn("row", F.monotonically_increasing_id()), "importance-scores")
    fit = rows.where(F.col("n_words") >= least_words)
    of = fit.count()
    wanted = of * percent // 100
    unranked = F.lit(None).cast("bigint").alias("rank")
    if not wanted:
        return rows.select("*", unranked).drop("row")
    cut = _cut(fit, wanted, of)
    best = fit if cut is None else fit.where(F.col("score") >= cut)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("row").asc()]
    ranged = staged(best.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "importance-ranged")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = {r["part"]: r["n"] for r in ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one entry a partition
    before = [0]
    for k in range(max(sizes)):
        before.append(before[-1] + sizes.get(k, 0))
    ranked = ranged.withColumn("rank", F.get(_fixed(before), part.cast("int")) + place + 1)
    last = ranked.where(F.col("rank") == wanted).first()
    place_of = lambda value: F.struct(*[x.cast("long").alias(f"k{i}") for i, x in enumerate((-value("score"), value("doc_id").isNull(), F.coalesce(value("doc_id").cast("long"), F.lit(0)), value("n_features"), value("row")))])
    own, end = place_of(F.col), place_of(lambda c: F.lit(last[c]))
    left = rows.where((F.col("n_words") < least_words) | (own > end))
    names = [c for c in rows.columns if c != "row"]
    return ranked.where(F.col("rank") <= wanted).select(*names, "rank").unionByName(left.select(*names, unranked))


def resampled(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of docs (doc_id, text), towards the texts of target (text)."""
    counted = staged(bucket_counts(docs, ("doc_id",), longest, buckets), "importance-counts")
    gain = gains(_totals(counted), _totals(bucket_counts(target, (), longest, buckets)), buckets)
    return drawn(scored(counted, gain, seed), least_words, percent)


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resampled(documents(spark, sf_dir), target).select("doc_id", "n_features", "weight", "score", "rank")


#: The CRC runs over a word's bytes by the table of the reflected polynomial 0xEDB88320.
OP11_SQL = rf"""
WITH RECURSIVE steps AS (
  SELECT i AS byte, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT byte, CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY byte) AS step FROM steps WHERE k = 8),
texts AS MATERIALIZED (SELECT 'd' AS side, doc_id, row_number() OVER () AS r, text FROM documents UNION ALL SELECT 't', NULL, -row_number() OVER (), text FROM benchmark),
words AS (SELECT side, r, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{_WORD}')) AS w FROM texts),
codes AS (
  SELECT w, xor(list_reduce(list_transform(range(len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT)),
                lambda c, x: xor(step[(xor(c, x) & 255) + 1], c >> 8), 4294967295), 4294967295) % {BUCKETS} AS b
  FROM (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM words)), crc),
counts AS (SELECT side, r, b, count(*) AS n FROM words JOIN codes USING (w) GROUP BY side, r, b),
sums AS (SELECT b, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 't') AS t FROM counts GROUP BY b),
whole AS (SELECT sum(s) + {BUCKETS} AS s_all, sum(t) + {BUCKETS} AS t_all FROM sums),
gains AS (SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * s_all::DOUBLE / ((coalesce(s, 0) + 1.0::DOUBLE) * t_all::DOUBLE))) AS BIGINT) AS gain FROM sums, whole),
weighed AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM counts JOIN gains USING (b) WHERE side = 'd' GROUP BY r),
scores AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM texts LEFT JOIN weighed USING (r) WHERE side = 'd'),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER (PARTITION BY n_features >= {LEAST_WORDS}) AS n FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND place <= n * {PERCENT} // 100 THEN place END AS rank FROM placed
"""
