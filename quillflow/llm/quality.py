"""Quality rules by divergence from language references. DataFrame operations only.

Every document gets the counts of its base rules, a histogram of character classes and one of
its language's common words. The references are the summed histograms of all documents of a
language. A document passes if it lies within a Jensen-Shannon distance of both references;
histograms of too few characters or words say nothing and are not compared.

Nulls and edges: a null text counts as empty; documents of a null or unlisted lang are compared
with the reference of that same lang value over the pooled word list. Repeated rows count as often
as they occur. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_GAP, documents, staged

# Common words of each language, as references.
COMMON_WORDS = {
    "en": "the of and to a in is that it for was on with as be by",
    "fr": "de la le et les des en un du une que pour est par qui dans",
    "de": "der die und in den von zu das mit sich des auf für ist im nicht",
    "es": "de la que el en y los se del las un por con no su una",
}
POOLED_WORDS = "the of and to de la le et der die und in que el en los"
#: Fewest words, and longest share of repeated words in percent, of the base rules.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Fewest characters and words of a histogram that is compared.
LEAST_CHARS, LEAST_COMPARED = 200, 50
#: Largest Jensen-Shannon distances (square root, base 2) from the references.
MOST_CHAR_DISTANCE, MOST_WORD_DISTANCE = 0.28, 0.27
_SYMBOLS = r"[#*$%&|<>]"
_K = 16


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _removed(text: Column, pattern: str) -> Column:
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def split_words(text: Column) -> Column:
    trimmed = F.regexp_replace(text, f"^{WORD_GAP}|{WORD_GAP}$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP))


def n_repeat_words(words: Column) -> Column:
    """Words that lie in a window of three words which the text has twice or more."""

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, k: F.when(k + 1 < F.size(at), F.least(F.lit(3), F.get(at, k + 1) - x)).otherwise(3))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)

    def repeated(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
        at = _let(ordered, lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"])))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(at, covered))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(_let(windows, repeated))


def _count_of(hits: Column, word: Column) -> Column:
    return F.size(hits) - F.size(F.array_remove(hits, word))


def document_stats(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, lang, the base counts, chars and common: the two histograms."""
    lists = F.create_map(*[x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v.split())))])
    own = F.coalesce(F.element_at(lists, F.col("lang")), F.array(*map(F.lit, POOLED_WORDS.split())))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("words", split_words(F.col("text"))).withColumn("common_words", own)
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    t, n = F.col("text"), F.size("words")
    hits = F.filter("words", lambda w: F.array_contains(F.col("common_words"), w))
    common = _let(hits, lambda h: F.concat(F.transform("common_words", lambda c: _count_of(h, c)), F.array(F.size("words") - F.size(h))))
    counted = rows.select(
        "doc_id",
        "lang",
        n.cast("long").alias("n_words"),
        _removed(t, r"[^\x20\x09-\x0D]+").cast("long").alias("word_chars"),
        _removed(t, f"{_SYMBOLS}+").cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        n_repeat_words(F.col("words")).alias("n_repeat_words"),
        F.char_length(t).cast("long").alias("all_chars"),
        _removed(t, r"\p{L}+").cast("long").alias("letters"),
        _removed(t, r"\p{Lu}+").cast("long").alias("upper"),
        _removed(t, r"\p{N}+").cast("long").alias("digits"),
        _removed(t, r"[.,;:!?]+").cast("long").alias("marks"),
        common.alias("common"),
    )
    rest = F.col("word_chars") - F.col("letters") - F.col("digits") - F.col("n_symbols") - F.col("marks")
    chars = F.array(F.col("letters") - F.col("upper"), "upper", "digits", "n_symbols", "marks", F.col("all_chars") - F.col("word_chars"), rest)
    return counted.withColumn("chars", chars).drop("all_chars", "letters", "upper", "digits", "marks")


def references(stats: DataFrame) -> DataFrame:
    """lang, ref_chars, ref_common: the histograms summed over all documents of a lang."""
    sums = lambda name, n: F.array(*[F.sum(F.get(name, F.lit(i)).cast("long")) for i in range(n)])
    return stats.groupBy("lang").agg(sums("chars", 7).alias("ref_chars"), sums("common", _K + 1).alias("ref_common"))


def js_distance(a: Column, b: Column) -> Column:
    """Square root of the base-2 Jensen-Shannon divergence of two count histograms; null if either is empty."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))
    pairs = lambda n, m: F.zip_with(a, b, lambda x, y: _let(F.struct((x / n).alias("p"), (y / m).alias("q")), lambda s: part(s["p"], (s["p"] + s["q"]) / 2) / 2 + part(s["q"], (s["p"] + s["q"]) / 2) / 2))
    sums = F.struct(total(a).alias("n"), total(b).alias("m"))
    return _let(sums, lambda s: F.when((s["n"] > 0) & (s["m"] > 0), F.sqrt(F.greatest(F.lit(0.0), total(pairs(s["n"], s["m"]))))))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """document_stats and char_distance, word_distance (null: not compared), base_failed, kept."""
    stats = staged(document_stats(docs, key, text, lang), "quality-stats")
    refs = references(stats).withColumnRenamed("lang", "ref_lang")  # one row a language
    both = stats.join(refs, F.col("lang").eqNullSafe(F.col("ref_lang")))
    chars = F.aggregate("chars", F.lit(0).cast("long"), lambda s, x: s + x)
    both = both.withColumn("char_distance", F.when(chars >= LEAST_CHARS, js_distance(F.col("chars"), F.col("ref_chars"))))
    both = both.withColumn("word_distance", F.when(F.col("n_words") >= LEAST_COMPARED, js_distance(F.col("common"), F.col("ref_common"))))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    near = (F.coalesce("char_distance", F.lit(0.0)) <= MOST_CHAR_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= MOST_WORD_DISTANCE)
    return both.withColumn("base_failed", failed).withColumn("kept", ~failed & near).drop("ref_lang", "ref_chars", "ref_common")


def op5_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_list(words: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words.split()) + "]"


#: The same counts, references and verdicts. Histograms are lists; a list's Jensen-Shannon distance sums over its places.
OP5_SQL = rf"""
WITH split AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         CASE lang {" ".join(f"WHEN '{k}' THEN {_sql_list(v)}" for k, v in COMMON_WORDS.items())} ELSE {_sql_list(POOLED_WORDS)} END AS common_words,
         row_number() OVER () AS r
  FROM documents),
windows AS (SELECT r, i, w[i:i + 2] AS three FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, three) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
counts AS (
  SELECT r, doc_id, lang, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         length(t) AS all_chars, length(t) - length(regexp_replace(t, '\p{{L}}+', '', 'g')) AS letters,
         length(t) - length(regexp_replace(t, '\p{{Lu}}+', '', 'g')) AS upper, length(t) - length(regexp_replace(t, '\p{{N}}+', '', 'g')) AS digits,
         length(t) - length(regexp_replace(t, '[.,;:!?]+', '', 'g')) AS marks,
         list_transform(common_words, lambda c: len(list_filter(w, lambda x: x = c))) AS hits
  FROM split),
stats AS (
  SELECT *, [letters - upper, upper, digits, n_symbols, marks, all_chars - word_chars, word_chars - letters - digits - n_symbols - marks] AS chars,
         list_append(hits, n_words - list_sum(hits)) AS common FROM counts),
long AS (
  SELECT r, lang, 'chars' AS kind, unnest(chars) AS n, generate_subscripts(chars, 1) AS k FROM stats
  UNION ALL SELECT r, lang, 'common' AS kind, unnest(common) AS n, generate_subscripts(common, 1) AS k FROM stats),
refs AS (SELECT lang, kind, k, sum(n) AS m, sum(sum(n)) OVER (PARTITION BY lang, kind) AS total FROM long GROUP BY lang, kind, k),
shares AS (
  SELECT l.r, l.kind, n, sum(n) OVER (PARTITION BY l.r, l.kind) AS size, n / nullif(sum(n) OVER (PARTITION BY l.r, l.kind), 0) AS p, m / nullif(total, 0) AS q
  FROM long l JOIN refs f ON f.lang IS NOT DISTINCT FROM l.lang AND f.kind = l.kind AND f.k = l.k),
distances AS (
  SELECT r, kind, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END / 2 + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END / 2))) AS d
  FROM shares WHERE size >= CASE kind WHEN 'chars' THEN {LEAST_CHARS} ELSE {LEAST_COMPARED} END GROUP BY r, kind),
judged AS (
  SELECT s.*, coalesce(c.n, 0) AS n_repeat_words, n_words < {LEAST_WORDS} OR 100 * coalesce(c.n, 0) > {MOST_REPEATED} * n_words AS base_failed,
         coalesce((SELECT d FROM distances x WHERE x.r = s.r AND kind = 'chars'), 0) <= {MOST_CHAR_DISTANCE}
         AND coalesce((SELECT d FROM distances x WHERE x.r = s.r AND kind = 'common'), 0) <= {MOST_WORD_DISTANCE} AS near
  FROM stats s LEFT JOIN covered c USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND near AS kept FROM judged
"""
