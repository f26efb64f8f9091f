"""Glossary candidates: capitalised phrases of two to four words, ranked by the documents that hold them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..scratch import staged

LONGEST, CONTEXTS, LIMIT = 4, 3, 200


def phrases(samples: DataFrame, document: str = "doc_index", text: str = "text", group: Sequence[str] = ()) -> DataFrame:
    """group, document, key, phrase: each phrase of a document once, as it first stands there.

    A phrase's words all begin in upper case, so only runs of such words are cut into words and judged, and only
    places where two fitting words meet are exploded, without the words of their run.
    """
    runs = samples.select(*group, F.col(document).alias("document"), F.posexplode(X.upper_runs(F.col(text))).alias("run", "words"))
    rows = runs.select(*group, "document", "run", F.regexp_extract_all("words", F.lit(X.TOKEN), 0).alias("t"))
    rows = rows.withColumn("ok", F.transform("t", lambda t: ~X.blocks_term(t)))
    fits = lambda i: F.coalesce(F.get("ok", i), F.lit(False))
    starts = F.filter(F.transform("ok", lambda ok, i: F.when(ok & fits(i + 1), i)), lambda i: i.isNotNull())
    longest = lambda i: F.lit(2) + fits(i + 2).cast("int") * (F.lit(1) + fits(i + 3).cast("int"))
    at = lambda i, n: F.col("run").cast("bigint") * (1 << 34) + i.cast("bigint") * 8 + n  # noqa: E731  in the order of run, start and length
    span = lambda i, n: F.struct(at(i, n).alias("at"), F.array_join(F.slice("t", i + 1, n), " ").alias("phrase"))
    spans = F.transform(starts, lambda i: F.transform(F.sequence(F.lit(2), longest(i)), lambda n: span(i, n)))
    rows = rows.select(*group, "document", F.explode(F.flatten(spans)).alias("span")).select(*group, "document", "span.*")
    # what a document repeats as it stands is one, by a sum that hashing does, before it is folded
    rows = rows.groupBy(*group, "document", "phrase").agg(F.min("at").alias("at")).withColumn("key", X.casefold(F.col("phrase")))
    return rows.groupBy(*group, "document", "key").agg(F.min_by("phrase", "at").alias("phrase"))


def glossary_candidates(samples: DataFrame, limit: int = LIMIT, document: str = "doc_index", text: str = "text", group: Sequence[str] = (), least_documents: int = 1) -> DataFrame:
    """group, place, term, frequency, document_count, contexts of the best phrases, of each group if there are any.

    A phrase counts once for each document, so frequency and document_count are equal. term and
    contexts come from the first documents that hold it; only limit phrases of a group are looked up for
    them. Texts are gone through once, their phrases staged. A group column must not be null.
    """
    found = staged(phrases(samples, document, text, group), "phrases")
    ranked = found.groupBy(*group, "key").agg(F.count(F.lit(1)).alias("frequency"), F.min_by("phrase", "document").alias("term")).where(F.col("frequency") >= least_documents)
    order = [F.col("frequency").desc(), F.size(F.split("term", " ")).desc(), X.casefold(F.col("term"))]
    if group:  # each task passes on at most limit rows of a group
        best = ranked.withColumn("place", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("place") <= limit)
    else:
        best = ranked.orderBy(*order).limit(limit).withColumn("place", F.row_number().over(W.orderBy(*order)))
    best = staged(best, "terms")
    by = [*group, "key"]
    wanted = F.broadcast(best.select(*by)) if not group else best.select(*by)
    first = found.join(wanted, by).withColumn("n", F.row_number().over(W.partitionBy(*by).orderBy("document"))).where(F.col("n") <= CONTEXTS)
    contexts = first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "phrase"))), lambda x: x["phrase"]).alias("contexts"))
    placed = best.join(contexts, by).select(*group, "place", "term", "frequency", F.col("frequency").alias("document_count"), "contexts")
    return placed.orderBy(*group, "place")
