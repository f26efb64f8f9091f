"""Toxicity by non-negative positive-unlabelled learning of a linear classifier in numpy.

Features are distinct words, hashed. From confirmed toxic texts and unlabelled ones, which are all
texts, the hashes that tell the two apart are selected, and weights are learned by minimising the
non-negative risk under the squared loss: prior * loss of positives as positive, plus the larger of
zero and (loss of unlabelled as negative - prior * loss of positives as negative). That loss needs no
more of the unlabelled texts than how often each two features meet, which is summed over all
partitions; the minimum is then found exactly (see nn_pu). The raw score is calibrated to a
probability by labelled texts, toxic and other, that the fit left out; they also give the class prior.

Only labelled rows are bounded: the TRAIN_POSITIVES toxic and as many other ones of least hash of id
and text, a total order but for equal rows. The two kinds are picked at different rates, so the
calibration weights each by the inverse of its rate: scores follow the toxic share of all labelled
rows, whatever their number.

Nulls and edges: a null or empty text has no feature and gets the score of the intercept. Labels
that are null teach nothing. A doc_id with several labels counts as toxic if one says so. Without
any confirmed toxic text, or without any text, every score is 0. With fewer than PARTS toxic texts or
without other labelled ones nothing can be left out, and the raw score goes through a fixed sigmoid.
Repeated rows are scored alike; a text of any length is one row of at most FEATURES numbers beside its
own words. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fold, slices, small_batches, trimmed, word_codes

HASH_BITS, FEATURES = 20, 512
#: Toxic rows, and other labelled rows, that a model learns from at most.
TRAIN_POSITIVES = 4000
RIDGE = 0.02
#: Scale of the sigmoid where nothing calibrates it.
SCALE = 4.0
#: Fits that each leave out a part of the labelled rows, whose scores then calibrate the fit to all.
PARTS = 3
#: Positive texts that must share a word for it to become a feature.
LEAST_POSITIVES = 3
THRESHOLD = 0.7
#: Most text that is handled at once, but for a longer row.
SLICE_BYTES = 2 << 20
#: Lower case, and a space for every ASCII character that no word has.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c > 127 else 32 for c in range(256))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct words of every whole text, ascending."""
    words, index, bounds = word_codes(texts, _TABLE)
    if not len(index):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    hashed = np.array([zlib.crc32(w.encode()) if w else -1 for w in words.to_pylist()], np.int64)
    hashed = np.where(hashed < 0, -1, (hashed * 2654435761 >> 11) & ((1 << HASH_BITS) - 1))[index]
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[hashed >= 0]
    pairs = np.sort((row << HASH_BITS) | hashed[hashed >= 0])
    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
    return pairs >> HASH_BITS, pairs & ((1 << HASH_BITS) - 1)


@dataclass
class Model:
    #: Column of each hash, -1 for most.
    column: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        row, h = features(texts)
        col = self.column[h]
        row, col = row[col >= 0], col[col >= 0]
        return _sigmoid(np.bincount(row, self.weights[col], len(texts)) + self.bias)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _select(positive: np.ndarray, n_positive: int, unlabelled: np.ndarray, n_unlabelled: int) -> np.ndarray:
    """The hashes whose share among positives stands out most from that among unlabelled texts, by their counts."""
    rate_p, rate_u = (positive + 0.5) / (n_positive + 1), (unlabelled + 0.5) / (n_unlabelled + 1)
    spread = np.sqrt(rate_u * (1 - rate_u) * (1 / max(1, n_positive) + 1 / max(1, n_unlabelled)))
    z = np.where(positive >= LEAST_POSITIVES, np.abs(rate_p - rate_u) / spread, 0)
    best = np.argsort(-z, kind="stable")[:FEATURES]
    return best[z[best] > 0]


def _with_one(gram: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Second and first moments with a constant feature after the others."""
    mean = np.append(mean, 1.0)
    return np.block([[gram, mean[:-1, None]], [mean[None]]]), mean


def nn_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative risk under the squared loss.

    positive: rows of features; unlabelled: mean products of features of all unlabelled rows (features
    are 0 or 1, so the diagonal holds their means). With N(w) the corrected loss as negative, the least
    of prior * P(w) + max(0, N(w)) is the saddle point of prior * P(w) + t * N(w) over 0 <= t <= 1: t = 1 if
    N is not negative there, else the t at which N is zero.
    """
    x = positive.astype(np.float64)
    second_p, first_p = _with_one(x.T @ x / len(x), x.mean(axis=0))
    second_u, first_u = _with_one(unlabelled, np.diag(unlabelled))
    ridge = RIDGE * np.eye(len(first_u))
    ridge[-1, -1] = 1e-9

    def at(t: float) -> np.ndarray:
        return np.linalg.solve(prior * (1 - t) * second_p + t * second_u + ridge, prior * (1 + t) * first_p - t * first_u)

    def negative(w: np.ndarray) -> float:
        loss = lambda second, first: 1 + 2 * w @ first + w @ second @ w
        return float(loss(second_u, first_u) - prior * loss(second_p, first_p))

    w = at(1.0)
    if negative(w) < 0:
        low, high = 0.0, 1.0
        for _ in range(40):
            t = (low + high) / 2
            w = at(t)
            low, high = (t, high) if negative(w) > 0 else (low, t)
    return w[:-1], float(w[-1])


def _calibrated(raw: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift by which labelled texts' scores become probabilities. Each text counts weight times.

    Newton's method with halved steps on the logistic loss, over scores of mean 0 and deviation 1.
    """
    weight = weight / weight.sum()
    mean = weight @ raw
    wide = np.sqrt(weight @ (raw - mean) ** 2) + 1e-12
    x = np.stack([(raw - mean) / wide, np.ones(len(raw))])
    # a little short of 0 and 1, so that kinds that never mix still have a best scale
    label = np.where(label == 1, 1 - 1 / (label.sum() + 2), 1 / ((1 - label).sum() + 2))
    loss = lambda c: float(weight @ (np.logaddexp(0, c @ x) - label * (c @ x)))
    c, now = np.zeros(2), loss(np.zeros(2))
    for _ in range(100):
        s = _sigmoid(c @ x)
        step = np.linalg.solve((x * (weight * (s * (1 - s) + 1e-9))) @ x.T + 1e-9 * np.eye(2), x @ (weight * (s - label)))
        while np.abs(step).max() > 1e-9 and loss(c - step) > now:
            step /= 2
        c = c - step
        if now - loss(c) < 1e-12:
            break
        now = loss(c)
    return (c[0] / wide, c[1] - c[0] * mean / wide) if c[0] > 0 else (SCALE, 0.0)


def _told(texts: DataFrame, most: int) -> list[np.ndarray]:
    """Distinct hashes of the most rows of least pick."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text", SLICE_BYTES):
                row, h = features(rows.column("text"))
                cuts = np.searchsorted(row, np.arange(rows.num_rows + 1)).astype(np.int32)
                yield pa.record_batch({"pick": rows.column("pick"), "h": pa.ListArray.from_arrays(pa.array(cuts), pa.array(h.astype(np.int32)))})

    found = texts.select("text", "pick").mapInArrow(trimmed(run), "pick long, h array<int>").orderBy("pick").limit(most).toArrow()
    h = found.column("h").combine_chunks() if found.num_rows else None
    return [] if h is None else np.split(h.flatten().to_numpy(), np.cumsum(np.diff(np.asarray(h.offsets)))[:-1])


def frequencies(docs: DataFrame, wanted: np.ndarray) -> tuple[np.ndarray, int]:
    """How many of all rows have each wanted hash, and how many rows there are."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, n, rows = np.unpackbits(shared.value).astype(bool), np.zeros(1 << HASH_BITS, np.int64), 0
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                _, h = features(part.column("text"))
                np.add.at(n, h[mask[h]], 1)
                rows += part.num_rows
        some = np.flatnonzero(n)
        yield pa.record_batch({"h": np.append(some, -1), "n": np.append(n[some], rows)})

    sums = docs.select("text").mapInArrow(trimmed(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).toArrow()
    h, n, found = sums.column("h").to_numpy(), sums.column("n").to_numpy(), np.zeros(1 << HASH_BITS, np.int64)
    found[h[h >= 0]] = n[h >= 0]
    return found, int(n[h < 0].sum())


def _dense(texts: pa.Array, column: np.ndarray, width: int) -> np.ndarray:
    row, h = features(texts)
    col = column[h]
    x = np.zeros((len(texts), width), np.float32)
    x[row[col >= 0], col[col >= 0]] = 1
    return x


def products(docs: DataFrame, column: np.ndarray, width: int) -> np.ndarray:
    """In how many of all rows each two features meet; width * width sums reach the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(column)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                x = _dense(part.column("text"), shared.value, width)
                total += x.T @ x
        k = np.flatnonzero(np.triu(total))
        yield pa.record_batch({"k": k, "n": total.ravel()[k].astype(np.int64)})

    sums = docs.select("text").mapInArrow(trimmed(run), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    found = np.zeros(width * width)
    found[sums.column("k").to_numpy()] = sums.column("n").to_numpy()
    found = found.reshape(width, width)
    return found + np.triu(found, 1).T


def learn(docs: DataFrame, labels: DataFrame, positives: int = TRAIN_POSITIVES) -> Model | None:
    """A model from docs (doc_id, text), all of them unlabelled, and labels (doc_id, toxic)."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.join(docs.select("doc_id"), "doc_id", "left_semi")  # labels of other documents say nothing here
    totals = marks.agg(F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0)), F.count(F.lit(1))).first()
    if not totals[0]:
        return None
    # ids are distinct here, so about positives of each kind are within the bound, and half as many more to be sure
    spread = F.xxhash64("doc_id", F.lit(1)) / F.lit(2.0**64) + 0.5
    toxic = F.col("toxic") == 1
    chosen = marks.where(spread * F.when(toxic, totals[0]).otherwise(totals[1] - totals[0]) <= 1.5 * positives + 50)
    picked = docs.join(F.broadcast(chosen), "doc_id").withColumn("pick", F.xxhash64("doc_id", "text", F.lit(2)))
    positive, other = _told(picked.where(toxic), positives), _told(picked.where(~toxic), positives)
    if not positive:
        return None
    seen = np.bincount(np.concatenate(positive), minlength=1 << HASH_BITS)
    everywhere, rows = frequencies(docs, seen >= LEAST_POSITIVES)
    hashes = _select(seen, len(positive), everywhere, rows)
    column, width = np.full(1 << HASH_BITS, -1, np.int16), len(hashes)
    column[hashes] = np.arange(width)
    unlabelled = products(docs, column, width) / rows

    def dense(texts: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(texts), width), np.float32)
        for k, h in enumerate(texts):
            c = column[h]
            x[k, c[c >= 0]] = 1
        return x

    prior = totals[0] / (totals[1] + 1)  # below one even if every label says toxic
    p, o = dense(positive), dense(other)
    scale, shift = SCALE, 0.0
    if len(p) >= PARTS and len(o):
        part, raw = np.arange(len(p)) % PARTS, np.empty(len(p))
        fits = [nn_pu(p[part != k], unlabelled, prior) for k in range(PARTS)]
        for k, (w, b) in enumerate(fits):
            raw[part == k] = p[part == k] @ w + b
        other_raw = np.mean([o @ w + b for w, b in fits], axis=0)  # no fit has seen them as such
        weight = np.append(np.full(len(p), totals[0] / len(p)), np.full(len(o), (totals[1] - totals[0]) / len(o)))
        scale, shift = _calibrated(np.append(raw, other_raw), np.append(np.ones(len(p)), np.zeros(len(o))), weight)
    w, b = nn_pu(p, unlabelled, prior)
    return Model(column, w * scale, b * scale + shift)


def score(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep columns and score for every row."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for rows in slices(batch, "_text", SLICE_BYTES):
                found = np.zeros(rows.num_rows) if m is None else m.score(rows.column("_text"))
                yield pa.record_batch({c: rows.column(c) for c in keep} | {"score": found})

    rows = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(trimmed(run), f"{kept}, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = fold("doc_id", 3) == 1
    model = learn(docs.where(~held).select("doc_id", "text"), labels.where(~held).select("doc_id", "toxic"))
    scored = score(docs.withColumn("held_out", held), model, ("doc_id", "held_out"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
