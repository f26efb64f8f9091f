"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

Characters are the code points of lower-case letters; any run of others is one gap. A model has
n-grams up to four characters. Languages share arrays in blocks of BLOCK: n-gram keys are hashed and
sorted, a directory on the first bits of the hash finds a key in a few steps, and each key has one row
of log-probabilities, a column for each language, with the back-off of the languages that lack it
worked in. A text goes to the language of least cross-entropy per character. It is rejected if its
cross-entropy is further from that language's own texts, held back for calibration, than a number
of standard deviations that depends on the text's length. A language of which fewer than LEAST_OWN
texts are held back has each of its texts scored by a model of its others (a lone text's halves by
each other), and its deviation is at least that of the languages with enough texts.

Any number of languages will do: blocks are learned in turn, each from a bounded number of rows, and
where there are more than BLOCKS_HELD they lie in the shared folder and are read in turn for each
stretch of text, which takes time by the block, not memory. A text takes memory for its code points,
and for EVENTS predictions at once, whatever its length.

Nulls and edges: a null text, or one without letters, gets ``und``, score 0 and rejected. Texts
without a lang are not learned from; rows equal in id, text and lang teach once. Ties go to the
language that sorts first. Without any labelled text every row gets ``und``. Repeated rows are
scored alike. Other columns pass through where keep names them.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import sharedfs
from .common import documents, fold, fresh_path, mix64, slices, small_batches, staged, text_buffer, trimmed

ORDER = 4
#: Relative deviation of a language's estimated number of distinct rows, which bounds what is picked from.
PICK_DEVIATION = 0.01
#: Labelled rows of each language that a model learns from at most, those of least hash; a fifth more calibrates.
TRAIN_ROWS, CALIBRATION_ROWS = 2000, 500
#: Languages whose numbers of rows are sent to every task at most.
MOST_BROADCAST = 100_000
#: Languages of a block, blocks kept in memory, and characters predicted at once.
BLOCK, BLOCKS_HELD, EVENTS = 16, 4, 1 << 18
#: Least standard deviations from a language's own texts at which a text is rejected.
LEAST_REJECTED = 6.0
#: Scores of own texts from which a language gets a limit of its own; below, its deviation is at least the pooled one.
LEAST_OWN = 20
#: Parts of a language of few texts, each scored by a model of the others.
PARTS = 5
#: Quantile of a language's own texts that sets its limit: up to a fiftieth of bad labels doesn't move it.
LIMIT_QUANTILE = 0.98
#: Least variance of one character's log-probability: a single odd character makes a short text's mean jump.
CHARACTER_VARIANCE = 6.0
#: Characters' worth of evidence that a score counts at most.
SCORE_CHARS = 32
UNKNOWN = "und"
#: Most text that is handled at once, but for a longer row.
SLICE_BYTES = 2 << 20
#: Odd numbers, one for each place before the predicted character: an n-gram's key is the sum of their products with its code points.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _code_table() -> np.ndarray:
    """Each letter's lower case, where that is one letter, else itself; 0 for anything else."""
    table = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        if (c := chr(cp)).isalpha():
            low = c.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


_table: list[np.ndarray] = []


def code_table() -> np.ndarray:
    if not _table:
        _table.append(_code_table())
    return _table[0]


@functools.cache
def alphabet() -> int:
    """How many characters there are to predict, the gap among them."""
    return len(np.unique(code_table()))


def codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts, each after ORDER - 1 gaps and before one; and the rows' offsets in them."""
    raw, off = text_buffer(column)
    raw = raw.tobytes()
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), "<u4")
    # characters before each row: bytes that don't continue one
    heads = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.int8) >= -64).astype(np.int64))])[off]
    c = code_table()[points]
    keep = c != 0
    keep[1:] |= c[:-1] != 0
    first = heads[:-1][heads[:-1] < heads[1:]]
    keep[first] = c[first] != 0  # a gap before the first letter is implied
    kept = np.concatenate([[0], np.cumsum(keep)])[heads]
    offsets = kept + np.arange(len(kept)) * ORDER
    out = np.zeros(int(offsets[-1]), np.uint32)
    row = np.repeat(np.arange(len(kept) - 1), np.diff(kept))
    out[np.arange(kept[-1]) + row * ORDER + ORDER - 1] = c[keep]
    return out, offsets


def keys_at(c: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """The key of the order codes up to each place."""
    found = c[at] * _PLACES[0]
    for k in range(1, order):
        found += c[at - k] * _PLACES[k]
    return found


def tuple_keys(c: np.ndarray) -> np.ndarray:
    """The same of rows of codes."""
    found = np.zeros(len(c), np.uint64)
    for k in range(c.shape[1]):
        found += c[:, -1 - k] * _PLACES[k]
    return found


def events(offsets: np.ndarray, n: int) -> np.ndarray:
    """The places that a model predicts: all but each row's leading gaps."""
    mask = np.ones(n, bool)
    for k in range(ORDER - 1):
        mask[offsets[:-1] + k] = False
    return np.flatnonzero(mask)


@dataclass
class HashArray:
    """Sorted hashes with a directory; find gives the place of each key, -1 where there is none."""

    hashes: np.ndarray
    directory: np.ndarray
    shift: int
    steps: int

    @classmethod
    def build(cls, sorted_keys_hashed: np.ndarray) -> HashArray:
        bits = max(4, int(np.ceil(np.log2(4 * len(sorted_keys_hashed) + 1))))
        shift = 64 - bits
        first = np.searchsorted(sorted_keys_hashed >> np.uint64(shift), np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        ends = np.concatenate([sorted_keys_hashed, [np.uint64(0xFFFFFFFFFFFFFFFF)]])
        return cls(ends, first[:-1], shift, int(np.diff(first).max(initial=0)))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        h = mix64(wanted)
        at = self.directory[(h >> np.uint64(self.shift)).astype(np.int64)]
        got = self.hashes[at]
        low = np.flatnonzero(got < h)
        for _ in range(self.steps):
            if not len(low):
                break
            at[low] += 1
            got[low] = self.hashes[at[low]]
            low = low[got[low] < h[low]]
        return np.where(got == h, at, -1)


@dataclass
class Block:
    """Some languages' models."""

    languages: list[str]
    #: By order: n-grams with rows of log-probabilities; from order 2 contexts with rows of log back-off weights.
    grams: dict[int, tuple[HashArray, np.ndarray]]
    contexts: dict[int, tuple[HashArray, np.ndarray]]
    #: Log-probabilities of a character that a language's texts lack.
    unseen: np.ndarray

    def log_probs(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A row of log-probabilities for each place."""
        out = np.zeros((len(at), len(self.languages)), np.float32)
        open_ = np.arange(len(at))
        for order in range(ORDER, 0, -1):
            key = keys_at(c, at[open_], order)
            array, rows = self.grams[order]
            found = array.find(key)
            hit = found >= 0
            out[open_[hit]] += rows[found[hit]]
            open_, key = open_[~hit], key[~hit]
            if order == 1:
                out[open_] += self.unseen
            elif len(open_):
                array, rows = self.contexts[order]
                found = array.find(key - c[at[open_]] * _PLACES[0])
                hit = found >= 0
                out[open_[hit]] += rows[found[hit]]
            if not len(open_):
                break
        return out

    def sums(self, c: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log-probabilities summed by row and language."""
        at, starts = events(offsets, len(c)), np.cumsum(np.diff(offsets) - ORDER + 1)
        starts = np.concatenate([[0], starts[:-1]]) if len(starts) else starts
        found = np.zeros((len(starts), len(self.languages)))
        for a in range(0, len(at), EVENTS):
            lp = self.log_probs(c, at[a : a + EVENTS])
            first, last = np.searchsorted(starts, [a, a + len(lp) - 1], side="right") - 1
            cuts = np.maximum(starts[first : last + 1] - a, 0)
            found[first : last + 1] += np.add.reduceat(lp, cuts, axis=0, dtype=np.float64)
        return found


@dataclass
class Model:
    languages: list[str]
    #: Blocks of languages in order, or where there are many the files that hold them.
    blocks: list[Block | str]
    #: For each language: mean and the two parts of the variance of its texts' cross-entropies, and the limit.
    limits: np.ndarray

    def each_block(self) -> Iterator[tuple[int, Block]]:
        """Blocks, and the place of the first language of each."""
        at = 0
        for block in self.blocks:
            if isinstance(block, str):
                with sharedfs.reading(block) as f:
                    block = pickle.loads(f.read())
            yield at, block
            at += len(block.languages)

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, score and whether it is rejected, by row."""
        c, offsets = codes(column)
        n = predicted(c, offsets)
        counted = np.minimum(np.maximum(n, 1), SCORE_CHARS)
        best, least, mass = np.zeros(len(n), np.int64), np.full(len(n), np.inf), np.zeros(len(n))
        for first, block in self.each_block():
            entropy = -block.sums(c, offsets) / np.maximum(n, 1)[:, None]
            own, place = entropy.min(axis=1), entropy.argmin(axis=1)
            now = np.minimum(least, own)
            # how likely all languages are beside the best so far
            mass = mass * np.exp(-np.where(np.isinf(least), 0, least - now) * counted) + np.exp(-(entropy - now[:, None]) * counted[:, None]).sum(axis=1)
            best, least = np.where(own < least, first + place, best), now
        mean, wide, narrow, most = self.limits[best].T
        far = (least - mean) / np.sqrt(wide + narrow / np.maximum(n, 1)) > most
        lang = np.where(n > 0, np.array(self.languages, object)[best], UNKNOWN)
        return lang, np.where(n > 0, 1 / np.maximum(mass, 1), 0.0), far | (n == 0)


def predicted(c: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Characters that are predicted in each row; 0 if it has no letter."""
    letters = np.concatenate([[0], np.cumsum(c != 0)])[offsets]
    return np.where(np.diff(letters) > 0, np.diff(offsets) - ORDER + 1, 0)


# ---- learning


def _tuples(c: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct longest n-grams of some texts, a row of ORDER codes each, and their counts."""
    at = events(offsets, len(c))
    _, first, n = np.unique(keys_at(c, at, ORDER), return_index=True, return_counts=True)
    return np.stack([c[at[first] - k] for k in range(ORDER - 1, -1, -1)], axis=1), n


def _as_longs(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of four codes as two longs."""
    wide = c.astype(np.int64)
    return wide[:, 0] << 32 | wide[:, 1], wide[:, 2] << 32 | wide[:, 3]


def _from_longs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([a >> 32, a & 0xFFFFFFFF, b >> 32, b & 0xFFFFFFFF], axis=1).astype(np.uint32)


def gram_counts(sample: DataFrame) -> DataFrame:
    """lang, a, b (an n-gram's four codes), n over the whole texts of sample."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text", SLICE_BYTES):
                langs = rows.column("lang").to_numpy(zero_copy_only=False)
                for lang in np.unique(langs):
                    c, n = _tuples(*codes(rows.column("text").filter(pa.array(langs == lang))))
                    a, b = _as_longs(c)
                    yield pa.record_batch({"lang": pa.array([lang] * len(n), pa.string()), "a": a, "b": b, "n": n})

    return sample.select("text", "lang").mapInArrow(trimmed(count), "lang string, a long, b long, n long").groupBy("lang", "a", "b").agg(F.sum("n").alias("n"))


def _grouped(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the sums of n, and a place where each stands."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    cut = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    return ranked[cut], np.add.reduceat(n[order], cut), order[cut]


def _discount(n: np.ndarray) -> float:
    once, twice = (n == 1).sum(), (n == 2).sum()
    return float(once / (once + 2 * twice)) if once and twice else 0.5


@dataclass
class _Level:
    grams: np.ndarray  # keys, in order
    tuples: np.ndarray
    n: np.ndarray
    discount: float
    contexts: np.ndarray
    totals: np.ndarray
    back: np.ndarray


class _Language:
    """Interpolated Kneser-Ney estimates of one language from the counts of its longest n-grams (rows of codes)."""

    def __init__(self, tuples: np.ndarray, n: np.ndarray):
        self.levels: dict[int, _Level] = {}
        for order in range(ORDER, 0, -1):
            keys, n, at = _grouped(tuple_keys(tuples), n)
            tuples = tuples[at]
            d = _discount(n)
            before = keys - tuples[:, -1] * _PLACES[0]
            context, total, _ = _grouped(before, n)
            _, kinds, _ = _grouped(before, np.ones(len(n), np.int64))
            self.levels[order] = _Level(keys, tuples, n, d, context, total, d * kinds / total)
            tuples, n = tuples[:, 1:], np.ones(len(n), np.int64)  # how many different codes stand before

    def prob(self, tuples: np.ndarray) -> np.ndarray:
        """Probabilities of the last code of each row after the others."""
        if not tuples.shape[1]:
            return np.full(len(tuples), 1 / alphabet())
        level, wanted = self.levels[tuples.shape[1]], tuple_keys(tuples)
        p, before = self.prob(tuples[:, 1:]), wanted - tuples[:, -1] * _PLACES[0]
        at = np.minimum(np.searchsorted(level.contexts, before), len(level.contexts) - 1)
        known = level.contexts[at] == before
        g = np.minimum(np.searchsorted(level.grams, wanted), len(level.grams) - 1)
        seen = level.grams[g] == wanted
        return np.where(known, np.where(seen, np.maximum(level.n[g] - level.discount, 0), 0) / level.totals[at] + level.back[at] * p, p)

    def back_off(self, wanted: np.ndarray, order: int) -> np.ndarray:
        level = self.levels[order]
        at = np.minimum(np.searchsorted(level.contexts, wanted), len(level.contexts) - 1)
        return np.where(level.contexts[at] == wanted, level.back[at], 1.0)


def _merged(keys: list[np.ndarray]) -> tuple[HashArray, np.ndarray]:
    """All keys, and where each stands in all of them end to end, in the order of their hashes."""
    union, first = np.unique(np.concatenate(keys), return_index=True)
    hashed = mix64(union)
    order = np.argsort(hashed)
    return HashArray.build(hashed[order]), first[order]


def build_block(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Block:
    names = sorted(counts)
    each = [_Language(*counts[k]) for k in names]
    logs = lambda x: np.log(np.stack(x, axis=1)).astype(np.float32)
    grams, contexts = {}, {}
    for order in range(1, ORDER + 1):
        levels = [x.levels[order] for x in each]
        array, at = _merged([x.grams for x in levels])
        tuples = np.concatenate([x.tuples for x in levels])[at]
        grams[order] = (array, logs([x.prob(tuples) for x in each]))
        if order > 1:
            array, at = _merged([x.contexts for x in levels])
            union = np.concatenate([x.contexts for x in levels])[at]
            contexts[order] = (array, logs([x.back_off(union, order) for x in each]))
    return Block(names, grams, contexts, np.log([x.levels[1].back[0] / alphabet() for x in each]).astype(np.float32))


def row_counts(sample: DataFrame) -> DataFrame:
    """lang, place, half, a, b, n: the counts in either half of each whole text that has a letter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text", SLICE_BYTES):
                c, offsets = codes(rows.column("text"))
                found = []
                for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
                    if c[a:b].any():
                        at = np.arange(a + ORDER - 1, b)
                        for half, x in enumerate(np.array_split(at, 2)):
                            _, first, n = np.unique(keys_at(c, x, ORDER), return_index=True, return_counts=True)
                            found.append((i, half, *_as_longs(np.stack([c[x[first] - k] for k in range(ORDER - 1, -1, -1)], axis=1)), n))
                at = pa.array([x[0] for x in found], pa.int64())
                lists = lambda k: pa.array([x[k] for x in found], pa.list_(pa.int64()))
                yield pa.record_batch({"lang": rows.column("lang").take(at), "place": rows.column("place").take(at), "half": pa.array([x[1] for x in found], pa.int32()), "a": lists(2), "b": lists(3), "n": lists(4)})

    return sample.select("text", "lang", F.col("place").cast("int")).mapInArrow(trimmed(count), "lang string, place int, half int, a array<long>, b array<long>, n array<long>")


def cross_scores(sample: DataFrame) -> DataFrame:
    """lang, h, n: cross-entropy and events of each text by a model of the language's other parts. All counts of a language meet in one task."""

    def run(table: pa.Table) -> pa.Table:
        places, text = np.unique(table.column("place").to_numpy(), return_inverse=True)
        if len(places) == 1:  # the halves of the only one
            text = table.column("half").to_numpy()
        a, b, n = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("a", "b", "n"))
        unit, tuples = np.repeat(text, np.array(pc.list_value_length(table.column("n")))), _from_longs(a, b)
        sums, size = np.zeros(text.max() + 1), np.bincount(unit, n, text.max() + 1)
        for part in range(min(PARTS, len(sums))):
            out = unit % PARTS == part
            if out.any() and not out.all():
                p = _Language(tuples[~out], n[~out]).prob(tuples[out])
                sums += np.bincount(unit[out], n[out] * np.log(p), len(sums))
        scored = sums < 0
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * int(scored.sum()), pa.string()), "h": -sums[scored] / size[scored], "n": size[scored].astype(np.int64)})

    return row_counts(sample).groupBy("lang").applyInArrow(run, "lang string, h double, n long")


def calibrate(model: Model, lang: np.ndarray, entropy: np.ndarray, n: np.ndarray) -> None:
    """Fit mean and variance of own texts' cross-entropies; the variance falls with the length to a floor."""
    few, rest = [], []
    for k, name in enumerate(model.languages):
        own = (lang == name) & (n > 0)
        h, m = entropy[own], n[own]
        mean = float(np.median(h)) if len(h) else np.log(alphabet())
        square = np.minimum((h - mean) ** 2, np.quantile((h - mean) ** 2, LIMIT_QUANTILE, method="lower")) if len(h) else h
        if len(h) < LEAST_OWN:
            few.append((k, mean, float(square.mean()) if len(h) else 0.0, len(h)))
            continue
        long_ = m >= np.median(m)
        wide = max(float(square[long_].mean()), 1e-6)
        narrow = max(float(((square - wide) * m)[~long_].mean()) if (~long_).any() else 0.0, CHARACTER_VARIANCE)
        z = (h - mean) / np.sqrt(wide + narrow / m)
        model.limits[k] = mean, wide, narrow, max(LEAST_REJECTED, 1.2 * float(np.quantile(z, LIMIT_QUANTILE, method="lower")))
        rest.append(model.limits[k])
    # the others' mean deviation, or without others that of all languages of few texts
    pooled = np.mean(rest, axis=0) if rest else np.array([0, max([np.mean([x[2] for x in few if x[3] > 1] or [0.0]), 1e-6]), CHARACTER_VARIANCE, LEAST_REJECTED])
    for k, mean, square, size in few:
        model.limits[k] = mean, max(pooled[1], square) * (1 + 1 / max(size, 1)), pooled[2], pooled[3]


def picked(labelled: DataFrame, wanted: int) -> DataFrame:
    """text, lang, place (from 1): the wanted rows of each language of least hash of id and text; equal rows are one."""
    rows = labelled.where("lang is not null and text is not null").select(F.col("text").cast("string").alias("text"), "lang", F.xxhash64("doc_id", "text", "lang").alias("pick"))
    # repeated rows count once here too; the slack is 15 times the estimate's deviation
    totals = staged(rows.groupBy("lang").agg(F.approx_count_distinct("pick", PICK_DEVIATION).alias("total")), "lang-totals")
    if totals.count() <= MOST_BROADCAST:  # else texts meet their language's total by a shuffle
        totals = F.broadcast(totals)
    likely = rows.join(totals, "lang").where((F.col("pick") / F.lit(2.0**64) + 0.5) * F.col("total") <= wanted * (1 + 15 * PICK_DEVIATION) + 50)
    # equal rows have one pick: joined where they lie, any number of them is one row in the window
    once = likely.groupBy("lang", "pick").agg(F.first("text").alias("text"))
    return once.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("pick"))).where(F.col("place") <= wanted).select("text", "lang", "place")


def learn(labelled: DataFrame, train_rows: int = TRAIN_ROWS, calibration_rows: int = CALIBRATION_ROWS) -> Model | None:
    """A model from rows (doc_id, text, lang): bounded numbers of each language's rows, of least hash."""
    spark, wanted = labelled.sparkSession, train_rows + calibration_rows
    small_batches(spark)
    sample = staged(picked(labelled, wanted), "lang-sample")
    held = F.col("place") % (wanted // max(1, calibration_rows)) == 0
    teaching = sample.where(~held).select("lang").distinct().collect()  # names only
    names = sorted(r["lang"] for r in teaching)
    model = Model(names, [], np.tile([0.0, 1.0, 0.0, np.inf], (len(names), 1)))
    if not names:
        return None
    counts = staged(gram_counts(sample.where(~held)), "lang-grams") if len(names) > BLOCK else gram_counts(sample.where(~held))
    seen: list[pa.Table] = []
    for a in range(0, len(names), BLOCK):
        some = names[a : a + BLOCK]
        table = counts.where(F.col("lang").isin(some)).toArrow()  # bounded by the block's rows
        lang = table.column("lang").to_numpy()
        tuples, n = _from_longs(table.column("a").to_numpy(), table.column("b").to_numpy()), table.column("n").to_numpy()
        block = build_block({x: (tuples[lang == x], n[lang == x]) for x in some})
        seen.append(_own_scores(sample.where(held & F.col("lang").isin(some)), block).toArrow())
        if len(names) > BLOCK * BLOCKS_HELD:
            path = f"{fresh_path(spark, 'lang-block')}.pickle"
            sharedfs.make_dir(path.rpartition("/")[0])
            with sharedfs.writing(path) as out:
                out.write(pickle.dumps(block))
            block = path
        model.blocks.append(block)
    lang, h, n = (np.concatenate([x.column(c).to_numpy() for x in seen]) for c in ("lang", "h", "n"))
    enough = {x for x, k in zip(*np.unique(lang[n > 0].astype(str), return_counts=True)) if k >= LEAST_OWN}
    few = [x for x in names if x not in enough]
    if few:
        crossed = cross_scores(sample.where(F.col("lang").isin(few))).toArrow()
        kept = ~np.isin(lang.astype(str), few)
        lang, h, n = (np.concatenate([x[kept], crossed.column(c).to_numpy()]) for c, x in (("lang", lang), ("h", h), ("n", n)))
    calibrate(model, lang, h, n)
    return model


def _own_scores(sample: DataFrame, block: Block) -> DataFrame:
    """lang, h, n: cross-entropy and events of each text under its own language."""
    shared = sample.sparkSession.sparkContext.broadcast(block)  # bounded by a block's rows

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {x: k for k, x in enumerate(shared.value.languages)}
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                c, offsets = codes(part.column("text"))
                m, at = predicted(c, offsets), np.array([place[x] for x in part.column("lang").to_pylist()], np.int64)
                yield pa.record_batch({"lang": part.column("lang"), "h": -shared.value.sums(c, offsets)[np.arange(len(at)), at] / np.maximum(m, 1), "n": m})

    return sample.select("text", "lang").mapInArrow(trimmed(own), "lang string, h double, n long")


def identify(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep columns and lang_pred, score, rejected for every row."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # BLOCKS_HELD blocks at most, each bounded by its training rows
    out = "lang_pred string, score double, rejected boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for rows in slices(batch, "_text", SLICE_BYTES):
                if m is None:
                    n = rows.num_rows
                    lang, score, far = np.full(n, UNKNOWN, object), np.zeros(n), np.ones(n, bool)
                else:
                    lang, score, far = m.predict(rows.column("_text"))
                yield pa.record_batch({c: rows.column(c) for c in keep} | {"lang_pred": pa.array(lang, pa.string()), "score": score, "rejected": far})

    rows = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(trimmed(run), f"{kept}, {out}")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = fold("doc_id", 4) == 2
    model = learn(docs.where(~held).select("doc_id", "text", "lang"))
    return identify(docs.withColumn("held_out", held), model, ("doc_id", "held_out")).select("doc_id", "held_out", "lang_pred", "score", "rejected")
