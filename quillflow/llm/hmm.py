"""A hidden Markov language model over word classes, trained by Baum-Welch across partitions.

Every word belongs to one class by its form: short words by their spelling, longer ones by their
ending. A state emits classes, a class emits its words by their smoothed counts, so the model is a
proper distribution over texts: log P(text) is the forward likelihood of the classes plus the
words' log-probabilities within their classes.

Word counts cover all training texts. They are too many for any one place: texts are encoded in
chunks, each chunk sends its distinct words to buckets by hash, a bucket adds up its words, and
each chunk gets back the counts of its own words. Training sums expected counts over all training
texts; only states * classes sums reach the driver. Training and scoring both run over whole texts:
very long ones in segments side by side, joined exactly by each segment's transfer matrix, so that
memory and steps are bounded by the segments, not by the longest text.

Nulls and edges: a null or wordless text is its end token alone. A null doc_id is scored like any
other. Repeated rows each count. With no training text, counts are zero, and the model is uniform
over classes. Other columns are ignored.
"""

from __future__ import annotations

import collections
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, documents, fold, slices, small_batches, staged, trimmed, word_codes

STATES, CLASSES = 8, 4096
#: Passes over all training texts.
PASSES = 15
#: Tokens of a text that is gone through at one stretch, and of the segments of a longer one; tokens handled at once.
LONG, SEGMENT, TOKENS_AT_ONCE = 4096, 256, 300_000
#: A text of more tokens takes no more room of a group than one of so many: each step then has enough texts to outweigh its call.
COUNTED = 1000
#: Tokens whose emissions are summed at once: few enough to stay in a core's cache.
SUMMED = 1 << 16
#: Segments of one text that its score takes at once.
SEGMENTS_AT_ONCE = 4096
#: Steps after which training's forward sums are scaled to one again; they shrink by the least ratio between states at each.
RESCALED = 4
#: Bytes of classes (two a token) among which texts of like length are handled together.
POOL_BYTES = 16 << 20
#: Bytes of text for each bucket of words.
BUCKET_BYTES = 16 << 20
SMOOTH = 0.05
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


# ---- words and their classes


def word_class(word: bytes) -> int:
    """1 to CLASSES - 1; 0 is the end token's. Short words by spelling, others by their last three bytes."""
    word = word.rstrip(b".,;:!?") or word
    return 1 + zlib.crc32(word if len(word) <= 4 else b"-" + word[-3:]) % (CLASSES - 1)


def encode(docs: DataFrame) -> DataFrame:
    """Texts in chunks: size (bytes), doc_ids, train, bounds, words in order of their hashes, the hashes, and each token's place among the words.

    docs: doc_id, text, train.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows in slices(batch, "text", BATCH_BYTES):
                words, index, bounds = word_codes(rows.column("text"), _LOWER)
                words = [w.encode() for w in words.to_pylist()]
                hashes = np.array([zlib.crc32(w) if w else -1 for w in words], np.int64)
                order = np.argsort(hashes, kind="stable")
                order = order[hashes[order] >= 0]
                place = np.full(len(words), -1, np.int64)
                place[order] = np.arange(len(order))
                tokens = place[index] if len(index) else np.empty(0, np.int64)
                real = tokens >= 0  # but for the empty words at rows' ends
                bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
                yield pa.record_batch({"chunk": [chunk], "size": [int(pc.sum(pc.binary_length(rows.column("text"))).as_py() or 0)], "doc_ids": pa.array([rows.column("doc_id").to_pylist()], pa.list_(pa.int64())), "train": pa.array([rows.column("train").to_pylist()], pa.list_(pa.bool_())), "bounds": [bounds.astype("<i4").tobytes()], "words": [b"\n".join([words[k] for k in order])], "hashes": [hashes[order].astype("<u4").tobytes()], "tokens": [tokens[real].astype("<u4").tobytes()]})
                chunk += 1

    schema = "chunk long, size long, doc_ids array<long>, train array<boolean>, bounds binary, words binary, hashes binary, tokens binary"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "train").mapInArrow(trimmed(run), schema)


def count_words(chunks: DataFrame, buckets: int) -> DataFrame:
    """For each chunk and bucket: counts over all training texts, and classes, of the chunk's words in order.

    A row of chunk -1 for each bucket has by class the sums of counts and the known words.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                chunk, train, bounds, words, hashes, tokens = (batch.column(c)[k].as_py() for c in ("chunk", "train", "bounds", "words", "hashes", "tokens"))
                bucket, words = np.frombuffer(hashes, "<u4").astype(np.int64) * buckets >> 32, words.split(b"\n")
                full = np.unique(bucket)  # those that the chunk has words of
                cuts = np.append(np.searchsorted(bucket, full), len(bucket))
                counted = np.repeat(np.array(train, bool), np.diff(np.frombuffer(bounds, "<i4")))
                n = np.bincount(np.frombuffer(tokens, "<u4")[counted], minlength=int(cuts[-1])).astype("<u4")
                spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
                yield pa.record_batch({"bucket": full.astype(np.int32), "chunk": np.full(len(full), chunk), "words": pa.array([b"\n".join(words[a:b]) for a, b in spans], pa.binary()), "n": pa.array([n[a:b].tobytes() for a, b in spans], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        parts = [x.split(b"\n") for x in table.column("words").to_pylist()]
        coded = pa.array([w for x in parts for w in x], pa.binary()).dictionary_encode()
        index = coded.indices.to_numpy()
        n = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("n").to_pylist()])
        total = np.bincount(index, n).astype(np.int64)
        cls = np.array([word_class(w) for w in coded.dictionary.to_pylist()], np.int64)
        sums = np.stack([np.bincount(cls, total, CLASSES), np.bincount(cls[total > 0], minlength=CLASSES)]).astype("<i8")
        stops = np.cumsum([len(x) for x in parts])
        own = np.split(index, stops[:-1])
        return pa.table({"chunk": pa.array([-1, *table.column("chunk").to_pylist()], pa.int64()), "bucket": pa.array([bucket] * (len(parts) + 1), pa.int32()), "n": pa.array([sums[0].tobytes(), *(total[x].astype("<i8").tobytes() for x in own)], pa.binary()), "cls": pa.array([sums[1].tobytes(), *(cls[x].astype("<u2").tobytes() for x in own)], pa.binary())})

    sent = chunks.select("chunk", "train", "bounds", "words", "hashes", "tokens").mapInArrow(trimmed(send), "bucket int, chunk long, words binary, n binary")
    return sent.groupBy("bucket").applyInArrow(add, "chunk long, bucket int, n binary, cls binary")


@dataclass(frozen=True)
class Totals:
    """All training tokens, distinct ones, texts; and by class the tokens and distinct words."""

    tokens: int
    distinct: int
    texts: int
    by_class: np.ndarray
    known: np.ndarray


def totals(chunks: DataFrame, counts: DataFrame) -> Totals:
    texts = chunks.select(F.explode("train").alias("t")).agg(F.coalesce(F.sum(F.col("t").cast("long")), F.lit(0))).first()[0]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, known in zip(b.column("n").to_pylist(), b.column("cls").to_pylist()):
                yield pa.record_batch({"c": np.arange(CLASSES), "n": np.frombuffer(n, "<i8"), "k": np.frombuffer(known, "<i8")})

    sums = counts.where("chunk = -1").select("n", "cls").mapInArrow(trimmed(unpack), "c long, n long, k long").groupBy("c").agg(F.sum("n"), F.sum("k")).toArrow()
    by_class, known = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    c = sums.column(0).to_numpy()
    by_class[c], known[c] = sums.column(1).to_numpy(), sums.column(2).to_numpy()
    return Totals(int(by_class.sum()) + texts, int(known.sum()) + (texts > 0), texts, by_class, known)


def sequences(chunks: DataFrame, counts: DataFrame, t: Totals) -> DataFrame:
    """doc_id, train, n_tokens, n_known, base_score, in_class (log10 of the words within their classes), classes."""
    shift = np.log10(t.by_class + 0.5 * (t.known + 1))
    base = np.log10(t.tokens + 0.5 * (t.distinct + 1))
    end = float(np.log10(t.texts + 0.5) - base)

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = {c: left.column(c)[0].as_py() for c in ("doc_ids", "train", "bounds", "tokens")} if left.num_rows else None
        if rows is None:
            return _EMPTY
        right = right.sort_by("bucket")
        blob = lambda c, kind: np.frombuffer(b"".join(right.column(c).to_pylist()), kind)
        n, cls = blob("n", "<i8"), blob("cls", "<u2").astype(np.int64)
        tokens, bounds = np.frombuffer(rows["tokens"], "<u4"), np.frombuffer(rows["bounds"], "<i4").astype(np.int64)
        seen = np.log10(n + 0.5)

        def by_row(x: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([[0.0], np.cumsum(x[tokens], dtype=np.longdouble)])[bounds]).astype(float) if len(tokens) else np.zeros(len(bounds) - 1)

        known = by_row((n > 0).astype(float)).round().astype(np.int64) + (t.texts > 0)
        codes = cls[tokens].astype("<u2") if len(tokens) else np.empty(0, "<u2")
        return pa.table({"doc_id": pa.array(rows["doc_ids"], pa.int64()), "train": pa.array(rows["train"], pa.bool_()), "n_tokens": np.diff(bounds) + 1, "n_known": known, "base_score": by_row(seen - base) + end, "in_class": by_row(seen - shift[cls]), "classes": pa.array([codes[a:b].tobytes() + b"\0\0" for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())})

    schema = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, in_class double, classes binary"
    chunks = chunks.select("chunk", "doc_ids", "train", "bounds", "tokens")
    return chunks.groupBy("chunk").cogroup(counts.where("chunk >= 0").groupBy("chunk")).applyInArrow(join, schema)


_EMPTY = pa.table({"doc_id": pa.array([], pa.int64()), "train": pa.array([], pa.bool_()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "in_class": pa.array([], pa.float64()), "classes": pa.array([], pa.binary())})


# ---- the model


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @classmethod
    def first(cls, by_class: np.ndarray, seed: int = 7) -> Model:
        """States near the overall class shares, each tilted at random, that tend to stay."""
        rng = np.random.default_rng(seed)
        share = by_class + 0.5
        emit = share * rng.dirichlet(np.full(STATES, 0.8), len(share)).T.clip(0.02)
        move = np.full((STATES, STATES), 0.1 / (STATES - 1))
        np.fill_diagonal(move, 0.9)
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=1, keepdims=True))

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        share = emit.sum(axis=0) + SMOOTH
        emit = emit + SMOOTH * STATES * share / share.sum() * len(share) / STATES  # a little of the overall shares
        start, move = start + SMOOTH, move + SMOOTH
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


def _ranks(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences side by side, longest first: their order, and where each step starts and how many it has."""
    order = np.argsort(-lengths, kind="stable")
    active = len(lengths) - np.searchsorted(lengths[order[::-1]], np.arange(int(lengths.max(initial=0))), side="right")
    return order, np.concatenate([[0], np.cumsum(active)]), active


def _by_time(lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The codes of all sequences step by step, in the order of _ranks."""
    order, starts, _ = _ranks(lengths)
    rank = np.empty(len(lengths), np.int64)
    rank[order] = np.arange(len(lengths))
    time = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.empty_like(codes)
    out[starts[time] + np.repeat(rank, lengths)] = codes
    return out


def _groups(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Places of sequences, those of like lengths together, in groups of a bounded number of tokens: LONG / COUNTED times TOKENS_AT_ONCE at most."""
    order = np.argsort(lengths, kind="stable")
    cut = np.cumsum(np.where(lengths > LONG, lengths, np.minimum(lengths, COUNTED))[order]) // TOKENS_AT_ONCE
    if len(order):
        yield from np.split(order, np.flatnonzero(cut[1:] != cut[:-1]) + 1)


def _picked(codes: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The codes of some sequences end to end."""
    n = np.diff(bounds)[which]
    return codes[np.arange(n.sum()) + np.repeat(bounds[which] - np.cumsum(n) + n, n)]


def _cut_long(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of segments, and which segments open a text: texts over LONG tokens are several."""
    n = np.where(lengths > LONG, -(-lengths // SEGMENT), 1)
    opens = np.zeros(n.sum(), bool)
    opens[np.cumsum(n) - n] = True
    sizes = np.full(n.sum(), SEGMENT)
    last = np.cumsum(n) - 1
    sizes[last] = lengths - (n - 1) * np.where(n > 1, SEGMENT, 0)
    return sizes, opens


def _transfers(model: Model, lengths: np.ndarray, by_time: np.ndarray, kind: type = np.float64) -> tuple[np.ndarray, np.ndarray]:
    """For each sequence and each state before its first token: the scaled forward row at its end, and the row's log.

    A class's share in the likeliest state is taken as 1, so each sequence's logs lack the same sum of logs.
    """
    order, starts, active = _ranks(lengths)
    n, move = len(lengths), model.move.astype(kind)
    emit = np.take((model.emit / model.emit.max(axis=0)).T.astype(kind, order="C"), by_time.astype(np.int64), axis=0)
    rows = np.tile(np.eye(STATES, dtype=kind), (n, 1))  # for each sequence a row for each state before
    spare, logs, total = np.empty_like(rows), np.zeros(n * STATES), np.ones_like(move)
    ends = np.empty((n, STATES, STATES))
    for t, (k, a) in enumerate(zip(active.tolist(), starts.tolist())):
        now = rows[: k * STATES]
        if t:
            now = np.matmul(now, move, out=spare[: k * STATES])
            rows, spare = spare, rows
        now *= np.repeat(emit[a : a + k], STATES, axis=0)
        later = active[t + 1] if t + 1 < len(active) else 0
        if t % RESCALED == 0 or later < k:
            scale = now @ total  # each row's sum, for every state
            now /= scale
            logs[: k * STATES] += np.log(scale[:, 0])
            ends[order[later:k]] = now[later * STATES :].reshape(-1, STATES, STATES)
    found = np.empty((n, STATES))
    found[order] = logs.reshape(n, STATES)
    return ends, found


def log_likelihoods(model: Model, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """log10 likelihood of each sequence by the scaled forward recursion.

    A text over LONG tokens is gone through in segments at once: each gives its end for every state
    before it, and the ends are joined in turn. The result is the same.
    """
    bounds, found = np.concatenate([[0], np.cumsum(lengths)]), np.empty(len(lengths))
    most = model.emit.max(axis=0)
    relative, logs, forth = model.emit / most, np.log(most), model.move.T.copy()
    short = np.flatnonzero(lengths <= LONG)
    for group in _groups(lengths[short]):
        which = short[group]
        own = _picked(codes, bounds, which)
        order, starts, active = _ranks(lengths[which])
        emit, total, alpha = np.take(relative, _by_time(lengths[which], own), axis=1), np.zeros(len(which)), None
        for t, n in enumerate(active):
            now = emit[:, starts[t] : starts[t] + n]
            alpha = model.start[:, None] * now if t == 0 else (forth @ alpha[:, :n]) * now
            later = active[t + 1] if t + 1 < len(active) else 0
            if t % RESCALED == 0 or later < n:
                scale = alpha.sum(axis=0)
                alpha /= scale
                total[:n] += np.log(scale)
        found[which[order]] = total
        found[which] += np.add.reduceat(logs[own], np.cumsum(lengths[which]) - lengths[which])
    for k in np.flatnonzero(lengths > LONG):
        sizes, _ = _cut_long(lengths[k : k + 1])
        before, total, at = model.start, 0.0, bounds[k]
        for a in range(0, len(sizes), SEGMENTS_AT_ONCE):
            some = sizes[a : a + SEGMENTS_AT_ONCE]
            for row, log in zip(*_transfers(model, some, _by_time(some, codes[at : at + some.sum()]))):
                after = (before * np.exp(log - log.max())) @ row
                total += log.max() + np.log(after.sum())
                before = (after / after.sum()) @ model.move
            at += some.sum()
        found[k] = total + logs[codes[bounds[k] : at]].sum()
    return found / np.log(10)


# ---- training


@dataclass(frozen=True)
class Group:
    """Sequences that training goes through side by side: distinct texts, or segments of long ones, with their codes by time.

    opens: whether a sequence begins a text. weights: how many texts are equal to the one it belongs to.
    """

    sizes: np.ndarray
    opens: np.ndarray
    weights: np.ndarray
    codes: np.ndarray

    def to_batch(self) -> pa.RecordBatch:
        return pa.record_batch({k: pa.array([v.tobytes()], pa.binary()) for k, v in zip(("sizes", "opens", "weights", "codes"), (self.sizes.astype("<i4"), self.opens, self.weights.astype("<i8"), self.codes.astype("<u2")))})

    @classmethod
    def from_row(cls, sizes: bytes, opens: bytes, weights: bytes, codes: bytes) -> Group:
        return cls(np.frombuffer(sizes, "<i4").astype(np.int64), np.frombuffer(opens, bool), np.frombuffer(weights, "<i8"), np.frombuffer(codes, "<u2"))


def arranged(texts: list[bytes]) -> Iterator[Group]:
    """Groups of texts' classes (two bytes a token); equal texts are one."""
    counts = collections.Counter(texts)
    kinds = list(counts)
    lengths = np.array([len(x) // 2 for x in kinds], np.int64)
    for some in (np.flatnonzero(lengths <= LONG), np.flatnonzero(lengths > LONG)):
        for group in _groups(lengths[some]):
            which = some[group]
            sizes, opens = _cut_long(lengths[which])
            weights = np.array([counts[kinds[k]] for k in which])[np.cumsum(opens) - 1]
            yield Group(sizes, opens, weights, _by_time(sizes, np.frombuffer(b"".join([kinds[k] for k in which]), "<u2")))


def _entries(model: Model, rows: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each segment of one text: the states before its first token, and what follows its last one (to scale)."""
    n = len(rows)
    before, after = np.empty((n, STATES)), np.ones((n, STATES))
    through = np.exp(logs - logs.max(axis=1, keepdims=True))[:, :, None] * rows
    forth, back = through @ model.move, model.move @ through
    before[0] = model.start
    for k in range(n - 1):
        b = before[k] @ forth[k]
        before[k + 1] = b / b.sum()
    for k in range(n - 1, 0, -1):
        v = back[k] @ after[k]
        after[k - 1] = v / v.sum()
    before, after = before.T, after.T
    return before, after


def _steps_alike(steps: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of steps that are followed by one of as many sequences, SUMMED tokens at most; a step that fewer follow by itself."""
    t = 0
    while t + 1 < len(steps):
        stop = t + 1
        while steps[stop] == steps[t] and stop + 1 < len(steps) and steps[stop + 1] == steps[t] and (stop + 1 - t) * steps[t] <= SUMMED:
            stop += 1
        yield t, stop
        t = stop


def _forward_backward(model: Model, active: np.ndarray, by_time: np.ndarray, before: np.ndarray, after: np.ndarray, weights: np.ndarray, sums: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Add to sums (moves within sequences, emissions); states at the first tokens, and what joins sequences of one text.

    All by rank. before: states ahead of each first token; after: what follows each last token, to scale.
    Weights come in with what follows, which all that is expected is proportional to.
    """
    n_all, steps, by_time = int(active[0]), active.tolist(), by_time.astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(active)]).tolist()
    # a class's share in the likeliest state is taken as 1: what states a token may have depends on the ratios alone
    shares, move = (model.emit / model.emit.max(axis=0)).T.astype(np.float32, order="C"), model.move.astype(np.float32)
    emit = np.take(shares, by_time, axis=0)  # a row for each token, so a step's tokens lie together
    alpha, beta, back, total = np.empty_like(emit), np.empty_like(emit), move.T.copy(), np.ones_like(move)
    now, last = before.T.astype(np.float32, order="C"), np.empty((n_all, STATES), np.float32)
    for t, (n, a) in enumerate(zip(steps, starts)):
        if t and n < len(now):
            last[n : len(now)] = now[n:]
            now = now[:n]
        e, to = emit[a : a + n], alpha[a : a + n]
        now = np.multiply(np.matmul(now, move, out=to) if t else now, e, out=to)
        if t % RESCALED == 0:
            scale = now @ total  # each row's sum, for every state
            now /= scale
            e /= scale
    last[: len(now)] = now
    follow = after.T.astype(np.float32, order="C")
    follow *= (weights / (last * follow).sum(axis=1))[:, None]
    later, x = 0, None
    for n, a in zip(steps[::-1], starts[-2::-1]):
        b = beta[a : a + n]
        if n > later:
            b[later:] = follow[later:n]
        if later:
            np.matmul(x, back, out=b[:later])
        x, later = emit[a : a + n], n
        x *= b
    moves = np.zeros((STATES, STATES))
    for t, stop in _steps_alike(steps):  # tokens of steps t to stop, and those after them
        n, next_n, a = steps[t], steps[stop], starts[t]
        size = (stop - t) * n if next_n == n else next_n
        moves += alpha[a : a + size].T @ emit[a + n : a + n + size]
    sums[0][:] += model.move * moves
    for a in range(0, len(by_time), SUMMED):
        some, share = by_time[a : a + SUMMED], alpha[a : a + SUMMED] * beta[a : a + SUMMED]
        for k in range(STATES):
            sums[1][k] += np.bincount(some, share[:, k], CLASSES)
    return (alpha[:n_all] * beta[:n_all]).T, emit[:n_all].T, (last / last.sum(axis=1, keepdims=True)).T


def group_counts(model: Model, group: Group, sums: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
    """Add a group's expected starts, moves and emissions to sums."""
    start, moves, emitted = sums
    order, starts, active = _ranks(group.sizes)
    before, after = np.repeat(model.start[:, None], len(order), axis=1), np.ones((STATES, len(order)))
    several = not group.opens.all()
    if several:
        rows, logs = _transfers(model, group.sizes, group.codes, np.float32)
        firsts = np.append(np.flatnonzero(group.opens), len(order))
        for a, b in zip(firsts[:-1], firsts[1:]):
            before[:, a:b], after[:, a:b] = _entries(model, rows[a:b], logs[a:b])
    joining, ending = np.empty((2, STATES, len(order)))
    step = max(1, TOKENS_AT_ONCE // len(active)) if several else len(order)
    for a in range(0, len(order), step):
        b = min(len(order), a + step)
        here = np.minimum(active, b) - a
        here = here[here > 0]
        codes = group.codes if b - a == len(order) else np.concatenate([group.codes[starts[t] + a : starts[t] + a + n] for t, n in enumerate(here)])
        own = order[a:b]
        opening, joining[:, own], ending[:, own] = _forward_backward(model, here, codes, before[:, own], after[:, own], group.weights[own], (moves, emitted))
        start += opening[:, group.opens[own]].sum(axis=1)
    if several:
        inner = np.flatnonzero(~group.opens)
        moves += model.move * (ending[:, inner - 1] @ joining[:, inner].T)


def expected_counts(model: Model, texts: Iterable[Group]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch sums of starts, moves and emissions over whole texts.

    Long texts are gone through in segments, whose states ahead and sequels are found first. Nothing is
    cut: the sums are those of one run through each text.
    """
    sums = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, CLASSES))
    for group in texts:
        group_counts(model, group, sums)
    return sums


def arrange(training: DataFrame) -> DataFrame:
    """Groups of all texts of training (classes), POOL_BYTES of them at a time, for every pass to read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for x in batch.column("classes").to_pylist():
                held.append(x)
                size += len(x)
                if size >= POOL_BYTES:
                    yield from (g.to_batch() for g in arranged(held))
                    held, size = [], 0
        yield from (g.to_batch() for g in arranged(held))

    return training.select("classes").mapInArrow(trimmed(run), "sizes binary, opens binary, weights binary, codes binary")


def baum_welch(model: Model, groups: DataFrame) -> Model:
    """One step over all groups. Sums of states * classes come to the driver."""
    shared = groups.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (Group.from_row(*(batch.column(c)[k].as_py() for c in ("sizes", "opens", "weights", "codes"))) for batch in batches for k in range(batch.num_rows))
        flat = np.concatenate([x.ravel() for x in expected_counts(shared.value, rows)])
        some = np.flatnonzero(flat)
        yield pa.record_batch({"k": some, "x": flat[some]})

    sums = groups.select("sizes", "opens", "weights", "codes").mapInArrow(trimmed(run), "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).toArrow()
    flat = np.zeros(STATES + STATES * STATES + STATES * CLASSES)
    flat[sums.column("k").to_numpy()] = sums.column("x").to_numpy()
    a, b = STATES, STATES + STATES * STATES
    return Model.from_counts(flat[:a], flat[a:b].reshape(STATES, STATES), flat[b:].reshape(STATES, CLASSES))


def train(rows: DataFrame, t: Totals) -> Model:
    """Every pass sees all training texts, whatever their number."""
    classes = t.by_class.astype(float)
    classes[0] = t.texts
    model = Model.first(classes)
    if not t.texts:
        return model
    groups = staged(arrange(rows.where("train")), "hmm-training", "snappy")  # read by every pass
    for _ in range(PASSES):
        model = baum_welch(model, groups)
    return model


def score(rows: DataFrame, model: Model) -> DataFrame:
    """rows with score, the log10 probability of the whole text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # of fixed size
    kept = [c for c in rows.columns if c not in ("classes", "in_class")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("n_tokens").to_numpy()
            codes = np.frombuffer(b"".join(batch.column("classes").to_pylist()), "<u2").astype(np.int64)
            found = log_likelihoods(shared.value, sizes, codes) if len(sizes) else np.empty(0)
            yield pa.record_batch({c: batch.column(c) for c in kept} | {"score": found + batch.column("in_class").to_numpy()})

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(trimmed(run), f"{schema}, score double")


def language_model_scores(docs: DataFrame) -> DataFrame:
    """doc_id, train, n_tokens, n_known, base_score, score, train_tokens. docs: doc_id, text, train."""
    small_batches(docs.sparkSession)
    chunks = staged(encode(docs), "hmm-chunks")
    size = chunks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    counts = staged(count_words(chunks, max(4, -(-size // BUCKET_BYTES))), "hmm-counts")
    t = totals(chunks, counts)
    rows = staged(sequences(chunks, counts, t), "hmm-sequences", "snappy")
    return score(rows, train(rows, t)).withColumn("train_tokens", F.lit(t.tokens).cast("long"))


def op8_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", (fold("doc_id", 5) != 1).alias("train"))
    return language_model_scores(docs).select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
