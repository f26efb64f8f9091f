"""Pack token sequences into rows of fixed capacity by a configuration linear program.

Only the histogram of piece lengths (at most capacity rows) reaches the driver. A configuration is
a multiset of lengths that fits one sequence. The covering program over configurations is solved
by multiplicative weights. Every length has a price; a knapsack dynamic program finds the
configuration of most value, and from the same table all others near it, each used for as long a
step as its scarcest length allows. Lengths of which something stays are priced higher, and the next
pass covers more, until all is covered. Any prices bound the program from below: all pieces at their
prices over the best configuration's value. Covers start from several first prices, until one lies
within GAP of the best bound. Where none does, prices and configurations are weighed against each other
step by step, each pricing gives a bound, and the mix of all answers a cover; the best cover is kept. Its steps are whole, so rounding only sets loose
configurations aside, whose pieces are placed best-fit. Plan says what the program was worth, its
bound, and how many tokens its configurations hold. Pieces then find
their place by their rank among pieces of their length; the ranks come from counts by partition,
so a length that many pieces share is not gathered anywhere.

Nulls and edges: a null or empty text is one piece with the end id alone. Texts longer than the
capacity are cut into full pieces and a rest. Repeated rows and null ids are packed like any other
rows. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import documents, slices, small_batches, staged, trimmed
from .tokens import default_vocabulary, encoder, with_end

ENCODE_BYTES = 4 << 20
#: How far above the bound a cover may be to end the search, and the exponents of a length in the first prices per token.
GAP, FIRST_PRICES = 0.002, (0.0, 0.1, 0.3, 0.6, 1.0)
#: How far below the best value of a pass a configuration may be; the next level holds if less than LEAST_COVERED of what is open was covered.
SLACKS, LEAST_COVERED = (0.004, 0.016, 0.064, 0.25, 1.0), 0.05
#: How fast prices grow.
GROWTH = 0.1
#: Steps of the mix, and rows of knapsack tables over all of them, at most.
MIX_STEPS, MIX_WORK = 3000, 40_000
#: Tokens that a rounded configuration may leave empty, the pieces of looser ones going best-fit: whichever needs the fewest sequences.
LOOSE = (1 << 30, 64, 16, 4)


@dataclass(frozen=True)
class Plan:
    """Groups of equal sequences: rows (length, first rank, pieces, first sequence, copies per sequence, first offset).

    program: the value of the program's cover in sequences, and bound: what no cover can go below; both
    without the pieces that fill a sequence alone. from_program: tokens in its rounded configurations and in full pieces.
    """

    rows: np.ndarray
    sequences: int
    program: int = 0
    bound: float = 0.0
    from_program: int = 0


class _Prices:
    """Bounded knapsack over one pass's prices, multiples by doubling: best value, and the way to any configuration."""

    def __init__(self, lengths: np.ndarray, values: np.ndarray, most: np.ndarray, capacity: int):
        self.capacity, items = capacity, []
        for k in np.lexsort((lengths, values / lengths)).tolist():  # dearest last: they are looked at first
            left, size = min(int(most[k]), capacity // int(lengths[k])), 1
            while left > 0:
                take = min(size, left)
                items.append((k, take, int(lengths[k]) * take))
                left, size = left - take, 2 * size
        best, with_it = np.zeros(capacity + 1, np.float32), np.empty(capacity + 1, np.float32)
        last = np.full((len(items), capacity + 1), -1, np.int16 if len(items) < 1 << 15 else np.int32)
        row = np.full(capacity + 1, -1, last.dtype)  # the last item that the best of each capacity takes
        for i, (k, take, weight) in enumerate(items):
            new = np.add(best[: capacity + 1 - weight], np.float32(values[k] * take), out=with_it[: capacity + 1 - weight])
            better = new >= best[weight:]
            row[weight:][better] = i
            np.maximum(best[weight:], new, out=best[weight:])
            last[i] = row
        self.items, self.last, self.best, self.values = items, last, float(best[-1]), values.tolist()
        self.below = list(range(-1, len(items) - 1))  # where to look next if nothing is left of an item

    def open_from(self, i: int, left: list[int]) -> int:
        """The next item from i down of which something is left; -1: none."""
        passed = []
        while i >= 0 and not left[self.items[i][0]]:
            passed.append(i)
            i = self.below[i]
        for k in passed:
            self.below[k] = i
        return i

    def trace(self, top: int, left: list[int]) -> tuple[dict[int, int], float]:
        """A configuration of items up to top of which enough is left, and its value."""
        at, i, found, value = self.capacity, top, {}, 0.0
        while i >= 0:
            i = int(self.last[i, at])
            if i < 0:
                break
            k, take, weight = self.items[i]
            if not left[k]:
                i = self.open_from(i, left)
                continue
            if found.get(k, 0) + take <= left[k]:
                found[k] = found.get(k, 0) + take
                value += take * self.values[k]
                at -= weight
            i -= 1
        return found, value

    def near_best(self, left: list[int], slack: float) -> Iterator[tuple[int, dict[int, int]]]:
        """(times, configuration) within slack of the best value, while left lasts."""
        top = len(self.items) - 1
        while (top := self.open_from(top, left)) >= 0:
            config, value = self.trace(top, left)
            if not config or value < (1 - slack) * self.best:
                top -= 1
                continue
            times = min(left[k] // m for k, m in config.items())
            for k, m in config.items():
                left[k] -= times * m
            yield times, config


def _cover(lengths: np.ndarray, stock: np.ndarray, capacity: int, price: np.ndarray) -> tuple[list[tuple[int, dict[int, int]]], float]:
    """(times, configuration) that cover the stock, and the dual bound of the first prices (per token)."""
    rest, found, bound = stock.copy(), [], 0.0
    while len(open_ := np.flatnonzero(rest)):
        table = _Prices(lengths[open_], (price * lengths)[open_], rest[open_], capacity)
        bound = bound or float((stock * price * lengths).sum()) / table.best
        left, most = rest[open_].tolist(), (1 - LEAST_COVERED) * float((rest * lengths).sum())
        for slack in SLACKS:
            for times, config in table.near_best(left, slack):
                found.append((times, {int(open_[k]): m for k, m in config.items()}))
            if (left * lengths[open_]).sum() <= most:
                break
        price = price.copy()
        price[open_] *= np.exp(GROWTH * np.array(left) / rest[open_])
        rest[open_] = left
    return found, bound


def _mixed(lengths: np.ndarray, stock: np.ndarray, capacity: int, value: int, bound: float) -> tuple[list[tuple[int, dict[int, int]]], float]:
    """The program solved by multiplicative weights on both sides: a cover, and the best dual bound of all pricings.

    Each step prices the lengths, and the knapsack answers with one configuration. Prices of lengths that
    it has too little of, by their share of the stock, rise, the others fall, by steps that get shorter.
    Of the answers, weighted by their steps, comes the mix of configurations that the cover consists of.
    """
    most, top, price = np.minimum(stock, capacity // lengths), bound, None
    for first in (np.ones(len(lengths)), lengths / capacity, 1 / np.maximum(1, capacity // lengths)):  # by piece, by token, by how many fit
        low = float((stock * first).sum()) / _Prices(lengths, first, most, capacity).best
        if price is None or low > top:
            top, price = max(low, top), first
    items, used = len(_Prices(lengths, price, most, capacity).items), {}
    steps = min(MIX_STEPS, MIX_WORK // max(1, items))
    for step in range(steps):
        table = _Prices(lengths, price, most, capacity)
        top = max(top, float((stock * price).sum()) / table.best)
        if value <= max(np.ceil(top - 1e-6), (1 + GAP) * top):
            return [], top
        config, count = table.trace(len(table.items) - 1, most.tolist())[0], np.zeros(len(lengths))
        count[list(config)] = list(config.values())
        lack = (stock - top * count) * price
        size = 0.5 / np.sqrt(step + 1) * np.sqrt(len(lengths)) / max(float(np.abs(lack).sum()), 1e-30)
        if step >= steps // 3:  # the first ones know little
            key = tuple(sorted(config.items()))
            used[key] = used.get(key, 0.0) + size
        price = price * np.exp(np.clip(size * lack, -1, 1))
        price = np.maximum(price / price.max(), 1e-12)
    total, left, found = sum(used.values()), stock.copy(), []
    for config, weight in sorted(used.items(), key=lambda x: (-x[1], x[0])):
        if times := min(int(top * weight / total), *(int(left[k]) // m for k, m in config)):
            found.append((times, dict(config)))
            for k, m in config:
                left[k] -= times * m
    open_ = np.flatnonzero(left)
    if len(open_):
        rest, _ = _cover(lengths[open_], left[open_], capacity, np.ones(len(open_)))
        found += [(times, {int(open_[k]): m for k, m in config.items()}) for times, config in rest]
    return found, top


def _solve(lengths: np.ndarray, stock: np.ndarray, capacity: int) -> tuple[list[tuple[int, dict[int, int]]], int, float]:
    """The best cover, its value and the best dual bound."""
    best, value, bound = [], 0, 0.0
    for exponent in FIRST_PRICES:
        found, low = _cover(lengths, stock, capacity, (lengths / capacity) ** exponent)
        bound = max(bound, low)
        if not best or sum(times for times, _ in found) < value:
            best, value = found, sum(times for times, _ in found)
        if value <= max(np.ceil(bound), (1 + GAP) * bound):
            return best, value, bound
    found, bound = _mixed(lengths, stock, capacity, value, bound)
    if found and sum(times for times, _ in found) < value:
        best, value = found, sum(times for times, _ in found)
    return best, value, bound


def _best_fit(stock: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, on groups of equal bins: (configuration, bins)."""
    groups: list[list[tuple[dict[int, int], int]]] = [[] for _ in range(capacity + 1)]  # by room left
    filled = np.zeros(capacity + 1, bool)
    for length in np.flatnonzero(stock)[::-1].tolist():
        left = int(stock[length])
        while left:
            fits = np.flatnonzero(filled[length:])
            if not len(fits):
                groups[capacity].append(({}, -(-left // (capacity // length))))
                filled[capacity] = True
                continue
            room = length + int(fits[0])
            config, bins = groups[room].pop()
            filled[room] = bool(groups[room])
            m = min(room // length, -(-left // bins))
            used = min(bins, left // m)
            if used < bins:
                groups[room].append((config, bins - used))
                filled[room] = True
            groups[room - m * length].append((config | {length: config.get(length, 0) + m}, used))
            filled[room - m * length] = True
            left -= m * used
    return [(config, bins) for group in groups for config, bins in group if config]


def _rounded(cover: list[tuple[dict[int, int], int]], capacity: int) -> tuple[list[tuple[dict[int, int], int]], list[tuple[dict[int, int], int]]]:
    """The cover's configurations that are kept, and best-fit ones of the others' pieces."""
    best: tuple = ()
    for loose in LOOSE:
        kept, stock = [], np.zeros(capacity + 1, np.int64)
        for config, times in cover:
            if sum(x * m for x, m in config.items()) >= capacity - loose:
                kept.append((config, times))
            else:
                for x, m in config.items():
                    stock[x] += m * times
        rest = _best_fit(stock, capacity)
        used = sum(n for _, n in kept) + sum(n for _, n in rest)
        if not best or used < best[0]:
            best = used, kept, rest
    return best[1:]


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Places for histogram[length] pieces of each length."""
    stock = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        stock[length] = n
    taken, rows, sequence, held = np.zeros(capacity + 1, np.int64), [], 0, 0

    def place(config: dict[int, int], times: int) -> int:
        nonlocal sequence
        offset = 0
        for length, m in sorted(config.items(), reverse=True):
            rows.append((length, taken[length], m * times, sequence, m, offset))
            taken[length] += m * times
            offset += m * length
        sequence += times
        return offset * times

    if stock[capacity]:
        held += place({capacity: 1}, int(stock[capacity]))
    lengths, program, bound = np.flatnonzero(stock[:capacity]), 0, 0.0
    rest = []
    if len(lengths):
        cover, program, bound = _solve(lengths, stock[lengths], capacity)
        named = [({int(lengths[k]): m for k, m in config.items()}, times) for times, config in cover]
        kept, rest = _rounded(named, capacity)
        for config, times in kept:
            held += place(config, times)
    for config, times in rest:
        place(config, times)
    table = np.array(rows, np.int64).reshape(-1, 6)
    return Plan(table[np.lexsort((table[:, 1], table[:, 0]))], sequence, program, bound, held)


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of every text: doc_id, piece, start, length, ids_crc32, part, place (and ids).

    place counts the pieces of the same length that the same part, a task of the scan, saw before.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, lib, seen = TaskContext.get().partitionId(), encoder(tokenizer), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for rows in slices(batch, "text", ENCODE_BYTES):
                ids, off = with_end(*lib.encode(rows.column("text")), end_id)
                n = -(-np.diff(off) // capacity)
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, np.diff(off)[row] - start)
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                place = np.empty(len(row), np.int64)
                place[order] = np.arange(len(row)) - np.searchsorted(ranked, ranked) + seen[ranked]
                seen += np.bincount(length, minlength=capacity + 1)
                raw, at = memoryview(ids.astype("<u4").tobytes()), 4 * (off[row] + start)
                own = [raw[a:b] for a, b in zip(at, at + 4 * length)]
                cols = {"doc_id": rows.column("doc_id").take(pa.array(row)), "piece": piece.astype(np.int32), "start": start, "length": length, "ids_crc32": np.array([zlib.crc32(x) for x in own], np.int64), "part": np.full(len(row), part, np.int32), "place": place}
                if with_ids:
                    cols["ids"] = pa.array([bytes(x) for x in own], pa.binary())
                yield pa.record_batch(cols)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(trimmed(pieces), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long" + ", ids binary" * with_ids)


def assign(pieces: DataFrame, capacity: int) -> DataFrame:
    """sequence_id and offset for staged pieces with columns length, part and place."""
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")
    counts = staged(counts.withColumn("before", before), "pack-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    made = plan(histogram, capacity).rows

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.int64(made[:, 1].max() + made[:, 2].max() + 1) if len(made) else 1
        keys = made[:, 0] * width + made[:, 1]
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("place").to_numpy() + b.column("before").to_numpy()
            row = made[np.searchsorted(keys, length * width + rank, side="right") - 1]
            k = rank - row[:, 1]
            cols = {c: b.column(c) for c in b.schema.names if c not in ("part", "place", "before")}
            yield pa.record_batch(cols | {"sequence_id": row[:, 3] + k // row[:, 4], "offset": row[:, 5] + k % row[:, 4] * length})

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name not in ("part", "place")]
    located = pieces.join(counts.select("length", "part", "before").hint("merge"), ["length", "part"])  # counts grow with the parts: never broadcast
    return located.mapInArrow(trimmed(place), ", ".join([c for c in kept if c.startswith("length ")] + [c for c in kept if not c.startswith("length ")] + ["sequence_id long", "offset long"]))


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, capacity: int = 4096, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece."""
    return assign(staged(cut(docs, tokenizer or default_vocabulary(), end_id, capacity, key, text, with_ids), "pack-pieces"), capacity)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
