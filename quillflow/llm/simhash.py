"""SimHash fingerprints of three-word shingles, and links within two bits by bit-sliced comparison.

Fingerprints are compared as distinct values. By the pigeonhole principle two that differ in two
bits at most agree in two of four 16-bit blocks, so each goes into six buckets. A bucket that
holds many is divided again by the bits that are still free, in the same way, until it is small or
no bits are left to divide: nothing is capped. Within a bucket the values stand as vertical bit
planes, 64 values to a machine word; a value is compared with all others at once by carry-save
counters, and a block of words is abandoned once all its counters are over the radius. A bucket
yields a spanning forest of its links, not all pairs; connected components join the forests.

Nulls and edges: a null or wordless text has fingerprint zero and links like any other. Rows with
a null id get a fingerprint and the component of their fingerprint, but are never its name (null if
all ids are null). Repeated rows and ties share fingerprint and component. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, small_batches, staged, text_buffer, trimmed
from .components import components

SEED, SHINGLE, RADIUS = 42, 3, 2
#: Buckets of more values than this are divided again.
BUCKET_VALUES = 2048
_SHINGLES_AT_ONCE = 1 << 15
_PLANES_BETWEEN_LOOKS = 16


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of a UTF-8 text."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(sizes + 1) - 1
    starts, stops = (stops - sizes)[: len(words) - SHINGLE + 1].tolist(), stops[SHINGLE - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for a in range(0, len(starts), _SHINGLES_AT_ONCE):
        hashes = np.fromiter((xxh64_intdigest(joined[i:j], SEED) for i, j in zip(starts[a : a + _SHINGLES_AT_ONCE], stops[a : a + _SHINGLES_AT_ONCE])), np.uint64)
        counts += _bit_counts(hashes)
    bits = counts * 2 > len(starts)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _bit_counts(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the 64 bits as a long), and the columns of keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text", 4 << 20):
                raw, off = text_buffer(rows.column("text"))
                raw = raw.tobytes()
                found = np.array([fingerprint(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())], np.uint64)
                yield pa.record_batch({"doc_id": rows.column("doc_id"), "fp": found.view(np.int64)} | {c: rows.column(f"_{c}") for c in keep})

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *[F.col(c).alias(f"_{c}") for c in keep])
    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(trimmed(run), f"doc_id long, fp long{kept}")


# ---- comparison within a bucket


def bit_planes(values: np.ndarray) -> np.ndarray:
    """64 rows of words: row b holds bit b of all values, 64 values to a word."""
    padded = np.zeros(-(-len(values) // 64) * 64, "<u8")
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def within_radius(planes: np.ndarray, value: int) -> np.ndarray:
    """For each lane of the planes: whether it differs from value in RADIUS bits at most.

    Two carry-save counter planes count up to three, where they stick.
    """
    words = planes.shape[1]
    ones, twos = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for b in range(64):
        p = ~planes[b] if value >> b & 1 else planes[b]
        carry = ones & p
        over = twos & carry  # from three to four: stay at three
        ones = (ones ^ p) | over | (twos & ones)
        twos |= carry
        if b % _PLANES_BETWEEN_LOOKS == _PLANES_BETWEEN_LOOKS - 1 and (ones & twos == full).all():
            return np.zeros(words * 64, bool)
    near = ~(ones & twos)
    return np.unpackbits(near.view(np.uint8), bitorder="little").astype(bool)


def forest(values: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links within RADIUS bits among distinct values."""
    n = len(values)
    if n == 2:
        a, b = int(values[0]), int(values[1])
        return [(a, b)] if (a ^ b).bit_count() <= RADIUS else []
    planes, found = bit_planes(values), []
    unseen = np.ones(n, bool)
    values = [int(v) for v in values]
    for k in range(n):
        if not unseen[k]:
            continue
        unseen[k], todo = False, [k]
        while todo:
            x = todo.pop()
            near = np.flatnonzero(within_radius(planes, values[x])[:n] & unseen)
            unseen[near] = False
            found += [(values[x], values[y]) for y in near.tolist()]
            todo += near.tolist()
    return found


# ---- buckets

_BLOCKS = tuple(0xFFFF << s for s in (0, 16, 32, 48))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _thirds(free: int) -> tuple[int, ...]:
    """The free bits in three parts: two values within two bits agree in at least one."""
    bits = [1 << b for b in range(64) if free >> b & 1]
    cut = [round(len(bits) * k / 3) for k in range(4)]
    return tuple(sum(bits[a:b]) for a, b in zip(cut, cut[1:]))


def _masks(levels: int) -> list[list[int]]:
    """By level, each mask of bits that a bucket holds fixed; a level's mask k divides into masks 3k to 3k + 2 of the next."""
    full = (1 << 64) - 1
    found = [[_BLOCKS[i] | _BLOCKS[j] for i in range(4) for j in range(i)]]
    for _ in range(levels - 1):
        found.append([m | t for m in found[-1] for t in _thirds(full ^ m)])
    return found


#: After these levels a bucket has 10 or fewer free bits, so 1024 values at most.
LEVELS = 4


def _bucketed(values: DataFrame, masks: list[int], path: Column | None) -> DataFrame:
    """fp in each of its buckets: mask (its place in masks) and fixed (the bits it fixes)."""
    table = F.array(*[F.lit(_signed(m)) for m in masks])
    which = F.sequence(F.lit(0), F.lit(len(masks) - 1)) if path is None else F.sequence(path * 3, path * 3 + 2)
    return values.select("fp", F.explode(which).alias("mask")).withColumn("fixed", F.col("fp").bitwiseAND(F.get(table, F.col("mask"))))


def links(values: DataFrame) -> DataFrame:
    """u, v: edges that connect whatever is linked. values: distinct fp."""
    masks, found, rest = _masks(LEVELS), [], None
    for level in range(LEVELS):
        rows = _bucketed(values, masks[0], None) if level == 0 else _bucketed(rest, masks[level], F.col("mask"))
        sizes = rows.groupBy("mask", "fixed").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        last = level == LEVELS - 1
        sizes = sizes if last else staged(sizes, "simhash-sizes")
        small = sizes if last else sizes.where(F.col("n") <= BUCKET_VALUES)
        found.append(rows.join(small, ["mask", "fixed"]).repartition("mask", "fixed").sortWithinPartitions("mask", "fixed").select("mask", "fixed", "fp").mapInArrow(trimmed(_compare), "u long, v long"))
        if last or sizes.where(F.col("n") > BUCKET_VALUES).isEmpty():
            break
        rest = rows.join(sizes.where(F.col("n") > BUCKET_VALUES), ["mask", "fixed"]).select("fp", "mask")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets come whole and in order, perhaps across batches."""
    held: list[np.ndarray] = []
    name = None

    def emit(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        table = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.record_batch({"u": table[:, 0], "v": table[:, 1]})

    for b in batches:
        mask, fixed, fp = (b.column(k).to_numpy() for k in range(3))
        if not len(fp):
            continue
        pairs: list[tuple[int, int]] = []
        cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (fixed[1:] != fixed[:-1])) + 1
        for a, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)]):
            if held and name != (mask[a], fixed[a]):
                pairs += forest(np.concatenate(held))
                held = []
            name = (mask[a], fixed[a])
            held.append(fp[a:e].astype(np.int64).view(np.uint64))
        yield emit(pairs)
    if held:
        yield emit(forest(np.concatenate(held)))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links reach from the row's fingerprint."""
    rows = staged(fingerprints(docs, key, text), "simhash")
    values = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-values")
    linked = components(links(values.select("fp")))
    named = values.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = named.select("fp", "component").join(least, "component").select("fp", "component_id")
    return rows.join(ids, "fp").select("doc_id", "fp", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
