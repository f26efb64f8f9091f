"""Token ids of documents in binary shards, with keyed access through a minimal perfect hash.

A store is a folder of
- ``shard-NNNNNN.tok``: ids of its rows end to end as little-endian unsigned integers, 16 bits wide
  if the vocabulary has up to 65,536 ids and else 32, then each row's offset in ids (rows + 1
  unsigned 64-bit integers), then rows and width in bytes (unsigned 64 bits each) and an 8-byte
  mark. Rows ascend by doc_id within a shard and from shard to shard.
- ``index-NNNNN.mph``: one for each bucket of keys: a perfect hash with fingerprints, each slot's
  first record (slots + 1), and records (shard, first row, rows). A look-up hashes the key to its
  bucket and slot and reads one run of records: constant time, whatever the store's size.

Nulls and edges: a null text counts as empty and still gets the end id. A null doc_id sorts first;
its rows are stored and listed in spans, but no key finds them. Rows that share a doc_id stand side
by side, ordered by a hash of the text; the key gives all of them. An empty table gives a store
without rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sharedfs
from .common import fresh_path, plan_bytes, slices, small_batches, staged, trimmed
from .mph import PerfectHash
from .tokens import encoder, with_end

#: Input bytes for each shard, by the optimizer's estimate.
SHARD_BYTES = 16 << 20
#: Distinct keys for each index file, about.
BUCKET_KEYS = 100_000
#: Most text that is encoded at once, but for a longer row.
ENCODE_BYTES = 4 << 20
#: Most bytes that a reader takes at once, but for a longer row.
READ_BYTES = 8 << 20
_MARK = b"QFTOK001"
_RECORD = np.dtype([("shard", "<u4"), ("first", "<u4"), ("rows", "<u4")])


@dataclass(frozen=True)
class TokenStore:
    path: str
    #: doc_id, shard, row, n_tokens of every stored row.
    spans: DataFrame
    buckets: int
    end_id: int


def _shard_path(root: str, shard: int) -> str:
    return f"{root}/shard-{shard:06d}.tok"


def _index_path(root: str, bucket: int) -> str:
    return f"{root}/index-{bucket:05d}.mph"


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_store(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> TokenStore:
    """Encode every whole text, append end_id, and write shards and index to the shared folder."""
    spark = docs.sparkSession
    small_batches(spark)
    root = fresh_path(spark, "token-store")
    sharedfs.make_dir(root)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    shards = max(1, -(-plan_bytes(rows) // SHARD_BYTES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        shard, lib, n, keys, sizes = TaskContext.get().partitionId(), encoder(tokenizer), 0, [], []
        with sharedfs.writing(_shard_path(root, shard)) as out:
            while first is not None:
                for part in slices(first, "text", ENCODE_BYTES):
                    ids, off = with_end(*lib.encode(part.column("text")), end_id)
                    width = 2 if lib.size <= 1 << 16 and end_id < 1 << 16 else 4
                    out.write(ids.astype(f"<u{width}"))
                    keys.append(part.column("doc_id"))
                    sizes.append(np.diff(off))
                first = next(batches, None)
            size = np.concatenate(sizes)
            n = len(size)
            out.write(np.concatenate([[0], np.cumsum(size)]).astype("<u8"))
            out.write(struct.pack("<QQ8s", n, width, _MARK))
        yield pa.record_batch({"doc_id": pa.concat_arrays(keys), "shard": np.full(n, shard, np.int32), "row": np.arange(n), "n_tokens": size})

    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie").select("doc_id", "text")
    spans = staged(ordered.mapInArrow(trimmed(write), "doc_id long, shard int, row long, n_tokens long"), "token-spans")
    buckets = max(1, -(-spans.count() // BUCKET_KEYS))
    _write_index(spans, root, buckets)
    return TokenStore(root, spans, buckets, end_id)


def _write_index(spans: DataFrame, root: str, buckets: int) -> None:
    runs = spans.where("doc_id is not null").groupBy("doc_id", "shard").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("rows"))

    def build(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        keys = table.column("doc_id").to_numpy().astype(np.int64).view(np.uint64)
        records = np.empty(len(keys), _RECORD)
        for name in _RECORD.names:
            records[name] = table.column(name).to_numpy()
        hashed = PerfectHash.build(np.unique(keys))
        slot = hashed.slots(keys)
        order = np.lexsort((records["first"], records["shard"], slot))
        starts = np.searchsorted(slot[order], np.arange(len(hashed.prints) + 1)).astype("<u4")
        with sharedfs.writing(_index_path(root, bucket)) as out:
            out.write(hashed.to_bytes() + starts.tobytes() + records[order].tobytes())
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "n": pa.array([len(keys)], pa.int64())})

    runs.withColumn("bucket", _bucket("doc_id", buckets)).groupBy("bucket").applyInArrow(build, "bucket int, n long").agg(F.sum("n")).collect()


class BucketIndex:
    """One index file in memory."""

    def __init__(self, root: str, bucket: int):
        with sharedfs.reading(_index_path(root, bucket)) as f:
            raw = f.read()
        self.hashed, at = PerfectHash.from_bytes(raw)
        n = len(self.hashed.prints)
        self.starts = np.frombuffer(raw, "<u4", n + 1, at).astype(np.int64)
        self.records = np.frombuffer(raw, _RECORD, int(self.starts[-1]), at + 4 * (n + 1))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each record found: which key it belongs to, and the record."""
        slot = self.hashed.slots(keys.astype(np.int64).view(np.uint64))
        known = np.flatnonzero(slot >= 0)
        a, b = self.starts[slot[known]], self.starts[slot[known] + 1]
        n = b - a
        return np.repeat(known, n), self.records[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())]


class Shard:
    """One shard file, read by row ranges."""

    def __init__(self, root: str, shard: int):
        self.file = sharedfs.reading(_shard_path(root, shard))
        size = self.file.size()
        n, self.width, mark = struct.unpack("<QQ8s", self.file.read_at(24, size - 24))
        if mark != _MARK:
            raise ValueError(f"shard {shard} of {root} is damaged")
        self.offsets = np.frombuffer(self.file.read_at(8 * (n + 1), size - 24 - 8 * (n + 1)), "<u8").astype(np.int64)

    def ids(self, first: int, rows: int = 1) -> np.ndarray:
        a, b = self.offsets[first], self.offsets[first + rows]
        return np.frombuffer(self.file.read_at(int(self.width * (b - a)), int(self.width * a)), f"<u{self.width}").astype("<u4")


def fetch(store: TokenStore, key: int) -> list[np.ndarray]:
    """The id arrays stored under one key, by hash; empty if there is none."""
    import xxhash

    h = xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42)
    _, records = BucketIndex(store.path, (h - (h >> 63 << 64)) % store.buckets).find(np.array([key], np.int64))
    return [Shard(store.path, int(r["shard"])).ids(int(r["first"]) + k) for r in records for k in range(r["rows"])]


def look_up(store: TokenStore, keys: DataFrame) -> DataFrame:
    """doc_id, shard, first, rows for each distinct key that the index holds."""
    root, buckets = store.path, store.buckets

    def find(table: pa.Table) -> pa.Table:
        index = BucketIndex(root, table.column("bucket")[0].as_py())
        ids = table.column("doc_id").to_numpy()
        which, found = index.find(ids)
        return pa.table({"doc_id": ids[which].astype(np.int64), "shard": found["shard"].astype(np.int32), "first": found["first"].astype(np.int64), "rows": found["rows"].astype(np.int64)})

    wanted = keys.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct()
    return wanted.withColumn("bucket", _bucket("doc_id", buckets)).groupBy("bucket").applyInArrow(find, "doc_id long, shard int, first long, rows long")


def read_rows(store: TokenStore, records: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of the rows that records name, from the shard files.

    start counts the ids of all rows before it in the store.
    """
    root = store.path
    bases = store.spans.groupBy("shard").agg(F.sum("n_tokens").alias("size"))
    bases = bases.selectExpr("shard", "sum(size) over (order by shard) - size as base")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = -1, None
        for batch in batches:
            doc, at, first, rows, base = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "shard", "first", "rows", "base"))
            absent = np.asarray(batch.column("doc_id").is_null())
            out: list[tuple] = []
            k, size = 0, 0
            while k < len(at):
                if at[k] != number:
                    number = int(at[k])
                    shard = Shard(root, number)
                j = k + 1  # records that follow on are read at once
                while j < len(at) and at[j] == number and first[j] == first[j - 1] + rows[j - 1] and 4 * (shard.offsets[first[j] + rows[j]] - shard.offsets[first[k]]) <= READ_BYTES:
                    j += 1
                off = shard.offsets
                ids = shard.ids(int(first[k]), int(first[j - 1] + rows[j - 1] - first[k])).tobytes()
                for r in range(k, j):
                    for row in range(int(first[r]), int(first[r] + rows[r])):
                        own = memoryview(ids)[4 * (off[row] - off[first[k]]) : 4 * (off[row + 1] - off[first[k]])]
                        out.append((None if absent[r] else int(doc[r]), int(base[r] + off[row]), len(own) // 4, zlib.crc32(own), *([bytes(own)] if with_ids else [])))
                        size += len(own) if with_ids else 32
                if size > READ_BYTES:
                    yield _rows(out, with_ids)
                    out, size = [], 0
                k = j
            if out:
                yield _rows(out, with_ids)

    located = records.join(bases, "shard")
    return located.repartition("shard").sortWithinPartitions("shard", "first").select("doc_id", "shard", "first", "rows", "base").mapInArrow(trimmed(read), schema)


def _rows(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    types = [pa.int64()] * 4 + [pa.binary()] * with_ids
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def read_back(store: TokenStore, keys: DataFrame, with_ids: bool = False) -> DataFrame:
    """All rows of the given keys through the index, and the stored rows without a key by their spans."""
    keyless = store.spans.where("doc_id is null").selectExpr("doc_id", "shard", "row as first", "1L as rows")
    return read_rows(store, look_up(store, keys).unionByName(keyless), with_ids)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import documents
    from .tokens import default_vocabulary

    docs = documents(spark, sf_dir)
    return read_back(write_store(docs, default_vocabulary(), end_id=2), docs)
