"""What the operators of this subpackage share: the shared folder, staged tables, folds, Arrow helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD_GAP = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all runs on this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quillflow-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Spark's limit on the buckets of a table.
MOST_BUCKETS = 100_000


def staged_by(df: DataFrame, column: str, buckets: int, label: str) -> DataFrame:
    """Like staged, but bucketed by a column: joins and groups on it then move the other side only."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    name = path.rpartition("/")[2].replace("-", "_")
    df.write.option("path", path).option("compression", "zstd").bucketBy(min(buckets, MOST_BUCKETS), column).saveAsTable(name)
    return spark.table(name)


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo modulus. A null id hashes as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus


#: Most text that a Python worker takes from the JVM at once, but for a longer row.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session: workers then need memory for one batch, whatever the rows' length."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key)).lower().rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES or int(now) <= 0:
        spark.conf.set(key, str(BATCH_BYTES))


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker, which waits for its next task, gives unused memory back to the system."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return tidy


def plan_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of df in its files, by the optimizer's estimate, or where it has none the size of its texts.

    For numbers of files and streamed partitions only: what a group holds in memory must not follow from
    how well its input compresses.
    """
    guess = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return guess if guess < 1 << 60 else df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch where the text of its rows exceeds most_bytes; a longer row stays whole."""
    lens = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, n = 0, batch.num_rows
    ends = np.cumsum(lens)
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, nulls as empty, and the row offsets in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, "<i8")[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_codes(texts: pa.Array, table: bytes | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, each word's place among them, and the rows' bounds. table: bytes.translate's, applied first.

    Rows that begin or end with white space, or are empty, have an empty word there.
    """
    raw, off = text_buffer(texts)
    raw = raw.tobytes()
    raw = raw.translate(table) if table else raw
    texts = pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(off)), pa.py_buffer(raw)]).cast(pa.large_string(), safe=False)
    words = pc.ascii_split_whitespace(texts)
    bounds = np.asarray(words.offsets).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), bounds - bounds[0]
