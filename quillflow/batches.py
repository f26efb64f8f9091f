"""Arrow batches of bounded size for Python workers: memory follows neither the table nor the rows' number."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes that a worker takes from the JVM at once, but for a longer row; and rows of them that are Python objects at a time.
BYTES, ROWS = 8 << 20, 64


def bound(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session; it stays set, as plans are run later."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key)).lower().rstrip("b")
    if not now.isdigit() or int(now) > BYTES or int(now) <= 0:
        spark.conf.set(key, str(BYTES))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches as slices of at most ROWS rows."""
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)
