"""Shared plumbing of the llm operators: table reads, stored intermediate results and Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from echogrid.session import scratch_path, tune

BATCH_BYTES = 2_000_000
#: Spark's own batches on their way to Python hold two pieces; by rows alone they would grow with the length of the texts.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", f"{2 * BATCH_BYTES}b"


def bounded(spark: SparkSession) -> SparkSession:
    """`spark`, tuned, with Arrow batches of bounded size."""
    if spark.conf.get(ARROW_BYTES[0], None) != ARROW_BYTES[1]:
        spark.conf.set(*ARROW_BYTES)
    return tune(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared checkpoint folder and read back: a compressed, prunable cut of the lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds about `limit` bytes of `text`, one row at least. No row is cut."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for k, size in enumerate(sizes):
            if k > start and total + size > limit:
                yield batch.slice(start, k - start)
                start, total = k, 0
            total += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)


def strings(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column as Python strings, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def long_list(values, counts) -> pa.Array:
    """array<bigint> column from flat int64 values and the number of values of each row."""
    import numpy as np

    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).view(np.int64)))
