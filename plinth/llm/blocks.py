"""Block shuffles: records packed in numpy arrays travel as one binary value a
source batch and target partition, so that the JVM moves blocks, not records."""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "_p int, _d binary"


def next_prime(n: int) -> int:
    while n < 2 or any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def scatter(part: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
    """A batch with the records of each partition as one block."""
    order = np.argsort(part, kind="stable")
    part, packed = part[order], np.ascontiguousarray(records[order])
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]) if len(part) else np.zeros(1, np.int64)
    offsets = (cuts * records.dtype.itemsize).astype(np.int64)
    blocks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(packed.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]].astype(np.int32)), blocks.cast(pa.binary())], names=["_p", "_d"])


def scatter_table(part: np.ndarray, records: np.ndarray) -> pa.Table:
    return pa.Table.from_batches([scatter(part, records)])


def gather(table: pa.Table, dtype: np.dtype) -> np.ndarray:
    """All records of the blocks of a table."""
    parts = [np.frombuffer(x.as_buffer(), dtype) for chunk in table.column("_d").chunks for x in chunk if x.is_valid]
    return np.concatenate(parts) if parts else np.empty(0, dtype)


def release(spark: SparkSession) -> None:
    """Between rounds that were materialised: let Spark's cleaner drop the
    shuffle files that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def grouped(df: DataFrame, fn, schema: str = SCHEMA) -> DataFrame:
    return df.groupBy("_p").applyInArrow(fn, schema)


def cogrouped(left: DataFrame, right: DataFrame, fn, schema: str = SCHEMA) -> DataFrame:
    return left.groupBy("_p").cogroup(right.groupBy("_p")).applyInArrow(fn, schema)
