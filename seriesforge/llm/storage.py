"""Tables in the folder that driver and executors share, and Arrow batches of bounded bytes."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch that goes to or comes from a Python worker, unless one row has more.
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a folder of this machine only in local mode without one, as in tests."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), f"seriesforge-{os.getuid()}")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there goes when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame written as a table in the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Removes a table of ``written`` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        there = spark._jvm.org.apache.hadoop.fs.Path(folder)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores after it until the frame has no column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def map_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow with batches bounded by bytes as well as rows: long texts don't pile up in a worker."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) != str(BATCH_BYTES):
        conf.set(name, str(BATCH_BYTES))

    def releasing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(run(batches), 1):
            yield batch
            if k % 32 == 0:
                release_memory()
        release_memory()

    return df.mapInArrow(releasing, schema)


def release_memory() -> None:
    """Hands what a worker has freed back to the system; workers of other tasks and the JVM need it."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def portions(batch: pa.RecordBatch, rows: int, column: str = "text", size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of so many rows and so many bytes of a column at most; a longer row is a slice of its own."""
    n = batch.num_rows
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) if n else np.empty(0, dtype=np.int64)
    at = 0
    while at < n:
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
        upto = min(n, at + rows, max(at + 1, upto))
        yield batch.slice(at, upto - at)
        at = upto
