"""Shared plumbing: written intermediate tables, bounded Arrow batches, table reading."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from voxmill.session import shared_folder, ship

#: Text bytes that a Python worker handles at once; a longer text is handled alone.
SLICE_BYTES = 8 << 20
#: Rows that Spark puts in one Arrow batch for the operators that carry whole texts.
BATCH_ROWS = 512

_written: list[_Table] = []
_scope: ContextVar[list[_Table] | None] = ContextVar("voxmill-scope", default=None)


@dataclass
class _Table:
    """A written table and what it takes to delete it, which works after the session has stopped, too."""

    path: str
    jvm: object
    conf: object

    def delete(self) -> None:
        target = self.jvm.org.apache.hadoop.fs.Path(self.path)
        target.getFileSystem(self.conf).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder; only Spark's reader opens it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, its lineage cut, safe when executors go."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/voxmill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    own = _scope.get()
    (_written if own is None else own).append(_Table(path, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def only(name: str) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Within it, written() tables last until its end; what is passed to the function it gives is written under `name` and outlives it.

        with only("stage") as kept:
            docs = kept(stage(spark, docs, sf_dir))
    """
    outer, own = _scope.get(), []
    token = _scope.set(own)

    def kept(df: DataFrame) -> DataFrame:
        out = written(df, name)
        (_written if outer is None else outer).append(own.pop())
        return out

    try:
        yield kept
    finally:
        _scope.reset(token)
        for t in own:
            t.delete()


def release() -> None:
    """Delete all tables made by written() so far; their readers fail afterwards. Runs at exit."""
    while _written:
        try:
            _written.pop().delete()
        except Exception:  # the JVM is gone; the owner of the folder clears it
            return


atexit.register(release)


def give_back() -> None:
    """Hand memory that this process no longer uses to the system, where allocators would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let an Arrow batch hold no more than `rows` rows, so long texts cannot fill a worker; and let workers import this package."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, each with at most `limit` bytes in the given text column (nested ones: on average), or one row."""
    n, start = batch.num_rows, 0
    if not n:
        return
    text = batch.column(column)
    if text.nbytes <= limit:
        yield batch
        return
    import numpy as np
    import pyarrow.compute as pc

    if pa.types.is_nested(text.type):
        rows = max(1, int(n * limit / text.nbytes))  # by the mean, as nested values have no length of their own
        yield from (batch.slice(at, rows) for at in range(0, n, rows))
        return
    ends = np.cumsum(pc.binary_length(text).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
