"""What the operators of this subpackage share: column picking, written intermediate tables, text batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_root

#: Rows whose texts exceed this many bytes in an Arrow batch are worked off in several steps.
STEP_BYTES = 1 << 20
ROWS = 1_000
_ROWS_OF_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def pick(df: DataFrame, **want: str) -> DataFrame:
    """The columns ``want`` (new name = name in df), found by exact name, so that others of clashing names don't matter."""
    names = df.columns
    flat = df.toDF(*(f"c{i}" for i in range(len(names))))
    return flat.select(*(F.col(f"c{names.index(old)}").alias(new) for new, old in want.items()))


class Tables:
    """Written intermediate tables: they cut the lineage, survive lost executors, and let shuffle files go."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, shared_root(spark), 0

    def keep(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete a kept table that nothing reads any more."""
        sc = self.spark.sparkContext
        for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

    def only(self, df: DataFrame) -> None:
        """Delete all other tables of this run, and let their shuffle files go."""
        sc = self.spark.sparkContext
        kept = {p.rsplit("/", 2)[1] for p in df.inputFiles()}
        root = sc._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(sc._jsc.hadoopConfiguration())
        for status in fs.listStatus(root) if fs.exists(root) else []:
            if status.getPath().getName() not in kept:
                fs.delete(status.getPath(), True)
        self.release()

    def release(self) -> None:
        """Let Spark's cleaner remove the shuffle files of finished steps."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def sliced(batch: pa.RecordBatch, column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive slices of about ``most`` bytes of text, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0), dtype=np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


@lru_cache(1)
def _trim() -> Callable[[int], object]:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return lambda _: None


def release_memory() -> None:
    """Give freed memory back to the system: workers live on between tasks, beside a JVM that needs it."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def settled(parts: Iterable, after: Callable[[], object] | None = None) -> Iterator:
    """parts, then after(), and then the worker's free memory goes back."""
    try:
        yield from parts
    finally:
        if after:
            after()
        release_memory()


def small_batches(spark: SparkSession) -> None:
    """Rows that go to Python at once, ROWS unless the session says otherwise than Spark's default: whole texts are in them, twice, in the JVM and in Python."""
    if spark.conf.get(_ROWS_OF_BATCH) == "10000":
        spark.conf.set(_ROWS_OF_BATCH, str(ROWS))


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: str = "text", after: Callable[[], object] | None = None) -> DataFrame:
    """df through fn, slice by slice; fn maps a batch of rows to a batch of results. after is called at a task's end."""
    small_batches(df.sparkSession)

    def run(batches):
        return settled((fn(part) for batch in batches for part in sliced(batch, column)), after)

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a slice of texts, end to end, and the offsets of each; nulls are empty."""
    if pa.types.is_large_string(column.type):
        column, kind = column, np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    u8 = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(off) else np.zeros(0, np.uint8)
    return u8, off - off[0]
