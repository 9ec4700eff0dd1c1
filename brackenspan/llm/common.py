"""Shared helpers: table access, durable intermediate tables, Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import ctypes.util
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where that is unset a temporary one, on a local master only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="brackenspan-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; removed when the driver ends."""
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` once to the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def released(*frames: DataFrame) -> None:
    """Remove stored tables that nothing reads any more, before the driver ends."""
    for df in frames:
        if path := getattr(df, "_stored_at", None):
            discard(path, df.sparkSession)


def discard(path: str, spark: SparkSession) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):
            discard(path, spark)


#: What a batch of rows may hold on its way to a Python worker, and a slice of one while it is worked on; a longer row comes alone.
BATCH_BYTES, SLICE_BYTES = 4 << 20, 1 << 20


def in_small_batches(spark: SparkSession) -> None:
    """Lower the session's bound on the bytes of an Arrow batch, which both the JVM and Python hold whole."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("bB")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def by_slices(batches: Iterable[pa.RecordBatch], rows: int, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``rows`` rows, and of a few rows or one where they are long, so that what is made of one stays small."""
    try:
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                part = batch.slice(start, rows)
                while part.num_rows > 1 and part.nbytes > most_bytes:
                    part = part.slice(0, (part.num_rows + 1) // 2)
                start += part.num_rows
                yield part
    finally:
        give_back()


def give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its task, and what it keeps lies idle beside the next one's."""
    pa.default_memory_pool().release_unused()
    if name := ctypes.util.find_library("c"):
        with contextlib.suppress(AttributeError, OSError):
            ctypes.CDLL(name).malloc_trim(0)


def per_slice(make: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int = 512) -> Callable:
    """A ``mapInArrow`` function that applies ``make`` to small slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_slices(batches, rows):
            yield make(part)

    return run


def train_fold(col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))
