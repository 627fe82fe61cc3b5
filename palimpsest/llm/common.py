"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by whatever file system the path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of one Arrow batch. Texts of the default of 10,000 would be copied several times over in a worker.
BATCH_ROWS = 2_000


def text_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches to BATCH_ROWS: bounded memory for workers, which Spark reuses."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def tidied(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function, giving its memory back to the system when a task ends: Spark goes on using its workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint into the folder that all executors share; the result survives lost executors.

    The folder is the session's ``spark.checkpoint.dir``; a temporary one is set only where the
    session names none, as in tests. Use it for ids, hashes and counts, not for texts.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints that no table refers to: it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints, set where the session has none yet; a temporary one only where all runs on one machine."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def _saved(df: DataFrame) -> str:
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(path)
    _file_system(df.sparkSession, path, "deleteOnExit")
    return path


def _file_system(spark: SparkSession, path: str, call: str, *more: bool) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    getattr(place.getFileSystem(spark._jsc.hadoopConfiguration()), call)(place, *more)


def written(df: DataFrame) -> DataFrame:
    """The table written as Parquet into the shared folder and read again; deleted when the session's JVM ends."""
    return df.sparkSession.read.parquet(_saved(df))


def in_turn(df: DataFrame, steps: Iterable[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The table after all steps, each written before the next one reads it; what a step wrote is deleted when the next has read it."""
    spark, before = df.sparkSession, None
    for step in steps:
        path = _saved(step(df))
        df = spark.read.parquet(path)
        if before:
            _file_system(spark, before, "delete", True)
        before = path
    return df


def free_name(df: DataFrame, name: str) -> str:
    """The name, or with underscores before it, such that no column of the table begins with it."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name = "_" + name
    return name


def crc_bucket(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo; null ids count as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def fraction_of(columns: Iterable[Column]) -> Column:
    """A number in [0, 1) that depends on the columns' values alone: for bounded training samples."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / F.lit(float(1 << 30))


def binary_of(column: pa.Array) -> tuple:
    """Offsets and bytes of an Arrow string column without copying; null counts as empty."""
    import numpy as np

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at, raw
