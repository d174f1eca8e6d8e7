"""Helpers shared by the training-data operators: Arrow maps, shared tables, row identity."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import shared_dir

#: Text bytes that one step of a Python task works on; a single longer text is a step of its own.
STEP_BYTES = 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def steps(batches: Iterator[pa.RecordBatch], limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about ``limit`` bytes each, at least one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = max(1, int(batch.num_rows * limit / max(batch.nbytes, 1)))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


#: Functions whose last result stays in a worker process.
_LASTING: list = []


def lasting(function):
    """The function with its last result kept for later tasks of the worker process, until a task without a use for it."""
    held = lru_cache(maxsize=1)(function)
    _LASTING.append(held)
    return held


def release(*used) -> None:
    """Give back what the worker process no longer uses, since it stays for later tasks; of the lasting results only the ``used`` stay."""
    for held in _LASTING:
        if held not in used:
            held.cache_clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def small_batches(spark: SparkSession) -> None:
    """Bound what Spark hands to Python at once, so that a run of very long texts fits in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def add_columns(df: DataFrame, fields: list[T.StructField], fill: Callable[[pa.RecordBatch], list], *used: Callable) -> DataFrame:
    """The frame with columns that ``fill`` computes from each slice of rows, in Arrow; ``used`` are the lasting functions it calls.

    Columns of the frame that have the name of a new one are replaced; for a
    frame that names a column twice, select the wanted ones before.
    """
    small_batches(df.sparkSession)
    names = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    positions = [df.columns.index(f.name) for f in kept]

    def run(batches):
        release(*used)
        for part in steps(batches):
            new = fill(part)
            arrays = [part.column(i) for i in positions] + new
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in kept] + [f.name for f in fields])
        release(*used)

    return df.mapInArrow(run, T.StructType(kept + fields))


def text_key(column: str = "text") -> F.Column:
    """A 128-bit fingerprint of a text; null counts as empty."""
    text = F.coalesce(F.col(column), F.lit(""))
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text, F.length(text)).alias("b"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """The frame written as Parquet into the shared folder and read again: lineage ends, lost executors lose nothing."""
    path = scratch(df.sparkSession, name)
    df.write.partitionBy(*partitions).parquet(path)
    schema = T.StructType([f for f in df.schema if f.name not in partitions] + [f for f in df.schema if f.name in partitions])
    out = df.sparkSession.read.schema(schema).parquet(path)
    _PATHS[id(out)] = (out, path)
    return out


#: Where stored frames lie, until they are discarded.
_PATHS: dict[int, tuple[DataFrame, str]] = {}


def discard(*frames: DataFrame) -> None:
    """Delete stored tables that no plan reads any more."""
    for frame in frames:
        held, path = _PATHS.pop(id(frame), (None, None))
        if held is frame:
            jvm = frame.sparkSession.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(frame.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
