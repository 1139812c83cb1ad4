"""Reading, naming and staging helpers of the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leafmark.session import note_staged, ship, shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see; an open ``leafmark.session.staging`` can drop it."""
    path = f"{shared_folder(spark)}/leafmark-corpus/{name}-{uuid.uuid4().hex}"
    note_staged(path=path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several steps read; survives lost executors and cuts the lineage."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of a document table whatever its other columns; null text is empty."""
    ship(docs.sparkSession)
    return docs.select(
        docs[f"`{id_col}`"].cast("bigint").alias("doc_id"),
        F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit("")).alias("text"),
    )


#: Longer texts are not taken into a training sample; they are judged like all others.
TRAIN_TEXT_BYTES = 1 << 16


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside hands at most ``rows`` rows at a time to Python; the setting is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def hidden(name: str) -> str:
    """A working column's name that no table is expected to have."""
    return f"__lm_{name}"


def null_safe(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def free_worker_memory() -> None:
    """Give back what a Python task has freed: unreachable objects, Arrow's pool, glibc's heap.

    Python workers are reused from task to task and stage to stage; without this their resident
    size only grows to the largest batch any task ever held."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def releasing(run):
    """An Arrow batch function that frees worker memory when its task's iterator ends."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            free_worker_memory()
    return wrapped


def released(run):
    """A function of one pandas group that frees worker memory when it returns."""
    def wrapped(frame):
        try:
            return run(frame)
        finally:
            free_worker_memory()
    return wrapped
