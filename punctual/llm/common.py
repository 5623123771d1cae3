"""What the training-data operators share: tables, shared storage, text batches."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.session import shared_path
from punctual.sources.tables import read_table

# Text held by one step of a Python worker; a single longer text is still taken whole.
STEP_CHARS = 2_000_000
# The same where distinct pieces of text are encoded, many at a time.
TOKEN_STEP_CHARS = 4_000_000


_HELD: dict = {}


def held(key, make: Callable):
    """The one large object (encoder, labeller) that a Python worker keeps between tasks.

    Another key drops it first, so that the stages of a pipeline do not add up in a worker's memory.
    """
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Give the held object's memory back; called by tasks that need none, so that a pipeline's stages do not add up."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _trim()


def _trim() -> None:
    """Ask the C library, where it can, to give freed memory back."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


@contextmanager
def no_cycles():
    """Let the collector of cycles rest while something runs that makes many objects but no cycles."""
    collecting = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if collecting:
            gc.enable()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder name on the storage that ``spark.checkpoint.dir`` names."""
    return shared_path(spark, f"llm/{name}-{uuid.uuid4().hex}")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to shared storage and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id`` and whole ``text`` of every document."""
    return read_table(spark, sf_dir, "documents", ["doc_id", "text"])


def steps(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the ``column`` of each holds about ``limit`` bytes (one row at least)."""
    for batch in batches:
        size = batch.column(batch.schema.get_field_index(column)).nbytes
        if not batch.num_rows:
            continue
        rows = max(1, batch.num_rows * limit // max(size, 1))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def strings(batch: pa.RecordBatch, column: str) -> list[str]:
    """A text column as Python strings, null read as empty."""
    return [s or "" for s in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def run_totals(df: DataFrame, key: str, total: str) -> list[tuple[int, int]]:
    """(key, total before it) per distinct ``key``; keys are partition numbers, hence few."""
    rows = df.groupBy(key).agg(F.sum(total).alias("n")).orderBy(key).collect()
    out, at = [], 0
    for r in rows:
        out.append((r[0], at))
        at += r["n"]
    return out
