"""Blocks of vectors for the two search operators.

Queries are a stated part of the rows, so both sides grow: rows are dealt
into blocks of bounded size, queries into query blocks of bounded size, and a
task meets one block of each.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 16_384
BLOCK_QUERIES = 4_096
# Rows that an index is fitted on.
SAMPLE_ROWS = 4_096


def finite(column: str) -> Column:
    """The vector is there and all its components are finite numbers."""
    return F.col(column).isNotNull() & (F.size(column) > 0) & F.forall(
        column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def one_dimension(rows: DataFrame, column: str) -> DataFrame:
    """Keep the vectors of the commonest length (ties: the longer)."""
    n = F.size(column)
    top = rows.groupBy(n.alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.filter(n == F.lit(top["d"] if top else 0))


def sample(rows: DataFrame, count: int, limit: int = SAMPLE_ROWS) -> DataFrame:
    """About ``limit`` rows by a hash of vec_id (all, if fewer)."""
    if count <= limit:
        return rows
    return rows.filter(F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 30)) < F.lit(int(limit / count * (1 << 30)))).limit(2 * limit)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """List column of equal-length vectors as a matrix of doubles."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(a) == 0:
        return np.empty((0, 0))
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), -1)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` smallest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, k - 1)[k - 1]
        some = np.flatnonzero(scores <= edge)
        return some[np.lexsort((ids[some], scores[some]))[:k]]
    return np.lexsort((ids, scores))[:k]


def meet(rows: DataFrame, queries: DataFrame, search: Callable, schema: str) -> DataFrame:
    """Run ``search(rows of a block, queries that visit it)`` for every block and query block."""
    on = ["block", "query_block"]
    return rows.groupBy(*on).cogroup(queries.groupBy(*on)).applyInArrow(search, schema)


def ranked(found: DataFrame, k: int, order: Column) -> DataFrame:
    """The first ``k`` per query over all blocks, with their rank."""
    w = Window.partitionBy("query_id").orderBy(order, "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
