"""Join helpers: size-checked broadcast and dense row indices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from punctual.functions.hashing import hash_mod

# Upper bound on rows shipped to every executor by ``broadcast_if_small``.
DEFAULT_BROADCAST_ROWS = 1_000_000
# Hash buckets of ``dense_index``: each bucket is ranked by one window
# partition, so 2^15 buckets keep a partition near 3*10^7 rows at 10^12 rows,
# while the bucket-offset table (2^15 rows) stays small enough to broadcast.
DENSE_BUCKETS = 1 << 15


# Rows of a shuffled partition; larger ones are sorted in parts on disk.
PARTITION_ROWS = 500_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` shuffled by ``keys`` into partitions for ``rows`` rows, where the session's number of partitions would be too small."""
    parts = -(-rows // PARTITION_ROWS)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS, rows: int | None = None) -> DataFrame:
    """Broadcast hint only behind a checked row bound; otherwise leave the
    choice to the planner (sort-merge or AQE's runtime conversion).  ``rows``
    is the row count where the caller knows it; else at most max_rows + 1
    rows are read to check."""
    n = df.limit(max_rows + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= max_rows else df


def dense_index_with_count(df: DataFrame, key_cols: Sequence[str], index_col: str = "idx",
                           n_buckets: int = DENSE_BUCKETS, salt: str = "dense") -> tuple[DataFrame, int]:
    """Attach a dense 0..n-1 index, ordered by (hash bucket, keys); also return n.

    Rows are spread over ``n_buckets`` hash buckets of their key; bucket
    sizes (a B-row table, computed once and kept) give each bucket's offset
    and the row count, and a row's index is the offset plus its rank inside
    the bucket.  No window runs over all rows, the result does not depend on
    partitioning, and keys must be unique.
    """
    key_text = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in key_cols])
    b = df.withColumn("_bucket", hash_mod(key_text, salt, F.lit(n_buckets)))
    sizes = b.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).persist()  # <= n_buckets rows
    n = sizes.agg(F.sum("_n")).first()[0] or 0
    offsets = sizes.select(
        "_bucket",
        (F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"),
    ).fillna(0, subset=["_off"])
    w = Window.partitionBy("_bucket").orderBy(*[F.col(c) for c in key_cols])
    out = (spread(b, int(n), "_bucket").join(F.broadcast(offsets), "_bucket")  # B rows: bounded by the parameter
             .withColumn(index_col, F.col("_off") + F.row_number().over(w) - F.lit(1))
             .drop("_bucket", "_off"))
    return out, int(n)


def dense_index(df: DataFrame, key_cols: Sequence[str], index_col: str = "idx",
                n_buckets: int = DENSE_BUCKETS, salt: str = "dense") -> DataFrame:
    """``dense_index_with_count`` without the count."""
    return dense_index_with_count(df, key_cols, index_col, n_buckets, salt)[0]
