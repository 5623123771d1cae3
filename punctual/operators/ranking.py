"""Distributed running sums, ranks and exact order statistics.

A window ordered over a whole table without ``partitionBy`` runs in one
task.  These helpers split the ordering into B buckets instead: bucket
totals (a B-row table) give each bucket's offset, and the running sum
inside a bucket is a window partitioned by bucket.  B is a parameter with
a proven bound, so the offsets table may be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.operators.joins import broadcast_if_small

# ``prefix_sums`` takes at least MIN_BUCKETS quantile buckets, and more when a
# bucket would hold above BUCKET_ROWS rows; ``uniform_rank`` takes uniform
# buckets (rows per window partition ~ N/(groups * 2^15)).
MIN_BUCKETS = 1024
BUCKET_ROWS = 1_000_000
UNIFORM_BUCKETS = 1 << 15


def bucket_count(rows: int) -> int:
    """Buckets for ``rows`` rows, none far above BUCKET_ROWS."""
    return max(MIN_BUCKETS, -(-rows // BUCKET_ROWS))


def _bucket_splits(df: DataFrame, col: str, n_buckets: int | None) -> list[float]:
    n_buckets = n_buckets or bucket_count(df.count())
    probs = [i / n_buckets for i in range(1, n_buckets)]
    qs = df.approxQuantile(col, probs, 1.0 / (4 * n_buckets)) if n_buckets > 1 else []
    inner = sorted({float(q) for q in qs if q is not None}) or [0.0]  # no rows: any bound will do
    return [float("-inf")] + inner + [float("inf")]


def prefix_sums(
    df: DataFrame,
    order: Sequence[tuple[str, bool]],
    values: Sequence[str],
    n_buckets: int | None = None,
    suffix: str = "_cum",
    splits: Sequence[float] | None = None,
    partition_cols: Sequence[str] = (),
) -> DataFrame:
    """Running (inclusive) sums of ``values`` in the order ``order``.

    ``order`` is a list of (column, descending); the first column must be
    numeric and non-null and drives the bucketing (ties on it share a
    bucket), the rest break ties.  Bucket bounds come from approximate
    quantiles of that column unless ``splits`` is given.  Output adds
    ``<value><suffix>`` per value column.  With ``partition_cols`` the sums
    restart per partition (e.g. per model); bucket bounds are shared.  ``n_buckets``
    follows the row count (``bucket_count``) unless given.
    """
    pc = list(partition_cols)
    first, first_desc = order[0]
    full = list(splits) if splits is not None else _bucket_splits(df, first, n_buckets)
    nb = len(full) - 1
    b = Bucketizer(splits=full, inputCol="_bx", outputCol="_bq", handleInvalid="keep").transform(
        df.withColumn("_bx", F.col(first).cast("double")))
    bucket = (F.lit(nb - 1) - F.col("_bq")) if first_desc else F.col("_bq")
    b = b.withColumn("_b", bucket.cast("int")).drop("_bx", "_bq")

    totals = b.groupBy(*pc, "_b").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    before = Window.partitionBy(*pc).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*pc, "_b", *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}")
                                         for v in values])
    ordering: list[Column] = [F.col(c).desc() if d else F.col(c).asc() for c, d in order]
    w = Window.partitionBy(*pc, "_b").orderBy(*ordering).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # offsets: (partitions x buckets) aggregated rows; broadcast only without partitions (bounded by B).
    out = b.join(F.broadcast(offsets) if not pc else offsets, [*pc, "_b"])
    for v in values:
        out = out.withColumn(f"{v}{suffix}", F.col(f"_o_{v}") + F.sum(v).over(w))
    return out.drop("_b", *[f"_o_{v}" for v in values])


def uniform_rank(
    df: DataFrame,
    group_cols: Sequence[str],
    u_col: str,
    tie_cols: Sequence[str],
    rank_col: str = "rank",
    n_buckets: int = UNIFORM_BUCKETS,
) -> DataFrame:
    """0-based rank of each row within ``group_cols`` ordered by (u, ties).

    ``u`` must be a uniform draw in [0, 1), so equal-width buckets are
    balanced whatever the skew of the groups: a group holding a third of
    the rows is still split over all buckets.
    """
    gb = list(group_cols)
    b = df.withColumn("_b", F.least(F.floor(F.col(u_col) * n_buckets), F.lit(n_buckets - 1)).cast("int"))
    sizes = b.groupBy(*gb, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*gb).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*gb, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    w = Window.partitionBy(*gb, "_b").orderBy(F.col(u_col), *[F.col(c) for c in tie_cols])
    # offsets: (groups x buckets) rows, aggregated; joined by key (the planner may broadcast it).
    return (b.join(offsets, [*gb, "_b"])
             .withColumn(rank_col, F.col("_off") + F.row_number().over(w) - F.lit(1))
             .drop("_b", "_off"))


def smallest_of_group(df: DataFrame, group: str, u_col: str, tie: str, quotas: DataFrame, n_buckets: int = UNIFORM_BUCKETS) -> DataFrame:
    """(group, _u_last, _tie_last): per group the last of its ``_quota`` smallest rows by (u, tie); none where the quota is 0.

    Rows are only counted, per bucket of ``u``; those of the one bucket in
    which a group's quota ends are ranked.  ``quotas`` has a row per group.
    """
    b = df.select(group, u_col, tie, F.least(F.floor(F.col(u_col) * n_buckets), F.lit(n_buckets - 1)).cast("int").alias("_b"))
    sizes = b.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    ends = (sizes.withColumn("_upto", upto).join(broadcast_if_small(quotas), group)
            .where((F.col("_upto") >= F.col("_quota")) & (F.col("_upto") - F.col("_n") < F.col("_quota")))
            .select(group, "_b", (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("_need")))
    last = Window.partitionBy(group).orderBy(u_col, tie)
    return (b.join(broadcast_if_small(ends), [group, "_b"]).withColumn("_r", F.row_number().over(last)).where(F.col("_r") == F.col("_need"))
            .select(group, F.col(u_col).alias("_u_last"), F.col(tie).alias("_tie_last")))


def exact_medians(df: DataFrame, cols: Sequence[str], n_buckets: int | None = None) -> dict[str, float | None]:
    """Exact medians (mean of the two middle values for even n), NULL/NaN ignored.

    All columns are stacked into one (column, value) -> count aggregate with
    map-side combine; running counts over the distinct values of every
    column (one bucketed pass, restarting per column) locate the middle
    ranks.  No task ever holds all values of a column.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in cols]))
    vals = (df.select(pairs.alias("_p")).select("_p._c", "_p._v")
              .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
              .groupBy("_c", "_v").agg(F.count(F.lit(1)).alias("_n"))
              .persist())
    try:
        counts = {r["_c"]: r["_t"] for r in vals.groupBy("_c").agg(F.sum("_n").alias("_t")).collect()}
        present = [c for c in cols if counts.get(c)]
        out: dict[str, float | None] = {c: None for c in cols}
        if not present:
            return out
        cum = prefix_sums(vals, [("_v", False)], ["_n"], n_buckets=n_buckets, partition_cols=["_c"])
        start = F.col("_n_cum") - F.col("_n")
        cond = None
        for c in present:
            lo, hi = (counts[c] - 1) // 2, counts[c] // 2
            hit = (F.col("_c") == c) & (((start <= lo) & (F.col("_n_cum") > lo)) |
                                       ((start <= hi) & (F.col("_n_cum") > hi)))
            cond = hit if cond is None else cond | hit
        for r in cum.where(cond).groupBy("_c").agg(F.min("_v").alias("a"), F.max("_v").alias("b")).collect():
            out[r["_c"]] = (r["a"] + r["b"]) / 2.0
        return out
    finally:
        vals.unpersist()


def exact_median(df: DataFrame, col: str, n_buckets: int | None = None) -> float | None:
    return exact_medians(df, [col], n_buckets)[col]
