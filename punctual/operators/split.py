"""Leakage-safe train/test splits.

Every split is a pure function of row/group keys (md5-based draws), so it
is reproducible across runs, partitionings and retries.  Ranks come from
the bucketed helpers; no window spans all rows in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from punctual.functions.cleaning import parse_date
from punctual.functions.features import group_key
from punctual.functions.hashing import uniform
from punctual.operators.joins import broadcast_if_small
from punctual.operators.prep import GROUP_KEY_COLUMNS, pick_existing
from punctual.operators.ranking import prefix_sums, smallest_of_group, uniform_rank

TRAIN, TEST = "train", "test"


def _class_quotas(df: DataFrame, label: str, test_size: float) -> DataFrame:
    """Per-class test quota: floor(n_test * n_c / n) plus one for the classes
    with the largest remainders (ties -> smaller label), n_test = ceil(t * n).
    Runs on the k-row class table."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    whole = Window.partitionBy()  # k class rows
    n = F.sum("_nc").over(whole)
    n_test = F.ceil(F.lit(float(test_size)) * n)
    exact = n_test * F.col("_nc") / n
    q = counts.select(label, "_nc", n_test.alias("_nt"), F.floor(exact).alias("_fl"), (exact - F.floor(exact))
                      .alias("_fr"))
    rest = F.col("_nt") - F.sum("_fl").over(whole)
    order = Window.orderBy(F.col("_fr").desc(), F.col(label).asc())
    return q.select(label, (F.col("_fl") + F.when(F.row_number().over(order) <= rest, 1).otherwise(0))
                    .cast("bigint").alias("_quota"))


def stratified_split(df: DataFrame, label: str = "label", key: str = "trip_key", test_size: float = 0.2,
                     seed: int = 42, split_col: str = "split") -> DataFrame:
    """D3: exact per-class test quotas; rows chosen by hash order within class (rows without label train)."""
    u = df.withColumn("_u", uniform(F.col(key), f"split{seed}"))
    last = smallest_of_group(u, label, "_u", key, _class_quotas(df, label, test_size))
    out = u.join(broadcast_if_small(last), label, "left")  # one row per class; no row of ``df`` moves
    chosen = (F.col("_u") < F.col("_u_last")) | (F.col("_u") == F.col("_u_last")) & (F.col(key) <= F.col("_tie_last"))
    return out.withColumn(split_col, F.when(chosen, F.lit(TEST)).otherwise(F.lit(TRAIN))).drop("_u", "_u_last", "_tie_last")


def stratified_folds(df: DataFrame, label: str = "label", key: str = "trip_key", k: int = 5, seed: int = 42,
                     fold_col: str = "fold") -> DataFrame:
    """fold = (rank within class by hash order) mod k, so every fold
    gets each class's rows in proportion."""
    u = df.withColumn("_u", uniform(F.col(key), f"fold{seed}"))
    ranked = uniform_rank(u, [label], "_u", [key], "_rank")
    return ranked.withColumn(fold_col, (F.col("_rank") % k).cast("int")).drop("_u", "_rank")


def time_split(df: DataFrame, date_col: str = "date", key: str = "trip_key", test_size: float = 0.2,
               seed: int = 42, split_col: str = "split") -> DataFrame:
    """Rows with unparseable dates dropped; the first int((1-t)*n) rows by
    (date, hash of key) train, the rest test.  Rows are counted per day, and on
    the boundary day per bucket of the hash; only the bucket in which the
    training rows end is ranked."""
    # A DATE is used as it is, so filters on it reach the scan; only other types are parsed.
    day = F.col(date_col) if dict(df.dtypes)[date_col] == "date" else parse_date(F.col(date_col))
    d = df.withColumn("_d", day).where(F.col("_d").isNotNull())
    days = d.groupBy("_d").agg(F.count(F.lit(1)).alias("_n")).persist()  # one row per day, read 3 times
    n = days.agg(F.sum("_n")).first()[0] or 0
    cutoff = int((1 - test_size) * n)
    cum = prefix_sums(days.withColumn("_dn", F.datediff("_d", F.lit("1970-01-01"))), [("_dn", False)], ["_n"])
    boundary = cum.where((F.col("_n_cum") - F.col("_n") <= cutoff) & (F.col("_n_cum") > cutoff)).select(
        "_d", (F.lit(cutoff) - (F.col("_n_cum") - F.col("_n"))).alias("_need")).first()
    days.unpersist()  # the result below depends only on literals from here on
    if boundary is None:  # cutoff == n: everything trains
        return d.withColumn(split_col, F.lit(TRAIN)).drop("_d")
    # The boundary day's last training row by (hash, key); every other row is told by literals, none moves.
    bday, need = F.lit(boundary["_d"]), boundary["_need"]
    u = uniform(F.col(key), f"time{seed}")
    quota = df.sparkSession.range(1).select(bday.alias("_d"), F.lit(need).alias("_quota"))
    last = smallest_of_group(d.where(F.col("_d") == bday).withColumn("_u", u), "_d", "_u", key, quota).first()
    early = F.lit(False) if last is None else (u < last["_u_last"]) | (u == last["_u_last"]) & (F.col(key) <= F.lit(last["_tie_last"]))
    train = (F.col("_d") < bday) | (F.col("_d") == bday) & early
    return d.withColumn(split_col, F.when(train, F.lit(TRAIN)).otherwise(F.lit(TEST))).drop("_d")


def with_group_key(df: DataFrame, group_col: str = "group", feature_cols: Sequence[str] = ()) -> DataFrame:
    """Timetable columns present joined by '|'; all features if none."""
    cols = pick_existing(GROUP_KEY_COLUMNS, df) or list(feature_cols)
    return df.withColumn(group_col, group_key(cols))


def group_folds(df: DataFrame, label: str = "label", group_col: str = "group", k: int = 5,
                seed: int = 42) -> DataFrame:
    """Per-group (size, positives, fold) by the snake rule: groups ranked by
    class imbalance |2*pos - n| desc, size desc, pos, then a hash of the key;
    rank r gets fold r mod k on even rounds and k-1 - (r mod k) on odd ones.

    Groups of equal (size, pos) form a class.  Running sums over the class
    table give each class's first rank, and the hash order splits a class
    evenly over buckets, so a third of all groups in one class is no hot spot.
    """
    g = df.groupBy(group_col).agg(F.count(F.lit(1)).alias("_gn"), F.sum(F.col(label).cast("bigint")).alias("_gp"))
    g = g.withColumn("_u", uniform(F.col(group_col), f"snake{seed}")).persist()  # read by ranks, sizes and classes
    classes = g.groupBy("_gn", "_gp").agg(F.count(F.lit(1)).alias("_c"))
    classes = classes.withColumn("_imb", F.abs(F.lit(2) * F.col("_gp") - F.col("_gn")))
    first = prefix_sums(classes, [("_imb", True), ("_gn", True), ("_gp", False)], ["_c"])
    first = first.select("_gn", "_gp", (F.col("_c_cum") - F.col("_c")).alias("_first"))
    ranked = uniform_rank(g, ["_gn", "_gp"], "_u", [group_col], "_rank").join(first, ["_gn", "_gp"])
    rank = F.col("_first") + F.col("_rank")
    pos = rank % k
    fold = F.when((F.floor(rank / k) % 2) == 0, pos).otherwise(F.lit(k - 1) - pos).cast("int")
    return ranked.select(group_col, "_gn", "_gp", fold.alias("fold"))


def stratified_group_split(df: DataFrame, label: str = "label", group_col: str = "group", k: int = 5,
                           test_fold: int = 0, split_col: str = "split", broadcast_rows: int = 1_000_000) -> DataFrame:
    """Fold ``test_fold`` of k is the test set; a group never straddles."""
    folds = group_folds(df, label, group_col, k).select(group_col, "fold")
    out = df.join(broadcast_if_small(folds, broadcast_rows), group_col)
    return out.withColumn(split_col, F.when(F.col("fold") == test_fold, F.lit(TEST)).otherwise(F.lit(TRAIN))) \
              .drop("fold")


def group_shuffle_split(df: DataFrame, group_col: str = "group", test_size: float = 0.2, seed: int = 42,
                        split_col: str = "split", broadcast_rows: int = 1_000_000) -> DataFrame:
    """ceil(t * n_groups) groups, chosen by hash order, form the test set."""
    g = df.select(group_col).distinct().withColumn("_u", uniform(F.col(group_col), f"gss{seed}"))
    n_groups = g.count()
    n_test = math.ceil(test_size * n_groups)
    ranked = uniform_rank(g, [], "_u", [group_col], "_rank")
    tagged = ranked.select(group_col, F.when(F.col("_rank") < n_test, F.lit(TEST)).otherwise(F.lit(TRAIN))
                           .alias(split_col))
    return df.join(broadcast_if_small(tagged, broadcast_rows, n_groups), group_col)


def split(df: DataFrame, mode: str = "group", label: str = "label", key: str = "trip_key", test_size: float = 0.2,
          seed: int = 42, feature_cols: Sequence[str] = ()) -> DataFrame:
    """D8: 'group' (stratified group folds), 'time' (needs a date column,
    else random) or 'random' (stratified)."""
    if mode == "time" and "date" in df.columns:
        return time_split(df, "date", key, test_size, seed)
    if mode == "group":
        g = with_group_key(df, "group", feature_cols)
        return stratified_group_split(g, label, "group", k=max(2, round(1 / test_size)))
    return stratified_split(df, label, key, test_size, seed)
