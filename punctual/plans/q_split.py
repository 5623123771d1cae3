"""Queries for the leakage-safe splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from punctual.functions.hashing import sql_uniform
from punctual.operators import prep
from punctual.operators import split as S
from punctual.plans.registry import register, with_trips
from punctual.sources.fixture import trips

SEED = 42
S_L = """
, l AS (SELECT trip_key, date, CASE WHEN delay_minutes > 5 THEN 1 ELSE 0 END AS label,
          concat_ws('|', coalesce(route, 'nan'), coalesce(direction, 'nan'), coalesce(CAST(trip_no AS VARCHAR), 'nan'),
                    coalesce(departure_time, 'nan'), coalesce(destination, 'nan')) AS grp
        FROM trips WHERE delay_minutes IS NOT NULL)"""


def _labelled(spark, sf):
    return prep.label_trips(trips(spark, sf)).select("trip_key", "date", "label", *prep.GROUP_KEY_COLUMNS)


def s_stratified(salt: str) -> str:
    return f"""
, u AS (SELECT *, {sql_uniform('trip_key', salt)} AS u FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY u, trip_key) - 1 AS rk FROM u),
c AS (SELECT label, count(*) AS nc FROM l GROUP BY 1),
q0 AS (SELECT label, nc, ceil(2e-1 * sum(nc) OVER ()) AS nt, sum(nc) OVER () AS n FROM c),
q1 AS (SELECT label, nt, floor(nt * nc / n) AS fl, nt * nc / n - floor(nt * nc / n) AS fr FROM q0),
q AS (SELECT label, fl + CASE WHEN row_number() OVER (ORDER BY fr DESC, label ASC) <= nt - sum(fl) OVER ()
                             THEN 1 ELSE 0 END AS quota FROM q1)"""


S_STRAT = S_L + s_stratified(f"split{SEED}") + """
SELECT r.trip_key, r.label, CASE WHEN r.rk < q.quota THEN 'test' ELSE 'train' END AS split
FROM r JOIN q USING (label)"""


@register("stratified_split", ["D3"], with_trips(S_STRAT))
def stratified_split(spark, sf):
    """Stratified 80/20 split with exact per-class quotas."""
    d = _labelled(spark, sf).select("trip_key", "label")
    return S.stratified_split(d, "label", "trip_key", 0.2, SEED).select("trip_key", "label", "split")


@register("split_dispatch_fallback", ["D8"], with_trips(S_STRAT))
def split_dispatch_fallback(spark, sf):
    """Mode 'time' on a table without dates falls back to the stratified split."""
    d = _labelled(spark, sf).select("trip_key", "label")
    return S.split(d, "time", "label", "trip_key", 0.2, SEED).select("trip_key", "label", "split")


@register("time_split", ["D4", "K2", "X18"], with_trips(S_L + f"""
, d AS (SELECT * FROM l WHERE date IS NOT NULL),
r AS (SELECT *, row_number() OVER (ORDER BY date, {sql_uniform('trip_key', f'time{SEED}')}, trip_key) - 1 AS rk,
        count(*) OVER () AS n FROM d)
SELECT trip_key, label, CASE WHEN rk < CAST(floor((1 - 2e-1) * n) AS BIGINT) THEN 'train' ELSE 'test' END AS split
FROM r"""))
def time_split(spark, sf):
    """First 80% of trips by date train, the rest test (ties by hashed key)."""
    d = _labelled(spark, sf).select("trip_key", "date", "label")
    return S.time_split(d, "date", "trip_key", 0.2, SEED).select("trip_key", "label", "split")


@register("stratified_group_split", ["D5", "X19"], with_trips(S_L + f"""
, g AS (SELECT grp, count(*) AS gn, sum(label) AS gp FROM l GROUP BY grp),
r AS (SELECT *, row_number() OVER (ORDER BY abs(2 * gp - gn) DESC, gn DESC, gp ASC, {sql_uniform('grp', f'snake{SEED}')}, grp ASC) - 1 AS rk FROM g),
f AS (SELECT grp, CASE WHEN (rk // 5) % 2 = 0 THEN rk % 5 ELSE 4 - rk % 5 END AS fold FROM r)
SELECT l.trip_key, l.label, l.grp AS "group", CASE WHEN f.fold = 0 THEN 'test' ELSE 'train' END AS split
FROM l JOIN f USING (grp)"""))
def stratified_group_split(spark, sf):
    """Fold 1 of 5 (snake-balanced over groups) is the test set; groups never straddle."""
    d = S.with_group_key(_labelled(spark, sf), "group")
    return S.stratified_group_split(d, "label", "group", 5).select("trip_key", "label", "group", "split")


@register("group_fold_sizes", ["D5"], with_trips(S_L + f"""
, g AS (SELECT grp, count(*) AS gn, sum(label) AS gp FROM l GROUP BY grp),
r AS (SELECT *, row_number() OVER (ORDER BY abs(2 * gp - gn) DESC, gn DESC, gp ASC, {sql_uniform('grp', f'snake{SEED}')}, grp ASC) - 1 AS rk FROM g),
f AS (SELECT *, CASE WHEN (rk // 5) % 2 = 0 THEN rk % 5 ELSE 4 - rk % 5 END AS fold FROM r)
SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n_groups, CAST(sum(gn) AS BIGINT) AS n_rows,
  round(sum(gp) / sum(gn), 6) AS late_rate
FROM f GROUP BY fold"""))
def group_fold_sizes(spark, sf):
    """Rows, groups and Late rate per snake fold (balance check)."""
    d = S.with_group_key(_labelled(spark, sf), "group")
    f = S.group_folds(d, "label", "group", 5)
    return f.groupBy("fold").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("_gn").cast("bigint").alias("n_rows"),
                                 F.round(F.sum("_gp") / F.sum("_gn"), 6).alias("late_rate"))


@register("group_shuffle_split", ["D6"], with_trips(S_L + f"""
, g AS (SELECT DISTINCT grp FROM l),
r AS (SELECT grp, row_number() OVER (ORDER BY {sql_uniform('grp', f'gss{SEED}')}, grp) - 1 AS rk,
        count(*) OVER () AS n FROM g)
SELECT l.trip_key, l.grp AS "group", CASE WHEN r.rk < ceil(2e-1 * r.n) THEN 'test' ELSE 'train' END AS split
FROM l JOIN r USING (grp)"""))
def group_shuffle_split(spark, sf):
    """ceil(20%) of the groups, chosen by hash, form the test set."""
    d = S.with_group_key(_labelled(spark, sf), "group")
    return S.group_shuffle_split(d, "group", 0.2, SEED).select("trip_key", "group", "split")


@register("stratified_folds", ["D7"], with_trips(S_L + f"""
, u AS (SELECT *, {sql_uniform('trip_key', f'fold{SEED}')} AS u FROM l)
SELECT trip_key, label, CAST((row_number() OVER (PARTITION BY label ORDER BY u, trip_key) - 1) % 5 AS INTEGER) AS fold
FROM u"""))
def stratified_folds(spark, sf):
    d = _labelled(spark, sf).select("trip_key", "label")
    return S.stratified_folds(d, "label", "trip_key", 5, SEED).select("trip_key", "label", "fold")
