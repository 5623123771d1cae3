"""Queries for dedup, class statistics, reports, sorts and unions (A*, K*, U1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from punctual.functions import cleaning as C
from punctual.functions import features as X
from punctual.operators import aggregates as A
from punctual.operators import prep
from punctual.plans.q_prep import S_LABEL, labelled
from punctual.plans.registry import DUPS, SCORED, register, with_trips
from punctual.sources.fixture import scored_trips, trips, with_duplicates

FEATS = prep.EXPERIMENT_FEATURES
R6 = 6


@register("dedup_keep_first", ["A2", "J6", "J7", "A1"], with_trips(f"""
, l AS (SELECT *, {S_LABEL} AS label FROM dups WHERE delay_minutes IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY {', '.join(FEATS)}, label ORDER BY row_id) AS rn FROM l)
SELECT {', '.join(FEATS)}, label, row_id, strftime(date, '%Y-%m-%d') AS date, departure_time FROM r WHERE rn = 1""",
    dups=DUPS))
def dedup_keep_first(spark, sf):
    """Exact dedup on features + label keeping the first row (and its date/departure)."""
    d = prep.label_trips(with_duplicates(trips(spark, sf)))
    out = A.dedup_keep_first(d, FEATS + ["label"], "row_id", carry=["date", "departure_time"])
    return out.withColumn("date", C.iso_date("date"))


@register("distinct_rows", ["A3"], with_trips("""
SELECT DISTINCT route, direction, trip_no, departure_time, destination FROM dups""", dups=DUPS))
def distinct_rows(spark, sf):
    d = with_duplicates(trips(spark, sf)).select(*prep.GROUP_KEY_COLUMNS)
    return A.distinct_rows(d)


@register("label_distribution", ["A5", "A1"], with_trips(f"""
, c AS (SELECT {S_LABEL} AS label, count(*) AS n FROM trips WHERE delay_minutes IS NOT NULL GROUP BY 1)
SELECT label, n, round(n / sum(n) OVER (), {R6}) AS share FROM c"""))
def label_distribution(spark, sf):
    d = A.label_distribution(labelled(spark, sf))
    return d.withColumn("share", F.round("share", R6))


@register("majority_class", ["A6"], with_trips(f"""
SELECT {S_LABEL} AS label, count(*) AS n FROM trips WHERE delay_minutes IS NOT NULL
GROUP BY 1 ORDER BY n DESC, label ASC LIMIT 1"""))
def majority_class(spark, sf):
    return A.majority_class(labelled(spark, sf))


@register("class_balance", ["A7"], with_trips(f"""
, c AS (SELECT CAST(sum(CASE WHEN {S_LABEL} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_neg,
               CAST(sum(CASE WHEN {S_LABEL} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_pos
        FROM trips WHERE delay_minutes IS NOT NULL)
SELECT n_neg, n_pos,
  round(CASE WHEN n_pos > 0 THEN CAST(n_neg AS DOUBLE) / n_pos ELSE 1e0 END, {R6}) AS scale_pos_weight,
  round(CAST(n_neg AS DOUBLE) / greatest(n_pos, 1), {R6}) AS neg_pos_ratio FROM c"""))
def class_balance(spark, sf):
    c = A.class_balance(labelled(spark, sf))
    return c.select("n_neg", "n_pos", F.round("scale_pos_weight", R6).alias("scale_pos_weight"),
                    F.round("neg_pos_ratio", R6).alias("neg_pos_ratio"))


@register("balanced_weights", ["A8"], with_trips(f"""
, l AS (SELECT trip_key, {S_LABEL} AS label FROM trips WHERE delay_minutes IS NOT NULL),
c AS (SELECT label, count(*) AS nc FROM l GROUP BY 1),
w AS (SELECT label, sum(nc) OVER () / (count(*) OVER () * nc) AS weight FROM c)
SELECT l.trip_key, l.label, round(w.weight, {R6}) AS weight FROM l JOIN w USING (label)"""))
def balanced_weights(spark, sf):
    w = A.balanced_weights(labelled(spark, sf).select("trip_key", "label"))
    return w.select("trip_key", "label", F.round("weight", R6).alias("weight"))


@register("confusion_matrix", ["A9"], with_trips("""
, g AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(label, prediction)),
c AS (SELECT label, prediction, count(*) AS n FROM scored GROUP BY 1, 2)
SELECT g.label, g.prediction, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM g LEFT JOIN c ON g.label = c.label AND g.prediction = c.prediction""", scored=SCORED))
def confusion_matrix(spark, sf):
    return A.confusion_matrix(scored_trips(trips(spark, sf)))


_REPORT_SQL = f"""
, c AS (SELECT
    CAST(sum(CASE WHEN label = 0 AND prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
    CAST(sum(CASE WHEN label = 0 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN label = 1 AND prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
    CAST(sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp FROM scored),
p AS (SELECT *,
    CASE WHEN tn + fn > 0 THEN CAST(tn AS DOUBLE) / (tn + fn) ELSE 0e0 END AS p0,
    CASE WHEN tn + fp > 0 THEN CAST(tn AS DOUBLE) / (tn + fp) ELSE 0e0 END AS r0,
    CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0e0 END AS p1,
    CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0e0 END AS r1,
    CAST(tn + fp AS DOUBLE) AS s0, CAST(tp + fn AS DOUBLE) AS s1, tn + fp + fn + tp AS n FROM c),
f AS (SELECT *, CASE WHEN p0 + r0 > 0 THEN 2e0 * p0 * r0 / (p0 + r0) ELSE 0e0 END AS f0,
               CASE WHEN p1 + r1 > 0 THEN 2e0 * p1 * r1 / (p1 + r1) ELSE 0e0 END AS f1 FROM p)
"""


@register("classification_report", ["A10"], with_trips(_REPORT_SQL + f"""
SELECT 'On-Time' AS class, round(p0, {R6}) AS precision, round(r0, {R6}) AS recall, round(f0, {R6}) AS f1,
  CAST(s0 AS BIGINT) AS support FROM f
UNION ALL SELECT 'Late', round(p1, {R6}), round(r1, {R6}), round(f1, {R6}), CAST(s1 AS BIGINT) FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round(CAST(tn + tp AS DOUBLE) / n, {R6}), n FROM f
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, {R6}), round((r0 + r1) / 2, {R6}), round((f0 + f1) / 2, {R6}), n
  FROM f
UNION ALL SELECT 'weighted avg', round((p0 * s0 + p1 * s1) / n, {R6}), round((r0 * s0 + r1 * s1) / n, {R6}),
  round((f0 * s0 + f1 * s1) / n, {R6}), n FROM f""", scored=SCORED))
def classification_report(spark, sf):
    return A.classification_report(scored_trips(trips(spark, sf)))


@register("delay_histogram", ["A11"], with_trips("""
SELECT CAST(floor(delay_minutes / 5e0) AS BIGINT) AS bin, count(*) AS n_trips,
  CAST(floor(delay_minutes / 5e0) AS BIGINT) * 5e0 AS bin_start
FROM trips WHERE delay_minutes IS NOT NULL GROUP BY 1"""))
def delay_histogram(spark, sf):
    return A.delay_histogram(trips(spark, sf), 5.0)


@register("route_performance", ["A11", "A4"], with_trips(f"""
SELECT route, round(avg({S_LABEL}), {R6}) AS late_rate, round(avg(delay_minutes), {R6}) AS mean_delay,
  count(*) AS n_trips FROM trips WHERE delay_minutes IS NOT NULL GROUP BY 1"""))
def route_performance(spark, sf):
    p = A.route_performance(labelled(spark, sf))
    return p.select("route", F.round("late_rate", R6).alias("late_rate"),
                    F.round("mean_delay", R6).alias("mean_delay"), "n_trips")


_FACTORS = ["traffic_condition", "weather", "special_event", "day_of_week", "time_bucket"]


@register("factor_lift", ["A12"], with_trips(f"""
, l AS (SELECT *, {S_LABEL} AS label,
    CASE WHEN floor(time_of_day) >= 5 AND floor(time_of_day) < 12 THEN 'Morning'
         WHEN floor(time_of_day) >= 12 AND floor(time_of_day) < 17 THEN 'Afternoon'
         WHEN floor(time_of_day) >= 17 AND floor(time_of_day) < 21 THEN 'Evening' ELSE 'Night' END AS time_bucket
    FROM trips WHERE delay_minutes IS NOT NULL),
u AS ({' UNION ALL '.join(f"SELECT '{f}' AS factor, coalesce(CAST({f} AS VARCHAR), 'NA') AS level, label FROM l"
                          for f in _FACTORS)}),
g AS (SELECT factor, level, count(*) AS n_trips, sum(label) AS late FROM u GROUP BY 1, 2)
SELECT factor, level, n_trips, round(late / n_trips, {R6}) AS late_rate,
  round(late / n_trips - sum(late) OVER (PARTITION BY factor) / sum(n_trips) OVER (PARTITION BY factor), {R6})
    AS late_rate_change FROM g"""))
def factor_lift(spark, sf):
    t = labelled(spark, sf).withColumn("time_bucket", X.time_bucket_from_hour(F.floor("time_of_day")))
    f = A.factor_lift(t, _FACTORS)
    return f.select("factor", "level", "n_trips", F.round("late_rate", R6).alias("late_rate"),
                    F.round("late_rate_change", R6).alias("late_rate_change"))


@register("timetable_sorted", ["K1", "A3"], with_trips("""
SELECT DISTINCT route, direction, trip_no, departure_time, destination FROM trips ORDER BY route, trip_no"""))
def timetable_sorted(spark, sf):
    t = A.distinct_rows(trips(spark, sf).select(*prep.GROUP_KEY_COLUMNS))
    return t.orderBy("route", "trip_no")


@register("first_rows", ["K6", "IO8"], with_trips("""
SELECT trip_key, route, delay_minutes FROM trips ORDER BY trip_key LIMIT 1000"""))
def first_rows(spark, sf):
    """First 1000 rows in trip-key order (a bounded preview batch)."""
    return trips(spark, sf).select("trip_key", "route", "delay_minutes").orderBy("trip_key").limit(1000)


@register("union_by_year", ["U1"], with_trips("""
SELECT year(date) AS year, count(*) AS n_trips FROM (
  SELECT * FROM trips WHERE date < DATE '1995-01-01'
  UNION ALL SELECT * FROM trips WHERE date >= DATE '1995-01-01') GROUP BY 1"""))
def union_by_year(spark, sf):
    t = trips(spark, sf)
    u = t.where(F.col("date") < F.lit("1995-01-01").cast("date")).unionByName(
        t.where(F.col("date") >= F.lit("1995-01-01").cast("date")))
    return u.groupBy(F.year("date").cast("bigint").alias("year")).agg(F.count(F.lit(1)).alias("n_trips"))
