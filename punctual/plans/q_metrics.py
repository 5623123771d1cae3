"""Queries for curves and evaluation metrics.

Scored rows come from the fixture's deterministic score (no training), so
every metric has an exact SQL twin.  The test set is the last fifth of the
trips by date (D4); the baseline learns from the earlier ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.functions.hashing import sql_uniform
from punctual.operators import curves as W
from punctual.operators.baseline import majority_values
from punctual.operators.split import TEST, TRAIN, time_split
from punctual.plans.registry import SCORED, register, with_trips
from punctual.sources.fixture import scored_trips, trips

R6 = 6
SEED = 42
TEST_SIZE = 0.2


def _scored(spark, sf) -> DataFrame:
    return scored_trips(trips(spark, sf))


def models_scored(spark, sf) -> DataFrame:
    """Three scored models on the test rows of the time split (D4): the additive
    score, a distance-only score and the majority baseline fitted on earlier trips."""
    t = trips(spark, sf).where(F.col("delay_minutes").isNotNull())
    s = time_split(scored_trips(t, extra=("date", "stop_distance_km")), "date", "trip_key", TEST_SIZE, SEED)
    test, train = s.where(F.col("split") == TEST), s.where(F.col("split") == TRAIN)
    mode, rate = majority_values(train)
    one = lambda model, prediction, score: F.struct(
        F.lit(model).alias("model"), prediction.alias("prediction"), score.alias("score"))
    # All models from one reading of the test rows.
    models = F.array(one("additive", F.col("prediction"), F.col("score")),
                     one("distance", F.when(F.col("stop_distance_km") >= 12.5, 1).otherwise(0),
                         F.round(F.col("stop_distance_km") / F.lit(25.0), 6)),
                     one("Majority Baseline", F.lit(mode), F.lit(rate)))
    return test.select("trip_key", "label", F.explode(models).alias("m")).select("m.model", "trip_key", "label",
                                                                                 "m.prediction", "m.score")


S_MODELS = f"""
, t AS (SELECT * FROM trips WHERE delay_minutes IS NOT NULL AND date IS NOT NULL),
s AS (SELECT sc.*, t.stop_distance_km, count(*) OVER () AS n_all,
        row_number() OVER (ORDER BY t.date, {sql_uniform('trip_key', f'time{SEED}')}, trip_key) - 1 AS rk
      FROM ({SCORED}) sc JOIN t USING (trip_key)),
cut AS (SELECT *, rk < CAST(floor((1 - 2e-1) * n_all) AS BIGINT) AS is_train FROM s),
test AS (SELECT * FROM cut WHERE NOT is_train),
train AS (SELECT label FROM cut WHERE is_train),
mode AS (SELECT label AS m FROM train GROUP BY label ORDER BY count(*) DESC, label ASC LIMIT 1),
rate AS (SELECT avg(CAST(label AS DOUBLE)) AS r FROM train),
models AS (
  SELECT model, trip_key, label, prediction, score FROM test
  UNION ALL SELECT 'distance', trip_key, label,
    CASE WHEN stop_distance_km >= 125e-1 THEN 1 ELSE 0 END, round(stop_distance_km / 25e0, 6) FROM test
  UNION ALL SELECT 'Majority Baseline', trip_key, label, (SELECT m FROM mode), (SELECT r FROM rate) FROM test)
"""

S_CUM = """
, c AS (SELECT {by} score AS threshold, sum(label) AS pos, sum(1 - label) AS neg FROM {src} GROUP BY {gb} score),
k AS (SELECT *,
  sum(pos) OVER (PARTITION BY {part} ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
  sum(neg) OVER (PARTITION BY {part} ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
  sum(pos) OVER (PARTITION BY {part}) AS P, sum(neg) OVER (PARTITION BY {part}) AS N FROM c)
"""


def s_cum(src: str, by: str | None = None) -> str:
    if by:
        return S_CUM.format(by=f"{by},", gb=f"{by},", part=by, src=src)
    return S_CUM.format(by="", gb="", part="1", src=src)


@register("pr_curve", ["W1"], with_trips(s_cum("scored") + f"""
SELECT threshold, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0e0 END, {R6}) AS precision,
  round(CASE WHEN P > 0 THEN tp / P ELSE 1e0 END, {R6}) AS recall FROM k
UNION ALL SELECT NULL, 1e0, 0e0""", scored=SCORED))
def pr_curve(spark, sf):
    """Precision/recall per distinct score, end point (P=1, R=0) included."""
    c = W.pr_curve(_scored(spark, sf))
    return c.select("threshold", F.round("precision", R6).alias("precision"), F.round("recall", R6).alias("recall"))


@register("roc_curve", ["W2"], with_trips(s_cum("scored") + f"""
SELECT threshold, round(CASE WHEN N > 0 THEN fp / N ELSE 0e0 END, {R6}) AS fpr,
  round(CASE WHEN P > 0 THEN tp / P ELSE 0e0 END, {R6}) AS tpr FROM k
UNION ALL SELECT CAST('inf' AS DOUBLE), 0e0, 0e0""", scored=SCORED))
def roc_curve(spark, sf):
    c = W.roc_curve(_scored(spark, sf))
    return c.select("threshold", F.round("fpr", R6).alias("fpr"), F.round("tpr", R6).alias("tpr"))


@register("ranking_metrics", ["W3", "W4"], with_trips(s_cum("scored") + f"""
SELECT round(sum(CAST(neg AS DOUBLE) * CAST(2 * tp - pos AS DOUBLE)) / (2e0 * max(P) * max(N)), {R6}) AS roc_auc,
  round(sum(pos * tp / (tp + fp)) / max(P), {R6}) AS average_precision FROM k""", scored=SCORED))
def ranking_metrics(spark, sf):
    """ROC AUC (trapezoid) and average precision (step sum) of the score."""
    r = W.ranking_metrics(_scored(spark, sf))
    return r.select(F.round("roc_auc", R6).alias("roc_auc"),
                    F.round("average_precision", R6).alias("average_precision"))


_SUMMARY_METRICS = ["accuracy", "balanced_accuracy", "macro_f1", "f1_late", "recall_late", "precision_late",
                    "late_rate", "roc_auc", "average_precision"]

S_SUMMARY = S_MODELS + s_cum("models", "model") + """
, r AS (SELECT model, sum(CAST(neg AS DOUBLE) * CAST(2 * tp - pos AS DOUBLE)) / (2e0 * max(P) * max(N)) AS roc_auc,
          sum(pos * tp / (tp + fp)) / max(P) AS average_precision FROM k GROUP BY model),
cc AS (SELECT model,
    CAST(sum(CASE WHEN label = 0 AND prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
    CAST(sum(CASE WHEN label = 0 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN label = 1 AND prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
    CAST(sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp FROM models GROUP BY model),
p AS (SELECT *,
    CASE WHEN tn + fn > 0 THEN CAST(tn AS DOUBLE) / (tn + fn) ELSE 0e0 END AS p0,
    CASE WHEN tn + fp > 0 THEN CAST(tn AS DOUBLE) / (tn + fp) ELSE 0e0 END AS r0,
    CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0e0 END AS p1,
    CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0e0 END AS r1,
    tn + fp AS s0, tp + fn AS s1, tn + fp + fn + tp AS n FROM cc),
f AS (SELECT *, CASE WHEN p0 + r0 > 0 THEN 2e0 * p0 * r0 / (p0 + r0) ELSE 0e0 END AS f0,
               CASE WHEN p1 + r1 > 0 THEN 2e0 * p1 * r1 / (p1 + r1) ELSE 0e0 END AS f1 FROM p),
summary AS (SELECT f.model, CAST(tn + tp AS DOUBLE) / n AS accuracy,
    CASE WHEN s0 > 0 AND s1 > 0 THEN (r0 + r1) / 2 WHEN s1 > 0 THEN r1 ELSE r0 END AS balanced_accuracy,
    (f0 + f1) / 2 AS macro_f1, f1 AS f1_late, r1 AS recall_late, p1 AS precision_late,
    CAST(s1 AS DOUBLE) / n AS late_rate, r.roc_auc, r.average_precision, n AS support
  FROM f JOIN r USING (model))
"""


def _summary(spark, sf) -> DataFrame:
    return W.model_summary(models_scored(spark, sf))


@register("model_summary", ["V1", "V2", "V3", "V4", "V5", "M14", "W3", "W4"], with_trips(
    S_SUMMARY + "SELECT model, support, " + ", ".join(f"round({m}, {R6}) AS {m}" for m in _SUMMARY_METRICS)
    + " FROM summary"))
def model_summary(spark, sf):
    """Per-model accuracy, balanced accuracy, macro-F1, Late F1/recall/precision,
    AUPRC, ROC AUC and Late rate for three scored models incl. the baseline."""
    s = _summary(spark, sf)
    return s.select("model", "support", *[F.round(m, R6).alias(m) for m in _SUMMARY_METRICS])


_TABLE = ["accuracy", "macro_f1", "balanced_accuracy", "f1_late", "average_precision", "late_rate"]


@register("model_comparison_table", ["V6"], with_trips(
    S_SUMMARY + "SELECT model, " + ", ".join(f"round({m}, 3) AS {m}" for m in _TABLE)
    + ", model || " + " || ".join(f"' & ' || printf('%.3f', round({m}, 3))" for m in _TABLE[:5])
    + " || ' \\\\' AS latex_row FROM summary"))
def model_comparison_table(spark, sf):
    """Comparison table with 3-decimal values and a LaTeX row per model."""
    s = _summary(spark, sf)
    latex = F.concat(F.col("model"), *[F.concat(F.lit(" & "), F.format_string("%.3f", F.round(m, 3)))
                                       for m in _TABLE[:5]], F.lit(" \\\\"))
    return s.select("model", *[F.round(m, 3).alias(m) for m in _TABLE], latex.alias("latex_row"))
