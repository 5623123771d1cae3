"""Queries for encoding, models, scoring and explanation.

Model fits are not bit-identical across engines, so model queries carry no
SQL twin (rows-only check); encoder statistics and vocabularies do.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from punctual.operators import aggregates as A
from punctual.operators import encode as E
from punctual.operators import explain as XP
from punctual.operators import models as M
from punctual.operators import prep
from punctual.plans import experiments as EX
from punctual.plans.q_build import S_BUILT, built_trips
from punctual.plans.registry import SCORED, register, with_trips
from punctual.sources.fixture import scored_trips, source_fingerprint, trips

R6 = 6
_SCALE_COLS = ["stop_distance_km", "temperature_celsius", "time_of_day"]


def _s_scaled(c: str, with_mean: bool) -> str:
    mean = f"avg({c}) OVER ()" if with_mean else "0e0"
    std = f"coalesce(nullif(stddev_pop({c}) OVER (), 0), 1e0)"
    return f"round(({c} - {mean}) / {std}, {R6})"


@register("standard_scaled", ["M3", "M4"], with_trips(
    "SELECT trip_key, " + ", ".join(f"{_s_scaled(c, True)} AS {c}" for c in _SCALE_COLS) + ", "
    + ", ".join(f"{_s_scaled(c, False)} AS {c}_unc" for c in _SCALE_COLS) + " FROM trips"))
def standard_scaled(spark, sf):
    """Standardisation with the population std (M3) and scale-only (M4)."""
    t = trips(spark, sf)
    full = E.fit_scaler(t, _SCALE_COLS, with_mean=True)
    only = E.fit_scaler(t, _SCALE_COLS, with_mean=False)
    base = t.select("trip_key", *_SCALE_COLS)
    s = E.scale_columns(E.scale_columns(base, only, "_unc"), full)  # "_unc" first: it reads the raw columns
    return s.select("trip_key", *[F.round(c, R6).alias(c) for c in _SCALE_COLS],
                    *[F.round(f"{c}_unc", R6).alias(f"{c}_unc") for c in _SCALE_COLS])


_VOCAB_COLS = ["route", "traffic_condition", "weather", "special_event", "destination"]


@register("category_vocabulary", ["M1", "M6", "P6"], with_trips(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, level, CAST(row_number() OVER (ORDER BY level) - 1 AS INTEGER) AS slot "
        f"FROM (SELECT DISTINCT CASE WHEN {c} IS NULL THEN '{'NoEvent' if c == 'special_event' else 'Unknown'}' "
        f"ELSE {c} END AS level FROM trips)" for c in _VOCAB_COLS)))
def category_vocabulary(spark, sf):
    """Alphabetical one-hot vocabulary (slot per level) learned on cleaned trips."""
    return E.dictionary(prep.clean_categories(trips(spark, sf), _VOCAB_COLS), _VOCAB_COLS)


_SLOT_COLS = ["route", "traffic_condition", "weather", "special_event"]


def _s_slots(drop_first: bool) -> str:
    out = []
    for c in _SLOT_COLS:
        level = f"coalesce({c}, '{'NoEvent' if c == 'special_event' else 'Unknown'}')"
        rest = f"WHERE level > (SELECT min({level}) FROM trips)" if drop_first else ""
        out.append(f"SELECT {str(drop_first).lower()} AS drop_first, '{c}_' || level AS slot_name, count(*) AS n_rows "
                   f"FROM (SELECT {level} AS level FROM trips) {rest} GROUP BY level")
    out.append(f"SELECT {str(drop_first).lower()}, 'time_of_day', count(*) FROM trips "
               f"WHERE time_of_day <> (SELECT avg(time_of_day) FROM trips)")
    return " UNION ALL ".join(out)


@register("encoded_slot_counts", ["M1", "M2", "M3", "M5", "M6"],
          with_trips(_s_slots(False) + " UNION ALL " + _s_slots(True)))
def encoded_slot_counts(spark, sf):
    """Rows with a value other than zero in every named slot of the encoded
    vectors, with all levels and without each column's first one."""
    t = prep.clean_categories(trips(spark, sf), _SLOT_COLS)
    out = None
    for drop_first in (False, True):
        spec = E.EncodingSpec(_SLOT_COLS, ["time_of_day"], drop_first=drop_first)
        enc = E.fit_encoder(t, spec)
        slots = enc.transform(t).select(F.posexplode(vector_to_array("features")).alias("slot", "value"))
        names = F.array(*[F.lit(n) for n in E.feature_names(enc, spec)])
        counts = (slots.where("value <> 0").groupBy("slot").agg(F.count(F.lit(1)).alias("n_rows"))
                  .select(F.lit(drop_first).alias("drop_first"), F.get(names, F.col("slot")).alias("slot_name"), "n_rows"))
        out = counts if out is None else out.unionByName(counts)
    return out


_EFFECT = "round(avg(CAST(delay_minutes AS DOUBLE)) - 3e0, 6)"
_S_EFFECTS = " UNION ALL ".join(
    f"SELECT '{c}_' || {c} AS feature, {_EFFECT} AS coef FROM trips WHERE {c} IS NOT NULL AND delay_minutes IS NOT NULL "
    f"GROUP BY {c}" for c in _SLOT_COLS)


def _level_effects(spark, sf):
    """Mean delay of every level, less three minutes, as (feature, coef, abs_coef)."""
    t = trips(spark, sf).where("delay_minutes IS NOT NULL")
    out = None
    for c in _SLOT_COLS:
        e = t.where(F.col(c).isNotNull()).groupBy(F.concat(F.lit(f"{c}_"), c).alias("feature")).agg(
            F.round(F.avg(F.col("delay_minutes").cast("double")) - 3.0, R6).alias("coef"))
        out = e if out is None else out.unionByName(e)
    return out.withColumn("abs_coef", F.abs("coef"))


@register("top_level_effects", ["K3", "K4"], with_trips(
    f"SELECT feature, coef, abs(coef) AS abs_coef FROM ({_S_EFFECTS}) ORDER BY abs(coef) DESC, feature LIMIT 10"))
def top_level_effects(spark, sf):
    """The ten levels that move the mean delay most, sorted by the signed effect."""
    return M.top_by_abs(_level_effects(spark, sf), 10)


@register("top_level_importances", ["K5"], with_trips(
    f"SELECT feature, abs(coef) AS importance FROM ({_S_EFFECTS}) ORDER BY abs(coef) DESC, feature LIMIT 8"))
def top_level_importances(spark, sf):
    return M.top_importances(_level_effects(spark, sf).select("feature", F.col("abs_coef").alias("importance")), 8)


@register("scored_columns", ["M15", "M16", "X21"], with_trips(f"""
SELECT trip_key, score, CASE WHEN score >= 5e-1 THEN 1 ELSE 0 END AS prediction,
  round(100e0 * greatest(score, 1e0 - score), {R6}) AS confidence, round(100e0 * (1e0 - score), {R6}) AS on_time_prob,
  CASE WHEN score >= 5e-1 THEN 'Late' ELSE 'On-Time' END AS predicted_status FROM scored""", scored=SCORED))
def scored_columns(spark, sf):
    """Prediction at 0.5, confidence, on-time share and status from given probabilities."""
    s = scored_trips(trips(spark, sf)).withColumnRenamed("score", "late")
    out = M.with_status(M.scored_from(s, F.array(F.lit(1.0) - F.col("late"), F.col("late")), 0.5, ["trip_key"]))
    return out.withColumns({c: F.round(c, R6) for c in ("confidence", "on_time_prob")})


@register("main_experiment_summary", ["M1", "M4", "M5", "M7", "M11", "M14", "M16", "A2", "D5", "P6", "P14",
                                      "V5", "D8"])
def main_experiment_summary(spark, sf):
    """Main experiment end to end: summary of LR, boosted trees and baseline."""
    r = EX.run_main(trips(spark, sf), snapshot=source_fingerprint(spark, sf))
    return r["summary"]


@register("lr_top_coefficients", ["M7", "M18", "K3", "K4", "X20", "M6"])
def lr_top_coefficients(spark, sf):
    """Top-25 LR coefficients by |coef|, re-sorted by signed value."""
    d = EX.prepare_main(trips(spark, sf))
    sp = EX.split_main(d, "group")
    lr = EX.fit_main_lr(sp.train, f"{source_fingerprint(spark, sf)}|main|group|42")
    return M.top_by_abs(M.coefficient_table(spark, lr), 25)


@register("boosted_shap_summary", ["M11", "M19", "D2"])
def boosted_shap_summary(spark, sf):
    """Mean |SHAP| of the boosted model over a 2000-row test sample, top 25."""
    d = EX.prepare_main(trips(spark, sf))
    sp = EX.split_main(d, "group")
    gbt = EX.fit_main_boosted(sp.train, snapshot=f"{source_fingerprint(spark, sf)}|main|group|42")
    from punctual.operators.builder import sample_without_replacement
    sample = sample_without_replacement(sp.test, 2000, "trip_key")
    features = gbt.model.transform(sample).select("trip_key", "features")
    ens = XP.load_ensemble(spark, gbt.classifier, len(gbt.names))
    return XP.shap_summary(XP.explain(features, ens, "trip_key"), gbt.names, 25)


@register("second_experiment_metrics", ["X3", "X5", "X6", "P10", "P13", "D3", "M3", "M7", "M11", "W3", "W4",
                                        "IO6"])
def second_experiment_metrics(spark, sf):
    """Second experiment: accuracy, macro-F1, balanced accuracy, ROC AUC, AUPRC."""
    return EX.run_second(trips(spark, sf), snapshot=source_fingerprint(spark, sf))["summary"]


@register("engine_grid_search", ["M2", "M3", "M5", "M13", "D7", "V7", "X1", "X4", "P5"])
def engine_grid_search(spark, sf):
    """UI engine: LR over C in {0.1, 1, 10}, 5-fold CV by accuracy, metrics record."""
    r = EX.run_engine(trips(spark, sf), "Logistic Regression", None, 3)
    return M.training_record(spark, r["scored"], r["best"])


@register("engine_grid_search_tree", ["M8", "M13", "V7"])
def engine_grid_search_tree(spark, sf):
    """UI engine: decision tree over its four depths, 5-fold CV by accuracy, metrics record."""
    r = EX.run_engine(trips(spark, sf), "Decision Tree Classifier")
    return M.training_record(spark, r["scored"], r["best"])


@register("engine_grid_search_forest", ["M9", "M13", "V7"])
def engine_grid_search_forest(spark, sf):
    """UI engine: random forest over its twelve candidates, 5-fold CV by accuracy, metrics record."""
    r = EX.run_engine(trips(spark, sf), "Random Forest Classifier")
    return M.training_record(spark, r["scored"], r["best"])


@register("engine_grid_search_boosting", ["M10", "M13", "V7"])
def engine_grid_search_boosting(spark, sf):
    """UI engine: gradient boosting over its eight candidates, 5-fold CV by accuracy, metrics record."""
    r = EX.run_engine(trips(spark, sf), "Gradient Boosting Classifier")
    return M.training_record(spark, r["scored"], r["best"])


_FIRST = ["route", "day_of_week", "traffic_condition", "weather", "special_event"]


@register("boosted_first_histogram", ["M11", "M1"], with_trips(
    f"""SELECT column_name, level, CAST(count(*) AS BIGINT) AS n_rows, round(sum(round((0.5e0 - label) * w * 1048576) / 1048576), {R6}) AS gradient,
  round(sum(round(0.25e0 * w * 1048576) / 1048576), {R6}) AS hessian
FROM (SELECT *, CASE WHEN label = 1 THEN (SELECT 1e0 * count(*) FILTER (WHERE label = 0) / count(*) FILTER (WHERE label = 1) FROM l) ELSE 1e0 END AS w
      FROM l) t, (VALUES """ + ", ".join(f"('{c}')" for c in _FIRST) + """) c(column_name),
  LATERAL (SELECT CASE column_name """ + " ".join(f"WHEN '{c}' THEN t.{c}" for c in _FIRST) + """ END AS level) v
GROUP BY column_name, level""", l="SELECT " + ", ".join(
        f"coalesce({c}, '{'NoEvent' if c == 'special_event' else 'Unknown'}') AS {c}" for c in _FIRST)
    + ", CASE WHEN delay_minutes > 5 THEN 1 ELSE 0 END AS label FROM trips WHERE delay_minutes IS NOT NULL"))
def boosted_first_histogram(spark, sf):
    """Gradient and hessian sums of every level at the first split of the boosted trees, before any sample
    (each row's share is rounded to a multiple of 2^-20, so that sums are exact)."""
    t = prep.clean_categories(prep.label_trips(trips(spark, sf).where("delay_minutes IS NOT NULL")), _FIRST)
    return M.first_histogram(t, EX.EncodingSpec(_FIRST, []))


@register("engine_unknown_model", ["M12", "V7"])
def engine_unknown_model(spark, sf):
    """UI engine with a model name it does not know: plain logistic regression, nothing to search."""
    r = EX.run_engine(trips(spark, sf), "no such model")
    return M.training_record(spark, r["scored"], r["best"])


@register("engine_tree_importances", ["M8", "M9", "M10", "M17", "K5"])
def engine_tree_importances(spark, sf):
    """Top-8 importances of a depth-10 tree, a forest of 100 trees and 100 boosting rounds."""
    d, spec = EX.engine_features(trips(spark, sf))
    out = None
    for kind, params in [("Decision Tree Classifier", {"max_depth": 10}),
                         ("Random Forest Classifier", {"n_estimators": 100, "max_depth": 10, "min_samples_split": 2}),
                         ("Gradient Boosting Classifier", {"n_estimators": 100, "learning_rate": 0.1,
                                                           "max_depth": 3})]:
        m = M.train(d, spec, kind, params)
        top = M.top_importances(M.importance_table(spark, m), 8).withColumn("model", F.lit(kind))
        out = top if out is None else out.unionByName(top)
    return out


_BUCKET = EX.ENGINE_BUCKET_HOUR
_BUCKET_KEPT = ["date", "day_of_week", "time_of_day", "route", "trip_no", "departure_time", "special_event",
                "is_rush_hour", "is_weekend", "label"]
# The builder's rows with the engine's features, from the builder's own SQL.
_S_BUCKET = f"""
SELECT * REPLACE (coalesce(special_event, 'None') AS special_event),
  CASE WHEN time_of_day IN ('Morning', 'Evening') THEN 1 ELSE 0 END AS is_rush_hour,
  CASE WHEN day_of_week IN ('Saturday', 'Sunday') THEN 1 ELSE 0 END AS is_weekend,
  CASE WHEN arrival_status = 'Late' THEN 1 ELSE 0 END AS label
FROM ({S_BUILT})"""


def _bucket_features(spark, sf):
    d, spec = EX.engine_features(built_trips(spark, sf))
    if spec != _BUCKET:
        raise ValueError("the built trips should take the bucket-hour columns")
    return d


@register("engine_bucket_features", ["X2", "X4", "P5", "P11"],
          f"SELECT {', '.join(_BUCKET_KEPT)}, count(*) AS n_trips FROM ({_S_BUCKET}) GROUP BY ALL")
def engine_bucket_features(spark, sf):
    """Engine features of the builder's output, whose hours are bucket texts."""
    return _bucket_features(spark, sf).groupBy(*_BUCKET_KEPT).agg(F.count(F.lit(1)).alias("n_trips"))


def _s_bucket_slots() -> str:
    out = [f"SELECT '{c}_' || {c} AS slot_name, count(*) AS n_rows FROM f WHERE {c} > (SELECT min({c}) FROM f) GROUP BY {c}"
           for c in _BUCKET.categorical]
    out += [f"SELECT '{c}', count(*) FROM f WHERE {c} <> (SELECT avg({c}) FROM f) HAVING count(*) > 0" for c in _BUCKET.numeric]
    return f"WITH f AS ({_S_BUCKET}) " + " UNION ALL ".join(out)


@register("engine_bucket_slot_counts", ["M2", "M3", "M5", "M6"], _s_bucket_slots())
def engine_bucket_slot_counts(spark, sf):
    """Rows with a value other than zero in every slot of the bucket-hour encoding of the builder's output."""
    # Read by the scaler, the vocabulary and the counts: kept, so that the trips are built once.
    d = _bucket_features(spark, sf).select(*_BUCKET.categorical, *_BUCKET.numeric).persist()
    enc = E.fit_encoder(d, _BUCKET)
    slots = enc.transform(d).select(F.posexplode(vector_to_array("features")).alias("slot", "value"))
    names = F.array(*[F.lit(n) for n in E.feature_names(enc, _BUCKET)])
    return (slots.where("value <> 0").groupBy("slot").agg(F.count(F.lit(1)).alias("n_rows"))
            .select(F.get(names, F.col("slot")).alias("slot_name"), "n_rows"))


@register("engine_bucket_importances", ["M5", "M8", "M17", "K5"])
def engine_bucket_importances(spark, sf):
    """Top-8 importances of a depth-10 tree fitted on the builder's output."""
    m = M.train(_bucket_features(spark, sf), _BUCKET, "Decision Tree Classifier", {"max_depth": 10})
    return M.top_importances(M.importance_table(spark, m), 8)


@register("cli_tree_report", ["M8", "A9", "A10", "IO3", "M16"])
def cli_tree_report(spark, sf):
    """CLI flow with the depth-10 tree: classification report of the test set."""
    return EX.run_cli(trips(spark, sf), "tree")["report"]


@register("score_with_confidence", ["M15", "M16", "X21"])
def score_with_confidence(spark, sf):
    """Batch scoring: Late probability, prediction at 0.5, confidence and
    on-time probability for every test trip."""
    r = EX.run_cli(trips(spark, sf), "logreg")
    return M.with_status(r["scored"])


@register("model_roundtrip", ["IO7"])
def model_roundtrip(spark, sf):
    """Save and reload the fitted pipeline; count rows scored differently."""
    import uuid

    from punctual.session import shared_path
    r = EX.run_cli(trips(spark, sf), "logreg")
    path = shared_path(spark, f"model-roundtrip-{uuid.uuid4().hex}")
    M.save_model(r["model"], path)
    back = M.load_model(path, EX.CLI_SPEC)
    test = r["scored"].select("trip_key")
    d = prep.label_trips(trips(spark, sf), keep_status=True)
    d = prep.fill_event(d).join(test, "trip_key")
    a = M.score(r["model"], d, keep=["trip_key"]).withColumnRenamed("score", "s1")
    b = M.score(back, d, keep=["trip_key"]).withColumnRenamed("score", "s2")
    j = a.select("trip_key", "s1").join(b.select("trip_key", "s2"), "trip_key")
    return j.agg(F.count(F.lit(1)).alias("n_scored"),
                 F.sum(F.when(F.col("s1") != F.col("s2"), 1).otherwise(0)).cast("bigint").alias("n_different"))


@register("confusion_by_model", ["A9", "V6"])
def confusion_by_model(spark, sf):
    """Confusion matrices of the main experiment's three models."""
    r = EX.run_main(trips(spark, sf), snapshot=source_fingerprint(spark, sf))
    return A.confusion_matrix(r["scored"], by=["model"])
