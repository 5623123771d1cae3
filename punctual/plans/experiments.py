"""End-to-end flows of the reference's scripts, as Spark jobs.

* ``prepare_main`` / ``run_main``: label -> clean -> impute -> dedup ->
  split -> LR + boosted trees + majority baseline -> metrics (main experiment).
* ``run_second``: time features -> stratified split -> LR + boosted trees
  -> accuracy / macro-F1 / balanced accuracy / ROC AUC / AUPRC (second experiment).
* ``run_engine``: engineered features -> stratified split -> grid search ->
  metrics record and importances (the UI's training engine).
* ``run_cli``: minimal train/evaluate with confusion matrix and report.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.functions import features as X
from punctual.operators import aggregates as A
from punctual.operators import curves as W
from punctual.operators import models as M
from punctual.operators import prep
from punctual.operators import split as S
from punctual.operators.baseline import majority_baseline
from punctual.operators.encode import EncodingSpec

BOOST_ROUNDS = 400


@dataclass
class Split:
    train: DataFrame
    test: DataFrame


def prepare_main(trips: DataFrame, row_id: str = "trip_key") -> DataFrame:
    """Label, clean categories, impute numerics with the median of all
    labelled rows, then drop exact (features + label) duplicates keeping the
    first row and its date/departure time."""
    d = prep.label_trips(trips)
    prep.require_columns(d, prep.EXPERIMENT_FEATURES)
    d = prep.clean_categories(d, prep.EXPERIMENT_CATEGORIES)
    cleaned = prep.coerce_numeric(d, prep.EXPERIMENT_NUMERICS).persist()  # read by the median fit and the dedup
    d = prep.impute_median(cleaned, prep.EXPERIMENT_NUMERICS)
    carry = [c for c in ("date", "departure_time") if c in d.columns]
    out = A.dedup_keep_first(d, prep.EXPERIMENT_FEATURES + ["label"], row_id, carry)
    # The prepared table feeds the split and every model: write it once to the
    # shared checkpoint folder (cuts lineage, survives executor loss).
    out = out.checkpoint(eager=True)
    cleaned.unpersist()
    return out


def split_main(d: DataFrame, mode: str = "group", row_id: str = "trip_key", seed: int = 42) -> Split:
    s = S.split(d, mode, "label", row_id, 0.2, seed, prep.EXPERIMENT_FEATURES).persist()  # both halves read it
    return Split(s.where(F.col("split") == S.TRAIN), s.where(F.col("split") == S.TEST))


def side_by_side(spark: SparkSession, *fits: Callable[[], M.TrainedModel]) -> list[M.TrainedModel]:
    """Fits that do not wait for one another: a boosted round leaves cores idle between its small jobs."""
    with ThreadPoolExecutor(len(fits)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(f)) for f in fits]]


MAIN_SPEC = EncodingSpec(prep.EXPERIMENT_CATEGORIES, prep.EXPERIMENT_NUMERICS, drop_first=False, with_mean=False)


def fit_main_boosted(train: DataFrame, rounds: int = BOOST_ROUNDS, seed: int = 42,
                     snapshot: str | None = None) -> M.TrainedModel:
    return M.train_shared(train, MAIN_SPEC, "Boosted Trees", {"n_estimators": rounds}, "positive", seed=seed,
                          snapshot=snapshot)


def fit_main_lr(train: DataFrame, snapshot: str | None = None) -> M.TrainedModel:
    return M.train_shared(train, MAIN_SPEC, "Logistic Regression", {"max_iter": 3000}, "balanced", snapshot=snapshot)


def run_main(trips: DataFrame, mode: str = "group", rounds: int = BOOST_ROUNDS, seed: int = 42,
             snapshot: str | None = None) -> dict:
    """Returns the fitted models, scored test rows (three models) and summary.
    With ``snapshot`` (a name of the trips' source) fits are shared between callers."""
    named = snapshot and f"{snapshot}|main|{mode}|{seed}"
    d = prepare_main(trips)
    sp = split_main(d, mode, seed=seed)
    train, test = sp.train, sp.test
    lr, gbt = side_by_side(trips.sparkSession, lambda: fit_main_lr(train, named), lambda: fit_main_boosted(train, rounds, seed, named))
    keep = ["trip_key", "label"]
    scored = [M.score(lr, test, keep=keep).withColumn("model", F.lit("Logistic Regression")),
              M.score(gbt, test, keep=keep).withColumn("model", F.lit("Boosted Trees")),
              majority_baseline(train.select(*keep), test.select(*keep))]
    cols = ["model", "trip_key", "label", "prediction", "score"]
    allscored = scored[0].select(*cols).unionByName(scored[1].select(*cols)).unionByName(scored[2].select(*cols))
    return {"data": d, "train": train, "test": test, "lr": lr, "gbt": gbt, "scored": allscored,
            "summary": W.model_summary(allscored)}


SECOND_SPEC = EncodingSpec(prep.SECOND_CATEGORIES, prep.SECOND_NUMERICS, drop_first=False, with_mean=True)


def second_features(trips: DataFrame) -> DataFrame:
    """Time features, substring label, leakage columns dropped, categories as text."""
    d = trips.withColumns({"is_weekend": X.weekend_casefold("day_of_week"),
                           "departure_minutes": X.time_to_minutes("departure_time")})
    d = d.withColumn("is_rush_hour", X.rush_hour_minutes("departure_minutes"))
    if "arrival_status" not in d.columns:
        d = prep.label_trips(d, keep_status=True).drop("label")
    d = d.withColumn("label", F.when(F.lower(F.col("arrival_status")).contains("late"), 1).otherwise(0))
    d = prep.drop_label_columns(d)
    d = prep.categories_as_text(d, prep.SECOND_CATEGORIES)
    d = prep.coerce_numeric(d, prep.SECOND_NUMERICS)
    # VectorAssembler rejects NULL: impute what the reference left missing.
    return prep.impute_median(d, ["stop_distance_km", "temperature_celsius", "departure_minutes"])


def run_second(trips: DataFrame, rounds: int = BOOST_ROUNDS, seed: int = 42, snapshot: str | None = None) -> dict:
    named = snapshot and f"{snapshot}|second|{seed}"
    d = second_features(trips)
    s = S.stratified_split(d, "label", "trip_key", 0.2, seed)
    train, test = s.where(F.col("split") == S.TRAIN).cache(), s.where(F.col("split") == S.TEST).cache()
    lr, gbt = side_by_side(
        trips.sparkSession,
        lambda: M.train_shared(train, SECOND_SPEC, "Logistic Regression", {"max_iter": 2000}, "balanced", snapshot=named),
        lambda: M.train_shared(train, SECOND_SPEC, "Boosted Trees", {"n_estimators": rounds, "subsample": 0.9, "colsample": 0.9},
                               "positive", seed=seed, snapshot=named))
    keep = ["trip_key", "label"]
    sc = (M.score(lr, test, keep=keep).withColumn("model", F.lit("LogisticRegression"))
          .unionByName(M.score(gbt, test, keep=keep).withColumn("model", F.lit("BoostedTrees"))))
    summary = W.model_summary(sc).select(
        "model", "accuracy", "macro_f1", "balanced_accuracy", "roc_auc", F.col("average_precision").alias("auprc"))
    return {"lr": lr, "gbt": gbt, "test": test, "scored": sc, "summary": summary}


ENGINE_NUMERIC_HOUR = EncodingSpec(["route", "day_of_week", "traffic_condition", "weather", "special_event"],
                                   ["stop_distance_km", "time_of_day", "temperature_celsius", "is_rush_hour",
                                    "is_weekend"], drop_first=True, with_mean=True)
ENGINE_BUCKET_HOUR = EncodingSpec(["route", "day_of_week", "time_of_day", "traffic_condition", "weather",
                                   "special_event"],
                                  ["stop_distance_km", "temperature_celsius", "is_rush_hour", "is_weekend"],
                                  drop_first=True, with_mean=True)


def engine_features(trips: DataFrame) -> tuple[DataFrame, EncodingSpec]:
    """Rush hour by hour value or by bucket, chosen by the declared type of
    ``time_of_day``; weekend flag; event filled with 'None'."""
    numeric = dict(trips.dtypes)["time_of_day"] in ("double", "float", "int", "bigint")
    rush = X.rush_hour_numeric("time_of_day") if numeric else X.rush_hour_bucket("time_of_day")
    d = trips.withColumns({"is_rush_hour": rush, "is_weekend": X.weekend_exact("day_of_week")})
    d = prep.fill_event(d)
    if "arrival_status" not in d.columns:
        d = prep.label_trips(d, keep_status=True).drop("label")
    d = d.withColumn("label", F.when(F.col("arrival_status") == "Late", 1).otherwise(0))
    return d, (ENGINE_NUMERIC_HOUR if numeric else ENGINE_BUCKET_HOUR)


def run_engine(trips: DataFrame, kind: str = "Logistic Regression", grid_values: dict | None = None,
               parallelism: int = 4, seed: int = 42) -> dict:
    d, spec = engine_features(trips)
    # The folds' ranks shuffle their rows, and both parts are kept: only columns that are read go along.
    d = d.select("trip_key", *spec.categorical, *spec.numeric, "label")
    s = S.stratified_split(d, "label", "trip_key", 0.2, seed)
    train = S.stratified_folds(s.where(F.col("split") == S.TRAIN).drop("split"), "label", "trip_key", 5, seed)
    train = (train if kind in M.KEYED else train.drop("trip_key")).cache()
    test = s.where(F.col("split") == S.TEST).drop("split").cache()
    model, best, cv_metrics = M.grid_search(train, spec, kind, grid_values, "fold", "label", parallelism, seed)
    scored = M.score(model, test, keep=["trip_key", "label"])
    return {"model": model, "best": best, "cv_metrics": cv_metrics, "scored": scored, "test": test}


CLI_SPEC = EncodingSpec(["route", "day_of_week", "traffic_condition", "weather", "special_event"],
                        ["stop_distance_km", "time_of_day", "temperature_celsius"], drop_first=True, with_mean=True)


def run_cli(trips: DataFrame, model: str = "logreg", seed: int = 42) -> dict:
    """Minimal train/evaluate: accuracy, confusion matrix, report."""
    d = trips
    if "arrival_status" not in d.columns:
        d = prep.label_trips(d, keep_status=True).drop("label")
    prep.require_columns(d, prep.CLI_REQUIRED)
    d = prep.fill_event(d).withColumn("label", F.when(F.col("arrival_status") == "Late", 1).otherwise(0))
    s = S.stratified_split(d, "label", "trip_key", 0.2, seed)
    train, test = s.where(F.col("split") == S.TRAIN), s.where(F.col("split") == S.TEST)
    kind = "tree" if model == "tree" else "logreg"
    m = M.train(train, CLI_SPEC, kind, {"max_depth": 10} if kind == "tree" else {"max_iter": 1000}, seed=seed)
    scored = M.score(m, test, keep=["trip_key", "label"])
    return {"model": m, "scored": scored, "confusion": A.confusion_matrix(scored),
            "report": A.classification_report(scored)}
