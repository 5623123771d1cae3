"""Classifiers, grid search, scoring and model tables (M7-M18, K3-K5, V7, IO7, IO9).

Models are Spark ML estimators fitted on the encoded vector; encoder and
classifier are stored together as one ``PipelineModel`` so a reloaded model
keeps its feature names and scores identically.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from concurrent.futures import ThreadPoolExecutor
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.functions.labels import LATE, ON_TIME
from punctual.operators import logistic as L
from punctual.operators import trees as T
from punctual.operators.aggregates import balanced_weights, class_balance
from punctual.operators.encode import EncodingSpec, feature_names, fit_encoder
from punctual.session import shared_path

# Changes whenever fits of the same parameters, or their files, change.
FIT_FORMAT = 2

# Reference hyper-parameter grids (fixed values).
GRIDS = {
    "Logistic Regression": {"C": [0.1, 1.0, 10.0]},
    "Decision Tree Classifier": {"max_depth": [5, 10, 20, None]},
    "Random Forest Classifier": {"n_estimators": [50, 100], "max_depth": [10, 20, None],
                                 "min_samples_split": [2, 5]},
    "Gradient Boosting Classifier": {"n_estimators": [50, 100], "learning_rate": [0.01, 0.1],
                                     "max_depth": [3, 5]},
}


LINEAR = ("Logistic Regression", "logreg", "lr")
# Models whose row samples are drawn by the rows' key.
KEYED = T.KINDS


class TreePipeline:
    """A fitted encoder and its trees, used like a ``PipelineModel``."""

    def __init__(self, encoder: PipelineModel, trees: T.TreeModel):
        self.encoder, self.trees = encoder, trees
        self.stages = [*encoder.stages, trees]

    def transform(self, df: DataFrame) -> DataFrame:
        return self.trees.transform(self.encoder.transform(df))


@dataclass
class TrainedModel:
    model: PipelineModel | TreePipeline
    spec: EncodingSpec
    names: list[str]
    kind: str
    params: dict = field(default_factory=dict)

    @property
    def classifier(self):
        return self.model.stages[-1]


def make_estimator(kind: str, params: dict | None = None, n_train: float | None = None,
                   weight_col: str | None = None, label: str = "label", seed: int = 42):
    """Logistic regression; unknown names fall back to its plain form (trees: see ``trees.fit``)."""
    p = dict(params or {})
    common = {"featuresCol": "features", "labelCol": label}
    if weight_col:
        common["weightCol"] = weight_col
    if kind in LINEAR:
        c = float(p.get("C", 1.0))
        reg = 1.0 / (c * n_train) if n_train else 0.0
        return LogisticRegression(maxIter=int(p.get("max_iter", 1000)), regParam=reg, elasticNetParam=0.0,
                                  standardization=False, fitIntercept=True, tol=1e-4, **common)
    return LogisticRegression(maxIter=100, regParam=1.0 / n_train if n_train else 0.0, standardization=False,
                              **common)


def positive_weights(df: DataFrame, label: str = "label", weight_col: str = "weight") -> DataFrame:
    """Weight neg/pos on positive rows, 1 on negatives (scale_pos_weight)."""
    ratio = class_balance(df, label).first()["scale_pos_weight"]
    return df.withColumn(weight_col, F.when(F.col(label) == 1, F.lit(float(ratio))).otherwise(F.lit(1.0)))


def train(train_df: DataFrame, spec: EncodingSpec, kind: str, params: dict | None = None,
          balanced: str | None = None, label: str = "label", seed: int = 42, key: str | None = None) -> TrainedModel:
    """Fit encoder + classifier on ``train_df``; ``key`` names the rows for the samples of tree ensembles.

    ``balanced``: None, 'balanced' (n/(k*n_c) weights, A8) or 'positive'
    (neg/pos on Late rows).  LR's penalty follows C via 1/(C * sum of weights).
    """
    df = train_df
    weight_col = None
    if balanced == "balanced":
        df, weight_col = balanced_weights(df, label, "weight"), "weight"
    elif balanced == "positive":
        df, weight_col = positive_weights(df, label, "weight"), "weight"
    key = key or ("trip_key" if "trip_key" in df.columns else None)
    cols = list(dict.fromkeys([*spec.categorical, *spec.numeric, label] + ([weight_col] if weight_col else []) + ([key] if key else [])))
    kept = train_df.storageLevel.useMemory  # a second copy of kept rows would be kept beside them
    df = df.select(*cols) if kept else df.select(*cols).persist()  # read by the vocabulary, scaler and model passes
    try:
        enc = fit_encoder(df, spec)
        if kind in T.KINDS:
            trees = T.fit(enc.transform(df), enc, spec, kind, dict(params or {}), label, weight_col, key, seed)
            return TrainedModel(TreePipeline(enc, trees), spec, feature_names(enc, spec), kind, dict(params or {}))
        # Not kept: the estimator keeps the vectors in blocks of its own, far smaller than a table of them.
        encoded = enc.transform(df).select(spec.features_col, label, *([weight_col] if weight_col else []))
        sum_w = df.agg(F.sum(F.col(weight_col)) if weight_col else F.count(F.lit(1))).first()[0]
        clf = make_estimator(kind, params, float(sum_w), weight_col, label, seed).fit(encoded)
    finally:
        if not kept:
            df.unpersist()
    return TrainedModel(PipelineModel(stages=list(enc.stages) + [clf]), spec, feature_names(enc, spec), kind,
                        dict(params or {}))


def first_histogram(df: DataFrame, spec: EncodingSpec, label: str = "label") -> DataFrame:
    """(column_name, level, n_rows, gradient, hessian): the sums that the first split of the boosted trees is chosen from."""
    from punctual.operators.encode import category_levels
    spark = df.sparkSession
    weighted = positive_weights(df, label).select(*spec.categorical, label, "weight")
    enc = fit_encoder(weighted, spec)
    encoded = enc.transform(weighted)
    blocks = T.Blocks(encoded, T.layout_of(encoded, enc, spec), label, "weight", None, None)
    try:
        index, sums = blocks.root_sums(T.rule_of("Boosted Trees", {"subsample": 1.0}, 1))
    finally:
        blocks.close()
    levels = category_levels(enc)
    names = [(c, v) for c in spec.categorical for v in [*levels[c], None]]  # one slot per column for unseen levels
    rows = [(*names[i], int(n), round(float(g), 6), round(float(h), 6)) for i, (g, h, n) in zip(index, sums)]
    return spark.createDataFrame(rows, "column_name string, level string, n_rows long, gradient double, hessian double")


def grid(kind: str, grid_values: dict | None = None) -> list[dict]:
    g = grid_values if grid_values is not None else GRIDS.get(kind, {})
    keys = list(g)
    return [dict(zip(keys, vals)) for vals in itertools.product(*[g[k] for k in keys])] or [{}]


def grid_search(train_df: DataFrame, spec: EncodingSpec, kind: str, grid_values: dict | None = None,
                fold_col: str = "fold", label: str = "label", parallelism: int = 4,
                seed: int = 42) -> tuple[TrainedModel, dict, list[float]]:
    """K-fold CV (folds from ``fold_col``, e.g. D7) by accuracy, refit the
    best candidate on all of ``train_df``."""
    candidates = grid(kind, grid_values)
    folds = [r[0] for r in train_df.select(fold_col).distinct().orderBy(fold_col).collect()]  # k fold numbers
    if kind in T.KINDS:
        # A level or value that only held-out rows have is in no sum, so one encoding serves all folds.
        enc = fit_encoder(train_df, spec)
        metrics = T.search(enc.transform(train_df), enc, spec, kind, candidates, folds, fold_col, label,
                           "trip_key" if "trip_key" in train_df.columns else None, seed)
        best = candidates[max(range(len(metrics)), key=lambda i: metrics[i])]
        return train(train_df, spec, kind, best, None, label, seed), best, metrics
    unknown = kind not in LINEAR  # plain logistic regression whatever the parameters, see ``make_estimator``
    if unknown or all(set(c) <= {"C"} for c in candidates):
        enc = fit_encoder(train_df, spec)
        metrics, _ = L.search(enc.transform(train_df), enc, spec, [1.0 if unknown else float(c.get("C", 1.0)) for c in candidates],
                              folds, fold_col, label, 100 if unknown else 1000)
        best = candidates[max(range(len(metrics)), key=lambda i: metrics[i])]
        return train(train_df, spec, kind, best, None, label, seed), best, metrics
    evaluator = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    totals = [0.0] * len(candidates)
    for fold in folds:
        # Vocabularies and scaling are learned from the fold's training rows only.
        enc = fit_encoder(train_df.where(F.col(fold_col) != fold), spec)
        encoded = enc.transform(train_df).select(spec.features_col, label, fold_col).persist()
        try:
            fit_rows, held_out = encoded.where(F.col(fold_col) != fold), encoded.where(F.col(fold_col) == fold)
            n = fit_rows.count()

            def accuracy(params: dict) -> float:
                fitted = make_estimator(kind, params, n, None, label, seed).fit(fit_rows)
                return evaluator.evaluate(fitted.transform(held_out))

            with ThreadPoolExecutor(max(1, parallelism)) as pool:  # candidates share the cached fold
                for i, acc in enumerate(pool.map(accuracy, candidates)):
                    totals[i] += acc
        finally:
            encoded.unpersist()
    metrics = [t / len(folds) for t in totals]
    best = candidates[max(range(len(metrics)), key=lambda i: metrics[i])]
    return train(train_df, spec, kind, best, None, label, seed), best, metrics


# --- scoring (M15, M16, X21) -------------------------------------------------------

def score(model: TrainedModel | PipelineModel, df: DataFrame, threshold: float = 0.5,
          keep: Sequence[str] | None = None) -> DataFrame:
    """Late probability by label value (index 1 = Late), thresholded
    prediction, confidence = 100 * max(p) and on-time probability * 100.
    Works on batch and streaming DataFrames alike."""
    pm = model.model if isinstance(model, TrainedModel) else model
    cols = list(keep) if keep is not None else [c for c in df.columns]
    return scored_from(pm.transform(df), vector_to_array(F.col("probability")), threshold, cols)


def scored_from(df: DataFrame, p: Column, threshold: float, cols: Sequence[str]) -> DataFrame:
    """The scoring columns from an array of class probabilities ``p``."""
    return df.select(*cols,
                      F.element_at(p, 2).alias("score"),
                      F.when(F.element_at(p, 2) >= F.lit(float(threshold)), 1).otherwise(0).alias("prediction"),
                      (F.array_max(p) * 100).alias("confidence"),
                      (F.element_at(p, 1) * 100).alias("on_time_prob"))


def with_status(scored: DataFrame) -> DataFrame:
    return scored.withColumn("predicted_status", F.when(F.col("prediction") == 1, F.lit(LATE))
                             .otherwise(F.lit(ON_TIME)))


# --- model tables (M17, M18, K3-K5) ---------------------------------------------

def coefficient_table(spark: SparkSession, model: TrainedModel) -> DataFrame:
    """(feature, coef, abs_coef) of a linear model."""
    coefs = model.classifier.coefficients.toArray().tolist()
    rows = [(n, float(c), abs(float(c))) for n, c in zip(model.names, coefs)]
    return spark.createDataFrame(rows, "feature string, coef double, abs_coef double")


def importance_table(spark: SparkSession, model: TrainedModel) -> DataFrame:
    """|coef| for linear models, impurity importance for trees."""
    clf = model.classifier
    if hasattr(clf, "coefficients"):
        vals = [abs(float(c)) for c in clf.coefficients.toArray()]
    elif hasattr(clf, "featureImportances"):
        vals = [float(v) for v in clf.featureImportances.toArray()]
    else:
        vals = []
    return spark.createDataFrame(list(zip(model.names, vals)), "feature string, importance double")


def top_by_abs(coefs: DataFrame, k: int = 25, resort_signed: bool = True) -> DataFrame:
    """K3/K4: top-k by |coef| (ties by name), optionally re-sorted by signed coef."""
    top = coefs.orderBy(F.col("abs_coef").desc(), F.col("feature").asc()).limit(k)
    return top.orderBy("coef") if resort_signed else top


def top_importances(imp: DataFrame, k: int = 8) -> DataFrame:
    """K5."""
    return imp.orderBy(F.col("importance").desc(), F.col("feature").asc()).limit(k)


def training_record(spark: SparkSession, scored: DataFrame, best_params: dict | None = None,
                    label: str = "label") -> DataFrame:
    """V7: accuracy, precision, recall, F1 of Late, ROC AUC and the best
    parameters as one row."""
    from punctual.operators.aggregates import confusion_counts, report_columns
    from punctual.operators.curves import ranking_metrics
    m = confusion_counts(scored, label, "prediction").select(*report_columns())
    r = ranking_metrics(scored, label, "score").first()
    params = ", ".join(f"{k}={v}" for k, v in sorted((best_params or {}).items()))
    return m.select("accuracy", F.col("precision_1").alias("precision"), F.col("recall_1").alias("recall"),
                    F.col("f1_1").alias("f1"), F.lit(r["roc_auc"]).cast("double").alias("roc_auc"),
                    F.lit(params).alias("best_params"))


# --- persistence and prediction log (IO7, IO9) ----------------------------------------

def save_model(model: TrainedModel, path: str) -> None:
    if isinstance(model.model, TreePipeline):
        model.model.encoder.write().overwrite().save(f"{path}/encoder")
        model.model.trees.save(SparkSession.active(), f"{path}/trees")
    else:
        model.model.write().overwrite().save(path)


def load_model(path: str, spec: EncodingSpec, kind: str = "") -> TrainedModel:
    spark = SparkSession.active()
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/trees")
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        enc = PipelineModel.load(f"{path}/encoder")
        trees = T.TreeModel.load(spark, f"{path}/trees")
        return TrainedModel(TreePipeline(enc, trees), spec, feature_names(enc, spec), kind or trees.kind)
    pm = PipelineModel.load(path)
    enc = PipelineModel(stages=pm.stages[:-1])
    return TrainedModel(pm, spec, feature_names(enc, spec), kind)


def train_shared(train_df: DataFrame, spec: EncodingSpec, kind: str, params: dict | None = None,
                 balanced: str | None = None, label: str = "label", seed: int = 42,
                 snapshot: str | None = None) -> TrainedModel:
    """``train``, fitted once per ``snapshot`` (a name of the training rows' source and preparation) and
    parameters: later callers load it from the shared folder.  Without a snapshot it is always fitted."""
    if snapshot is None:
        return train(train_df, spec, kind, params, balanced, label, seed)
    spark = train_df.sparkSession
    name = hashlib.md5(repr((FIT_FORMAT, snapshot, spec, kind, sorted((params or {}).items()), balanced, label, seed))
                       .encode()).hexdigest()
    done = shared_path(spark, f"fitted-{name}")
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target = hadoop_path(done)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # The marker is written last, into the folder that only this writer fills.
    for st in (fs.listStatus(target) if fs.exists(target) else []):
        if fs.exists(hadoop_path(st.getPath(), "_FITTED")):
            return load_model(st.getPath().toString() + "/model", spec, kind)
    model = train(train_df, spec, kind, params, balanced, label, seed)
    own = f"{done}/{uuid.uuid4().hex}"
    save_model(model, f"{own}/model")
    fs.create(hadoop_path(f"{own}/_FITTED")).close()
    return model


def log_predictions(scored: DataFrame, path: str, batch: int | str | None = None) -> bool:
    """IO9: add (timestamp, prediction, confidence, inputs) to a table as one batch.

    The batch is written beside the table and published by one rename to
    ``batch=<its name>``: readers see all of it or none, and a batch that is
    logged again under its name (a retry) changes nothing.  Returns whether
    it was published now.
    """
    spark = scored.sparkSession
    to_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target = to_path(path, f"batch={uuid.uuid4().hex if batch is None else batch}")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        return False
    staged = to_path(path, f"_staged-{uuid.uuid4().hex}")  # readers pass over names that begin so
    with_status(scored).withColumn("logged_at", F.current_timestamp()).write.parquet(staged.toString())
    # Where another writer was first, the rename fails or lands inside its folder; either way ours goes.
    if fs.exists(target) or not fs.rename(staged, target):
        fs.delete(staged, True)
        return False
    inside = to_path(target, staged.getName())
    if fs.exists(inside):
        fs.delete(inside, True)
        return False
    return True
