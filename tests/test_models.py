"""Model sanity, metric cross-checks, TreeSHAP, persistence and streaming."""

import math

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from punctual.operators import curves as W
from punctual.operators import encode as E
from punctual.operators import explain as XP
from punctual.operators import models as M
from punctual.operators import prep
from punctual.plans import experiments as EX
from punctual.sources.fixture import scored_trips, trips


@pytest.fixture(scope="module")
def cli(spark, sf):
    return EX.run_cli(trips(spark, sf), "logreg")


def test_lr_beats_majority_and_high_traffic_raises_risk(spark, cli):
    summary = W.model_summary(cli["scored"].withColumn("model", F.lit("lr"))).first()
    assert summary["balanced_accuracy"] > 0.5
    coefs = {r["feature"]: r["coef"] for r in M.coefficient_table(spark, cli["model"]).collect()}
    # drop_first removes 'High' (alphabetically first): Low and Medium must lower the risk
    assert coefs["traffic_condition_Low"] < 0 and coefs["traffic_condition_Medium"] < 0


def test_auc_matches_builtin_evaluator(spark, sf):
    s = scored_trips(trips(spark, sf))
    ours = W.ranking_metrics(s).first()["roc_auc"]
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", metricName="areaUnderROC",
                                       numBins=0)
    assert abs(ours - ev.evaluate(s.withColumn("label", F.col("label").cast("double")))) < 1e-9


def test_average_precision_with_ties(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.2), (1, 0.2)]
    df = spark.createDataFrame(rows, "label int, score double")
    ap = W.ranking_metrics(df).first()["average_precision"]
    # thresholds 0.9: P=1/2, R=1/3 ; 0.5: P=2/3, R=2/3 ; 0.2: P=3/5, R=1
    expected = (1 / 3) * 0.5 + (1 / 3) * (2 / 3) + (1 / 3) * 0.6
    assert abs(ap - expected) < 1e-12
    pr = {r["threshold"]: (r["precision"], r["recall"]) for r in W.pr_curve(df).collect()}
    assert pr[None] == (1.0, 0.0) and abs(pr[0.5][0] - 2 / 3) < 1e-12


def test_one_class_test_set(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (0, 1, 0.7)], "label int, prediction int, score double")
    r = W.model_summary(df.withColumn("model", F.lit("m"))).first()
    assert r["precision_late"] == 0.0 and r["balanced_accuracy"] == 0.5 and r["roc_auc"] is None


def test_unseen_category_encodes_as_zeros(spark):
    train = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "c string, x double")
    test = spark.createDataFrame([("z", 1.0)], "c string, x double")
    for drop_first in (False, True):
        spec = E.EncodingSpec(["c"], ["x"], drop_first=drop_first)
        enc = E.fit_encoder(train, spec)
        v = enc.transform(test).select("features").first()[0].toArray()
        n_cat = 1 if drop_first else 2
        assert list(v[:n_cat]) == [0.0] * n_cat and len(v) == len(E.feature_names(enc, spec))


def test_population_std_scaler(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (8.0,)], "x double")
    st = E.fit_scaler(df, ["x"])[0]
    assert abs(st.std - np.std([1.0, 3.0, 8.0])) < 1e-12


def test_treeshap_one_split_by_hand():
    # root splits feature 0 at 0.5; left leaf 1.0 (cover 3), right leaf 5.0 (cover 1)
    nodes = {0: {"value": 0.0, "cover": 4.0, "leftChild": 1, "rightChild": 2, "feature": 0,
                 "threshold": ("num", 0.5)},
             1: {"value": 1.0, "cover": 3.0, "leftChild": -1, "rightChild": -1, "feature": -1, "threshold": None},
             2: {"value": 5.0, "cover": 1.0, "leftChild": -1, "rightChild": -1, "feature": -1, "threshold": None}}
    leaves = XP._leaves_of(nodes, 0)
    ens = XP.Ensemble([leaves], [1.0], 2, 1.0, 0.75 * 1.0 + 0.25 * 5.0)
    phi = XP.shap_matrix(ens, np.array([[0.0, 9.0], [1.0, 9.0]]))
    assert np.allclose(phi[:, 0], [1.0 - 2.0, 5.0 - 2.0]) and np.allclose(phi[:, 1], 0.0)


def test_gbt_shap_additivity_and_roundtrip(spark, sf, tmp_path):
    d = prep.label_trips(trips(spark, sf))
    spec = E.EncodingSpec(["traffic_condition", "weather"], ["time_of_day", "stop_distance_km"], with_mean=False)
    gbt = M.train(d, spec, "Boosted Trees", {"n_estimators": 5, "max_depth": 3})
    feats = gbt.model.transform(d).select("trip_key", "features", "probability")
    ens = XP.load_ensemble(spark, gbt.classifier, len(gbt.names))
    j = XP.explain(feats, ens, "trip_key").join(feats, "trip_key").select("base", "shap", "probability").toPandas()
    p = np.array([v[1] for v in j["probability"]])
    total = j["base"].to_numpy() + np.array([s.sum() for s in j["shap"]])
    assert np.abs(total - np.log(p / (1 - p))).max() < 1e-9
    path = str(tmp_path / "gbt")
    M.save_model(gbt, path)
    back = M.load_model(path, spec)
    a = M.score(gbt, d, keep=["trip_key"]).select("trip_key", F.col("score").alias("a"))
    b = M.score(back, d, keep=["trip_key"]).select("trip_key", F.col("score").alias("b"))
    assert a.join(b, "trip_key").where("a != b").count() == 0
    assert back.names == gbt.names


def test_streaming_scoring(spark, sf, cli, tmp_path):
    from punctual.streaming.scoring import score_stream, trip_stream
    src = str(tmp_path / "in")
    d = prep.fill_event(prep.label_trips(trips(spark, sf), keep_status=True))
    d.limit(500).write.parquet(src)
    q = score_stream(cli["model"], trip_stream(spark, src, d.schema), str(tmp_path / "out"), name="t",
                     keep=["trip_key"], available_now=True)
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 500 and out.where("score < 0 OR score > 1").count() == 0
    assert math.isclose(out.agg(F.max("confidence")).first()[0] <= 100.0, True)


def test_buckets_follow_rows():
    from punctual.operators.ranking import BUCKET_ROWS, MIN_BUCKETS, bucket_count
    assert bucket_count(0) == MIN_BUCKETS
    assert bucket_count(10**10) == 10**10 // BUCKET_ROWS


def test_shap_by_patterns_equals_row_by_row():
    rng = np.random.default_rng(1)
    zero, o = rng.random(4), rng.integers(0, 2, (50, 4)).astype(float)
    conds = [(i, i, ("num", 0.5), False) for i in range(4)]
    e = {"trees": [[(2.0, np.arange(4), zero, conds)]], "weights": [1.0], "n_features": 4, "scale": 1.0, "base": 0.0}
    assert np.allclose(XP.shap_matrix(e, o), 2.0 * XP._path_values(o, zero))


def test_grid_search_learns_encoding_inside_folds(spark):
    rows = [(f"c{i % 3}", float(i), i % 2, i % 5) for i in range(60)]
    df = spark.createDataFrame(rows, "c string, x double, label int, fold int")
    model, best, metrics = M.grid_search(df, E.EncodingSpec(["c"], ["x"]), "Logistic Regression", {"C": [0.1, 1.0]})
    assert len(metrics) == 2 and best["C"] in (0.1, 1.0) and len(model.names) == 4


def test_fits_are_shared_by_snapshot(spark, sf):
    d = EX.engine_features(trips(spark, sf))[0]
    fit = lambda name: M.train_shared(d, EX.CLI_SPEC, "tree", {"max_depth": 2}, snapshot=name).classifier.uid
    assert fit("a") == fit("a") and fit("a") != fit("b")


def test_engine_keeps_one_narrow_copy(spark, sf, monkeypatch):
    from punctual.operators import models as M
    from punctual.plans import experiments as EX
    from punctual.sources.fixture import trips
    seen, plain = [], M.train

    def train(df, *args, **kwargs):
        before = spark.sparkContext._jsc.getPersistentRDDs().size()
        out = plain(df, *args, **kwargs)
        seen.append((df.columns, df.storageLevel.useMemory, spark.sparkContext._jsc.getPersistentRDDs().size() - before))
        return out

    monkeypatch.setattr(M, "train", train)
    r = EX.run_engine(trips(spark, sf), "no such model")
    read = {*EX.ENGINE_NUMERIC_HOUR.categorical, *EX.ENGINE_NUMERIC_HOUR.numeric, "label"}
    assert set(r["test"].columns) == read | {"trip_key"}
    (columns, kept, more), = seen
    assert set(columns) == read | {"fold"} and kept and more <= 0


def test_trips_let_go_of_their_shuffles(spark, sf, monkeypatch, tmp_path):
    import shutil
    from punctual.sources import fixture
    shutil.copytree(sf, tmp_path / "tables")
    calls = []
    monkeypatch.setattr(fixture, "release", lambda s: calls.append(s))
    for _ in range(2):
        assert fixture.trips(spark, str(tmp_path / "tables")).count() == fixture.trips(spark, sf).count()
    assert calls == [spark]


def test_even_rows_become_linear_blocks_where_they_are(spark, monkeypatch):
    from pyspark.sql import functions as F
    from punctual.operators import encode as E
    from punctual.operators import logistic as L
    spec = E.EncodingSpec(["c"], ["x"])
    parts = spark.sparkContext.defaultParallelism + 2
    df = spark.range(0, 100 * parts, 1, parts).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("c"), (F.col("id") % 7).cast("double").alias("x"),
                                                      (F.col("id") % 2).cast("int").alias("label"))
    enc = E.fit_encoder(df, spec)
    monkeypatch.setattr(L, "BLOCK_ROWS", 70)
    monkeypatch.setattr(L, "BLOCK_ROWS_MOST", 70)
    rows = L.Rows(enc.transform(df), enc, spec, "label", None)
    assert rows.count == 100 * parts and rows.blocks.map(lambda b: len(b["y"])).collect() == [70, 30] * parts
    rows.close()
