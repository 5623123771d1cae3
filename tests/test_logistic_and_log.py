"""Stacked logistic regressions against single Spark fits; a prediction log that takes each batch once."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from punctual.operators import encode as E
from punctual.operators import logistic as L
from punctual.operators import models as M
from punctual.plans import experiments as EX
from punctual.sources.fixture import trips
from punctual.streaming.scoring import log_stream, trip_stream


@pytest.fixture(scope="module")
def labelled(spark, sf):
    d, spec = EX.engine_features(trips(spark, sf))
    d = d.withColumn("fold", (F.crc32("trip_key") % 3).cast("int")).select("trip_key", "label", "fold", *spec.categorical, *spec.numeric).persist()
    yield d, spec
    d.unpersist()


def test_stacked_coefficients_equal_single_fits(labelled):
    d, spec = labelled
    enc = E.fit_encoder(d, spec)
    rows = L.Rows(enc.transform(d), enc, spec, "label", "fold")
    models = [(c, f) for c in (0.1, 10.0) for f in (0, 2)]
    w, _, _ = L.fit_many(rows, models, spec.with_mean)
    jobs = rows.jobs
    rows.close()
    for j, (c, f) in enumerate(models):
        part = d.where(F.col("fold") != f)
        own = E.fit_encoder(part, spec)
        lr = LogisticRegression(maxIter=2000, regParam=1 / (c * part.count()), standardization=False, tol=1e-12).fit(own.transform(part))
        assert np.abs(w[:-1, j] - lr.coefficients.toArray()).max() < 1e-4 and abs(w[-1, j] - lr.intercept) < 1e-4
    assert jobs < 400  # all models together


def test_search_takes_the_held_out_accuracy(labelled):
    d, spec = labelled
    enc = E.fit_encoder(d, spec)
    got, _ = L.search(enc.transform(d), enc, spec, [0.1, 1.0], [0, 1, 2])
    want = []
    for c in (0.1, 1.0):
        right = []
        for f in (0, 1, 2):
            part = d.where(F.col("fold") != f)
            own = E.fit_encoder(part, spec)
            lr = LogisticRegression(maxIter=2000, regParam=1 / (c * part.count()), standardization=False, tol=1e-12).fit(own.transform(part))
            right.append(lr.transform(own.transform(d.where(F.col("fold") == f))).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0])
        want.append(np.mean(right))
    assert np.allclose(got, want, atol=2e-3)


def test_a_repeated_batch_is_logged_once(spark, tmp_path):
    scored = spark.createDataFrame([("a", 0.9, 1, 90.0, 10.0), ("b", 0.2, 0, 80.0, 80.0)],
                                   "trip_key string, score double, prediction int, confidence double, on_time_prob double")
    path = str(tmp_path / "log")
    assert M.log_predictions(scored, path, 7) and not M.log_predictions(scored, path, 7) and M.log_predictions(scored.limit(1), path, 8)
    assert spark.read.parquet(path).groupBy("batch").count().orderBy("batch").collect() == [(7, 2), (8, 1)]
    assert M.log_predictions(scored, path) and spark.read.parquet(path).count() == 5


def test_stream_of_batches_into_the_log(spark, labelled, tmp_path):
    d, spec = labelled
    model = M.train(d, spec, "Decision Tree Classifier", {"max_depth": 3})
    d.limit(40).repartition(2).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    for _ in range(2):  # a restart finds nothing new
        log_stream(model, trip_stream(spark, str(tmp_path / "in"), schema, 1), str(tmp_path / "log"), keep=["trip_key"], available_now=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).agg(F.count("*"), F.countDistinct("trip_key")).first() == (40, 40)
