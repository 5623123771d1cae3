"""What must not grow faster than the rows: driver's share of tree searches, draws per row, rows per partition, passes over built trips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from punctual.operators import builder as B
from punctual.operators import encode as E
from punctual.operators import joins as J
from punctual.operators import logistic as L
from punctual.operators import models as M
from punctual.operators import trees as T

SPEC = E.EncodingSpec(["a"], ["x"])


@pytest.fixture(scope="module")
def rows(spark):
    u = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(100))
    d = spark.range(3000).select(F.col("id").alias("trip_key"), F.concat(F.lit("l"), u("a") % 4).alias("a"), u("x").cast("double").alias("x"),
                                 (u("y") + u("x") > 100).cast("int").alias("label"), (u("f") % 3).cast("int").alias("fold")).persist()
    yield d
    d.unpersist()


def test_splits_chosen_in_tasks_equal_those_of_the_driver(rows, monkeypatch):
    enc = E.fit_encoder(rows, SPEC)
    encoded = enc.transform(rows)
    monkeypatch.setattr(T, "BLOCK_ROWS", 300)
    monkeypatch.setattr(T, "LOCAL_ROWS", 200)
    monkeypatch.setattr(T, "NODES_TOGETHER", 2)
    fits = []
    for cells in (10**9, 0):  # with 0, no sums reach the driver
        monkeypatch.setattr(T, "DIRECT_CELLS", cells)
        for kind in ("Random Forest Classifier", "Boosted Trees"):
            fits.append(T.fit(encoded, enc, SPEC, kind, {"n_estimators": 3, "max_depth": 6}, key="trip_key").trees)
    for a, b in zip(fits[0] + fits[1], fits[2] + fits[3]):
        assert len(a["column"]) > 20 and all((a[k] == b[k]).all() for k in ("column", "slot", "yes", "no", "value", "rows"))


def test_votes_of_held_out_rows_equal_whole_trees(rows, monkeypatch):
    enc = E.fit_encoder(rows, SPEC)
    encoded = enc.transform(rows)
    monkeypatch.setattr(T, "BLOCK_ROWS", 300)
    candidates = [{"max_depth": d, "min_samples_split": 2} for d in (2, 5, None)]
    got = []
    for local in (50, 10**6):  # small nodes below several levels, or the root itself
        monkeypatch.setattr(T, "LOCAL_ROWS", local)
        got.append(T.search(encoded, enc, SPEC, "Decision Tree Classifier", candidates, [0, 1, 2], key="trip_key"))
    want = []
    for c in candidates:
        right = []
        for f in (0, 1, 2):
            model = T.fit(encoded.where(F.col("fold") != f), enc, SPEC, "Decision Tree Classifier", c, key="trip_key")
            p = encoded.where(F.col("fold") == f).toPandas()
            codes = model.layout.codes([p["a__idx"].to_numpy(float), p["x_scaled"].to_numpy(float)])
            right.append(((model.scores(codes) > 0.5) == (p["label"].to_numpy() == 1)).mean())
        want.append(float(np.mean(right)))
    assert got[0] == got[1] and np.allclose(got[0], want, atol=0.01)


def test_a_worker_that_missed_trees_catches_up(rows):
    layout = T.Layout(["a"], [4], ["x"], [[10.5, 50.5]])
    rng = np.random.default_rng(1)
    codes = layout.codes([rng.integers(0, 4, 500).astype(float), rng.integers(0, 100, 500).astype(float)])
    block = {"codes": codes, "y": rng.integers(0, 2, 500).astype(float), "w": np.ones(500), "fold": np.full(500, -2, np.int32),
             "key": np.arange(500, dtype=np.uint64), "margin": {}, "name": "catch-up-0"}
    done = []
    for n in range(6):
        tree = T.Tree()
        tree.add(np.array([n + 1.0, -n]), np.ones(2), np.ones(2), np.array([2, 3], np.uint64))
        for k, v in (("column", 1), ("slot", int(layout.offsets[1]) + n % 2), ("yes", 1), ("no", 2)):
            tree.nodes[k][0] = v
        if n in (0, 4):  # the trees between were grown on other workers
            plan = {"id": 0, "rule": T.Rule("newton", 3), "base": 0.0, "fold": -1, "seed": n, "done": list(done), "run": "catch-up", "renewed": 0, "few": True}
            stats, _ = T._state(block, plan, T.Tree().arrays(), 1)
            assert (stats == T._stats(plan["rule"], block, plan, T._margin(block, plan, 1))).all()
        done.append(tree.arrays())


def test_an_unknown_model_searches_all_folds_in_one_pass(rows, monkeypatch):
    calls = []
    monkeypatch.setattr(M.L, "search", lambda *a, real=L.search: calls.append(a) or real(*a))
    _, best, metrics = M.grid_search(rows, SPEC, "no such model")
    assert best == {} and len(calls) == 1 and 0.5 < metrics[0] <= 1


def test_rows_of_equal_levels_share_margins(spark, rows):
    enc = E.fit_encoder(rows, SPEC)
    kept = L.Rows(enc.transform(rows), enc, SPEC, "label", "fold")
    try:
        blocks = kept.blocks.collect()
    finally:
        kept.close()
    assert all(len(b["codes"]) == 4 for b in blocks)  # a combination per level, not a row
    w = np.arange(12.0).reshape(6, 2) / 10
    for b in blocks:
        assert np.allclose(L.margins(b, w, 4), w[b["codes"][b["row"], 0]] + b["x"] @ w[4:5] + w[5])


def test_generated_trips_make_each_draw_once(spark):
    keys = spark.range(5).select(F.col("id").cast("string").alias("trip_key"))
    plan = B.generate_mock_trips(keys, "trip_key")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 12  # six uniform draws and three normal ones of two each


def test_spread_bounds_rows_of_a_partition(spark, monkeypatch):
    monkeypatch.setattr(J, "PARTITION_ROWS", 100)
    d = spark.range(2000).withColumn("k", F.col("id").cast("string"))
    assert J.spread(d, 2000, "k").rdd.getNumPartitions() == 20 and J.spread(d, 700, "k") is d
    got = J.dense_index(d, ["k"], "i").agg(F.min("i"), F.max("i"), F.countDistinct("i")).first()
    assert tuple(got) == (0, 1999, 2000)


@pytest.mark.parametrize("most", [70, 400_000])
def test_many_rows_that_lie_evenly_are_cut_where_they_are(spark, rows, monkeypatch, most):
    d = rows.select("trip_key", "label", "a", "x").repartition(40).persist()
    enc = E.fit_encoder(d, SPEC)
    encoded = enc.transform(d)
    monkeypatch.setattr(T, "BLOCK_ROWS", 1)
    monkeypatch.setattr(T, "BLOCK_ROWS_MOST", most)
    monkeypatch.setattr(spark.sparkContext.__class__, "defaultParallelism", 4)
    moved = []
    monkeypatch.setattr(encoded.__class__, "repartition", lambda self, *a, real=encoded.__class__.repartition: moved.append(a) or real(self, *a))
    blocks = T.Blocks(encoded, T.layout_of(encoded, enc, SPEC), "label", None, None, "trip_key")
    try:
        found = blocks.blocks.map(lambda b: (b["name"], len(b["y"]), b["key"].tolist())).collect()
    finally:
        blocks.close()
        d.unpersist()
    keys = [k for _, _, some in found for k in some]
    assert len(keys) == len(set(keys)) == d.count() == blocks.rows and len({name for name, _, _ in found}) == len(found) == blocks.parts
    assert max(n for _, n, _ in found) <= most and bool(moved) == (most > 70)
