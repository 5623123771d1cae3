"""Binned trees against plain recursion, and candidates read off larger ensembles against separate fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from punctual.operators import encode as E
from punctual.operators import models as M
from punctual.operators import trees as T
from punctual.plans import experiments as EX
from punctual.sources.fixture import trips


def brute(codes, g, h, n, layout, rule, depth=0):
    """(slot or None, value, yes, no) by trying every test at every node."""
    total = np.array([g.sum(), h.sum(), (n > 0).sum()])
    value = float(rule.value(total[None, :])[0])
    feature = layout.features()
    best = None
    if rule.may_split(total[None, :], depth)[0]:
        for slot in np.flatnonzero(feature >= 0):
            column = int(np.searchsorted(layout.offsets, slot, "right")) - 1
            met = codes[:, column] == slot if column < len(layout.sizes) else codes[:, column] <= slot
            sides = [np.array([g[m].sum(), h[m].sum(), (n[m] > 0).sum()]) for m in (met, ~met)]
            if min(s[2] for s in sides) > 0 and min(s[1] for s in sides) >= rule.min_child:
                gain = sum(s[0] ** 2 / (s[1] + rule.l2) for s in sides) - total[0] ** 2 / (total[1] + rule.l2)
                if best is None or round(gain, 9) > round(best[0], 9):
                    best = gain, slot, met
    if best is None or best[0] <= (1e-6 if rule.kind == "newton" else -1e-9):
        return None, value, None, None
    met = best[2]
    return (int(best[1]), value, *(brute(codes[m], g[m], h[m], n[m], layout, rule, depth + 1) for m in (met, ~met)))


def nested(tree, node=0):
    if tree["column"][node] < 0:
        return None, tree["value"][node], None, None
    return int(tree["slot"][node]), tree["value"][node], nested(tree, tree["yes"][node]), nested(tree, tree["no"][node])


def same(a, b):
    if a[0] != b[0] or abs(a[1] - b[1]) > 1e-5:
        return False
    return a[0] is None or same(a[2], b[2]) and same(a[3], b[3])


def size(t):
    return 1 if t[0] is None else 1 + size(t[2]) + size(t[3])


SPEC = E.EncodingSpec(["traffic_condition", "weather"], ["stop_distance_km", "time_of_day"])


@pytest.fixture(scope="module")
def rows(spark, sf):
    d, _ = EX.engine_features(trips(spark, sf))
    d = d.where("crc32(trip_key) % 4 = 0").select("trip_key", "label", *SPEC.categorical, *SPEC.numeric, (F.crc32("trip_key") % 5).cast("int").alias("fold"))
    enc = E.fit_encoder(d, SPEC)
    encoded = enc.transform(d.withColumn("weight", F.when(F.col("label") == 1, 0.75).otherwise(1.0))).persist()
    yield d, enc, encoded
    encoded.unpersist()


def plain(encoded, layout):
    p = encoded.toPandas()
    codes = layout.codes([p[f"{c}__idx"].to_numpy(float) for c in layout.categorical] + [p[f"{c}_scaled"].to_numpy(float) for c in layout.numeric])
    return codes, p["label"].to_numpy(float), p["weight"].to_numpy(float)


def test_second_order_leaves_equal_plain_recursion(rows, monkeypatch):
    _, enc, encoded = rows
    monkeypatch.setattr(T, "BLOCK_ROWS", 300)
    monkeypatch.setattr(T, "CELLS_PER_JOB", 400)
    model = T.fit(encoded, enc, SPEC, "Boosted Trees", {"n_estimators": 3, "max_depth": 4, "subsample": 1.0, "colsample": 1.0, "max_bins": 20},
                  weight="weight", key="trip_key")
    codes, y, w = plain(encoded, model.layout)
    rule = T.Rule("newton", 4, l2=1.0, min_child=1.0, rate=0.05)
    margin = np.zeros(len(y))
    for t in model.trees:
        p = 1 / (1 + np.exp(-margin))
        g, h = np.rint((p - y) * w / T.STEP) * T.STEP, np.rint(p * (1 - p) * w / T.STEP) * T.STEP
        want = brute(codes, g, h, np.ones(len(y)), model.layout, rule)
        assert same(nested(t), want) and size(want) > 10
        leaf = T.route(t, codes, 2)
        for node in np.unique(leaf):
            rows_ = leaf == node
            assert abs(t["value"][node] + 0.05 * g[rows_].sum() / (h[rows_].sum() + 1.0)) < 1e-9  # -rate * G / (H + L2)
        margin += t["value"][leaf]
    assert np.allclose(T.run_packed(T.packed(model), codes), margin)


@pytest.mark.parametrize("local", [10, 10**6])
def test_unbounded_tree_equals_plain_recursion(rows, monkeypatch, local):
    _, enc, encoded = rows
    monkeypatch.setattr(T, "LOCAL_ROWS", local)
    monkeypatch.setattr(T, "BLOCK_ROWS", 300)
    for split in (2, 40):
        model = T.fit(encoded, enc, SPEC, "Decision Tree Classifier", {"max_depth": None, "min_samples_split": split, "max_bins": 50})
        codes, y, _ = plain(encoded, model.layout)
        want = brute(codes, y, np.ones(len(y)), np.ones(len(y)), model.layout, T.Rule("gini", None, split))
        assert same(nested(model.trees[0]), want) and size(want) == len(model.trees[0]["column"])
        inner = model.trees[0]["column"] >= 0
        assert (model.trees[0]["rows"][inner] >= split).all()


@pytest.mark.parametrize("kind, grid", [
    ("Decision Tree Classifier", {"max_depth": [3, 6, None]}),
    ("Random Forest Classifier", {"n_estimators": [3, 6], "max_depth": [4, None], "min_samples_split": [2, 30]}),
    ("Gradient Boosting Classifier", {"n_estimators": [3, 5], "learning_rate": [0.1, 0.5], "max_depth": [2, 3]})])
def test_candidates_read_off_one_fit_equal_separate_fits(rows, kind, grid):
    _, enc, encoded = rows
    candidates = M.grid(kind, grid)
    together = T.search(encoded, enc, SPEC, kind, candidates, [0, 1, 2, 3, 4], "fold", "label", "trip_key")
    alone = [T.search(encoded, enc, SPEC, kind, [c], [0, 1, 2, 3, 4], "fold", "label", "trip_key")[0] for c in candidates]
    assert together == alone and len(set(together)) > 1


def test_trees_do_not_depend_on_blocks(rows, monkeypatch):
    _, enc, encoded = rows
    fits = []
    for block in (100, 10**6):
        monkeypatch.setattr(T, "BLOCK_ROWS", block)
        fits.append(T.fit(encoded, enc, SPEC, "Boosted Trees", {"n_estimators": 20, "max_depth": 4}, key="trip_key"))
    for a, b in zip(fits[0].trees, fits[1].trees):
        assert all((a[k] == b[k]).all() for k in ("column", "slot", "yes", "no", "value", "rows"))


def test_samples_of_rows_and_features(rows):
    _, enc, encoded = rows
    model = T.fit(encoded, enc, SPEC, "Boosted Trees", {"n_estimators": 30, "max_depth": 3, "subsample": 0.5, "colsample": 0.4}, key="trip_key")
    share = np.array([t["rows"][0] for t in model.trees]) / encoded.count()
    assert abs(share.mean() - 0.5) < 0.03 and len(set(share)) > 10
    feature = model.layout.features()
    used = [set(feature[t["slot"][t["column"] >= 0]]) for t in model.trees]
    assert all(len(u) <= int(0.4 * len(set(feature) - {-1})) for u in used) and len(set().union(*used)) > 4


def test_unknown_levels_and_missing_values_take_the_no_side(spark, rows):
    d, _, _ = rows
    model = M.train(d, SPEC, "Decision Tree Classifier", {"max_depth": 4})
    odd = d.limit(3).withColumn("weather", F.lit("never seen"))
    assert M.score(model, odd, keep=["trip_key"]).count() == 3
    layout = model.classifier.layout
    codes = layout.codes([np.array([np.nan, 99.0]), np.array([0.0, 0.0]), np.array([np.nan, 1e9]), np.array([np.nan, -1e9])])
    assert (codes[:, 0] == layout.offsets[1] - 1).all() and codes[0, 2] == layout.offsets[3] - 1


def test_saved_ensemble_scores_alike(spark, rows, tmp_path):
    d, _, _ = rows
    for kind, params in (("Random Forest Classifier", {"n_estimators": 4}), ("Gradient Boosting Classifier", {"n_estimators": 4})):
        model = M.train(d, SPEC, kind, params)
        path = str(tmp_path / kind.replace(" ", "-"))
        M.save_model(model, path)
        back = M.load_model(path, SPEC)
        a = M.score(model, d, keep=["trip_key"]).collect()
        assert {r.trip_key: r.score for r in a} == {r.trip_key: r.score for r in M.score(back, d, keep=["trip_key"]).collect()}
        assert back.kind == kind and back.names == model.names


def test_larger_children_are_told_by_their_siblings(rows, monkeypatch):
    _, enc, encoded = rows
    blocks = T.Blocks(encoded, T.layout_of(encoded, enc, SPEC), "label", "weight", None, "trip_key")
    added, asked, chosen = T._level, [], []

    def level(blocks, job, trees, given, depth, width, parents, sums_of):
        told = T._told_by_siblings(job, trees, parents)
        alone = added(blocks, job, trees, given, depth, width, {}, {})
        out = added(blocks, job, trees, given, depth, width, parents, sums_of)
        asked.append((sum(len(n) for _, n in job), len(told)))
        chosen.extend(zip(alone, out))
        return out

    monkeypatch.setattr(T, "_level", level)
    try:
        T.grow(blocks, [T.Plan(T.Rule("newton", 5, l2=1.0, min_child=1.0, rate=0.05, subsample=0.8), 2)])
    finally:
        blocks.close()
    assert sum(told for _, told in asked) > 10 and all(2 * told <= nodes for nodes, told in asked)
    for (totals, splits), (totals_, splits_) in chosen:
        assert (totals == totals_).all() and all((a == b).all() for a, b in zip(splits, splits_))


def test_workers_read_what_another_noted(rows, monkeypatch, tmp_path):
    monkeypatch.setenv("SPARK_LOCAL_DIRS", str(tmp_path))
    rng = np.random.default_rng(1)
    layout = T.Layout([], [], ["a", "b"], [[0.0, 1.0], [0.5]])
    block = {"codes": layout.codes([rng.normal(size=500), rng.normal(size=500)]), "y": (rng.random(500) < 0.4).astype(float), "w": np.ones(500),
             "fold": np.zeros(500, int), "key": np.arange(500, dtype=np.uint64), "margin": {}, "name": "run-0"}
    rule = T.Rule("newton", 2, l2=1.0, subsample=0.8)
    tree = T.Tree()
    calls = []
    plain = T._stats
    monkeypatch.setattr(T, "_stats", lambda *a: calls.append(1) or plain(*a))
    for filed in (True, False):
        plan = {"id": 0, "rule": rule, "base": 0.0, "fold": T.NONE, "seed": 7, "done": [], "renewed": 0, "filed": filed}
        got = [T._state(block, plan, tree.arrays(), 0) for _ in range(3)]
        assert all((s == plain(rule, block, plan, np.zeros(500))).all() and (at == 0).all() for s, at in got)
        assert len(calls) == (1 if filed else 4)  # without a file and with many ensembles: each time
    assert len(list(tmp_path.iterdir())) == 2
    T._forget(block)
    assert not list(tmp_path.iterdir())


def test_two_sums_in_one_are_exact():
    rng = np.random.default_rng(2)
    layout = T.Layout([], [], ["a"], [[0.0, 1.0]])
    codes, node = layout.codes([rng.normal(size=3000)]), rng.integers(0, 3, 3000)
    for h in (rng.integers(0, 2**20, 3000) * T.STEP, rng.integers(0, 5, 3000).astype(float), rng.random(3000), -rng.random(3000), np.full(3000, 2.0**40)):
        count = (rng.random(3000) < 0.8).astype(float)
        stats = np.stack([rng.normal(size=3000), h * count, count], 1)
        index, sums = T.cells(codes, node, stats, 3, layout)
        for i, s in zip(index, sums):
            mine = (node == i // 4) & (codes[:, 0] == i % 4)
            assert s[2] == count[mine].sum() and np.isclose(s[0], stats[mine, 0].sum()) and np.isclose(s[1], stats[mine, 1].sum(), rtol=1e-12, atol=0)


def test_columns_are_counted_together(monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 700)
    rng = np.random.default_rng(4)
    layout = T.Layout(["a", "b", "c"], [3, 40, 5], ["x", "y"], [list(np.arange(200) + 0.5), [0.0, 1.0]])
    codes = layout.codes([rng.integers(-1, 6, 4000).astype(float), rng.integers(0, 40, 4000).astype(float), rng.integers(0, 5, 4000).astype(float),
                          rng.integers(0, 201, 4000).astype(float), np.where(rng.random(4000) < 0.1, np.nan, rng.normal(size=4000))]).astype(np.uint16)
    assert sorted(j for g in T.together(layout.widths) for j in g) == list(range(5)) and len(T.together(layout.widths)) < 4
    node, rows = rng.integers(0, 3, 4000), np.flatnonzero(rng.random(4000) < 0.7)
    use = rng.integers(0, 3, 4000).astype(float)
    exact = [rng.integers(-2**20, 2**20, 4000) * T.STEP * use, rng.integers(0, 2**20, 4000) * T.STEP * use]
    for stats in ([*exact, use], [exact[0], use, use, exact[1]], [use * (node > 0), use, (use > 0).astype(float)]):
        stats = np.stack(stats, 1)
        for quantum in (None, T.STEP):
            got = T.joint_cells(T.joint_codes(codes, layout), node, stats, 3, layout, rows, quantum)
            assert all(np.array_equal(a, b) for a, b in zip(got, T.cells(codes, node, stats, 3, layout, rows)))


def test_lost_files_are_written_again(rows, monkeypatch):
    _, enc, encoded = rows
    layout = T.layout_of(encoded, enc, SPEC)
    rule = T.Rule("newton", 3, l2=1.0, subsample=0.8)

    def grown(lose: bool, filed: int) -> list[dict]:
        monkeypatch.setattr(T, "FILED", filed)
        blocks, plan, known = T.Blocks(encoded, layout, "label", None, None, None), T.Plan(rule, 5), T.Blocks.of_level
        calls, kept = [], []
        monkeypatch.setattr(T.Blocks, "keep", lambda self, plans, f=T.Blocks.keep: kept.append(1) or f(self, plans))

        def of_level(self, sent):
            calls.append(1)
            if lose and len(calls) in (2, 8):
                self.kept.foreach(lambda name: T._forget({"name": name}))
            return known(self, sent)

        with monkeypatch.context() as m:
            m.setattr(T.Blocks, "of_level", of_level)
            T.grow(blocks, [plan])
        blocks.close()
        assert len(kept) == (0 if not filed else 3 if lose else 1) and bool(calls) == bool(filed)
        monkeypatch.undo()
        return [t.arrays() for t in plan.trees]

    plain = grown(False, 0)
    for got in (grown(False, 1 << 30), grown(True, 1 << 30)):
        assert all(np.array_equal(a[k], b[k]) for a, b in zip(plain, got) for k in a)


@pytest.mark.parametrize("kind, candidates", [("Decision Tree Classifier", [{"max_depth": 3}, {"max_depth": None}]),
                                              ("Random Forest Classifier", [{"n_estimators": 3, "max_depth": d, "min_samples_split": 5} for d in (4, None)])])
def test_folds_one_after_another_find_the_same(rows, monkeypatch, kind, candidates):
    _, enc, encoded = rows
    monkeypatch.setattr(T, "LOCAL_ROWS", 200)
    at_once = T.search(encoded, enc, SPEC, kind, candidates, [0, 1, 2], key="trip_key")
    groups, grow = [], T.grow
    monkeypatch.setattr(T, "grow", lambda blocks, plans, together, finish: groups.append((len(plans), together)) or grow(blocks, plans, together, finish))
    monkeypatch.setattr(T, "SHUFFLED", 1)
    assert T.search(encoded, enc, SPEC, kind, candidates, [0, 1, 2], key="trip_key") == at_once
    assert groups == [(1, 1)] * 3
