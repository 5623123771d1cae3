"""Operators 1, 5, 7 and the pipeline against brute force."""

import math
import random

import corpus_pipeline
import numpy as np

from punctual.llm import op1_projected_neighbours, op5_near_duplicates, op7_pivot_search, setsketch

R = random.Random(5)


def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist(), 1) for i in range(900)]
    rows += [(900 + i, rows[100][1], 1) for i in range(60)]  # ties
    rows += [(2000, None, 1), (2050, [], 1), (2100, [float("nan")] * 8, 1), (2150, [None] * 8, 1), (2200, [1.0] * 3, 1),
             (2300, [0.0] * 8, 1), (None, [1.0] * 8, 1), (300, rows[300][1], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int"), rows


def test_neighbours(spark):
    df, rows = vectors(spark)
    good = [(i, v) for i, v, _ in rows if i is not None and v and len(v) == 8 and None not in v and all(map(math.isfinite, v)) and any(v)]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good], np.float32).astype(float)
    got = {}
    found = op1_projected_neighbours.nearest(df, df.filter("vec_id % 100 = 0"), block_rows=100)
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    hits = total = 0
    for q in [i for i in sorted(set(ids.tolist())) if i % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        want = [(float(d[k]), int(ids[k])) for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        mine = sorted(got[q])[:10]
        assert [r for r, *_ in mine] == list(range(1, 11)) and mine == sorted(mine, key=lambda r: (r[1], r[2]))
        hits += len({i for _, i in want} & {i for *_, i in mine})
        total += 10
    assert hits / total >= 0.9 and 2300 not in got and len(got) == total / 10
    assert op1_projected_neighbours.nearest(df.limit(0), df.limit(0)).count() == 0
    assert op1_projected_neighbours.nearest(df.filter("vec_id in (0, 1, 2)"), df.filter("vec_id = 0")).count() == 2


def test_copies_are_found_despite_rounding(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 48)).astype(np.float32)
    x[:80] = x[0]
    projected = x.astype(float) @ rng.normal(size=(48, 8))
    for nudged in (np.nextafter(projected[0], np.inf), np.nextafter(projected[0], -np.inf)):  # last bits
        tree = op1_projected_neighbours.Tree(projected)
        near, who = tree.search(x.astype(float), np.arange(240), x[0].astype(float), 0, nudged, 0.0, 10, 13.0)
        assert near.tolist() == [0.0] * 10 and who.tolist() == list(range(1, 11))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    for q in (0, 40):
        got = op1_projected_neighbours.nearest(df, df.filter(f"vec_id = {q}"), block_rows=40).orderBy("rank").collect()
        assert [(r.vec_id, r.score) for r in got] == [(i, 0.0) for i in range(11) if i != q][:10]


def test_top_products(spark):
    df, rows = vectors(spark)
    good = [(i, v) for i, v, _ in rows if i is not None and v and len(v) == 8 and None not in v and all(map(math.isfinite, v))]
    ids, x = np.array([i for i, _ in good]), np.floor(256 * np.array([v for _, v in good], np.float32).astype(float)).astype(int)
    want = []
    for k, q in enumerate(ids):
        if q % 50 == 0:
            s = x @ x[k]
            top = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:5]
            want += [(int(q), r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(top)]
    got = op7_pivot_search.top_k(df, df.filter("vec_id % 50 = 0").dropDuplicates(["vec_id"]), block_rows=100)
    assert sorted(map(tuple, got.collect())) == sorted(set(want))
    assert op7_pivot_search.top_k(df.limit(0), df.limit(0)).count() == 0


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(0)
    draw = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = draw[:2000], draw[400:2600]
    owner = np.repeat([0, 1, 2], [len(a), len(b), len(draw[:2600])])
    s = setsketch.sketches(np.concatenate([a, b, draw[:2600]]), owner, 3, m=4096)
    assert (setsketch.merge(s[0], s[1]) == s[2]).all()
    j = setsketch.similarity(s[:1], s[1:2], np.array([2000]), np.array([2200]))[0]
    assert abs(j - 1600 / 2600) < 0.04


def brute_components(texts, percent=85):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i:i + 5]) for i in range(len(w) - 4)]))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(sets)):
        for k in range(i):
            if sets[i] and sets[k] and 100 * len(sets[i] & sets[k]) >= percent * len(sets[i] | sets[k]):
                a, b = root(i), root(k)
                parent[max(a, b)] = min(a, b)
    return sets, [root(i) for i in range(len(sets))]


def near_copies():
    words = [f"w{i}" for i in range(500)]
    base = [R.choice(words) for _ in range(120)]
    texts = []
    for _ in range(60):  # scattered around one text, not all linked with it
        t = list(base)
        for _ in range(R.randint(0, 3)):
            t[R.randrange(len(t))] = R.choice(words)
        texts.append(" ".join(t))
    chain = list(base)
    for _ in range(30):  # each linked with the one before
        chain = list(chain)
        chain[R.randrange(len(chain))] = R.choice(words)
        texts.append(" ".join(chain))
    return texts + ["", None, "a b c", "A  b\nc", "one", " ", "x " * 3000] * 2


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(op5_near_duplicates, "BLOCK", 16)
    texts = near_copies()
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in enumerate(texts)], "doc_id long, text string, cls int, root int")
    got = op5_near_duplicates.near_duplicates(docs).orderBy("doc_id").collect()
    sets, roots = brute_components(texts)
    assert [(r.n_shingles, r.component_id, r.kept) for r in got] == [(len(s), c, c == i) for i, (s, c) in enumerate(zip(sets, roots))]
    assert op5_near_duplicates.near_duplicates(docs.limit(0)).count() == 0


def test_bands_miss_few_pairs_at_any_threshold(spark):
    assert op5_near_duplicates.banding(85) == (5, 25) and op5_near_duplicates.banding(80) == (4, 32)
    for percent in range(11, 100):
        width, bands = op5_near_duplicates.banding(percent)
        assert width * bands <= setsketch.REGISTERS and (1 - (percent / 100) ** width) ** bands < 1e-6
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    assert [len(set(op5_near_duplicates.sketched(docs, p).first().bands)) for p in (85, 80)] == [25, 32]


def test_null_and_repeated_ids_lose_no_document(spark):
    texts = [" ".join(f"t{k}w{i}" for i in range(40)) for k in range(12)]
    near = texts[0] + " more"  # 36 of 37 shingles
    rows = [(None, t) for t in texts[:8]] + [(None, near), (None, texts[1]), (None, None), (None, None), (None, " \n")]
    rows += [(7, t) for t in texts[8:]] + [(7, texts[8]), (7, texts[8] + " more"), (3, texts[9] + " more"), (4, None), (4, None), (4, " ")]
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, n int")
    got = op5_near_duplicates.without_near_duplicates(docs)
    assert got.columns == docs.columns
    out = [(r.doc_id, r.text) for r in got.collect()]
    assert len(out) == 12 + 3 + 2 and {t for _, t in out} >= set(texts[1:8]) | {texts[10], texts[11]}
    assert sum(t in (texts[0], near) for _, t in out) == sum(t in (texts[8], texts[8] + " more") for _, t in out) == 1
    assert (3, texts[9] + " more") in out and sorted(str(t) for d, t in out if d == 4) == [" ", "None"]
    marks = op5_near_duplicates.near_duplicates(docs).collect()
    assert len(marks) == len(rows) and {r.component_id for r in marks if r.doc_id == 3} == {3}
    of = {t: r for r in marks for t in [0] if r.doc_id == 7 and r.component_id == 3}
    assert of and not any(r.kept for r in of.values())


def test_pipeline_equals_plain_steps(spark, sf):
    """Rows of the pipeline against brute force over the same texts, stage by stage."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "near duplicates", "secret scans", "packing"]
    known = stages["language ID"](spark, docs, sf)
    assert known.columns == docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id for r in known.collect()}
    assert after == {d for d, t in rows.items() if any(c.isalpha() for c in t or "")}
    ids = sorted(after)
    _, roots = brute_components([rows[d] for d in ids], 80)
    single = stages["near duplicates"](spark, known, sf)
    kept = {ids[c] for c in set(roots)}
    assert {r.doc_id for r in single.collect()} == kept and single.columns == docs.columns
    clean = stages["secret scans"](spark, single, sf).collect()
    assert {r.doc_id for r in clean} == kept and all("token = \"" not in r.text and r.n_chars == len(r.text) for r in clean)
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == kept
