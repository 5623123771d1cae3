"""Distributed helpers against brute force on small frames."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from punctual.operators.joins import dense_index_with_count
from punctual.operators.ranking import exact_medians, prefix_sums, uniform_rank


def _frame(spark, n=3000, seed=3):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"k": np.arange(n), "g": rng.integers(0, 3, n),
                        "x": np.round(rng.normal(size=n), 2), "v": rng.integers(0, 5, n)})
    return spark.createDataFrame(pdf), pdf


def test_prefix_sums_match_cumsum_with_partitions(spark):
    df, pdf = _frame(spark)
    out = prefix_sums(df, [("x", True), ("k", False)], ["v"], n_buckets=16, partition_cols=["g"]).toPandas()
    exp = pdf.sort_values(["g", "x", "k"], ascending=[True, False, True])
    exp["v_cum"] = exp.groupby("g")["v"].cumsum()
    m = out.merge(exp[["k", "v_cum"]], on="k", suffixes=("", "_exp"))
    assert len(m) == len(pdf) and (m["v_cum"] == m["v_cum_exp"]).all()


def test_uniform_rank_is_exact(spark):
    df, pdf = _frame(spark)
    df = df.withColumn("u", F.rand(7))
    out = uniform_rank(df, ["g"], "u", ["k"], "rank", n_buckets=32).toPandas()
    exp = out.sort_values(["g", "u", "k"]).groupby("g").cumcount()
    assert (out.loc[exp.index, "rank"].to_numpy() == exp.to_numpy()).all()


def test_dense_index_is_a_permutation(spark):
    df, pdf = _frame(spark)
    out, n = dense_index_with_count(df, ["k"], "idx", n_buckets=64)
    idx = sorted(r[0] for r in out.select("idx").collect())
    assert n == len(pdf) and idx == list(range(len(pdf)))


def test_exact_medians(spark):
    df, pdf = _frame(spark, n=1001)
    df2 = df.withColumn("y", F.when(F.col("k") % 7 == 0, F.lit(None)).otherwise(F.col("x") * 3))
    m = exact_medians(df2.limit(1000), ["x", "y"])
    p = pdf.iloc[:1000]
    y = (p["x"] * 3).where(p["k"] % 7 != 0)
    assert abs(m["x"] - p["x"].median()) < 1e-12 and abs(m["y"] - y.median()) < 1e-12
