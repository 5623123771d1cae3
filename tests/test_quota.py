"""Quota selection without moving rows, and the distributed dictionary."""

from pyspark.sql import functions as F

from punctual.functions.hashing import uniform
from punctual.operators import encode as E
from punctual.operators import split as S
from punctual.operators.ranking import smallest_of_group


def test_quota_rows_equal_plain_ranking(spark):
    rows = [(f"k{i}", i % 7 % 3, (i * 7919 % 1000) / 1000) for i in range(2000)]
    df = spark.createDataFrame(rows, "key string, label int, u double")
    want = {0: 13, 1: 250, 2: 0}
    quotas = spark.createDataFrame(list(want.items()), "label int, _quota long")
    got = {r.label: (r._u_last, r._tie_last) for r in smallest_of_group(df, "label", "u", "key", quotas, 16).collect()}
    for label, quota in want.items():
        ranked = sorted((u, k) for k, c, u in rows if c == label)
        assert got.get(label) == (ranked[quota - 1] if quota else None)


def test_stratified_split_shuffles_no_row(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("trip_key"), (F.col("id") % 3).cast("int").alias("label"),
                                  F.lit("carried").alias("carried"))
    out = S.stratified_split(df, test_size=0.25)
    plan = out._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line and "carried" in line]
    assert not moved and out.where("split = 'test'").count() == 250
    assert S.stratified_split(df.limit(0)).count() == 0


def test_time_split_moves_no_row_and_equals_plain_order(spark):
    rows = [(f"k{i}", f"2024-01-{1 + i * i % 3:02d}" if i % 50 else None, "carried") for i in range(900)]
    df = spark.createDataFrame(rows, "trip_key string, date string, carried string")
    order = {r.trip_key: r.u for r in df.select("trip_key", uniform(F.col("trip_key"), "time42").alias("u")).collect()}
    ranked = [k for _, _, k in sorted((d, order[k], k) for k, d, _ in rows if d)]
    for size in (0.0, 0.1, 0.5, 0.97, 1.0):
        out = S.time_split(df, test_size=size)
        got = {r.trip_key for r in out.where("split = 'train'").collect()}
        assert got == set(ranked[:int((1 - size) * len(ranked))]) and out.count() == len(ranked)
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert S.time_split(df.limit(0)).count() == 0


def test_dictionary_equals_sorted_levels(spark):
    df = spark.range(3000).select(F.concat(F.lit("é"), F.col("id") % 997).alias("a"), F.when(F.col("id") % 2 == 0, F.lit("x")).alias("b"))
    got = {(r.column_name, r.level): r.slot for r in E.dictionary(df, ["a", "b"]).collect()}
    levels = sorted({f"é{i % 997}" for i in range(3000)}, key=str.encode)
    assert got == {("a", v): i for i, v in enumerate(levels)} | {("b", "x"): 0}
