"""Boundary cases of the scalar expressions (literal frames)."""

import math

from pyspark.sql import functions as F

from punctual.functions import cleaning as C
from punctual.functions import features as X
from punctual.functions import labels as L


def col_values(spark, values, expr, dtype="double"):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_late_label_is_strict(spark):
    assert col_values(spark, [5.0, 5.0001, 4.9, None, float("nan"), -3.0], L.late_from_delay) == [0, 1, 0, 0, 0, 0]


def test_rush_hour_numeric_closed_windows(spark):
    hours = [6.99, 7.0, 9.0, 9.01, 16.99, 17.0, 19.0, 19.01, None, float("nan")]
    assert col_values(spark, hours, X.rush_hour_numeric) == [0, 1, 1, 0, 0, 1, 1, 0, 0, 0]


def test_rush_minutes(spark):
    mins = [419, 420, 570, 571, 989, 990, 1140, 1141, None]
    assert col_values(spark, mins, X.rush_hour_minutes, "int") == [0, 1, 1, 0, 0, 1, 1, 0, 0]


def test_time_bucket_edges(spark):
    assert col_values(spark, [4, 5, 11, 12, 16, 17, 20, 21, 0], X.time_bucket_from_hour, "int") == [
        "Night", "Morning", "Morning", "Afternoon", "Afternoon", "Evening", "Evening", "Night", "Night"]


def test_weekend_variants(spark):
    days = ["Saturday", "sunday", "Sat", "Monday", None]
    assert col_values(spark, days, X.weekend_exact, "string") == [1, 0, 0, 0, 0]
    assert col_values(spark, days, X.weekend_casefold, "string") == [1, 1, 1, 0, 0]


def test_clean_category_tokens(spark):
    vals = [None, "", " nan ", "NaN", "None", "\tDusty ", "Clear"]
    assert col_values(spark, vals, lambda c: C.clean_category(c, "Unknown"), "string") == [
        "Unknown", "Unknown", "Unknown", "Unknown", "Unknown", "Dusty", "Clear"]


def test_safe_numeric(spark):
    vals = ["5d", "abc", "", " 31.5 ", "1e3", "-2", "NaN", None, ".5"]
    out = col_values(spark, vals, C.safe_numeric, "string")
    assert out == [None, None, None, 31.5, 1000.0, -2.0, None, None, 0.5]


def test_time_to_minutes(spark):
    vals = ["07:30", "7:05:59", "7", None, "ab:cd", " 16:30 "]
    assert col_values(spark, vals, X.time_to_minutes, "string") == [450, 425, None, None, None, 990]


def test_direction_from_route(spark):
    vals = ["RAK To Dubai", "Dubai to RAK", "Campus Loop", " rak  to x", None]
    assert col_values(spark, vals, X.direction_from_route, "string") == ["From", "To", "Unknown", "From", "Unknown"]


def test_clamp_keeps_missing(spark):
    out = col_values(spark, [None, float("nan"), 0.1, 20.0, 3.0], lambda c: X.clamp(c, 0.5, 15.0))
    assert out[0] is None and math.isnan(out[1]) and out[2:] == [0.5, 15.0, 3.0]


def test_group_key_keeps_nulls(spark):
    df = spark.createDataFrame([("A", None, 3)], "a string, b string, c int")
    assert df.select(X.group_key(["a", "b", "c"])).first()[0] == "A|nan|3"


def test_timetable_text(spark):
    assert col_values(spark, ["5.30"], X.normalise_time_text, "string") == ["5:30"]
    assert col_values(spark, [" (Dubai Mall) "], X.clean_destination, "string") == ["Dubai Mall"]
    assert col_values(spark, ["12", "1a", "", None], X.digits_to_int, "string") == [12, None, None, None]


def test_csv_reader_missing_tokens(spark, tmp_path):
    from pyspark.sql import types as T

    from punctual.sources.files import read_csv
    path = tmp_path / "t.csv"
    path.write_text("a,b,c,d\nNA,1.5,3,2024-01-02\nn/a,5d,x,bad\nnull,#N/A,,\nDusty, 2.5 , 7 ,2024-02-30\n")
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.DoubleType()),
                           T.StructField("c", T.IntegerType()), T.StructField("d", T.DateType())])
    rows = [tuple(r) for r in read_csv(spark, str(path), schema).collect()]
    import datetime as dt
    assert rows == [(None, 1.5, 3, dt.date(2024, 1, 2)), (None, None, None, None), (None, None, None, None),
                    ("Dusty", 2.5, 7, None)]
