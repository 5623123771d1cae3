"""Queries for sources and sinks (IO1, IO2, IO5, IO6, IO9)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from punctual.functions import cleaning as C
from punctual.operators import curves as W
from punctual.operators import models as M
from punctual.operators import prep
from punctual.plans import q_metrics
from punctual.plans.registry import SCORED, register, with_trips
from punctual.session import shared_path
from punctual.sources import files
from punctual.sources.fixture import TRIP_COLUMNS, scored_trips, trips
from punctual.sources.tables import read_table
from punctual.sources.timetable_pages import extract_timetable, timetable_pages

R6 = 6


def _scratch(spark, name: str) -> str:
    return shared_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


@register("csv_roundtrip", ["IO1", "IO2", "P3"], with_trips(
    "SELECT " + ", ".join("strftime(date, '%Y-%m-%d') AS date" if c == "date" else c for c in TRIP_COLUMNS)
    + " FROM trips"))
def csv_roundtrip(spark, sf):
    """Trips written as header CSV and read back with the typed, token-aware reader."""
    path = _scratch(spark, "trips-csv")
    files.write_csv(trips(spark, sf), path)
    back = files.read_csv(spark, path)
    return back.withColumn("date", C.iso_date("date"))


_METRICS = ["accuracy", "balanced_accuracy", "macro_f1", "f1_late", "roc_auc", "average_precision", "late_rate"]


@register("metrics_json_sink", ["IO6", "V5"], with_trips(
    q_metrics.S_SUMMARY + f"""
, long AS (UNPIVOT (SELECT model, {', '.join(_METRICS)} FROM summary) ON {', '.join(_METRICS)}
           INTO NAME metric VALUE value)
SELECT model, metric, round(value, {R6}) AS value FROM long"""))
def metrics_json_sink(spark, sf):
    """Per-model metrics written as JSON lines (model, metric, value) and read back."""
    summary = W.model_summary(q_metrics.models_scored(spark, sf))
    path = _scratch(spark, "metrics-json")
    files.write_metrics_json(files.metrics_long(summary, ["model"], _METRICS), path)
    return files.read_metrics_json(spark, path).withColumn("value", F.round("value", R6))


@register("prediction_log", ["IO9", "M15", "P12"], with_trips("""
SELECT CASE WHEN prediction = 1 THEN 'Late' ELSE 'On-Time' END AS predicted_status, count(*) AS n_logged
FROM scored GROUP BY 1""", scored=SCORED))
def prediction_log(spark, sf):
    """Scored rows appended to a prediction log with a timestamp, then counted by status."""
    path = _scratch(spark, "prediction-log")
    M.log_predictions(scored_trips(trips(spark, sf)), path)
    log = spark.read.parquet(path)
    return log.where(F.col("logged_at").isNotNull()).groupBy("predicted_status") \
        .agg(F.count(F.lit(1)).alias("n_logged"))


@register("timetable_from_rendered_pages", ["IO5", "X10", "X11", "X12", "X13", "A3", "K1"], with_trips("""
, tt AS (SELECT DISTINCT route, direction, trip_no, departure_time, destination FROM trips)
SELECT CASE WHEN direction = 'From' THEN 'RAK to ' || route ELSE route || ' to RAK' END AS route,
  CASE WHEN direction = 'From' THEN 'From' ELSE 'To' END AS direction, trip_no, departure_time, destination
FROM tt ORDER BY route, trip_no"""))
def timetable_from_rendered_pages(spark, sf):
    """Pages rendered from the trips' timetable (tables and text lines), parsed back."""
    tt = trips(spark, sf).select("route", "direction", "trip_no", "departure_time", "destination").distinct()
    pages = timetable_pages(tt)
    return extract_timetable(pages).orderBy("route", "trip_no")


@register("timetable_from_marked_up_pages", ["IO5", "X10", "X11", "X12", "X13"], with_trips("""
SELECT DISTINCT destination || ' to RAK' AS route, 'To' AS direction, trip_no, departure_time, route AS destination FROM trips"""))
def timetable_from_marked_up_pages(spark, sf):
    """One page per destination whose trips stand in lines full of inline tags, with script, comments and open tags around."""
    t = trips(spark, sf).select("route", "trip_no", "departure_time", "destination").distinct()
    tag = lambda name, c: F.concat(F.lit(f"<{name} class='x'>"), c, F.lit(f"</{name}>"))
    line = F.concat(F.lit("<div><br>"), tag("b", F.col("trip_no").cast("string")), F.lit(" <!-- <p>9 9.99 No</p> -->"),
                    tag("i", F.replace("departure_time", F.lit(":"), F.lit("."))), F.lit(" <em><u>"), tag("span", F.col("route")), F.lit("</u></em></div>"))
    body = t.groupBy("destination").agg(F.array_join(F.sort_array(F.collect_list(line)), "").alias("body"))
    html = F.concat(F.lit("<html><head><title>t</title></head><body><script>if (a<b) '<p>8 8:88 No</p>'</script><h2>"), "destination",
                    F.lit(" to RAK</h2><h4><a href='#'>Trip</a> Details</h4>"), "body", F.lit("<h6>Contact<table><tr><td>7<td>7:77<td>No"))
    pages = body.select(F.xxhash64("destination").alias("page_id"), F.lit("local:").alias("url"), html.alias("html"))
    return extract_timetable(pages)


@register("timetable_from_pages", ["IO5"])
def timetable_from_pages(spark, sf):
    """Timetable sections found in the crawled pages table (none expected)."""
    return extract_timetable(read_table(spark, sf, "pages", ["page_id", "html"])).orderBy("route", "trip_no")


@register("required_columns_check", ["IO3", "P1"], with_trips("""
SELECT route, stop_distance_km, day_of_week, time_of_day, traffic_condition, weather, special_event,
  temperature_celsius, CASE WHEN delay_minutes > 5 THEN 'Late' ELSE 'On-Time' END AS arrival_status
FROM trips WHERE delay_minutes IS NOT NULL"""))
def required_columns_check(spark, sf):
    """CLI input check passes on labelled trips; projection of the required columns."""
    d = prep.label_trips(trips(spark, sf), keep_status=True)
    return prep.project(prep.require_columns(d, prep.CLI_REQUIRED), prep.CLI_REQUIRED)
