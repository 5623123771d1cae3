"""Queries for cleaning, labels and scalar features (P*, X*, flagship slice)."""

from __future__ import annotations

from pyspark.sql import functions as F

from punctual.functions import cleaning as C
from punctual.functions import features as X
from punctual.functions import labels as L
from punctual.operators import prep
from punctual.plans.registry import DIRTY, SCORED, register, with_trips
from punctual.sources.fixture import dirty_trips, scored_trips, trips

# SQL snippets of the same expressions (DuckDB dialect).
S_LABEL = "CASE WHEN delay_minutes > 5 THEN 1 ELSE 0 END"
S_RUSH = ("CASE WHEN (time_of_day >= 7 AND time_of_day <= 9) OR (time_of_day >= 17 AND time_of_day <= 19) "
          "THEN 1 ELSE 0 END")
S_WEEKEND = "CASE WHEN day_of_week IN ('Saturday', 'Sunday') THEN 1 ELSE 0 END"
S_WS = "'^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$'"


def s_strip(x: str) -> str:
    return f"regexp_replace({x}, {S_WS}, '', 'g')"


def s_clean_cat(x: str, token: str) -> str:
    s = s_strip(f"CAST({x} AS VARCHAR)")
    return f"CASE WHEN {s} IS NULL OR {s} IN ('nan', 'NaN', 'None', '') THEN '{token}' ELSE {s} END"


def s_safe_numeric(x: str) -> str:
    v = f"CAST({x} AS VARCHAR)"
    pat = C.NUMERIC_PATTERN
    return f"CASE WHEN regexp_matches({v}, '{pat}') THEN TRY_CAST({s_strip(v)} AS DOUBLE) END"


def s_minutes(x: str) -> str:
    parts = f"string_split({s_strip(f'CAST({x} AS VARCHAR)')}, ':')"
    return (f"CASE WHEN len({parts}) >= 2 THEN TRY_CAST({parts}[1] AS INTEGER) * 60 "
            f"+ TRY_CAST({parts}[2] AS INTEGER) END")


def s_bucket(hour: str) -> str:
    return (f"CASE WHEN {hour} >= 5 AND {hour} < 12 THEN 'Morning' WHEN {hour} >= 12 AND {hour} < 17 "
            f"THEN 'Afternoon' WHEN {hour} >= 17 AND {hour} < 21 THEN 'Evening' ELSE 'Night' END")


def labelled(spark, sf):
    t = prep.label_trips(trips(spark, sf))
    return t.withColumns({"is_rush_hour": X.rush_hour_numeric("time_of_day"),
                          "is_weekend": X.weekend_exact("day_of_week")})


# --- flagship slice ----------------------------------------------------------

@register("late_rate_by_traffic_rush", ["P8", "X1", "X4", "A1", "A4"], with_trips(f"""
SELECT traffic_condition, {S_RUSH} AS is_rush_hour, count(*) AS n_trips,
  round(avg({S_LABEL}), 6) AS late_rate, CAST(sum({S_WEEKEND}) AS BIGINT) AS weekend_trips
FROM trips WHERE delay_minutes IS NOT NULL GROUP BY 1, 2"""))
def late_rate_by_traffic_rush(spark, sf):
    """Late rate and trip count by traffic level and rush hour."""
    return (labelled(spark, sf).groupBy("traffic_condition", "is_rush_hour")
            .agg(F.count(F.lit(1)).alias("n_trips"), F.round(F.avg("label"), 6).alias("late_rate"),
                 F.sum("is_weekend").cast("bigint").alias("weekend_trips")))


# --- P: projections, filters, labels ------------------------------------------

@register("feature_projection", ["P1", "P3"], with_trips(
    "SELECT trip_key, " + ", ".join(prep.EXPERIMENT_FEATURES) + " FROM trips"))
def feature_projection(spark, sf):
    t = trips(spark, sf)
    return prep.project(t, ["trip_key"] + prep.pick_existing(prep.EXPERIMENT_FEATURES, t))


@register("drop_label_columns", ["P2", "X9"], with_trips("""
SELECT trip_key, strftime(date, '%Y-%m-%d') AS date, day_of_week, time_of_day, route, direction, trip_no,
  departure_time, destination, stop_distance_km, traffic_condition, weather, special_event, temperature_celsius
FROM trips WHERE delay_minutes IS NOT NULL"""))
def drop_label_columns(spark, sf):
    t = prep.drop_label_columns(prep.label_trips(trips(spark, sf), keep_status=True)).drop("label")
    return t.withColumn("date", C.iso_date("date"))


@register("drop_missing_label_date", ["P4"], with_trips(
    "SELECT trip_key, delay_minutes, strftime(date, '%Y-%m-%d') AS date FROM dirty "
    "WHERE delay_minutes IS NOT NULL AND date IS NOT NULL", dirty=DIRTY))
def drop_missing_label_date(spark, sf):
    d = prep.drop_missing(dirty_trips(trips(spark, sf)), ["delay_minutes", "date"])
    return d.select("trip_key", "delay_minutes", C.iso_date("date").alias("date"))


@register("fill_event", ["P5"], with_trips(
    "SELECT trip_key, coalesce(special_event, 'None') AS special_event FROM trips"))
def fill_event(spark, sf):
    return prep.fill_event(trips(spark, sf)).select("trip_key", "special_event")


@register("clean_categories", ["P6"], with_trips(f"""
SELECT trip_key, {s_clean_cat('weather', 'Unknown')} AS weather,
  {s_clean_cat('special_event', 'NoEvent')} AS special_event,
  {s_clean_cat('trip_no', 'Unknown')} AS trip_no, {s_clean_cat('route', 'Unknown')} AS route
FROM dirty""", dirty=DIRTY))
def clean_categories(spark, sf):
    d = prep.clean_categories(dirty_trips(trips(spark, sf)), ["weather", "special_event", "trip_no", "route"])
    return d.select("trip_key", "weather", "special_event", "trip_no", "route")


@register("coerce_numeric", ["P7"], with_trips(f"""
SELECT trip_key, {s_safe_numeric('stop_distance_km')} AS stop_distance_km,
  {s_safe_numeric('temperature_celsius')} AS temperature_celsius FROM dirty""", dirty=DIRTY))
def coerce_numeric(spark, sf):
    d = prep.coerce_numeric(dirty_trips(trips(spark, sf)), ["stop_distance_km", "temperature_celsius"])
    return d.select("trip_key", "stop_distance_km", "temperature_celsius")


@register("label_from_delay", ["P8", "P12"], with_trips(f"""
SELECT trip_key, delay_minutes, {S_LABEL} AS label,
  CASE WHEN {S_LABEL} = 1 THEN 'Late' ELSE 'On-Time' END AS arrival_status
FROM trips WHERE delay_minutes IS NOT NULL"""))
def label_from_delay(spark, sf):
    return prep.label_trips(trips(spark, sf)).select("trip_key", "delay_minutes", "label", "arrival_status")


@register("label_from_status", ["P9"], with_trips(f"""
SELECT trip_key, CASE WHEN lower({s_strip('arrival_status')}) = 'late' THEN 1 ELSE 0 END AS label
FROM dirty WHERE arrival_status IS NOT NULL""", dirty=DIRTY))
def label_from_status(spark, sf):
    d = dirty_trips(trips(spark, sf)).drop("delay_minutes")
    return prep.label_trips(d).select("trip_key", "label")


@register("label_status_contains", ["P10", "P11"], with_trips("""
SELECT trip_key,
  CASE WHEN contains(lower(arrival_status), 'late') THEN 1 ELSE 0 END AS label_contains,
  CASE WHEN arrival_status = 'Late' THEN 1 ELSE 0 END AS label_exact
FROM dirty""", dirty=DIRTY))
def label_status_contains(spark, sf):
    d = dirty_trips(trips(spark, sf))
    return d.select("trip_key", L.late_from_status_substring().alias("label_contains"),
                    L.late_from_status_exact().alias("label_exact"))


@register("categories_as_text", ["P13"], with_trips("""
SELECT trip_key, coalesce(CAST(trip_no AS VARCHAR), 'NA') AS trip_no, coalesce(weather, 'NA') AS weather,
  coalesce(CAST(date AS VARCHAR), 'NA') AS date FROM dirty""", dirty=DIRTY))
def categories_as_text(spark, sf):
    d = prep.categories_as_text(dirty_trips(trips(spark, sf)), ["trip_no", "weather", "date"])
    return d.select("trip_key", "trip_no", "weather", "date")


@register("median_impute", ["P14", "P7"], with_trips(f"""
, d AS (SELECT trip_key, {s_safe_numeric('stop_distance_km')} AS s, {s_safe_numeric('temperature_celsius')} AS t
        FROM dirty WHERE delay_minutes IS NOT NULL),
m AS (SELECT median(s) AS ms, median(t) AS mt FROM d)
SELECT trip_key, coalesce(s, ms) AS stop_distance_km, coalesce(t, mt) AS temperature_celsius
FROM d, m""", dirty=DIRTY))
def median_impute(spark, sf):
    d = prep.label_trips(dirty_trips(trips(spark, sf)))
    d = prep.coerce_numeric(d, ["stop_distance_km", "temperature_celsius"])
    return prep.impute_median(d, ["stop_distance_km", "temperature_celsius"]).select(
        "trip_key", "stop_distance_km", "temperature_celsius")


# --- X: scalar features ---------------------------------------------------------

@register("rush_hour_by_hour", ["X1"], with_trips(f"""
SELECT time_of_day, {S_RUSH} AS is_rush_hour, count(*) AS n_trips FROM trips GROUP BY 1, 2"""))
def rush_hour_by_hour(spark, sf):
    return (trips(spark, sf).withColumn("is_rush_hour", X.rush_hour_numeric())
            .groupBy("time_of_day", "is_rush_hour").agg(F.count(F.lit(1)).alias("n_trips")))


@register("rush_hour_by_bucket", ["X2", "X7"], with_trips(f"""
, b AS (SELECT {s_bucket("TRY_CAST(string_split(departure_time, ':')[1] AS INTEGER)")} AS time_bucket FROM trips)
SELECT time_bucket, CASE WHEN time_bucket IN ('Morning', 'Evening') THEN 1 ELSE 0 END AS is_rush_hour,
  count(*) AS n_trips FROM b GROUP BY 1, 2"""))
def rush_hour_by_bucket(spark, sf):
    b = trips(spark, sf).select(X.time_bucket_from_text("departure_time").alias("time_bucket"))
    return (b.withColumn("is_rush_hour", X.rush_hour_bucket("time_bucket"))
            .groupBy("time_bucket", "is_rush_hour").agg(F.count(F.lit(1)).alias("n_trips")))


@register("rush_hour_by_minutes", ["X3", "X6"], with_trips(f"""
SELECT departure_time, CAST({s_minutes('departure_time')} AS DOUBLE) AS departure_minutes,
  CASE WHEN ({s_minutes('departure_time')} BETWEEN 420 AND 570)
         OR ({s_minutes('departure_time')} BETWEEN 990 AND 1140) THEN 1 ELSE 0 END AS is_rush_hour,
  count(*) AS n_trips
FROM (SELECT departure_time FROM trips UNION ALL SELECT replace(departure_time, ':', '') FROM trips
      UNION ALL SELECT departure_time || ':30' FROM trips)
GROUP BY 1, 2, 3"""))
def rush_hour_by_minutes(spark, sf):
    t = trips(spark, sf).select("departure_time")
    t = t.unionByName(t.select(F.replace("departure_time", F.lit(":"), F.lit("")).alias("departure_time"))) \
         .unionByName(t.select(F.concat("departure_time", F.lit(":30")).alias("departure_time")))
    t = t.withColumn("departure_minutes", X.time_to_minutes("departure_time").cast("double"))
    return (t.withColumn("is_rush_hour", X.rush_hour_minutes("departure_minutes"))
            .groupBy("departure_time", "departure_minutes", "is_rush_hour")
            .agg(F.count(F.lit(1)).alias("n_trips")))


@register("weekend_flags", ["X4", "X5", "X8"], with_trips(f"""
SELECT dayname(date) AS day_name, {S_WEEKEND} AS is_weekend,
  CASE WHEN lower(day_of_week) IN ('sat', 'saturday', 'sun', 'sunday') THEN 1 ELSE 0 END AS is_weekend_cf,
  CASE WHEN lower(substr(day_of_week, 1, 3)) IN ('sat', 'saturday', 'sun', 'sunday') THEN 1 ELSE 0 END
    AS is_weekend_short,
  count(*) AS n_trips
FROM trips GROUP BY 1, 2, 3, 4"""))
def weekend_flags(spark, sf):
    t = trips(spark, sf)
    return (t.select(C.day_name("date").alias("day_name"), X.weekend_exact().alias("is_weekend"),
                     X.weekend_casefold().alias("is_weekend_cf"),
                     X.weekend_casefold(F.substring("day_of_week", 1, 3)).alias("is_weekend_short"))
            .groupBy("day_name", "is_weekend", "is_weekend_cf", "is_weekend_short")
            .agg(F.count(F.lit(1)).alias("n_trips")))


@register("date_text_roundtrip", ["X9", "X18"], with_trips("""
SELECT strftime(date, '%Y-%m-%d') AS date_text,
  CAST(TRY_CAST(strftime(date, '%Y-%m-%d') AS DATE) = date AS INTEGER) AS parsed_ok,
  CAST(TRY_CAST(replace(strftime(date, '%Y-%m-%d'), '-', '/') || 'x' AS DATE) IS NULL AS INTEGER) AS bad_is_null,
  count(*) AS n_trips
FROM trips GROUP BY 1, 2, 3"""))
def date_text_roundtrip(spark, sf):
    t = trips(spark, sf).select("date", C.iso_date("date").alias("date_text"))
    bad = F.concat(F.replace("date_text", F.lit("-"), F.lit("/")), F.lit("x"))
    return (t.select("date_text", (C.parse_date("date_text") == F.col("date")).cast("int").alias("parsed_ok"),
                     C.parse_date(bad).isNull().cast("int").alias("bad_is_null"))
            .groupBy("date_text", "parsed_ok", "bad_is_null").agg(F.count(F.lit(1)).alias("n_trips")))


def _route_text():
    return (F.when(F.col("direction") == "From", F.concat(F.lit("RAK To "), F.col("destination")))
             .when(F.col("trip_no") % 3 == 0, F.col("route"))
             .otherwise(F.concat(F.lower("destination"), F.lit(" to RAK"))))


S_ROUTE_TEXT = ("CASE WHEN direction = 'From' THEN 'RAK To ' || destination WHEN trip_no % 3 = 0 THEN route "
                "ELSE lower(destination) || ' to RAK' END")


@register("direction_from_route", ["X10"], with_trips(f"""
, r AS (SELECT {S_ROUTE_TEXT} AS route_text FROM trips)
SELECT route_text,
  CASE WHEN NOT contains(lower(route_text), ' to ') THEN 'Unknown'
       WHEN {s_strip("split_part(lower(route_text), ' to ', 1)")} = 'rak' THEN 'From' ELSE 'To' END AS direction,
  count(*) AS n_trips FROM r GROUP BY 1, 2"""))
def direction_from_route(spark, sf):
    r = trips(spark, sf).select(_route_text().alias("route_text"))
    return (r.withColumn("direction", X.direction_from_route("route_text"))
            .groupBy("route_text", "direction").agg(F.count(F.lit(1)).alias("n_trips")))


@register("timetable_text_cleanup", ["X11", "X12", "X13"], with_trips("""
, raw AS (SELECT replace(departure_time, ':', '.') AS time_raw, '(' || destination || ') ' AS dest_raw,
       CASE WHEN trip_no % 4 = 0 THEN CAST(trip_no AS VARCHAR) || 'a' ELSE CAST(trip_no AS VARCHAR) END AS no_raw
     FROM trips)
SELECT replace(time_raw, '.', ':') AS departure_time,
  regexp_replace(replace(replace(dest_raw, '(', ''), ')', ''), '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g')
    AS destination,
  CAST(regexp_matches(no_raw, '^[0-9]+$') AS INTEGER) AS no_is_digits,
  CAST(CASE WHEN regexp_matches(no_raw, '^[0-9]+$') THEN TRY_CAST(no_raw AS INTEGER) END AS DOUBLE) AS trip_no,
  count(*) AS n_trips
FROM raw GROUP BY 1, 2, 3, 4"""))
def timetable_text_cleanup(spark, sf):
    t = trips(spark, sf)
    raw = t.select(F.replace("departure_time", F.lit(":"), F.lit(".")).alias("time_raw"),
                   F.concat(F.lit("("), F.col("destination"), F.lit(") ")).alias("dest_raw"),
                   F.when(F.col("trip_no") % 4 == 0, F.concat(F.col("trip_no").cast("string"), F.lit("a")))
                    .otherwise(F.col("trip_no").cast("string")).alias("no_raw"))
    return (raw.select(X.normalise_time_text("time_raw").alias("departure_time"),
                       X.clean_destination("dest_raw").alias("destination"),
                       X.is_digits("no_raw").cast("int").alias("no_is_digits"),
                       X.digits_to_int("no_raw").cast("double").alias("trip_no"))
            .groupBy("departure_time", "destination", "no_is_digits", "trip_no")
            .agg(F.count(F.lit(1)).alias("n_trips")))


@register("additive_delay_effect", ["X14"], with_trips("""
SELECT trip_key,
  CASE WHEN traffic_condition = 'High' THEN 5e0 ELSE 0e0 END
  + CASE WHEN weather = 'Dusty' THEN 3e0 WHEN weather = 'Foggy' THEN 4e0 ELSE 0e0 END
  + CASE WHEN special_event IS NOT NULL THEN 2e0 ELSE 0e0 END
  + CASE WHEN time_of_day >= 7 AND time_of_day <= 9 THEN 2e0 ELSE 0e0 END
  + CASE WHEN time_of_day >= 17 AND time_of_day <= 19 THEN 3e0 ELSE 0e0 END AS delay_effect
FROM trips"""))
def additive_delay_effect(spark, sf):
    return trips(spark, sf).select("trip_key", X.additive_delay_effect().alias("delay_effect"))


@register("clamp_numeric", ["X15"], with_trips("""
SELECT trip_key,
  CASE WHEN stop_distance_km < 0.5 THEN 5e-1 WHEN stop_distance_km > 15 THEN 15e0 ELSE stop_distance_km END
    AS stop_distance_km,
  CASE WHEN time_of_day < 7 THEN 7e0 WHEN time_of_day > 22 THEN 22e0 ELSE time_of_day END AS time_of_day,
  CASE WHEN temperature_celsius < 24 THEN 24e0 WHEN temperature_celsius > 42 THEN 42e0
       ELSE temperature_celsius END AS temperature_celsius
FROM trips"""))
def clamp_numeric(spark, sf):
    t = trips(spark, sf)
    return t.select("trip_key", *[X.clamp(c, lo, hi).alias(c) for c, (lo, hi) in X.JITTER_CLAMP.items()])


@register("group_key_counts", ["X19"], with_trips("""
SELECT concat_ws('|', coalesce(route, 'nan'), coalesce(direction, 'nan'), coalesce(CAST(trip_no AS VARCHAR), 'nan'),
                 coalesce(departure_time, 'nan'), coalesce(destination, 'nan')) AS group_key,
  count(*) AS n_trips FROM trips GROUP BY 1"""))
def group_key_counts(spark, sf):
    t = trips(spark, sf)
    return (t.select(X.group_key(prep.GROUP_KEY_COLUMNS).alias("group_key"))
            .groupBy("group_key").agg(F.count(F.lit(1)).alias("n_trips")))


@register("abs_delay_by_route", ["X20"], with_trips("""
SELECT route, round(avg(abs(delay_minutes)), 6) AS mean_abs_delay, max(abs(delay_minutes)) AS max_abs_delay
FROM trips GROUP BY 1"""))
def abs_delay_by_route(spark, sf):
    return trips(spark, sf).groupBy("route").agg(
        F.round(F.avg(F.abs("delay_minutes")), 6).alias("mean_abs_delay"),
        F.max(F.abs("delay_minutes")).alias("max_abs_delay"))


@register("threshold_predictions", ["X21"], with_trips("""
, t AS (SELECT * FROM (VALUES (3e-1), (5e-1), (7e-1)) v(threshold))
SELECT CAST(t.threshold AS DOUBLE) AS threshold,
  CAST(sum(CASE WHEN s.score >= t.threshold THEN 1 ELSE 0 END) AS BIGINT) AS n_pred_late,
  CAST(sum(CASE WHEN s.score >= t.threshold AND s.label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_true_late
FROM scored s, t GROUP BY 1""", scored=SCORED))
def threshold_predictions(spark, sf):
    s = scored_trips(trips(spark, sf))
    aggs = []
    for t in (0.3, 0.5, 0.7):
        p = X.at_threshold("score", t)
        aggs.append(s.select(F.lit(t).alias("threshold"), p.alias("p"), "label"))
    u = aggs[0].unionByName(aggs[1]).unionByName(aggs[2])
    return u.groupBy("threshold").agg(F.sum("p").cast("bigint").alias("n_pred_late"),
                                      F.sum(F.col("p") * F.col("label")).cast("bigint").alias("n_true_late"))
