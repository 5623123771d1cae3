"""Queries for the data builders (J1-J5, D1, D2, IO4, X16, X17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from punctual.functions import features as X
from punctual.functions.hashing import sql_hash_mod, sql_normal, sql_uniform
from punctual.operators import builder as B
from punctual.operators.joins import DENSE_BUCKETS
from punctual.operators import prep
from punctual.plans.registry import register, with_trips
from punctual.sources.fixture import trips

R6 = 6
SEED = 42
TT = B.TIMETABLE_COLUMNS
CTX = B.CONTEXT_COLUMNS

S_LABELLED = """
, l AS (SELECT *, CASE WHEN delay_minutes > 5 THEN 'Late' ELSE 'On-Time' END AS arrival_status
        FROM trips WHERE delay_minutes IS NOT NULL)"""


def s_dense(src: str, keys: list[str], salt: str, idx: str, n_buckets: int = DENSE_BUCKETS) -> str:
    key_text = "concat_ws(chr(1), " + ", ".join(f"CAST({k} AS VARCHAR)" for k in keys) + ")"
    return (f"SELECT *, row_number() OVER (ORDER BY {sql_hash_mod(key_text, salt, str(n_buckets))}, "
            f"{', '.join(keys)}) - 1 AS {idx} FROM {src}")


def s_bucket_text(dep: str) -> str:
    h = f"TRY_CAST(string_split({dep}, ':')[1] AS INTEGER)"
    return (f"CASE WHEN {h} >= 5 AND {h} < 12 THEN 'Morning' WHEN {h} >= 12 AND {h} < 17 THEN 'Afternoon' "
            f"WHEN {h} >= 17 AND {h} < 21 THEN 'Evening' ELSE 'Night' END")


def s_clamp(v: str, lo: float, hi: float) -> str:
    return (f"CASE WHEN {v} IS NULL OR isnan({v}) THEN {v} WHEN {v} < {lo!r}e0 THEN {lo!r}e0 "
            f"WHEN {v} > {hi!r}e0 THEN {hi!r}e0 ELSE {v} END")


@register("calendar_dates", ["J1", "X8", "X9"], with_trips("""
SELECT strftime(d, '%Y-%m-%d') AS date, dayname(d) AS day_of_week
FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d FROM trips)"""))
def calendar_dates(spark, sf):
    """Inclusive calendar over the span of trip dates."""
    lo, hi = trips(spark, sf).agg(F.min("date"), F.max("date")).first()
    cal = B.calendar_between(spark, lo, hi)
    return cal.select(F.date_format("date", "yyyy-MM-dd").alias("date"), F.date_format("date", "EEEE")
                      .alias("day_of_week"))


S_BUILT = with_trips(S_LABELLED + f"""
, tt0 AS (SELECT DISTINCT {', '.join(TT)} FROM l),
tt AS ({s_dense('tt0', TT, 'tt', '_tt')}),
cx AS ({s_dense('l', ['trip_key'], 'cx', '_cx')}),
p AS (SELECT (SELECT count(*) FROM tt) AS nt, (SELECT count(*) FROM cx) AS nc, (SELECT min(date) FROM l) AS start,
        greatest(1, CAST(ceil(CAST((SELECT count(*) FROM l) AS DOUBLE) / (SELECT count(*) FROM tt)) AS BIGINT)) AS days),
g AS (SELECT unnest(generate_series(0, days * nt - 1)) AS i, nt, nc, start FROM p),
gen AS (SELECT CAST(start + CAST(i // nt AS INTEGER) AS DATE) AS date, i % nt AS _tt, nc FROM g),
gen2 AS (SELECT date, _tt, {sql_hash_mod("strftime(date, '%Y-%m-%d') || '|' || CAST(_tt AS VARCHAR)", f'ctx{SEED}', 'nc')}
           AS _cx FROM gen)
SELECT strftime(gen2.date, '%Y-%m-%d') AS date, dayname(gen2.date) AS day_of_week,
  {s_bucket_text('tt.departure_time')} AS time_of_day,
  {', '.join('tt.' + c for c in TT)}, {', '.join('cx.' + c for c in CTX)}
FROM gen2 JOIN tt ON gen2._tt = tt._tt JOIN cx ON gen2._cx = cx._cx""")


def built_trips(spark, sf):
    """Timetable (distinct trips) x calendar from the first trip date, sized to
    the trip count, each row with one context trip drawn with replacement."""
    t = prep.label_trips(trips(spark, sf))
    target, start = t.agg(F.count(F.lit(1)), F.min("date")).first()
    return B.build_trip_table(t.select(*TT), t, start, None, "trip_key", SEED, target_rows=target)


@register("build_trip_table", ["J2", "J3", "J4", "J5", "X7", "X8", "X9", "K1"], S_BUILT)
def build_trip_table(spark, sf):
    """Every timetable entry on every day, as many days as give the trip count."""
    return built_trips(spark, sf)


def _s_boot_src() -> str:
    return S_LABELLED + f"""
, src AS ({s_dense('l', ['trip_key'], 'boot', '_src')}),
n AS (SELECT count(*) AS c FROM src),
picks AS (SELECT i AS draw, {sql_hash_mod('i', f'boot{SEED}', 'c')} AS _src
          FROM (SELECT unnest(generate_series(0, 2 * c - 1)) AS i, c FROM n)),
boot AS (SELECT picks.draw, src.* FROM picks JOIN src USING (_src))"""


@register("bootstrap_exact", ["D1"], with_trips(_s_boot_src() + """
SELECT draw, trip_key FROM boot"""))
def bootstrap_exact(spark, sf):
    """Exactly 2x the trip count, drawn with replacement."""
    t = prep.label_trips(trips(spark, sf))
    n = t.count()
    return B.bootstrap(t, 2 * n, ["trip_key"], SEED).select("draw", "trip_key")


def _jit_sql(col: str) -> str:
    v = f"({col} + {sql_normal('draw', f'jit{SEED}{col}', 0.0, X.JITTER_STD[col])})"
    lo_hi = X.JITTER_CLAMP.get(col)
    return s_clamp(v, *lo_hi) if lo_hi else v


@register("expand_jitter_relabel", ["D1", "X16", "X17", "X15"], with_trips(_s_boot_src() + f"""
, j AS (SELECT draw, trip_key, {', '.join(f'{_jit_sql(c)} AS {c}' for c in X.JITTER_STD)} FROM boot)
SELECT draw, trip_key, {', '.join(f'round({c}, {R6}) AS {c}' for c in X.JITTER_STD)},
  CASE WHEN delay_minutes > 5 THEN 'Late' ELSE 'On-Time' END AS arrival_status FROM j"""))
def expand_jitter_relabel(spark, sf):
    """Bootstrap to 2x, Gaussian jitter with clamps, re-label from the jittered delay."""
    t = prep.label_trips(trips(spark, sf))
    n = t.count()
    e = B.expand_dataset(t, 2 * n, ["trip_key"], SEED)
    return e.select("draw", "trip_key", *[F.round(c, R6).alias(c) for c in X.JITTER_STD], "arrival_status")


@register("sample_without_replacement", ["D2"], with_trips(f"""
SELECT trip_key, route, delay_minutes FROM trips ORDER BY {sql_uniform('trip_key', f'pick{SEED}')}, trip_key
LIMIT 2000"""))
def sample_without_replacement(spark, sf):
    t = trips(spark, sf).select("trip_key", "route", "delay_minutes")
    return B.sample_without_replacement(t, 2000, "trip_key", SEED)


def _s_choice(u: str, choices) -> str:
    names, probs = choices
    parts = [f"WHEN {u} < {b!r}e0 THEN '{n}'" for n, b in zip(names[:-1], B.cumulative_bounds(probs))]
    return f"CASE {' '.join(parts)} ELSE '{names[-1]}' END"


def _s_mock() -> str:
    s = f"mock{SEED}"
    k = "trip_key"
    hour = s_clamp(sql_normal(k, s + "hour", *B.MOCK_HOUR[:2]), *B.MOCK_HOUR[2:])
    temp = s_clamp(sql_normal(k, s + "temp", *B.MOCK_TEMPERATURE[:2]), *B.MOCK_TEMPERATURE[2:])
    lo, hi = B.MOCK_DISTANCE
    return f"""
, m0 AS (SELECT trip_key,
  {_s_choice(sql_uniform(k, s + 'route'), B.MOCK_ROUTES)} AS route,
  ({lo!r}e0 + {sql_uniform(k, s + 'dist')} * {hi - lo!r}e0) AS stop_distance_km,
  {_s_choice(sql_uniform(k, s + 'day'), B.MOCK_DAYS)} AS day_of_week,
  {hour} AS time_of_day,
  {_s_choice(sql_uniform(k, s + 'traffic'), B.MOCK_TRAFFIC)} AS traffic_condition,
  {_s_choice(sql_uniform(k, s + 'weather'), B.MOCK_WEATHER)} AS weather,
  {_s_choice(sql_uniform(k, s + 'event'), B.MOCK_EVENTS)} AS special_event,
  {temp} AS temperature_celsius,
  {sql_normal(k, s + 'delay', *B.MOCK_DELAY)} AS noise FROM trips),
m AS (SELECT *, noise + (CASE WHEN traffic_condition = 'High' THEN 5e0 ELSE 0e0 END
  + CASE WHEN weather = 'Dusty' THEN 3e0 WHEN weather = 'Foggy' THEN 4e0 ELSE 0e0 END
  + CASE WHEN special_event IS NOT NULL AND special_event <> 'None' THEN 2e0 ELSE 0e0 END
  + CASE WHEN time_of_day >= 7 AND time_of_day <= 9 THEN 2e0 ELSE 0e0 END
  + CASE WHEN time_of_day >= 17 AND time_of_day <= 19 THEN 3e0 ELSE 0e0 END) AS delay_minutes FROM m0)
SELECT trip_key, route, round(stop_distance_km, {R6}) AS stop_distance_km, day_of_week,
  round(time_of_day, {R6}) AS time_of_day, traffic_condition, weather, special_event,
  round(temperature_celsius, {R6}) AS temperature_celsius, round(delay_minutes, {R6}) AS delay_minutes,
  CASE WHEN delay_minutes <= 5 THEN 'On-Time' ELSE 'Late' END AS arrival_status FROM m"""


@register("generated_trips", ["IO4", "X14", "X15"], with_trips(_s_mock()))
def generated_trips(spark, sf):
    """One generated trip (weighted categoricals, clipped normals, additive
    delay) per trip key of the derived trips."""
    g = B.generate_mock_trips(trips(spark, sf).select("trip_key"), "trip_key", SEED)
    return g.withColumns({c: F.round(c, R6) for c in
                          ["stop_distance_km", "time_of_day", "temperature_celsius", "delay_minutes"]})
