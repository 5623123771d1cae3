"""The derived ``trips`` table and its companion inputs.

The driver's tables hold no trips, so trips are projected from
lineitem/orders/part/supplier/nation/region by one deterministic formula
(delays follow the additive model, with uniform noise).  The same formula
is written once as DataFrame code (Spark) and once as SQL text (DuckDB
oracle).  ``arrival_status`` is left out so the label step derives it.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.functions.common import flag
from punctual.functions.hashing import sql_uniform, uniform
from punctual.operators.joins import broadcast_if_small, spread
from punctual.session import release, shared_path
from punctual.sources.tables import read_table, table_path

TRIP_COLUMNS = [
    "trip_key", "date", "day_of_week", "time_of_day", "route", "direction", "trip_no", "departure_time",
    "destination", "stop_distance_km", "traffic_condition", "weather", "special_event",
    "temperature_celsius", "delay_minutes",
]

# Fixed values of the fixture formula.
ROUTE_CUTS = [(6, "Route A"), (12, "Route B"), (17, "Route C")]
ROUTE_LAST = "Route D"
WEATHER_BY_TYPE = {"ECONOMY": "Cloudy", "SMALL": "Dusty", "PROMO": "Foggy", "LARGE": "Rainy"}
EVENT_BY_DISCOUNT = {10: "Sports Match", 9: "Career Fair", 8: "University Exam", 7: "Open Day"}


def _d(c: Column | int | float) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("double")


FIXTURE_VERSION = "trips-v2"
# Trips per file: a scan task packs several files, so it reads a bounded number of rows.
FILE_ROWS = 100_000
SOURCE_TABLES = ["lineitem", "orders", "part", "supplier", "nation", "region"]
_MATERIALIZED: dict[str, str] = {}


def _hadoop_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def source_fingerprint(spark: SparkSession, sf_dir: str) -> str:
    parts = [FIXTURE_VERSION, sf_dir]
    for t in SOURCE_TABLES:
        fs, p = _hadoop_fs(spark, table_path(sf_dir, t))
        files = fs.listFiles(p, True)  # every file: a folder's own time may not move when a partition changes
        found = []
        while files.hasNext():
            st = files.next()
            found.append(f"{st.getPath()}:{st.getLen()}:{st.getModificationTime()}")
        parts += [t, *sorted(found)]
    return hashlib.md5("|".join(parts).encode()).hexdigest()[:16]


def trips(spark: SparkSession, sf_dir: str, materialize: bool = True) -> DataFrame:
    """The derived trips table, written once per source snapshot as parquet
    under the shared ``spark.checkpoint.dir`` and read from there.

    Writing cuts the six-table join out of every later plan (and its lineage
    out of failure recovery); the copy is keyed by the source files' sizes
    and modification times and published by an atomic rename, so concurrent
    writers never expose a partial table.
    """
    if not materialize:
        return build_trips(spark, sf_dir)
    key = source_fingerprint(spark, sf_dir)
    path = _MATERIALIZED.get(key)
    if path is None:
        path = shared_path(spark, f"trips-{key}")
        fs, p = _hadoop_fs(spark, path)
        if not fs.exists(_hadoop_fs(spark, f"{path}/_SUCCESS")[1]):
            tmp = shared_path(spark, f"trips-{key}-{uuid.uuid4().hex[:8]}.tmp")
            # Written as the joins leave the rows: clustering them would shuffle the whole table once more.
            build_trips(spark, sf_dir).write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).parquet(tmp)
            if not fs.rename(_hadoop_fs(spark, tmp)[1], p):  # another writer won the race
                path = tmp
            release(spark)  # the joins have shuffled all rows twice
        _MATERIALIZED[key] = path
    return spark.read.parquet(path).select(*TRIP_COLUMNS)


def build_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trip per lineitem row (F2 schema, numeric ``time_of_day``)."""
    li = read_table(spark, sf_dir, "lineitem", [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_linestatus", "l_shipdate"])
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderpriority", "o_totalprice"])
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_type"])
    supplier = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey"])
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    region = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])

    # nation/region are tiny dimension tables; the bound is checked, not assumed.
    geo = nation.join(broadcast_if_small(region, 10_000), nation.n_regionkey == region.r_regionkey)
    sup = supplier.join(broadcast_if_small(geo, 10_000),
                        supplier.s_nationkey == geo.n_nationkey) \
        .select("s_suppkey", "r_name")
    n = li.count()  # from the files' footers
    b = (spread(li, n, "l_orderkey").join(spread(orders, n, "o_orderkey"), li.l_orderkey == orders.o_orderkey))
    b = (spread(b, n, "l_partkey").join(spread(part, n, "p_partkey"), li.l_partkey == part.p_partkey)
           .join(sup, li.l_suppkey == sup.s_suppkey))

    ec = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    tc = F.round(F.col("o_totalprice") * 100).cast("bigint")
    dm = F.lit(300) + F.lit(30) * ((F.col("l_partkey") * 37 + F.col("l_orderkey") * 11) % 38)
    dc = F.round(F.col("l_discount") * 100).cast("int")
    sb = F.col("l_suppkey") % 20
    b = b.select("*", ec.alias("ec"), tc.alias("tc"), dm.alias("dm"), dc.alias("dc"), sb.alias("sb"))

    route = F.lit(ROUTE_LAST)
    for cut, name in reversed(ROUTE_CUTS):
        route = F.when(F.col("sb") < cut, F.lit(name)).otherwise(route)
    weather = F.lit("Clear")
    for t, w in reversed(list(WEATHER_BY_TYPE.items())):
        weather = F.when(F.col("p_type") == t, F.lit(w)).otherwise(weather)
    event = F.lit(None).cast("string")
    for d, e in reversed(list(EVENT_BY_DISCOUNT.items())):
        event = F.when(F.col("dc") == d, F.lit(e)).otherwise(event)
    prio = F.substring("o_orderpriority", 1, 1)
    traffic = (F.when(prio == "1", F.lit("High")).when(prio.isin("2", "3"), F.lit("Medium"))
               .otherwise(F.lit("Low")))
    hour_txt = F.lpad((F.floor(_d(F.col("dm")) / _d(60))).cast("int").cast("string"), 2, "0")
    min_txt = F.lpad((F.col("dm") % 60).cast("string"), 2, "0")

    f = b.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in
                          ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ec"]]).alias("trip_key"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.date_format("l_shipdate", "EEEE").alias("day_of_week"),
        (_d(F.col("dm")) / _d(60)).alias("time_of_day"),
        route.alias("route"),
        F.when(F.col("l_linestatus") == "O", F.lit("From")).otherwise(F.lit("To")).alias("direction"),
        F.col("l_linenumber").alias("trip_no"),
        F.concat(hour_txt, F.lit(":"), min_txt).alias("departure_time"),
        F.col("r_name").alias("destination"),
        (F.col("l_quantity") / _d(2)).alias("stop_distance_km"),
        traffic.alias("traffic_condition"),
        weather.alias("weather"),
        event.alias("special_event"),
        (_d(F.lit(2000) + F.col("ec") % 2500) / _d(100)).alias("temperature_celsius"),
        (_d((F.col("ec") + F.col("tc")) % 1600 - 500) / _d(100)).alias("base"),
        F.col("dm"),
    )
    delay = (
        F.col("base")
        + F.when(F.col("traffic_condition") == "High", 5).otherwise(0)
        + F.when(F.col("weather") == "Dusty", 3).when(F.col("weather") == "Foggy", 4).otherwise(0)
        + F.when(F.col("special_event").isNotNull(), 2).otherwise(0)
        + F.when(F.col("dm").between(420, 540), 2).otherwise(0)
        + F.when(F.col("dm").between(1020, 1140), 3).otherwise(0)
    )
    return f.select(*TRIP_COLUMNS[:-1], delay.alias("delay_minutes"))


def trips_sql() -> str:
    """DuckDB text of the same projection (body of a ``trips`` CTE)."""
    return """
WITH b AS (
  SELECT l.*, o.o_orderpriority, p.p_type, r.r_name,
    CAST(round(l.l_extendedprice * 100) AS BIGINT) AS ec,
    CAST(round(o.o_totalprice * 100) AS BIGINT) AS tc,
    300 + 30 * ((l.l_partkey * 37 + l.l_orderkey * 11) % 38) AS dm,
    CAST(round(l.l_discount * 100) AS INT) AS dc,
    l.l_suppkey % 20 AS sb
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey),
f AS (
  SELECT
    concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
              CAST(l_suppkey AS VARCHAR), CAST(ec AS VARCHAR)) AS trip_key,
    CAST(l_shipdate AS DATE) AS date,
    dayname(l_shipdate) AS day_of_week,
    CAST(dm AS DOUBLE) / CAST(60 AS DOUBLE) AS time_of_day,
    CASE WHEN sb < 6 THEN 'Route A' WHEN sb < 12 THEN 'Route B'
         WHEN sb < 17 THEN 'Route C' ELSE 'Route D' END AS route,
    CASE WHEN l_linestatus = 'O' THEN 'From' ELSE 'To' END AS direction,
    l_linenumber AS trip_no,
    concat(lpad(CAST(CAST(floor(CAST(dm AS DOUBLE) / CAST(60 AS DOUBLE)) AS INT) AS VARCHAR), 2, '0'), ':',
           lpad(CAST(dm % 60 AS VARCHAR), 2, '0')) AS departure_time,
    r_name AS destination,
    l_quantity / CAST(2 AS DOUBLE) AS stop_distance_km,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'High' WHEN '2' THEN 'Medium'
         WHEN '3' THEN 'Medium' ELSE 'Low' END AS traffic_condition,
    CASE p_type WHEN 'ECONOMY' THEN 'Cloudy' WHEN 'SMALL' THEN 'Dusty' WHEN 'PROMO' THEN 'Foggy'
         WHEN 'LARGE' THEN 'Rainy' ELSE 'Clear' END AS weather,
    CASE dc WHEN 10 THEN 'Sports Match' WHEN 9 THEN 'Career Fair'
         WHEN 8 THEN 'University Exam' WHEN 7 THEN 'Open Day' END AS special_event,
    CAST(2000 + ec % 2500 AS DOUBLE) / CAST(100 AS DOUBLE) AS temperature_celsius,
    CAST((ec + tc) % 1600 - 500 AS DOUBLE) / CAST(100 AS DOUBLE) AS base,
    dm
  FROM b)
SELECT trip_key, date, day_of_week, time_of_day, route, direction, trip_no, departure_time, destination,
  stop_distance_km, traffic_condition, weather, special_event, temperature_celsius,
  base + CASE WHEN traffic_condition = 'High' THEN 5 ELSE 0 END
       + CASE weather WHEN 'Dusty' THEN 3 WHEN 'Foggy' THEN 4 ELSE 0 END
       + CASE WHEN special_event IS NOT NULL THEN 2 ELSE 0 END
       + CASE WHEN dm BETWEEN 420 AND 540 THEN 2 ELSE 0 END
       + CASE WHEN dm BETWEEN 1020 AND 1140 THEN 3 ELSE 0 END AS delay_minutes
FROM f
"""


# --- companion inputs --------------------------------------------------------

DIRTY_SALT = "dirty"
DIRTY_BUCKETS = 10
DUP_SALT = "dup"


def _bucket(key: Column, salt: str, n: int) -> Column:
    return F.floor(uniform(key, salt) * F.lit(n)).cast("int")


def dirty_trips(t: DataFrame) -> DataFrame:
    """Trips with injected dirty values (P4-P7, P13, P14 inputs).

    Bucket k of md5(trip_key) picks the defect: category columns receive
    NULL, '', ' nan ', 'None' or tab-padded text; numeric text columns receive
    '5d', 'abc', '' or NULL; some delays and dates go missing; a status text
    column carries 'Late'/'On-Time' with noise.
    """
    k = F.col("trip_key")
    # Buckets are materialised as columns first so each md5 runs once per row.
    t = t.withColumns({f"_b{x}": _bucket(k, DIRTY_SALT + x, DIRTY_BUCKETS) for x in "wdns"})
    bw, bd, bn, bs = F.col("_bw"), F.col("_bd"), F.col("_bn"), F.col("_bs")
    weather = (F.when(bw == 0, F.lit(None).cast("string")).when(bw == 1, F.lit(""))
               .when(bw == 2, F.lit(" nan ")).when(bw == 3, F.lit("None"))
               .when(bw == 4, F.concat(F.lit("\t"), F.col("weather"), F.lit(" ")))
               .otherwise(F.col("weather")))
    dist_txt = (F.when(bn == 0, F.lit("5d")).when(bn == 1, F.lit("abc")).when(bn == 2, F.lit(""))
                .when(bn == 3, F.lit(None).cast("string"))
                .otherwise(F.col("stop_distance_km").cast("string")))
    temp_txt = (F.when(bd == 5, F.lit("n/a")).when(bd == 6, F.lit(" 31.5 "))
                .otherwise(F.col("temperature_celsius").cast("string")))
    delay = F.when(bd == 0, F.lit(None).cast("double")).otherwise(F.col("delay_minutes"))
    date = F.when(bd == 1, F.lit(None).cast("date")).otherwise(F.col("date"))
    late = F.col("delay_minutes") > 5
    status = (F.when(bs == 0, F.lit(None).cast("string"))
              .when(bs == 1, F.when(late, F.lit(" LATE ")).otherwise(F.lit("on-time")))
              .when(bs == 2, F.when(late, F.lit("Late arrival")).otherwise(F.lit("On-Time")))
              .otherwise(F.when(late, F.lit("Late")).otherwise(F.lit("On-Time"))))
    return t.select(
        "trip_key", date.alias("date"), "day_of_week", "route", "trip_no", "departure_time",
        "traffic_condition", weather.alias("weather"), "special_event",
        dist_txt.alias("stop_distance_km"), temp_txt.alias("temperature_celsius"),
        delay.alias("delay_minutes"), status.alias("arrival_status"))


def dirty_trips_sql() -> str:
    def b(salt: str) -> str:
        return f"CAST(floor({sql_uniform('trip_key', salt)} * {DIRTY_BUCKETS}) AS INTEGER)"
    bw, bd, bn, bs = b(DIRTY_SALT + "w"), b(DIRTY_SALT + "d"), b(DIRTY_SALT + "n"), b(DIRTY_SALT + "s")
    return f"""
SELECT trip_key,
  CASE WHEN {bd} = 1 THEN NULL ELSE date END AS date,
  day_of_week, route, trip_no, departure_time, traffic_condition,
  CASE {bw} WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' nan ' WHEN 3 THEN 'None'
            WHEN 4 THEN chr(9) || weather || ' ' ELSE weather END AS weather,
  special_event,
  CASE {bn} WHEN 0 THEN '5d' WHEN 1 THEN 'abc' WHEN 2 THEN '' WHEN 3 THEN NULL
            ELSE CAST(stop_distance_km AS VARCHAR) END AS stop_distance_km,
  CASE {bd} WHEN 5 THEN 'n/a' WHEN 6 THEN ' 31.5 ' ELSE CAST(temperature_celsius AS VARCHAR) END
    AS temperature_celsius,
  CASE WHEN {bd} = 0 THEN NULL ELSE delay_minutes END AS delay_minutes,
  CASE {bs} WHEN 0 THEN NULL
            WHEN 1 THEN CASE WHEN delay_minutes > 5 THEN ' LATE ' ELSE 'on-time' END
            WHEN 2 THEN CASE WHEN delay_minutes > 5 THEN 'Late arrival' ELSE 'On-Time' END
            ELSE CASE WHEN delay_minutes > 5 THEN 'Late' ELSE 'On-Time' END END AS arrival_status
FROM trips"""


def with_duplicates(t: DataFrame, fraction_buckets: int = 10) -> DataFrame:
    """Trips plus an exact copy of md5 bucket 0 of ``fraction_buckets``.

    ``row_id`` (trip_key + copy number) orders rows the way file order would.
    """
    orig = t.withColumn("row_id", F.concat(F.col("trip_key"), F.lit("#0")))
    dup = (t.where(_bucket(F.col("trip_key"), DUP_SALT, fraction_buckets) == 0)
            .withColumn("row_id", F.concat(F.col("trip_key"), F.lit("#1"))))
    return orig.unionByName(dup)


def with_duplicates_sql(fraction_buckets: int = 10) -> str:
    bucket = f"CAST(floor({sql_uniform('trip_key', DUP_SALT)} * {fraction_buckets}) AS INTEGER)"
    return f"""
SELECT *, trip_key || '#0' AS row_id FROM trips
UNION ALL
SELECT *, trip_key || '#1' AS row_id FROM trips WHERE {bucket} = 0"""


def scored_trips(t: DataFrame, model: str = "additive", extra: tuple[str, ...] = ()) -> DataFrame:
    """F5 scored rows without training: score = logistic of the additive
    effects (centred), rounded to 6 decimals so ties occur; label from P8."""
    from punctual.functions.features import additive_delay_effect
    from punctual.functions.labels import late_from_delay
    eff = additive_delay_effect()
    z = (eff - F.lit(3.0)) / F.lit(2.0) + (F.col("stop_distance_km") - F.lit(12.5)) / F.lit(25.0)
    score = F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 6)
    return t.select(
        F.lit(model).alias("model"), "trip_key",
        late_from_delay().alias("label"),
        flag(score >= F.lit(0.5)).alias("prediction"),
        score.alias("score"), *extra)


def scored_trips_sql(model: str = "additive") -> str:
    eff = ("(CASE WHEN traffic_condition = 'High' THEN 5e0 ELSE 0e0 END"
           " + CASE WHEN weather = 'Dusty' THEN 3e0 WHEN weather = 'Foggy' THEN 4e0 ELSE 0e0 END"
           " + CASE WHEN special_event IS NOT NULL THEN 2e0 ELSE 0e0 END"
           " + CASE WHEN time_of_day >= 7 AND time_of_day <= 9 THEN 2e0 ELSE 0e0 END"
           " + CASE WHEN time_of_day >= 17 AND time_of_day <= 19 THEN 3e0 ELSE 0e0 END)")
    z = f"(({eff} - 3e0) / 2e0 + (stop_distance_km - 125e-1) / 25e0)"
    score = f"round(1e0 / (1e0 + exp(-{z})), 6)"
    return f"""
SELECT '{model}' AS model, trip_key,
  CASE WHEN delay_minutes > 5 THEN 1 ELSE 0 END AS label,
  CASE WHEN {score} >= 5e-1 THEN 1 ELSE 0 END AS prediction,
  {score} AS score
FROM trips"""
