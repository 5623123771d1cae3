"""File sources and sinks (IO1, IO2, IO6, IO9).

CSV is read with an explicit schema, every field first as text, so the
missing-value tokens pandas recognises become NULL before typing (Spark's
reader nulls only ``nullValue``), and malformed numbers become NULL
instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from punctual.functions.cleaning import parse_date, safe_numeric
from punctual.operators.prep import require_columns

# Texts pandas' CSV reader treats as missing by default.
MISSING_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                  "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

TRIP_SCHEMA = T.StructType([
    T.StructField("trip_key", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("day_of_week", T.StringType()),
    T.StructField("time_of_day", T.DoubleType()),
    T.StructField("route", T.StringType()),
    T.StructField("direction", T.StringType()),
    T.StructField("trip_no", T.IntegerType()),
    T.StructField("departure_time", T.StringType()),
    T.StructField("destination", T.StringType()),
    T.StructField("stop_distance_km", T.DoubleType()),
    T.StructField("traffic_condition", T.StringType()),
    T.StructField("weather", T.StringType()),
    T.StructField("special_event", T.StringType()),
    T.StructField("temperature_celsius", T.DoubleType()),
    T.StructField("delay_minutes", T.DoubleType()),
])

TRIP_OPTIONAL = T.StructType([T.StructField("arrival_status", T.StringType())])


def read_csv(spark: SparkSession, path: str, schema: T.StructType = TRIP_SCHEMA,
             missing: list[str] | None = None, optional: T.StructType = TRIP_OPTIONAL) -> DataFrame:
    """IO1: header CSV -> typed DataFrame with pandas-style missing tokens.

    Columns are taken by their header name, in any order; others are left
    out.  Those of ``schema`` must be there, those of ``optional`` may.
    """
    tokens = MISSING_TOKENS if missing is None else missing
    raw = (spark.read.option("header", True).option("mode", "PERMISSIVE")
           .option("nullValue", "\u0000").option("emptyValue", "").csv(path))
    require_columns(raw, [f.name for f in schema.fields])
    cols = []
    for f in [*schema.fields, *[f for f in optional.fields if f.name in raw.columns and f.name not in schema.names]]:
        v = F.when(F.col(f.name).isin(*tokens), F.lit(None).cast("string")).otherwise(F.col(f.name))
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            v = safe_numeric(v)
        elif isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType)):
            v = F.when(v.rlike("^[ ]*[+-]?[0-9]+[ ]*$"), F.trim(v)).try_cast(f.dataType)
        elif isinstance(f.dataType, T.DateType):
            v = parse_date(v)
        cols.append(v.cast(f.dataType).alias(f.name))
    return raw.select(*cols)


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """IO8: the first ``n`` rows (a bounded peek; order is the scan's)."""
    return df.limit(n)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """IO2: header CSV, no index column."""
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def metrics_long(summary: DataFrame, id_cols: list[str], metric_cols: list[str]) -> DataFrame:
    """(model, metric, value) rows from a wide summary."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                                for m in metric_cols]))
    return summary.select(*id_cols, pairs.alias("_m")).select(*id_cols, "_m.metric", "_m.value")


def write_metrics_json(metrics: DataFrame, path: str) -> None:
    """IO6: metrics as JSON lines."""
    metrics.coalesce(1).write.mode("overwrite").json(path)  # a handful of rows


def read_metrics_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("model string, metric string, value double").json(path)
