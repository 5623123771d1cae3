"""Scoring as a Structured Streaming job (M15 + IO9 on an unbounded input).

The reference scores one record per button press; here new trip files
arriving in a folder are scored in micro-batches by the same fitted
pipeline and appended to the prediction log.  The checkpoint lives under
the shared ``spark.checkpoint.dir`` so a restarted query resumes exactly
where it stopped.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from punctual.operators.models import TrainedModel, log_predictions, score, with_status
from punctual.session import shared_path


def trip_stream(spark: SparkSession, path: str, schema: StructType, max_files_per_trigger: int = 16) -> DataFrame:
    """Parquet files dropped into ``path`` as an unbounded table."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(path))


def score_stream(model: TrainedModel, stream: DataFrame, sink_path: str, name: str = "trip-scoring",
                 keep: list[str] | None = None, threshold: float = 0.5,
                 available_now: bool = False) -> StreamingQuery:
    """Append (inputs, score, prediction, confidence, status, timestamp) to ``sink_path``."""
    scored = with_status(score(model, stream, threshold, keep=keep)).withColumn("logged_at", F.current_timestamp())
    writer = (scored.writeStream.format("parquet").outputMode("append")
              # one checkpoint per (query name, sink): a restart resumes, a new sink starts fresh
              .option("checkpointLocation", shared_path(
                  stream.sparkSession, f"stream-ckpt-{name}-{hashlib.md5(sink_path.encode()).hexdigest()[:12]}"))
              .option("path", sink_path))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.queryName(name).start()


def log_stream(model: TrainedModel, stream: DataFrame, log_path: str, name: str = "trip-log", keep: list[str] | None = None,
               threshold: float = 0.5, available_now: bool = False) -> StreamingQuery:
    """Add every micro-batch to the prediction log under its own number, so a batch that is run again is logged once."""
    writer = (score(model, stream, threshold, keep=keep).writeStream
              .foreachBatch(lambda batch, number: log_predictions(batch, log_path, number) and None)
              .option("checkpointLocation", shared_path(
                  stream.sparkSession, f"stream-ckpt-{name}-{hashlib.md5(log_path.encode()).hexdigest()[:12]}")))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.queryName(name).start()
