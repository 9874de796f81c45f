"""Audit events, request counters and health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notesift.functions import clean
from notesift.functions import constants as C
from notesift.operators import notes as document_path


def outcomes(notes: DataFrame) -> DataFrame:
    """``status`` of every note: blank texts fail and are skipped."""
    blank = clean.strip(F.coalesce("text", F.lit(""))) == ""
    return notes.select("doc_id", F.when(blank, "failed").otherwise("success").alias("status"))


def audit_events(notes: DataFrame) -> DataFrame:
    """What the log would say of each note, without time stamps."""
    done = outcomes(notes)
    event = F.when(F.col("status") == "failed", "empty_note_skipped").otherwise("document_processed")
    level = F.when(F.col("status") == "failed", "WARNING").otherwise("INFO")
    return done.select("doc_id", level.alias("level"), event.alias("event"))


def write_audit(events: DataFrame, path: str) -> None:
    """Append the events with the time, as JSON lines."""
    events.withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).write.mode("append").json(path)


def batch_extract(notes: DataFrame, order: str | None = None) -> DataFrame:
    """Output documents of a batch. Blank texts are left out; requests without an id are named by their place, the column ``order``."""
    if order:
        notes = notes.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("doc_"), F.col(order).cast("string"))))
    return document_path.run(notes)


def request_counter(events: DataFrame) -> DataFrame:
    """Requests by endpoint and status."""
    return events.groupBy(F.col("event_type").alias("endpoint"), F.when(F.col("value") < 0, "500").otherwise("200").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def latency_histogram(events: DataFrame, seconds: str = "value / 100") -> DataFrame:
    """Cumulative buckets by endpoint, the last without bound, as monitoring expects them: one pass."""
    value = F.expr(seconds)
    counts = [F.count_if(value <= le).alias(str(le)) for le in C.LATENCY_BOUNDS] + [F.count(F.lit(1)).alias("+Inf")]
    wide = events.groupBy(F.col("event_type").alias("endpoint")).agg(*counts)
    each = F.array(*[F.struct(F.lit(str(le)).alias("le"), F.col(f"`{le}`").alias("n")) for le in (*C.LATENCY_BOUNDS, "+Inf")])
    return wide.select("endpoint", F.explode(each).alias("b")).select("endpoint", "b.le", "b.n")


def health(spark: SparkSession, model_loaded: bool = True) -> DataFrame:
    """State of the service: degraded without a model; seconds since the session's context was started."""
    status = "healthy" if model_loaded else "degraded"
    uptime = (F.unix_millis(F.current_timestamp()) - F.lit(spark.sparkContext.startTime)) / 1000
    return spark.range(1).select(F.lit(status).alias("status"), F.lit(model_loaded).alias("model_loaded"), F.lit(C.MODEL_VERSION).alias("model_version"), uptime.alias("uptime_seconds"))

