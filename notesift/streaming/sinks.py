"""Sinks of streams that survive a restart, and request metrics that are kept up while requests arrive.

A micro-batch has a number, and after a failure the same rows come again under the
same number. Each is written to a folder of that number, in place of what a failed
attempt left there, so every row is in the output once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from notesift.functions import constants as C
from notesift.operators import notes as document_path

BATCH = "batch"


def write_batches(rows: DataFrame, path: str, checkpoint: str, mode: str = "append", prepared: Callable[[DataFrame], DataFrame] | None = None, **trigger: object) -> StreamingQuery:
    """Start writing ``rows``, each micro-batch (after ``prepared``) to a folder of its own."""

    def write(batch: DataFrame, number: int) -> None:
        (prepared(batch) if prepared else batch).write.mode("overwrite").json(f"{path}/{BATCH}={number}")

    stream = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    return stream.trigger(**(trigger or {"availableNow": True})).start()


def read_batches(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """All batches written so far, with their number."""
    return spark.read.schema(schema).option("basePath", path).json(f"{path}/{BATCH}=*").withColumn(BATCH, F.col(BATCH).cast("long"))


def documents(rows: DataFrame, path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """The document path on a stream of notes: each document is written once, as its batch is done."""
    return write_batches(rows, path, checkpoint, prepared=document_path.run, **trigger)


METRICS = "endpoint string, status string, n long, seconds double, buckets array<struct<le:string,n:long>>"


def _bucket_counts(seconds: Column) -> list[Column]:
    return [F.count_if(seconds <= le).alias(str(le)) for le in C.LATENCY_BOUNDS]


def totals(events: DataFrame) -> DataFrame:
    """Requests, seconds and cumulative buckets by endpoint and status since the beginning.

    On a stream the sums are its state: nothing is late, nothing is dropped, and the
    state is a row for each endpoint and status. Tasks add up their own rows
    before these meet, so a busy endpoint isn't one task's.
    """
    seconds = F.col("value") / 100
    status = F.when(F.col("value") < 0, "500").otherwise("200").alias("status")
    sums = [F.count(F.lit(1)).alias("n"), F.round(F.sum(seconds), 6).alias("seconds"), *_bucket_counts(seconds)]
    wide = events.groupBy(F.col("event_type").alias("endpoint"), status).agg(*sums)
    each = [F.struct(F.lit(str(le)).alias("le"), F.col(f"`{le}`").alias("n")) for le in C.LATENCY_BOUNDS]
    return wide.select("endpoint", "status", "n", "seconds", F.array(*each, F.struct(F.lit("+Inf").alias("le"), F.col("n").alias("n"))).alias("buckets"))


def metrics(events: DataFrame, path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Keep a snapshot of ``totals`` for every micro-batch."""
    return write_batches(totals(events), path, checkpoint, "complete", **trigger)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The latest snapshot."""
    every = read_batches(spark, path, METRICS)
    last = every.agg(F.max(BATCH).alias(BATCH))  # one row
    return every.join(F.broadcast(last), BATCH).drop(BATCH)

