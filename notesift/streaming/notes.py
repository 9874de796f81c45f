"""The document path and the request metrics on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from notesift.operators import notes as document_path
from notesift.sources.jsonl import NOTE


def read(spark: SparkSession, path: str) -> DataFrame:
    """Notes as their files arrive."""
    rows = spark.readStream.schema(NOTE).json(path)
    return rows.withColumnRenamed("document_id", "doc_id")


def run(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Output documents, written as JSON lines; each row is worked on by itself, so there is no state."""
    return document_path.run(rows).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def request_counts(events: DataFrame, late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """Requests by endpoint in tumbling windows; what is later than ``late`` is dropped."""
    live = events.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs one with a zone
    return live.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n"))
