"""JSON lines in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NOTE = "document_id string, note_type string, text string"
ANNOTATION = "document_id string, entities array<struct<text:string,label:string,start:int,end:int>>"
BIO = "document_id string, note_type string, tokens array<string>, tags array<string>, tag_ids array<int>, char_offsets array<array<int>>"


def read(spark: SparkSession, path: str, schema: str = NOTE) -> DataFrame:
    return spark.read.schema(schema).json(path)


def parsed(lines: DataFrame, schema: str = NOTE) -> DataFrame:
    """The fields of JSON lines (the column ``value``); of a line that isn't JSON of this kind ``bad`` is the text, and the fields are null."""
    got = F.from_json("value", f"{schema}, bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    return lines.where(F.trim("value") != "").select(*[c for c in lines.columns if c != "value"], got.alias("r")).select(*[c for c in lines.columns if c != "value"], "r.*")


def line_counts(rows: DataFrame) -> DataFrame:
    """Good and bad lines of what ``parsed`` gives."""
    return rows.agg(F.count_if(F.col("bad").isNull()).alias("good"), F.count_if(F.col("bad").isNotNull()).alias("bad"))


def read_lines(spark: SparkSession, path: str, schema: str = NOTE) -> DataFrame:
    """Files of JSON lines, bad ones kept aside in ``bad``."""
    return parsed(spark.read.text(path), schema)


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with equal keys the last by ``order``, as loading into a dictionary would leave."""
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("rn", F.row_number().over(newest)).where("rn = 1").drop("rn")


def with_ids(rows: DataFrame, order: str) -> DataFrame:
    """Defaults of a batch: a missing id is ``doc_`` and the row's number, a missing text is empty."""
    return rows.withColumn("document_id", F.coalesce("document_id", F.concat(F.lit("doc_"), F.col(order).cast("string")))).withColumn("text", F.coalesce("text", F.lit("")))


def write(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_dataset(generated: DataFrame, path: str) -> DataFrame:
    """Two files, notes and annotations, and the counts of labels."""
    keyed = generated.withColumnRenamed("doc_id", "document_id")
    write(keyed.select("document_id", "note_type", "text"), f"{path}/notes.jsonl")
    write(keyed.select("document_id", "entities"), f"{path}/annotations.jsonl")
    return label_counts(generated)


def label_counts(generated: DataFrame) -> DataFrame:
    return generated.select(F.explode("entities").alias("e")).groupBy("e.label").agg(F.count(F.lit(1)).alias("n"))


def write_splits(records: DataFrame, splits: DataFrame, path: str) -> None:
    records.join(splits, "doc_id").write.mode("overwrite").partitionBy("split").json(path)


def report(*parts: DataFrame, names: list[str]) -> DataFrame:
    """One JSON row of small result tables (scores, counts, top lists)."""
    cells = [p.agg(F.collect_list(F.struct(*p.columns)).alias(n)) for p, n in zip(parts, names, strict=True)]
    out = cells[0]
    for c in cells[1:]:
        out = out.crossJoin(c)  # one row each
    return out.select(F.to_json(F.struct(*names)).alias("report"))
