"""A bounded sample of labelled rows, and a model fitted on it in one task."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: Column, fold: int = 5) -> Column:
    """Rows whose crc32 of the id as text is divisible by ``fold`` are never learned from; a null id isn't held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % fold == 0, F.lit(False))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int, id_col: str = "doc_id", text_col: str = "text", fold: int = 5
) -> DataFrame:
    """``id``, ``text``, ``label`` of at most ``max_rows`` documents outside the held-out fold.

    The sample is chosen among the labels by the hash of the id, before any text
    is read. Null ids and labels are left out; of repeated ids one row counts.
    """
    chosen = (
        labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
        .where("id is not null and label is not null")
        .where(~held_out(F.col("id"), fold))
        .groupBy("id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_rows)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # broadcast: at most max_rows rows of two numbers
    return texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))


def fitted(sample: DataFrame, fit: Callable[..., Any], columns: tuple[str, ...] = ("text", "label")) -> Any:
    """``fit`` of the lists of ``columns`` of the whole sample by id, run on an executor; None without rows."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        return pd.DataFrame({"model": [pickle.dumps(fit(*[rows[c].tolist() for c in columns]))]})

    got = sample.withColumn("one task", F.lit(1)).groupBy("one task").applyInPandas(run, "model binary").collect()
    return pickle.loads(bytes(got[0].model)) if got else None
