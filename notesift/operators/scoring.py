"""Scorers that run a model on executors, with retries by row and counters that come from the run itself.

A scorer is loaded once for each Python worker. It takes a list of texts and the
number of the attempt, and gives a list of entities for each text. A batch that
raises is halved until the row that raises is found; that row is tried by itself
up to ``attempts`` times, and its last error is kept beside the others' results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from notesift.functions import kernel
from notesift.functions import constants as C

#: text, label, start, end, confidence
Entity = tuple[str, str, int, int, float]
Score = Callable[[list[str], int], list[list[Entity]]]
ENTITY = StructType([StructField(n, t) for n, t in (("text", StringType()), ("label", StringType()), ("start", IntegerType()), ("end", IntegerType()), ("ord", IntegerType()), ("confidence", DoubleType()), ("source", StringType()))])
OUTPUT = StructType([StructField("model", ArrayType(ENTITY)), StructField("error", StringType()), StructField("attempts", IntegerType())])
KIND = pa.struct([("text", pa.string()), ("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("ord", pa.int32()), ("confidence", pa.float64()), ("source", pa.string())])
#: Rows that are scored at a time: what Python holds of a batch follows from these, but for the least number of texts that a model is given.
ROWS = 256
#: Scorers that this worker has loaded, by name.
LOADED: dict[str, Score] = {}


@dataclass(frozen=True)
class Model:
    """``load`` makes the scorer on a worker; ``name`` tells models apart there."""

    name: str
    load: Callable[[], Score]

    def scorer(self) -> Score:
        if self.name not in LOADED:
            LOADED[self.name] = self.load()
        return LOADED[self.name]


def tried(score: Score, texts: Sequence[str], attempts: int) -> list[tuple[list[Entity] | None, str | None, int]]:
    """Entities, error and number of attempts for each text."""
    if not texts:
        return []
    if len(texts) > 1:
        try:
            return [(found, None, 1) for found in score(list(texts), 1)]
        except Exception:  # noqa: BLE001  any error of a model belongs to a row, which is looked for
            half = len(texts) // 2
            return tried(score, texts[:half], attempts) + tried(score, texts[half:], attempts)
    error = None
    for attempt in range(1, attempts + 1):
        try:
            return [(score(list(texts), attempt)[0], None, attempt)]
        except Exception as e:  # noqa: BLE001
            error = f"{type(e).__name__}: {e}"
    return [(None, error, attempts)]


def scored(notes: DataFrame, model: Model, text_col: str = "cleaned_text", attempts: int = 3, batch: int = 64) -> DataFrame:
    """``notes`` with ``model`` (its entities; none for a row that failed), ``error`` and ``attempts``.

    Blank and null texts aren't given to the model: they have no attempts and no error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for rows in (some.slice(at, ROWS) for some in batches for at in range(0, some.num_rows, ROWS)):
            texts = rows.column(rows.schema.get_field_index(text_col)).to_pylist()
            full = [k for k, t in enumerate(texts) if t and t.strip()]
            out: list[tuple[list[Entity] | None, str | None, int]] = [([], None, 0)] * len(texts)
            for at in range(0, len(full), batch):
                some = full[at : at + batch]
                for k, got in zip(some, tried(score, [texts[k] for k in some], attempts), strict=True):
                    out[k] = got
            cells = [
                [dict(zip(("text", "label", "start", "end", "confidence", "ord", "source"), (*e, 0, "model"), strict=True)) for e in found or []] for found, _, _ in out
            ]
            added = [pa.array(cells, pa.list_(KIND)), pa.array([e for _, e, _ in out], pa.string()), pa.array([n for _, _, n in out], pa.int32())]
            yield pa.RecordBatch.from_arrays([*rows.columns, *added], [*rows.schema.names, "model", "error", "attempts"])

    schema = StructType([*notes.schema.fields, *OUTPUT.fields])
    return notes.mapInArrow(run, schema)


def outcome() -> Column:
    """``failed`` for blank texts and rows whose attempts are used up."""
    return F.when((F.col("attempts") == 0) | F.col("error").isNotNull(), "failed").otherwise("success")


def counters() -> list[Column]:
    """Totals of a scored batch: every attempt after a row's first is a retry."""
    count = lambda s: F.count_if(outcome() == s)
    retried = F.coalesce(F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))), F.lit(0)).cast("long")
    return [F.count(F.lit(1)).alias("total"), count("success").alias("success"), count("failed").alias("failed"), retried.alias("retried")]


def batch_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(*counters())


def observed(rows: DataFrame, name: str = "batch") -> tuple[DataFrame, Observation]:
    """``rows`` and the counters of the job that will write them: no second pass."""
    seen = Observation(name)
    return rows.observe(seen, *counters()), seen


def retries(rows: DataFrame) -> DataFrame:
    """How many rows took how many attempts, by outcome and error."""
    return rows.groupBy("attempts", outcome().alias("status"), "error").agg(F.count(F.lit(1)).alias("n"))


def log_events(rows: DataFrame, attempts: int = 3) -> DataFrame:
    """What the log says of a batch: retries, failures, skipped and processed documents."""
    failed = F.col("error").isNotNull()
    tries = F.transform(F.sequence(F.lit(1), F.greatest(F.col("attempts") - 1, F.lit(1))), lambda k: F.struct(F.lit("ERROR").alias("level"), F.lit("document_retry").alias("event"), k.alias("attempt"), F.col("error").alias("error")))
    none = F.array().cast("array<struct<level:string,event:string,attempt:int,error:string>>")
    last = (
        F.when(F.col("attempts") == 0, F.struct(F.lit("WARNING").alias("level"), F.lit("document_skipped").alias("event"), F.lit(None).cast("int").alias("attempt"), F.lit("empty text").alias("error")))
        .when(failed, F.struct(F.lit("ERROR").alias("level"), F.lit("document_failed").alias("event"), F.lit(attempts).alias("attempt"), F.col("error").alias("error")))
        .otherwise(F.struct(F.lit("INFO").alias("level"), F.lit("document_processed").alias("event"), F.lit(None).cast("int").alias("attempt"), F.lit(None).cast("string").alias("error")))
    )
    events = F.concat(F.when(F.col("attempts") > 1, tries).otherwise(none), F.array(last))
    return rows.select("doc_id", F.posexplode(events).alias("ord", "e")).select("doc_id", "ord", "e.*")


def terms_that_fail(always: int = 7, once: int = 5) -> Score:
    """A scorer for trials: dictionary terms, but texts whose length is divisible by ``always`` fail, those by ``once`` on their first attempt."""
    keys = tuple(C.MEDICATIONS[:12])

    def score(texts: list[str], attempt: int) -> list[list[Entity]]:
        for t in texts:
            if len(t) % always == 0:
                raise ValueError("length not supported")
            if len(t) % once == 0 and attempt == 1:
                raise TimeoutError("first attempt")
        return [[(t[a:b], "MEDICATION", a, b, 0.97) for a, b, _ in kernel.occurrences(t, keys, True, False)] for t in texts]

    return score


TRIAL = Model("terms that fail", terms_that_fail)

