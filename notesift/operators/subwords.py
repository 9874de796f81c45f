"""Training rows of subwords: words cut by a tokenizer, with the labels of their first subwords."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notesift.functions import constants as C

#: Places of rows that are made at a time.
PLACES = 1 << 18
ROW = "doc_id long, input_ids array<int>, attention_mask array<int>, word_ids array<int>, labels array<int>, words_cut int"


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def framed(ids: list[int], words: list[int], tags: list[int], frame: tuple[int, int, int], size: int) -> tuple[list[int], list[int], list[int | None], list[int]]:
    """One row of ``size`` places: begin, as many subwords as fit, end, padding; a word's tag stands at its first subword, elsewhere the ignored id."""
    begin, end, pad = frame
    ids, words = ids[: size - 2], words[: size - 2]
    labels = [tags[w] if k == 0 or words[k - 1] != w else C.IGNORED for k, w in enumerate(words)]
    rest = size - 2 - len(ids)
    return [begin, *ids, end] + [pad] * rest, [1] * (len(ids) + 2) + [0] * rest, [None, *words, None] + [None] * rest, [C.IGNORED, *labels, C.IGNORED] + [C.IGNORED] * rest


def dataset(records: DataFrame, tokenizer_path: str, frame: tuple[int, int, int], size: int = 512) -> DataFrame:
    """A row for each of ``records`` (``doc_id``, ``tokens``, ``tag_ids``); ``words_cut`` don't begin within it.

    ``frame`` has the ids that begin, end and pad a row. The tokenizer's file must be
    where the workers run. A word without subwords has no place.
    """

    rows = max(PLACES // size, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(tokenizer_path)
        for batch in (some.slice(at, rows) for some in batches for at in range(0, some.num_rows, rows)):
            docs, words, tags = (batch.column(k).to_pylist() for k in range(3))
            made = []
            for w, t in zip(words, tags, strict=True):
                got = encoder.encode(w or [], is_pretokenized=True, add_special_tokens=False)
                row = framed(got.ids, got.word_ids, t or [], frame, size)
                made.append((*row, len(set(got.word_ids)) - len(set(row[2]) - {None})))
            cells = [pa.array([m[k] for m in made], pa.list_(pa.int32())) for k in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), *cells, pa.array([m[4] for m in made], pa.int32())], [c.split()[0] for c in ROW.split(", ")])

    return records.select("doc_id", "tokens", "tag_ids").mapInArrow(run, ROW)


def placed(rows: DataFrame) -> DataFrame:
    """``doc_id``, ``pos``, ``word_id`` and ``label`` of every place that isn't padding: what word-level predictions are read from."""
    each = rows.select("doc_id", F.posexplode(F.arrays_zip("attention_mask", "word_ids", "labels")).alias("pos", "x"))
    return each.where("x.attention_mask = 1").select("doc_id", "pos", F.col("x.word_ids").alias("word_id"), F.col("x.labels").alias("label"))
