"""How filters of documents interact: what each removes in every order, and what it removes alone.

Rows are sorted over all partitions by the fingerprint of their text, the text
and the id; a row whose predecessors hold its text with a lesser id repeats it.
Ranges are cut by fingerprint and id, so many copies of one text are spread; what
a partition begins with is compared with what earlier ones end with. Each row
comes out as a mask of the filters it fails. Counts of masks by part add up, and
every order of the filters is worked out from the 32 counts of a part.

Filters: A, too few words; B, too small a share of distinct words; C, too large a
share of ASCII capitals; D, an unwanted symbol; E, the text of a row with a
lesser id.

Defined results: a null text counts as empty, a null part as an empty string; rows
with a null id repeat nothing, aren't repeated and have no labels; rows that share
id and text don't repeat each other; a document is good or toxic if one of its
labels says so; null labels say nothing; an empty table gives no parts. Columns
other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notesift.llm.common import stored, word_lists

LETTERS = "ABCDE"
REPEATED = 1 << LETTERS.index("E")
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
INSIDE = bytes(range(0x80, 0xC0))
#: A row, or with ``begins`` set a text of a partition's first (or else last) fingerprint.
MARKED = "id long, part string, mask int, place int, run long, begins boolean, text binary"
REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def own_failures(text: bytes, min_words: int, distinct_percent: int, capital_percent: int, symbols: bytes) -> int:
    """Mask of the filters A to D that ``text`` (UTF-8) fails."""
    count, distinct = 0, set()
    for words in word_lists(text):
        count += len(words)
        distinct.update(words)
    points = len(text.translate(None, INSIDE))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    fails = (count < min_words, 100 * len(distinct) < distinct_percent * count, 100 * capitals > capital_percent * points, len(text.translate(None, symbols)) < len(text))
    return sum(1 << k for k, failed in enumerate(fails) if failed)


def marked(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
    min_words: int = 100, distinct_percent: int = 80, capital_percent: int = 10, symbols: str = "#$%&*|",
) -> DataFrame:
    """``id``, ``part`` and ``mask`` of every row of ``docs``."""
    limits = (min_words, distinct_percent, capital_percent, symbols.encode())
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part")
    ).withColumn("fp", F.xxhash64("text"))
    # the bounds of the ranges are drawn from numbers only; texts don't pass the driver
    by_id = F.col("id").asc_nulls_last()
    ranged = rows.repartitionByRange("fp", by_id).sortWithinPartitions("fp", "text", by_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        first = fp = text = head = None
        run_, mask, ending = -1, 0, []
        edges: list[tuple[int, bool, bytes]] = []
        for batch in batches:
            ids, masks, runs = batch.column("id").to_pylist(), [], []
            for id_, now, print_ in zip(ids, batch.column("text"), batch.column("fp").to_pylist(), strict=True):
                now = now.as_py()
                if first is None:
                    first = print_
                if print_ != fp:
                    fp, ending = print_, []
                if now != text:
                    text, head, run_, mask = now, None, run_ + 1, own_failures(now, *limits)
                if head is None and id_ is not None:
                    head = id_
                    ending.append((run_, False, text))
                    if fp == first:
                        edges.append((run_, True, text))
                repeats = id_ is not None and id_ > head
                masks.append(mask | REPEATED if repeats else mask)
                runs.append(run_ if fp == first and id_ is not None and not repeats else None)
            n = batch.num_rows
            none = [pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array([place] * n, pa.int32()), pa.array(runs, pa.int64()), *none], [c.split()[0] for c in MARKED.split(", ")])
        for some in (*edges, *ending):
            cells = [None, None, None, place, *some]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(cells, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], [c.split()[0] for c in MARKED.split(", ")])

    every, _ = stored(ranged.select("id", "text", "part", "fp").mapInArrow(run, MARKED), "failure-masks")
    # Of partitions that end with one text the earliest counts, so there is one row to meet for each text.
    earlier = every.where("not begins").groupBy("text").agg(F.min("place").alias("earliest"))
    repeated = every.where("begins").join(earlier, "text").where("earliest < place").select("place", "run", F.lit(REPEATED).alias("more"))
    plain = every.where("begins is null")
    open_ = plain.where("run is not null").join(repeated, ["place", "run"], "left")
    mask = F.col("mask").bitwiseOR(F.coalesce("more", F.lit(0)))
    return plain.where("run is null").select("id", "part", "mask").unionAll(open_.select("id", "part", mask.alias("mask")))


def counted(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """Documents ``n``, ``good`` and ``toxic`` ones of each ``part`` and ``mask``: counters that add up over any split of the rows."""
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long"))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(flag(good_col).alias("good"), flag(toxic_col).alias("toxic"))
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    return masks.join(known, "id", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), total("good").alias("good"), total("toxic").alias("toxic"))


def orders() -> tuple[list[str], np.ndarray, np.ndarray]:
    """All orders of the filters; for each order and step the mask of the filters before it, and its own bit."""
    names = ["".join(p) for p in permutations(LETTERS)]
    bit = np.array([[1 << LETTERS.index(x) for x in name] for name in names])
    return names, np.cumsum(bit, axis=1) - bit, bit


def report(counts: DataFrame) -> DataFrame:
    """A row of REPORT for every part, order of the filters and step, from at most 32 counters of a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, before, bit = (x if isinstance(x, list) else x.reshape(-1, 1) for x in orders())
        mask = np.arange(1 << len(LETTERS))[None, :]
        fails, earlier = (mask & bit) > 0, (mask & before) > 0
        here, steps = fails & ~earlier, len(LETTERS)
        for batch in batches:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, good, toxic = np.zeros((3, 1 << len(LETTERS)), dtype=np.int64)
                for c in cells:
                    n[c["mask"]], good[c["mask"]], toxic[c["mask"]] = c["n"], c["good"], c["toxic"]
                removed = here @ n
                over_all = {int(b): int(removed[bit.ravel() == b].sum()) for b in np.unique(bit)}
                columns = [~(fails | earlier) @ n, removed, (fails & earlier) @ n, (mask == bit) @ n, here @ good, here @ toxic, np.array([over_all[int(b)] for b in bit.ravel()])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(bit)), pa.array(np.repeat(names, steps)), pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), len(names))), *map(pa.array, columns)],
                    [c.split()[0] for c in REPORT.split(", ")],
                )

    return counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")).mapInArrow(run, REPORT)


def audit(docs: DataFrame, labels: DataFrame, **how: object) -> DataFrame:
    """The report for ``docs``, whose labels are in ``labels``; ``how`` has names of columns and limits for ``marked``."""
    return report(counted(marked(docs, **how), labels))
