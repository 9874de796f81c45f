"""Packing of tokenised documents into sequences of a fixed capacity.

Only lengths matter for the packing, and a length is at most the capacity, so the
plan is made from a histogram of at most ``capacity`` counts. Exact complements
go first: for the longest length left, a single, a pair or a triple of lengths
whose sum is exactly the gap is consumed as often as the counts allow. What has
no exact complement left is placed best-fit, longest first. Exact fits may use up
short lengths that others need more, so plans are made with exact complements of
all lengths, of those over half the capacity, and of none, and the one with the
fewest sequences is taken: it never has more than best fit alone. The plan says
which ranks of each length go to which sequences; the pieces take their places
by rank.

Defined results: a null text counts as empty and still has its end token; every
row, repeated ones too, is packed by itself; a null id is kept; an empty table
gives no pieces. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notesift.llm.common import stored

# Fixed value: how a byte-level pre-tokenizer cuts texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_spellings() -> dict[str, int]:
    """The character that spells each byte in a byte-level vocabulary: itself if it can be seen, else one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


def ranked(spec: dict) -> dict[bytes, int] | None:
    """Ranks of byte strings if ids follow the order of merges, so that merging by rank gives the tokenizer's ids; else None."""
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or spec["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        return None
    pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
    made, spelt = [a + b for a, b in pairs], byte_spellings()
    ids = [model["vocab"].get(x, -1) for x in made]
    if any(x >= y for x, y in zip(ids, ids[1:], strict=False)) or any(c not in model["vocab"] for c in spelt):
        return None
    return {bytes(spelt[c] for c in x): model["vocab"][x] for x in (*spelt, *made)}


class Encoder:
    """Token ids of texts, as little-endian unsigned 32-bit integers, equal to those of the tokenizer at ``path``.

    Where merging by rank is the same, the library for ranked vocabularies does it,
    in less than half the time; texts with the spelling of an added token, and all
    texts of other vocabularies, go to the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.added = [x["content"] for x in spec["added_tokens"]]
        ranks = ranked(spec)
        self.fast = tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None

    def encode(self, text: str) -> bytes:
        if self.fast is None or any(x in text for x in self.added):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids, dtype="<u4").tobytes()


@cache
def worker_encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """A row for each piece: ``id``, ``piece``, ``start``, ``length``, ``crc`` and, if asked for, its ``ids`` (binary).

    Longer documents are cut into pieces of ``capacity`` tokens, the first of
    which may be shorter. ``tokenizer`` is the path of a tokenizers file.
    """
    schema = "id long, piece int, start long, length long, crc long" + ", ids binary" * with_ids
    last = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = encoder.encode(text or "") + last
                    n = len(ids) // 4
                    edge = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for k in range(len(edge) - 1):
                        own = ids[4 * edge[k] : 4 * edge[k + 1]]
                        rows.append((key, k, edge[k], edge[k + 1] - edge[k], zlib.crc32(own), own)[: 5 + with_ids])
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                columns = list(zip(*rows, strict=True)) or [()] * (5 + with_ids)
                names = ["id", "piece", "start", "length", "crc", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], names[: 5 + with_ids])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in a sequence) and how many sequences have each; every length is used as often as it occurs."""
    plans = [plan_above(counts, capacity, least) for least in (0, capacity // 2, capacity)]
    return min(plans, key=lambda p: sum(n for _, n in p))


def plan_above(counts: dict[int, int], capacity: int, least: int) -> list[tuple[tuple[int, ...], int]]:
    """The plan with exact complements of lengths above ``least`` only."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    out: list[tuple[tuple[int, ...], int]] = []
    have = left > 0
    #: Sums that a pair may still make; availability only falls, so a sum that fails once is done.
    pair_sums = np.convolve(have, have)[: capacity + 1] > 0

    def times(pattern: tuple[int, ...]) -> int:
        need = defaultdict(int)
        for x in pattern:
            need[x] += 1
        return min(int(left[x]) // n for x, n in need.items())

    def take(pattern: tuple[int, ...]) -> int:
        n = times(pattern)
        for x in pattern if n else ():
            left[x] -= n
        if n:
            out.append((pattern, n))
        return n

    def pairs(total: int, with_: tuple[int, ...]) -> tuple[int, ...] | None:
        low = np.arange(1, total // 2 + 1)
        for b in low[(left[low] > 0) & (left[total - low] > 0)].tolist():
            if times((*with_, total - b, b)):
                return total - b, b
        return None

    def complement(length: int) -> tuple[int, ...] | None:
        gap = capacity - length
        if gap and times((length, gap)):
            return (gap,)
        if gap > 1 and pair_sums[gap]:
            if found := pairs(gap, (length,)):
                return found
        third = np.arange(gap - 2, 0, -1)
        for a in third[(left[third] > 0) & pair_sums[gap - third]].tolist():
            if found := pairs(gap - a, (length, a)):
                return (a, *found)
            if pairs(gap - a, ()) is None:
                pair_sums[gap - a] = False
        return None

    take((capacity,))
    for length in range(capacity - 1, least, -1):
        while left[length] and (found := complement(length)):
            take((length, *found))

    # best-fit decreasing: groups of equal sequences by the gap that they have left
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            gap = next((g for g in range(length, capacity) if open_.get(g)), None)
            if gap is None:
                each = min(n, capacity // length)
                made = n // each
                open_[capacity - each * length].append(((length,) * each, made))
                n -= made * each
            else:
                pattern, m = open_[gap].pop()
                used = min(n, m)
                if m > used:
                    open_[gap].append((pattern, m - used))
                open_[gap - length].append(((*pattern, length), used))
                n -= used
    return out + [x for group in open_.values() for x in group]


def pack(found: DataFrame, capacity: int = 2048) -> DataFrame:
    """``found`` (as from ``pieces``, stored) with ``sequence_id`` and ``offset``.

    Ranks are counted within a length and one of several salts, so that a length
    that many pieces have is not one task.
    """
    spark = found.sparkSession
    n = found.count()
    salts = 32 + n // 1_000_000
    salted = found.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "crc"), F.lit(salts)).cast("int"))
    cells = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    runs, used, sequence = [], defaultdict(int), 0
    for pattern, m in plan(counts, capacity):
        for length, offset in zip(pattern, accumulate(pattern, initial=0), strict=False):
            runs.append((length, used[length], used[length] + m, sequence, offset))
            used[length] += m
        sequence += m
    places = spark.createDataFrame(runs, "length long, lo long, hi long, first long, offset long")

    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece", "crc")) - 1)
    ranked = ranked.join(cells, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    # the plan's size follows the capacity, not the data
    joined = ranked.alias("r").join(F.broadcast(places.alias("p")), F.expr("r.length = p.length and r.rank >= p.lo and r.rank < p.hi"))
    own = [f"r.{c}" for c in found.columns]
    return joined.select(*own, F.expr("p.first + r.rank - p.lo").alias("sequence_id"), F.col("p.offset").alias("offset"))


def packed(docs: DataFrame, tokenizer: str, capacity: int = 2048, **kw) -> DataFrame:
    """Tokenise, cut and pack ``docs``."""
    found, _ = stored(pieces(docs, tokenizer, capacity, **kw), "pieces")
    return pack(found, capacity)
