"""Fill-in-middle transformation of whole documents.

A text is cut into units, runs of ASCII letters or single other code points. Two
hashed places among them part it into prefix, middle and suffix, which are put in
another order behind marks, so that a model trained left to right learns to fill
the middle in. One kernel handles all rows of a piece of an Arrow batch: a table
gives each byte's class, a byte begins a unit by its class and its predecessor's,
cumulative sums that start anew with each document number units and code points,
and one search finds the cuts of all rows.

Defined results: a null text counts as empty; an empty text, and one that holds a
mark, stays plain; a null id has no digits and is hashed as such; repeated rows
come back as often as they went in, each alike; an empty table gives an empty
result; a text of any length is cut as a whole, and pieces of a batch bound the
memory for others. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKS = ("<P>", "<S>", "<M>")
SCHEMA = "id long, n long, form string, prefix_chars long, middle_chars long, fim string"
#: Bytes of text that the kernel takes at once (one text at least).
PIECE = 1 << 22
INSIDE, OTHER, LETTER = 0, 1, 2
#: Class of each byte: inside a code point, the first of one, or a letter.
CLASS = np.full(256, OTHER, dtype=np.uint8)
CLASS[0x80:0xC0] = INSIDE
CLASS[ord("A") : ord("Z") + 1] = CLASS[ord("a") : ord("z") + 1] = LETTER


def draws(ids: list[int | None], seed: str) -> np.ndarray:
    """Four unsigned numbers of 32 bits for each id, from the digest of the seed and the id."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(digests, dtype=">u4").astype(np.int64).reshape(-1, 4)


def cuts(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
    """Units of each text, the bytes where its middle begins and ends, and the code points of prefix and middle.

    ``data`` has the bytes of all texts, ``offsets`` where each begins and the last
    ends; of n units the middle lies between ``first`` and ``second`` modulo n + 1.
    """
    kind = CLASS[data]
    begins = kind != INSIDE
    points = np.concatenate([[0], np.cumsum(begins)])
    same_run = (kind[1:] == LETTER) & (kind[:-1] == LETTER)
    begins[1:] &= ~same_run
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[heads] = True  # a text doesn't go on with the run of the one before it
    units = np.cumsum(begins)
    before = np.concatenate([[0], units])[offsets]  # what the sums of each text start from
    n = np.diff(before)
    a, b = first % (n + 1), second % (n + 1)

    def place(k: np.ndarray) -> np.ndarray:
        """The byte where the text's unit ``k`` begins, or its end."""
        return np.where(k == n, offsets[1:], np.searchsorted(units, before[:-1] + k + 1))

    low, high = place(np.minimum(a, b)), place(np.maximum(a, b))
    return n, low, high, points[low] - points[offsets[:-1]], points[high] - points[low]


def arranged(ids: pa.Array, texts: pa.Array, seed: str, plain_percent: int, spm_percent: int) -> pa.RecordBatch:
    """The rows of SCHEMA for ``texts``, which has no nulls."""
    texts = pa.concat_arrays([texts])  # its buffers begin with the first row
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data or b"", dtype=np.uint8)[: offsets[-1]]
    data, offsets = data[offsets[0] :], offsets - offsets[0]
    h = draws(ids.to_pylist(), seed)
    n, low, high, prefix, middle = cuts(data, offsets, h[:, 0], h[:, 1])

    marked = np.zeros(len(texts), dtype=bool)
    for mark in MARKS:
        marked |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
    plain = (n == 0) | marked | (h[:, 2] % 100 >= 100 - plain_percent)
    spm = h[:, 3] % 100 < spm_percent

    # prefix, middle and suffix of all rows as one array over the same bytes
    ends = np.concatenate([np.stack([offsets[:-1], low, high], axis=1).ravel(), offsets[-1:]]).astype(np.int32)
    parts = pa.Array.from_buffers(pa.string(), 3 * len(texts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    pre, mid, suf = (parts.take(pa.array(np.arange(k, 3 * len(texts), 3))) for k in range(3))
    p, s, m = MARKS
    psm = pc.binary_join_element_wise(p, pre, s, suf, m, mid, "")
    out = pc.if_else(pa.array(plain), texts, pc.if_else(pa.array(spm), pc.binary_join_element_wise(s, suf, p, pre, m, mid, ""), psm))
    form = pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")), pa.string())
    counts = [pa.array(x, pa.int64(), mask=plain) for x in (prefix, middle)]
    return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(n, pa.int64()), form, *counts, out], ["id", "n", "form", "prefix_chars", "middle_chars", "fim"])


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """The rearranged text ``fim`` of every row with its ``form``, number of units and sizes; nothing is shuffled.

    ``plain_percent`` of the documents stay as they are; of the others
    ``spm_percent`` begin with the suffix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), pc.fill_null(batch.column(1), "")
            total = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(texts):
                done = total[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(total, done + PIECE, side="right")))
                yield arranged(ids.slice(at, end - at), texts.slice(at, end - at), seed, plain_percent, spm_percent)
                at = end

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def restored(fim: Column, form: Column) -> Column:
    """The text from which ``fim`` was made. Marks don't occur in texts that were rearranged, so each stands once."""
    p, s, m = MARKS

    def between(before: str, after: str) -> Column:
        return F.substring_index(F.substring_index(fim, after, 1), before, -1)

    middle = F.substring_index(fim, m, -1)
    psm, spm = F.concat(between(p, s), middle, between(s, m)), F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "plain", fim).when(form == "psm", psm).otherwise(spm)
