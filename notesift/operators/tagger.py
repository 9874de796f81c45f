"""A softmax tagger of words on hashed features: trained over partitions, applied as a scorer.

Each epoch sums the gradients of all partitions by feature; the weights, a table of
a stated size, go out with the next job. Its sums are all the driver sees.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from notesift.functions import constants as C
from notesift.operators import evaluation
from notesift.operators.scoring import Entity, Model, Score

WORD = re.compile(r"[^\s\x1c-\x1f]+")
#: Rows of the table of weights.
BUCKETS = 1 << 14
TAGS = len(C.TAGS)
FEATURES = 11
#: Words whose gradient is worked out at a time, and rows that are prepared at a time.
WORDS, ROWS = 4096, 256
#: Words that a worker remembers the features, or the number of subwords, of.
KNOWN = 50_000
#: Subwords of a window, two of them special; words beyond it get no prediction.
WINDOW = 512


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


BIAS = _bucket("bias")
#: Where the checksums of a word with the one before it and the one after it begin.
BEFORE, AFTER = zlib.crc32(b"b "), zlib.crc32(b"c ")


def _shape(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"[0-9]", "0", word))))


@lru_cache(maxsize=KNOWN)
def _own(word: str) -> tuple[int, ...]:
    """Buckets of a word itself, its ends and its shape."""
    low = word.lower()
    return tuple(_bucket(x) for x in (f"w {low}", f"p {low[:3]}", f"s {low[-3:]}", f"f {_shape(word)}"))


@lru_cache(maxsize=KNOWN)
def _beside(low: str) -> tuple[int, ...]:
    """Buckets of a word as a neighbour."""
    return tuple(_bucket(f"{at} {low}") for at in ("-1", "-2", "+1", "+2"))


def features(words: list[str]) -> np.ndarray:
    """Buckets of each word's features: itself, its ends, its shape and its neighbours."""
    n = len(words)
    low = ["<s>", "<s>", *[w.lower() for w in words], "</s>", "</s>"]
    raw = [w.encode("utf-8", "surrogatepass") for w in low[1:-1]]
    pairs = [b" ".join(p) for p in zip(raw, raw[1:], strict=False)]
    near = np.fromiter(chain.from_iterable(map(_beside, low)), dtype=np.int64, count=4 * len(low)).reshape(-1, 4)
    out = np.empty((n, FEATURES), dtype=np.int64)
    out[:, :4] = np.fromiter(chain.from_iterable(map(_own, words)), dtype=np.int64, count=4 * n).reshape(-1, 4)
    for k, at in enumerate((1, 0, 3, 4)):
        out[:, 4 + k] = near[at : at + n, k]
    out[:, 8] = np.fromiter(map(zlib.crc32, pairs[:n], repeat(BEFORE)), dtype=np.int64, count=n)
    out[:, 9] = np.fromiter(map(zlib.crc32, pairs[1:], repeat(AFTER)), dtype=np.int64, count=n)
    out[:, 8:10] %= BUCKETS
    out[:, 10] = BIAS
    return out


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradient(weights: np.ndarray, x: np.ndarray, tags: np.ndarray, class_weights: np.ndarray, into: np.ndarray) -> tuple[float, float]:
    """Adds the gradient of the weighted cross-entropy of words with features ``x`` to ``into``; their loss and the sum of their weights."""
    p = softmax(weights[x].sum(axis=1))
    w = class_weights[tags]
    rows = np.arange(len(tags))
    loss = float(-(w * np.log(np.maximum(p[rows, tags], 1e-12))).sum())
    p[rows, tags] -= 1
    at = x.ravel()
    for k in range(TAGS):
        into[:, k] += np.bincount(at, np.repeat(p[:, k] * w, x.shape[1]), BUCKETS)
    return loss, float(w.sum())


def prepared(records: DataFrame) -> DataFrame:
    """``doc_id``, ``tokens`` and ``tag_ids`` of ``records`` and ``x``, the features of their words as 16-bit numbers: worked out once, not in each epoch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (some.slice(at, ROWS) for some in batches for at in range(0, some.num_rows, ROWS)):
            x = [features(words or []).astype("<u2").tobytes() for words in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x, pa.binary())], [*batch.schema.names, "x"])

    rows = records.select("doc_id", "tokens", "tag_ids")
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("x", BinaryType())]))


def _unpacked(x: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(x), dtype="<u2").reshape(-1, FEATURES).astype(np.int64)


@dataclass
class Adam:
    """Adaptive steps with a linear warm-up and a linear decay."""

    rate: float
    warm: int
    total: int
    at: int = 0
    m: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, TAGS)))
    v: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, TAGS)))

    def step(self, weights: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.at += 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g * g
        by = self.at / self.warm if self.at <= self.warm else max((self.total - self.at + 1) / (self.total - self.warm + 1), 0.0)
        return weights - self.rate * by * (self.m / (1 - 0.9**self.at)) / (np.sqrt(self.v / (1 - 0.999**self.at)) + 1e-8)


def summed(records: DataFrame, weights: np.ndarray, class_weights: np.ndarray) -> tuple[np.ndarray, float]:
    """Mean gradient and loss over all ``records`` (``x``, ``tag_ids``): sums by feature within partitions, then over them."""
    sent = records.sparkSession.sparkContext.broadcast((weights, class_weights))  # BUCKETS x TAGS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, by = sent.value
        into, loss, total = np.zeros_like(w), 0.0, 0.0
        for batch in (some.slice(at, ROWS) for some in batches for at in range(0, some.num_rows, ROWS)):
            x, tags = _unpacked(batch.column(0).to_pylist()), batch.column(1).flatten().to_numpy()
            for at in range(0, len(x), WORDS):
                some = gradient(w, x[at : at + WORDS], tags[at : at + WORDS], by, into)
                loss, total = loss + some[0], total + some[1]
        hit = np.flatnonzero(into.any(axis=1))
        sums = [np.append(into[hit, k], loss if k == 0 else total if k == 1 else 0.0) for k in range(TAGS)]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1)), *map(pa.array, sums)], ["feature", *[f"g{k}" for k in range(TAGS)]])

    columns = [f"g{k}" for k in range(TAGS)]
    rows = records.select("x", "tag_ids").mapInArrow(run, "feature long, " + ", ".join(f"{c} double" for c in columns))
    got = rows.groupBy("feature").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()  # at most BUCKETS + 1 rows
    sent.destroy()
    feature, values = got.column(0).to_numpy(), np.stack([got.column(c).to_numpy() for c in columns], axis=1)
    loss, total = values[feature == -1][:, :2].sum(axis=0)
    g = np.zeros_like(weights)
    g[feature[feature >= 0]] = values[feature >= 0]
    return g / max(total, 1e-12), float(loss / max(total, 1e-12))


def tagged(records: DataFrame, weights: np.ndarray) -> DataFrame:
    """``doc_id``, ``pos``, ``token``, ``true_id``, ``pred_id`` and ``conf`` of every word of ``records``."""
    records = records if "x" in records.columns else prepared(records)
    sent = records.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (some.slice(at, ROWS) for some in batches for at in range(0, some.num_rows, ROWS)):
            x, sizes = _unpacked(batch.column(3).to_pylist()), [len(words or []) for words in batch.column(1).to_pylist()]
            if not len(x):
                continue
            p = np.concatenate([softmax(sent.value[x[at : at + WORDS]].sum(axis=1)) for at in range(0, len(x), WORDS)])
            pos = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
            docs = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), sizes)))
            cells = [docs, pa.array(pos), batch.column(1).flatten(), batch.column(2).flatten(), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(p.max(axis=1))]
            yield pa.RecordBatch.from_arrays(cells, ["doc_id", "pos", "token", "true_id", "pred_id", "conf"])

    return records.select("doc_id", "tokens", "tag_ids", "x").mapInArrow(run, "doc_id long, pos int, token string, true_id int, pred_id int, conf double")


@dataclass
class Trained:
    """The weights with the best F1 on the validation split, and what happened in each epoch."""

    weights: np.ndarray
    history: list[tuple[int, float, float]]

    @property
    def best(self) -> float:
        return max((f1 for _, _, f1 in self.history), default=0.0)


def trained(train: DataFrame, val: DataFrame, class_weights: list[float] | None = None, epochs: int = 10, rate: float = 0.5, patience: int = 3) -> Trained:
    """Weights fitted to ``train``; stops when F1 on ``val`` hasn't grown for ``patience`` epochs. Both have ``doc_id``, ``tokens``, ``tag_ids``."""
    by = np.array(class_weights if class_weights is not None else [1.0] * TAGS)
    weights = np.zeros((BUCKETS, TAGS))
    optimizer = Adam(rate, max(epochs // 10, 1), epochs)
    best, out, waited = -1.0, Trained(weights, []), 0
    train, val = (prepared(some).persist(StorageLevel.DISK_ONLY) for some in (train, val))  # no executor's memory holds what each epoch reads
    for epoch in range(1, epochs + 1):
        g, loss = summed(train, weights, by)
        weights = optimizer.step(weights, g)
        f1 = evaluation.ner_prf(tagged(val, weights)).first().f1
        out.history.append((epoch, loss, f1))
        waited += 1
        if f1 > best:
            best, out.weights, waited = f1, weights, 0
        if waited >= patience:
            break
    train.unpersist()
    val.unpersist()
    return out


def in_window(words: list[str], size: Callable[[str], int]) -> int:
    """How many words begin within the window of subwords; ``size`` says how many a word has."""
    n = at = 0
    for k, word in enumerate(words[:WINDOW], 1):
        if at >= WINDOW - 2:
            break
        if some := size(word):
            n, at = k, at + some
    return n


def merged(text: str, spans: list[tuple[int, int]], tags: list[str], confidence: list[float]) -> list[Entity]:
    """Entities of a tagged text: an I goes on only after its own label; the least confidence counts."""
    out, now = [], None
    for (start, end), tag, conf in zip(spans, tags, confidence, strict=True):
        if tag.startswith("B-"):
            now = [[text[start:end]], tag[2:], start, end, conf]
            out.append(now)
        elif now and tag == f"I-{now[1]}":
            now[0].append(text[start:end])
            now[3], now[4] = end, min(now[4], conf)
        else:
            now = None
    return [(" ".join(w), label, a, b, float(c)) for w, label, a, b, c in out]


def model(weights: np.ndarray, tokenizer_path: str, name: str) -> Model:
    """A scorer of ``weights``; the tokenizer's file must be where the workers run."""
    small = weights.astype(np.float32)

    def load() -> Score:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)

        @lru_cache(maxsize=KNOWN)
        def size(word: str) -> int:
            # a word is cut by itself, whatever stands beside it
            return len(tokenizer.encode([word], is_pretokenized=True, add_special_tokens=False).ids)

        def score(texts: list[str], attempt: int) -> list[list[Entity]]:
            found = []
            for text in texts:
                spans = [m.span() for m in islice(WORD.finditer(text), WINDOW)]  # each has a subword at least
                words = [text[a:b] for a, b in spans]
                n = in_window(words, size)
                p = softmax(small[features(words[:n])].sum(axis=1)) if n else np.zeros((0, TAGS))
                found.append(merged(text, spans[:n], [C.TAGS[k] for k in p.argmax(axis=1)], p.max(axis=1).tolist()) if n else [])
            return found

        return score

    return Model(name, load)
