"""Quality of documents: random-indexing word vectors and a two-layer network.

A term's vector is the sum of its own sparse random index vector and those of
its neighbours, over the sample; a document's is the mean over its terms. Terms
are words, runs of other marks, and classes that also words never seen have
(capitals, digits, a repeated word). The network has one hidden layer, and a
temperature fitted on rows that it wasn't trained on calibrates its probability.

Defined results: null and empty texts have the zero vector and get that vector's
score; without any labelled row every score is 0.5; null ids are kept; repeated
rows are scored each by itself; an empty table gives no rows. Columns other than
the id and the text are not read, and labels are never inputs of a score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notesift.llm.training import fitted, labelled_sample

TERM = re.compile(r"\w+|[^\w\s]+")
#: Classes that every term may have besides itself.
CAPITALS, DIGITS, REPEATED, LONG, UNKNOWN = "<capitals>", "<digits>", "<repeated>", "<long>", "<unknown>"
CLASSES = (UNKNOWN, CAPITALS, DIGITS, REPEATED, LONG)


@dataclass
class Model:
    index: dict[str, int]
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    temperature: float


def terms(text: str) -> list[str]:
    return TERM.findall(text)


def index_vector(term: str, size: int, nonzero: int = 8) -> np.ndarray:
    """A sparse vector of ones and minus ones that only the term decides."""
    rng = np.random.default_rng(zlib.crc32(term.encode("utf-8", "surrogatepass")))
    out = np.zeros(size, dtype=np.float32)
    out[rng.choice(size, nonzero, replace=False)] = rng.choice((-1.0, 1.0), nonzero)
    return out


def _classes(found: list[str]) -> list[int]:
    """How often each class of CLASSES but the first occurs."""
    low = list(map(str.lower, found))
    return [
        sum(1 for x in found if len(x) > 1 and x.isupper()),
        sum(1 for x in found if x.isdigit()),
        sum(1 for a, b in zip(low, low[1:], strict=False) if a == b),
        sum(1 for x in found if len(x) > 24),
    ]


def pooled(text: str | None, index: dict[str, int], vectors: np.ndarray) -> np.ndarray:
    found = terms(text or "")
    if not found:
        return np.zeros(vectors.shape[1])
    ids, n = np.unique(np.fromiter((index.get(x, 0) for x in map(str.lower, found)), dtype=np.int64, count=len(found)), return_counts=True)
    total = n.astype(np.float32) @ vectors[ids]
    total = total + np.array(_classes(found), dtype=np.float32) @ vectors[1 : len(CLASSES)]
    return total / len(found)


def _vectors(docs: list[list[str]], size: int, least: int, most: int) -> tuple[dict[str, int], np.ndarray]:
    seen = Counter(t for d in docs for t in set(d))
    kept = [t for t, n in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:most] if n >= least]
    names = [*CLASSES, *kept]
    index = {t: k for k, t in enumerate(names)}
    own = np.stack([index_vector(t, size) for t in names])
    context = np.zeros_like(own)
    for d in docs:
        ids = np.fromiter((index.get(x, 0) for x in d), dtype=np.int64, count=len(d))
        for step in (1, 2):
            np.add.at(context, ids[:-step], own[ids[step:]])
            np.add.at(context, ids[step:], own[ids[:-step]])
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    # a term counts as itself first and by its company second
    vectors = own / np.sqrt(8.0) + 0.5 * context / np.maximum(norm, 1e-9)
    return index, vectors.astype(np.float32)


def _forward(x: np.ndarray, layers: tuple) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = layers
    hidden = np.tanh(x @ w1 + b1)
    return hidden, hidden @ w2 + b2


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _train(x: np.ndarray, y: np.ndarray, hidden: int, epochs: int, seed: int = 7) -> tuple:
    rng = np.random.default_rng(seed)
    state = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    first, second, step = [np.zeros_like(s) for s in state], [np.zeros_like(s) for s in state], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 128):
            some, step = order[at : at + 128], step + 1
            h, logit = _forward(x[some], state)
            d = (_sigmoid(logit) - y[some]) / len(some)
            dh = np.outer(d, state[2]) * (1 - h * h)
            grads = [x[some].T @ dh + 1e-3 * state[0], dh.sum(0), h.T @ d + 1e-3 * state[2], d.sum(keepdims=True)]
            for s, g, m, v in zip(state, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                s -= 0.003 * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return tuple(state)


def fit(texts: list[str], labels: list[int], size: int = 96, hidden: int = 32, least: int = 3, most: int = 20_000, epochs: int = 40) -> Model:
    docs = [list(map(str.lower, terms(t))) for t in texts]
    index, vectors = _vectors(docs, size, least, most)
    x = np.stack([pooled(t, index, vectors) for t in texts])
    y = np.array([float(k > 0) for k in labels])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = np.clip((x - mean) / scale, -8, 8)
    check = np.arange(len(y)) % 5 == 4
    layers = _train(z[~check], y[~check], hidden, epochs)
    temperature = 1.0
    if check.sum() > 20:
        logit = _forward(z[check], layers)[1]
        grid = np.exp(np.linspace(np.log(0.3), np.log(10), 60))
        loss = [np.logaddexp(0, np.where(y[check] > 0, -1, 1) * logit / t).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
    return Model(index, vectors, mean, scale, layers, temperature)


def score(model: Model | None, texts: list[str | None]) -> np.ndarray:
    if model is None or not texts:
        return np.full(len(texts), 0.5)
    x = np.stack([pooled(t, model.index, model.vectors) for t in texts])
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    return _sigmoid(_forward(z, model.layers)[1] / model.temperature)


def learned(docs: DataFrame, labels: DataFrame, max_rows: int = 10_000, fold: int = 5) -> Model | None:
    """The model of a sample of at most ``max_rows`` labelled rows outside the held-out fold."""
    return fitted(labelled_sample(docs, labels, "quality", max_rows, fold=fold), fit)


def scored(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 20,000 vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = score(shared.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(got, pa.float64())], ["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, score double")
