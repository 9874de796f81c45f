"""Severity of toxic language by cumulative-link ordinal regression.

P(grade <= k) = sigmoid(theta_k - w.x): one weight vector for all thresholds,
which are kept in order. x is sparse: how often words and word beginnings occur,
relative to the length. Labels only say toxic or not, so the learned grades are
0 (not toxic) and, among toxic rows, 1 or 2 below or above the median density of
what tells the two apart. The score is the expected grade, from 0 to 2.

Defined results: null and empty texts have no features and get the score of the
thresholds alone; without any labelled row every score is 0; null ids are kept;
repeated rows are scored each by itself; an empty table gives no rows. Columns
other than the id and the text are not read, and labels are never inputs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notesift.llm.common import discard, stored, unused
from notesift.llm.training import fitted, labelled_sample

WORD = re.compile(r"\w+")
#: Lengths of word beginnings; words of at least that length have them.
STEMS = (5, 6, 7, 8)
GRADES = 3


@dataclass
class Model:
    index: dict[str, int]
    first: frozenset[str]
    weights: np.ndarray
    thresholds: np.ndarray


def terms(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in STEMS if len(word) >= k)]


def rate(count: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Occurrences for about 200 words; short texts count as 100 more."""
    return np.log1p(200.0 * count / (100.0 + words))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _documents(texts: Iterable[str], toxic: Iterable[bool], most: int = 1 << 16) -> Iterator[tuple[Counter, Counter]]:
    """Documents and toxic documents with each term, in parts of about ``most`` terms."""
    seen, bad = Counter(), Counter()
    for text, y in zip(texts, toxic, strict=True):
        own = {t for w in set(WORD.findall(text.lower())) for t in terms(w)}
        seen.update(own)
        if y:
            bad.update(own)
        if len(seen) > most:
            yield seen, bad
            seen, bad = Counter(), Counter()
    yield seen, bad


def _screen(texts: list[str], toxic: np.ndarray, most: int) -> dict[str, int]:
    """Terms whose share of documents differs between the classes (|z| >= 4), the clearest first."""
    seen, bad = Counter(), Counter()
    for part in _documents(texts, toxic):
        seen.update(part[0])
        bad.update(part[1])
    n, m, out = len(texts), int(toxic.sum()), []
    for t, k in seen.items():
        if k >= 4 and 0 < m < n:
            p = k / n
            z = (bad[t] / m - (k - bad[t]) / (n - m)) / np.sqrt(p * (1 - p) * (1 / m + 1 / (n - m)) + 1e-12)
            if abs(z) >= 4:
                out.append((-abs(z), t))
    return {t: k for k, (_, t) in enumerate(sorted(out)[:most])}


def _beginnings(index: dict[str, int]) -> frozenset[str]:
    return frozenset(t[:5] for t in index if t.endswith("*"))


def _vector(words: Counter, total: int, index: dict[str, int], first: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    found: Counter[int] = Counter()
    for w, n in words.items():
        if w in index or w[:5] in first:
            for t in terms(w):
                if (k := index.get(t)) is not None:
                    found[k] += n
    at = np.fromiter(found.keys(), dtype=np.int64, count=len(found))
    return at, rate(np.fromiter(found.values(), dtype=np.float64, count=len(found)), np.float64(total))


def _counted(text: str, index: dict[str, int], first: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    words = WORD.findall(text.lower())
    return _vector(Counter(words), len(words), index, first)


def fit(texts: list[str], labels: list[int], most: int = 4096, steps: int = 400, penalty: float = 1e-4) -> Model:
    toxic = np.array([y > 0 for y in labels])
    index = _screen(texts, toxic, most)
    first = _beginnings(index)
    found = [_counted(t, index, first) for t in texts]
    return _solved([x[0] for x in found], [x[1] for x in found], toxic, index, steps, penalty)


def _solved(cols: list[np.ndarray], values: list[np.ndarray], toxic: np.ndarray, index: dict[str, int], steps: int = 400, penalty: float = 1e-4) -> Model:
    """The model of documents whose terms (places in ``index``) and values are given."""
    row = np.repeat(np.arange(len(cols)), [len(x) for x in cols])
    col, val = np.concatenate(cols).astype(np.int64), np.concatenate(values)
    n, m = len(cols), len(index)

    # grades: toxic rows by the density of positive evidence
    base = np.bincount(col, val, m) if len(col) else np.zeros(m)
    lift = np.bincount(col[toxic[row]], val[toxic[row]], m) / max(1, toxic.sum()) - base / max(1, n) if len(col) else np.zeros(m)
    mass = np.bincount(row, val * (lift[col] > 0), n) if len(col) else np.zeros(n)
    grade = toxic.astype(int)
    if toxic.any():
        grade[toxic & (mass > np.median(mass[toxic]))] = 2

    w, share = np.zeros(m), np.array([(grade <= k).mean() for k in range(GRADES - 1)]).clip(1e-3, 1 - 1e-3)
    theta = np.log(share / (1 - share))
    cut, gap = theta[0], np.log(max(theta[1] - theta[0], 0.05))
    moments = [[np.zeros(m), np.zeros(m)], [np.zeros(2), np.zeros(2)]]
    for step in range(1, steps + 1):
        eta = np.bincount(row, val * w[col], n) if len(col) else np.zeros(n)
        edge = np.array([-np.inf, cut, cut + np.exp(gap), np.inf])
        high, low = _sigmoid(edge[grade + 1] - eta), _sigmoid(edge[grade] - eta)
        p = np.maximum(high - low, 1e-9)
        slope_high, slope_low = high * (1 - high), low * (1 - low)
        d_eta = (slope_high - slope_low) / p / n  # of the negative log-likelihood
        d_edge = np.zeros(2)
        for k in (1, 2):
            d_edge[k - 1] = -(slope_high / p)[grade + 1 == k].sum() / n + (slope_low / p)[grade == k].sum() / n
        grads = [np.bincount(col, val * d_eta[row], m) + penalty * w if len(col) else penalty * w, np.array([d_edge.sum(), d_edge[1] * np.exp(gap)])]
        moves = []
        for g, mo in zip(grads, moments, strict=True):
            mo[0] = 0.9 * mo[0] + 0.1 * g
            mo[1] = 0.999 * mo[1] + 0.001 * g * g
            moves.append(0.05 * mo[0] / (1 - 0.9**step) / (np.sqrt(mo[1] / (1 - 0.999**step)) + 1e-8))
        w = w - moves[0]
        cut, gap = cut - moves[1][0], gap - moves[1][1]
    return Model(index, _beginnings(index), w, np.array([cut, cut + np.exp(gap)]))


def severity(model: Model | None, text: str | None) -> tuple[float, float]:
    """The expected grade and the probability of any toxicity."""
    if model is None:
        return 0.0, 0.0
    at, x = _counted(text or "", model.index, model.first)
    above = 1 - _sigmoid(model.thresholds - (model.weights[at] * x).sum())
    return float(above.sum()), float(above[0])


def _index(sample: DataFrame, n: int, m: int, most: int) -> dict[str, int]:
    """As ``_screen``, of ``n`` rows of which ``m`` are toxic; only the terms that stay reach the driver."""
    if not 0 < m < n:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seen, bad in _documents((x.as_py() for x in batch.column(1)), (x.as_py() > 0 for x in batch.column(0))):
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64()), pa.array([bad[t] for t in seen], pa.int64())], ["term", "seen", "bad"])

    counts = sample.select("label", "text").mapInArrow(run, "term string, seen long, bad long").groupBy("term").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad")).where("seen >= 4")
    p = F.col("seen") / n
    z = (F.col("bad") / m - (F.col("seen") - F.col("bad")) / (n - m)) / F.sqrt(p * (1 - p) * (1 / m + 1 / (n - m)) + 1e-12)
    got = counts.select("term", F.abs(z).alias("z")).where("z >= 4").orderBy(F.desc("z"), "term").limit(most).collect()
    return {r.term: k for k, r in enumerate(got)}


def learned(docs: DataFrame, labels: DataFrame, max_rows: int = 10_000, fold: int = 5, most: int = 4096) -> Model | None:
    """The model of a sample of at most ``max_rows`` labelled rows outside the held-out fold.

    The same as ``fit`` of the sample, whose texts are counted where they lie: the
    task that fits has the numbers of their terms only.
    """
    spark = docs.sparkSession
    sample, path = stored(labelled_sample(docs, labels, "toxic", max_rows, fold=fold), "toxicity-sample")
    n, m = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("label") > 0).cast("long")), F.lit(0))).first()
    if not n:
        discard(spark, path)
        return None
    index = _index(sample, n, m, most)
    shared = spark.sparkContext.broadcast((index, _beginnings(index)))  # at most ``most`` terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_counted(x.as_py(), *shared.value) for x in batch.column(2)]
            cols, values = pa.array([x[0] for x in found], pa.list_(pa.int64())), pa.array([x[1] for x in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cols, values], ["id", "label", "cols", "values"])

    counted = sample.select("id", "label", "text").mapInArrow(run, "id long, label int, cols array<long>, values array<double>")
    model = fitted(counted, lambda label, cols, values: _solved(cols, values, np.array(label) > 0, index), ("label", "cols", "values"))
    discard(spark, path)
    return model


def judged(spark: SparkSession, model: Model | None) -> Callable[[Column], Column]:
    """A function of a text column: a struct of ``severity``, ``p_toxic`` and ``is_toxic`` (probability of one half or more)."""
    shared = spark.sparkContext.broadcast(model)  # at most 4096 terms

    @F.arrow_udf("struct<severity:double,p_toxic:double,is_toxic:boolean>")
    def judge(texts: pa.Array) -> pa.Array:
        got = [severity(shared.value, x.as_py()) for x in texts]
        s, p = pa.array([x[0] for x in got], pa.float64()), pa.array([x[1] for x in got], pa.float64())
        return pa.StructArray.from_arrays([s, p, pa.array([x[1] >= 0.5 for x in got], pa.bool_())], ["severity", "p_toxic", "is_toxic"])

    return judge


def scored(docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs``, then ``severity``, ``p_toxic`` and ``is_toxic``; ``keep`` may not have these names."""
    judge = judged(docs.sparkSession, model)
    return docs.select(*keep, judge(F.col(text_col)).alias("judged text")).select(*keep, "`judged text`.*")


def rejected(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` without the toxic rows; its columns may have any names."""
    name = unused("toxicity", docs)
    judge = judged(docs.sparkSession, model)
    return docs.withColumn(name, judge(F.col(text_col))).where(~F.col(name)["is_toxic"]).drop(name)
