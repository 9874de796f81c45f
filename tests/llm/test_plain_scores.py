"""Scores of the two classifiers against plain versions that go through texts term by term."""

import math
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from notesift.llm import quality, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def labelled():
    docs = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    labels = pq.read_table(f"{SF}/labels.parquet").to_pydict()
    return dict(zip(docs["doc_id"], docs["text"], strict=True)), labels


ODD = [None, "", " ", "x", "!!! !!!", "AAA AAA aaa 12 12 " + "z" * 30, "word " * 5000, "é É ß 漢字 漢字"]


def sigmoid(x):
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def plain_severity(model, text):
    words = re.findall(r"\w+", (text or "").lower())
    eta = 0.0
    for term, k in model.index.items():
        n = sum(w.startswith(term[:-1]) for w in words if len(w) >= len(term) - 1) if term.endswith("*") else words.count(term)
        eta += model.weights[k] * math.log1p(200 * n / (100 + len(words)))
    above = [1 - sigmoid(t - eta) for t in model.thresholds]
    return sum(above), above[0]


def test_severity(labelled):
    texts, labels = labelled
    model = toxicity.fit([texts[d] for d in labels["doc_id"]], labels["toxic"])
    assert len(model.index) > 5
    for text in [*list(texts.values())[:60], *ODD, *(f"{t.strip('*')}zz {t.strip('*')}" for t in list(model.index)[:30])]:
        assert toxicity.severity(model, text) == pytest.approx(plain_severity(model, text), abs=1e-9)


def plain_quality(model, text):
    found = re.findall(r"\w+|[^\w\s]+", text or "")
    x = np.zeros(model.vectors.shape[1])
    for k, term in enumerate(found):
        x += model.vectors[model.index.get(term.lower(), 0)]
        kinds = [len(term) > 1 and term.isupper(), term.isdigit(), k > 0 and found[k - 1].lower() == term.lower(), len(term) > 24]
        for j, has in enumerate(kinds):
            x += has * model.vectors[1 + j].astype(float)
    x = x / max(1, len(found))
    z = [min(8.0, max(-8.0, (a - m) / s)) for a, m, s in zip(x, model.mean, model.scale, strict=True)]
    w1, b1, w2, b2 = model.layers
    hidden = [math.tanh(sum(z[i] * w1[i, j] for i in range(len(z))) + b1[j]) for j in range(len(b1))]
    return sigmoid((sum(h * w for h, w in zip(hidden, w2, strict=True)) + b2[0]) / model.temperature)


def test_quality(labelled):
    texts, labels = labelled
    model = quality.fit([texts[d] for d in labels["doc_id"]], labels["quality"], epochs=5)
    some = [*list(texts.values())[:40], *ODD]
    assert quality.score(model, some) == pytest.approx([plain_quality(model, t) for t in some], abs=2e-3)
