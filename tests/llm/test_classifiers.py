import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from notesift.llm import quality, queries, toxicity, training

SF = "/root/testdata/sf0.01"


def labelled(column):
    texts = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    labels = pq.read_table(f"{SF}/labels.parquet").to_pydict()
    by = dict(zip(texts["doc_id"], texts["text"], strict=True))
    rows = [(by[d], y, zlib.crc32(str(d).encode()) % 5 == 0) for d, y in zip(labels["doc_id"], labels[column], strict=True)]
    return [r for r in rows if not r[2]], [r for r in rows if r[2]]


def test_quality_on_held_out_rows():
    train, test = labelled("quality")
    model = quality.fit([r[0] for r in train], [r[1] for r in train])
    got = quality.score(model, [r[0] for r in test])
    assert np.mean((got >= 0.5) == np.array([r[1] == 1 for r in test])) >= 0.95
    assert ((0 <= got) & (got <= 1)).all()


def test_toxicity_on_held_out_rows():
    train, test = labelled("toxic")
    model = toxicity.fit([r[0] for r in train], [r[1] for r in train])
    assert model.thresholds[0] < model.thresholds[1]
    got = [toxicity.severity(model, r[0])[1] >= 0.5 for r in test]
    assert np.mean([g == (r[1] == 1) for g, r in zip(got, test, strict=True)]) >= 0.95
    assert not any(g for g, r in zip(got, test, strict=True) if r[1] == 0)


def test_severity_grows_with_the_evidence():
    rng = np.random.default_rng(0)
    word = lambda: "w" + str(rng.integers(0, 400))
    texts, labels = [], []
    for k in range(600):
        words = [word() for _ in range(80)]
        for _ in range(k % 10 if k % 3 == 0 else 0):
            words[int(rng.integers(0, 80))] = "nastyish" + "abc"[k % 3]
        texts.append(" ".join(words))
        labels.append(int("nasty" in texts[-1]))
    model = toxicity.fit(texts, labels)
    base = [word() for _ in range(80)]
    got = [toxicity.severity(model, " ".join(base + ["nastyishzz"] * n))[0] for n in (0, 3, 12)]
    assert got[0] < 0.5 < got[1] < got[2] <= 2


@pytest.mark.parametrize("texts", [["", "word"], ["", "", ""]])
@pytest.mark.parametrize("labels", [0, 1])
def test_one_class_and_no_words(texts, labels):
    for module in (quality, toxicity):
        model = module.fit(texts, [labels] * len(texts))
        if module is quality:
            assert np.isfinite(module.score(model, [None, "", "x " * 100_000])).all()
        else:
            assert np.isfinite([module.severity(model, t) for t in (None, "", "x " * 100_000)]).all()


def test_sample_is_bounded_and_leaves_out_the_fold(spark):
    docs = spark.createDataFrame([(k % 50, f"t{k}", 0) for k in range(100)] + [(None, "x", 0), (3, None, 0)], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)] + [(1, None), (None, 1), (2, 0)], "doc_id long, quality int")
    rows = training.labelled_sample(docs, labels, "quality", 20).collect()
    assert len(rows) == 20 == len({r.id for r in rows})
    assert all(zlib.crc32(str(r.id).encode()) % 5 for r in rows)


def test_scoring_frames(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (None, None, 6), (1, "a b", 5), (2, "", 7)], "doc_id long, text string, score int")
    none = labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.learned(docs, labels)
    assert model is None and [r.score for r in quality.scored(docs, model).collect()] == [0.5] * 4
    assert toxicity.learned(docs, none) is None
    rows = toxicity.scored(docs, None, ["doc_id", "text", "score"]).collect()
    assert len(rows) == 4 and {r.severity for r in rows} == {0.0} and sorted(r.score for r in rows) == [5, 5, 6, 7]
    assert quality.scored(docs.limit(0), model).collect() == []


def test_queries_cover_every_document(spark):
    n = pq.read_table("/root/testdata/sf0.001/documents.parquet").num_rows
    for name in ("op2_toxicity", "op10_quality"):
        rows = queries.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
        assert len(rows) == n and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_the_task_that_fits_severity_holds_no_texts(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    given = []
    monkeypatch.setattr(toxicity, "fitted", lambda sample, *more: given.append(sample) or training.fitted(sample, *more))
    model = toxicity.learned(docs, labels)
    assert [f.dataType.simpleString() for f in given[0].schema] == ["bigint", "int", "array<bigint>", "array<double>"]
    rows = sorted(training.labelled_sample(docs, labels, "toxic", 10_000).collect(), key=lambda r: r.id)
    plain = toxicity.fit([r.text for r in rows], [r.label for r in rows])
    assert model.index == plain.index and model.first == plain.first and len(plain.index) > 5
    assert np.allclose(model.weights, plain.weights, atol=1e-12) and np.allclose(model.thresholds, plain.thresholds, atol=1e-12)
