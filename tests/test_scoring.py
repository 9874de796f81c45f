"""Scorers on executors: retries against a plain loop, observed counters, the window of a tagger, training against a plain version."""

import random

import numpy as np
import public_tokenizers
import pytest

from notesift.functions import constants as C
from notesift.operators import notes as path
from notesift.operators import scoring, tagger

TEXTS = [None, "", "  \n"] + ["metformin " + "x" * k for k in range(60)]


def loop(texts, attempts=3):
    """One text after the other, as a batch runner would."""
    score, out = scoring.terms_that_fail(), []
    for t in texts:
        if not (t or "").strip():
            out.append((None, 0))
            continue
        error = None
        for n in range(1, attempts + 1):
            try:
                score([t], n)
                error = None
                break
            except Exception as e:  # noqa: BLE001
                error = f"{type(e).__name__}: {e}"
        out.append((error, n))
    return out


@pytest.mark.parametrize("batch", [1, 7, 64])
def test_retries_against_a_plain_loop(spark, batch):
    frame = spark.createDataFrame([(k, t, "kept") for k, t in enumerate(TEXTS)], "doc_id long, text string, ord string").repartition(3)
    rows = scoring.scored(frame, scoring.TRIAL, "text", batch=batch)
    got = sorted(rows.collect(), key=lambda r: r.doc_id)
    want = loop(TEXTS)
    assert [(r.error, r.attempts) for r in got] == want
    assert all(r.ord == "kept" for r in got)
    assert all(len(r.model) == (1 if n and e is None else 0) for r, (e, n) in zip(got, want, strict=True))
    stats = scoring.batch_stats(rows).first()
    bad = sum(n == 0 or e is not None for e, n in want)
    assert tuple(stats) == (len(want), len(want) - bad, bad, sum(max(n - 1, 0) for _, n in want))
    events = scoring.log_events(rows).collect()
    assert sum(e.event == "document_retry" for e in events) == stats.retried
    assert sum(e.event == "document_failed" for e in events) == sum(e is not None for e, _ in want)


def test_observed_counters_are_those_of_the_output(spark, tmp_path):
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    rows, seen = scoring.observed(scoring.scored(frame, scoring.TRIAL, "text"))
    rows.write.parquet(str(tmp_path / "out"))
    assert seen.get == scoring.batch_stats(spark.read.parquet(str(tmp_path / "out"))).first().asDict()


def test_a_model_on_the_document_path(spark):
    frame = spark.createDataFrame([(1, "Patient takes metformin."), (2, " "), (3, "y" * 7), (4, "No evidence of sepsis.")], "doc_id long, text string")
    got = {r.doc_id: r for r in path.run(frame, scoring.TRIAL).collect()}
    assert sorted(got) == [1, 4]  # blank and failed notes give no document
    assert [(e.text, e.source) for e in got[1].entities] == [("metformin", "model")]


RECORDS = [(k, ["Patient", "takes", w, f"{5 * k}mg", "for", d], [0, 0, 3, 7, 0, 1]) for k, (w, d) in enumerate([("aspirin", "sepsis"), ("heparin", "gout"), ("insulin", "asthma"), ("aspirin", "gout")] * 6)] + [(99, [], [])]


def test_training_against_a_plain_version(spark):
    frame = spark.createDataFrame(RECORDS, "doc_id long, tokens array<string>, tag_ids array<int>").repartition(3)
    by = [0.5] + [2.0] * 10
    made = tagger.trained(frame, frame, by, epochs=6, patience=9)
    weights, optimizer, losses = np.zeros((tagger.BUCKETS, tagger.TAGS)), tagger.Adam(0.5, 1, 6), []
    for _ in range(6):
        g, loss, total = np.zeros_like(weights), 0.0, 0.0
        for _, words, tags in RECORDS:
            for k, t in enumerate(tags):
                x = tagger.features(words)[k]
                z = weights[x].sum(axis=0)
                p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
                loss -= by[t] * np.log(p[t])
                total += by[t]
                for f in x:
                    g[f] += by[t] * (p - np.eye(tagger.TAGS)[t])
        losses.append(loss / total)
        weights = optimizer.step(weights, g / total)
    assert np.allclose([x for _, x, _ in made.history], losses, rtol=1e-6)
    assert losses[-1] < losses[0] / 5 and made.best == 1.0


def test_training_stops_early(spark):
    frame = spark.createDataFrame(RECORDS[:4], "doc_id long, tokens array<string>, tag_ids array<int>")
    made = tagger.trained(frame, frame, epochs=40, patience=2)
    assert len(made.history) < 40 and made.best == 1.0


def test_words_beyond_the_window_get_no_prediction(spark):
    import public_tokenizers

    weights = np.zeros((tagger.BUCKETS, tagger.TAGS))
    weights[tagger._bucket("w aspirin")] = np.eye(tagger.TAGS)[C.TAG_IDS["B-MEDICATION"]] * 9
    made = tagger.model(weights, public_tokenizers.path("byte_bpe_50k.json"), "test")
    text = "aspirin word " * 600
    (got,) = spark.createDataFrame([(1, text)], "doc_id long, text string").transform(lambda d: scoring.scored(d, made, "text")).collect()
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text.split(), is_pretokenized=True, add_special_tokens=False).word_ids[: 512 - 2]
    assert len(got.model) == sum(k % 2 == 0 for k in set(ids))
    assert all(text[e.start : e.end] == e.text == "aspirin" for e in got.model)


def test_merging_tags():
    text = "a b c d"
    spans = [(0, 1), (2, 3), (4, 5), (6, 7)]
    assert tagger.merged(text, spans, ["B-DATE", "I-DATE", "I-DOSAGE", "I-DATE"], [0.9, 0.8, 1, 1]) == [("a b", "DATE", 0, 3, 0.8)]
    assert tagger.merged(text, spans, ["I-DATE", "B-DATE", "B-DATE", "O"], [1, 0.5, 0.6, 1]) == [("b", "DATE", 2, 3, 0.5), ("c", "DATE", 4, 5, 0.6)]


def test_windows_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    size = lambda w: len(made.encode([w], is_pretokenized=True, add_special_tokens=False).ids)
    rng = random.Random(8)
    texts = [[], ["x"] * 600, ["é😀漢字" * 50] * 9, ["a" * 3000], *[[rng.choice(["a", "of", "Zyloxantrine,", "12.5mg", "漢", "é-é"]) for _ in range(rng.randrange(700))] for _ in range(20)]]
    for words in texts:
        ids = made.encode(words, is_pretokenized=True, add_special_tokens=False).word_ids[: tagger.WINDOW - 2]
        assert tagger.in_window(words, size) == max((k for k in ids if k is not None), default=-1) + 1
    asked = []
    tagger.in_window(["word"] * 100_000, lambda w: asked.append(w) or 1)
    assert len(asked) == tagger.WINDOW - 2  # and not the words beyond the window


def test_features_are_those_of_their_names():
    words = ["Aspirin", "İx", "5mg", "aspirin"]
    low = ["<s>", "<s>", *[w.lower() for w in words], "</s>", "</s>"]
    for k, x in enumerate(tagger.features(words).tolist()):
        b = tagger._bucket
        near = [b(f"-1 {low[k + 1]}"), b(f"-2 {low[k]}"), b(f"+1 {low[k + 3]}"), b(f"+2 {low[k + 4]}")]
        assert x[4:] == [*near, b(f"b {low[k + 1]} {low[k + 2]}"), b(f"c {low[k + 2]} {low[k + 3]}"), b("bias")]
    assert tagger.features([]).shape == (0, tagger.FEATURES)


def test_training_keeps_nothing_in_executors_memory(spark, monkeypatch):
    from notesift.plans import catalog

    frame, levels = type(spark.range(1)), []
    persist = frame.persist
    monkeypatch.setattr(frame, "persist", lambda self, *level: levels.append(level) or persist(self, *level))
    monkeypatch.setattr(tagger, "trained", lambda train, val, by, f=tagger.trained: f(train, val, by, epochs=1))
    found = catalog.QUERIES["ner_training"](spark, "/root/testdata/sf0.001")
    assert found.count() == 1
    assert len(levels) == 3 and not any(level[0].useMemory for level in levels)
