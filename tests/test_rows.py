"""Steps that stay within rows, batches that are worked on by slices, and columns that a query doesn't ask for."""

import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from notesift.functions import clean, kernel
from notesift.functions import constants as C
from notesift.operators import evaluation, labeling, subwords, tagger

SF = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_tags_of_overlapping_entities_are_those_of_the_join(spark):
    rng = random.Random(5)
    rows = []
    for k in range(60):
        text = "".join(rng.choice("ab \n ") for _ in range(40))
        found = [(rng.choice(["DATE", "DOSAGE", "X", None]), a, a + rng.randrange(0, 9)) for a in (rng.randrange(40) for _ in range(6))]
        rows.append((k, text, found))
    rows += [(60, None, [("DATE", 0, 3)]), (61, "a b", None), (62, "", [])]
    notes = spark.createDataFrame(rows, "doc_id long, text string, entities array<struct<label:string,start:int,end:int>>")
    each = notes.select("doc_id", F.posexplode("entities").alias("ord", "e")).select("doc_id", "ord", "e.*")
    want = sorted(map(repr, labeling.bio_tags(labeling.tokens(notes), each).collect()))
    made = labeling.tagged_words(notes)
    assert sorted(map(repr, labeling.by_word(made).collect())) == want
    key = lambda r: r.doc_id
    assert sorted(labeling.word_records(made).collect(), key=key) == sorted(labeling.bio_records(labeling.by_word(made)).collect(), key=key)


@pytest.mark.parametrize("name", ["bio_tags", "bio_records", "tag_counts", "subword_dataset"])
def test_tags_are_made_without_joins(spark, name):
    made = plan(entry.queries()[name](spark, SF))
    assert "Join" not in made and made.count("Exchange ") <= (name == "tag_counts")


@pytest.mark.parametrize("name", ["ner_prf", "entity_prf", "error_distribution"])
def test_pairs_are_worked_out_once(spark, name):
    assert plan(entry.queries()[name](spark, SF)).count("FileScan") == 1


def test_entities_of_both_tags_against_chunks(spark):
    rng = random.Random(6)
    rows = [(d, p, rng.choice([*range(11), -100]), rng.randrange(11)) for d in range(30) for p in range(25)]
    pairs = spark.createDataFrame(rows, "doc_id long, pos int, true_id int, pred_id int")
    both = [{tuple(r) for r in evaluation.chunks(evaluation.named(pairs), c).select("doc_id", "kind", "s", "e").collect()} for c in ("true", "pred")]
    got = evaluation.ner_prf(pairs).first()
    assert (got.tp, got.fp, got.fn) == (len(both[0] & both[1]), len(both[1] - both[0]), len(both[0] - both[1])) and got.tp


def test_a_long_row_of_subwords_is_made_with_few_others():
    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    run = subwords.dataset(Rows(), public_tokenizers.path("word_bpe_49k.json"), (49406, 49407, 0), 4096)
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array([["a"]] * 200), pa.array([[0]] * 200)], ["doc_id", "tokens", "tag_ids"])
    sizes = [b.num_rows for b in run(iter([batch]))]
    assert sum(sizes) == 200 and max(sizes) * 4096 <= subwords.PLACES


def test_batches_are_worked_on_by_slices():
    seen = []

    def upper(texts):
        seen.append(len(texts))
        return pa.array([t and t.upper() for t in texts.to_pylist()])

    rows = pa.array([None, "b"] * 400)
    assert kernel.sliced(upper)(rows).to_pylist() == [None, "B"] * 400 and max(seen) <= kernel.SLICE


def test_sections_that_hide_in_others(spark):
    texts = ["ASSESSMENT AND\nPLAN:\nrest", "\n\n  plan:\n\n\nMEDICAL\nHISTORY\n", "MEDICATIONS\nON\nADMISSION", "x PLAN:", "", None, "CC:\n\n \nPLAN:"]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", clean.detect_sections(F.col("t")).alias("s"), clean.detect_sections(F.col("t"), False).alias("places")).collect()
    for r in got:
        t = texts[r.k] or ""
        want = sorted((m.start(), k, name) for k, (name, p) in enumerate(C.SECTIONS.items()) for m in re.finditer(r"^\s*(?:" + "|".join(p) + r")\s*:?\s*$", t, re.I | re.M))
        assert [(s.start, s.name) for s in r.s or []] == [(a, name) for a, _, name in want]
        assert [tuple(s)[:3] for s in r.s or []] == [tuple(s) for s in r.places or []]


def test_words_of_other_cases():
    keys = ("kiss", "im")
    assert [(a, b) for a, b, _ in kernel.occurrences("KiſS é İM", keys, True, False)] == [(0, 4), (7, 9)]


def test_epochs_need_no_words(spark):
    rows = tagger.prepared(spark.createDataFrame([(1, ["aspirin", "5mg"], [3, 7]), (2, [], []), (3, None, None)], "doc_id long, tokens array<string>, tag_ids array<int>"))
    g, loss = tagger.summed(rows.drop("tokens"), np.zeros((tagger.BUCKETS, tagger.TAGS)), np.ones(tagger.TAGS))
    # both words have three features in common, where a part of the gradients cancels out
    assert np.isclose(loss, np.log(tagger.TAGS)) and np.isclose(np.abs(g).sum(), 20 - 3 * 2 / 11)
    assert [(r.doc_id, r.pos, r.token, r.true_id) for r in tagger.tagged(rows, g).collect()] == [(1, 0, "aspirin", 3), (1, 1, "5mg", 7)]


def test_a_query_does_what_its_columns_need(spark):
    steps = {name: plan(entry.queries()[name](spark, SF)).count("ArrowEvalPython") for name in ("scorer_stub", "dedup_entities", "resolve_overlaps", "confidence_routing", "context_snippet", "postprocess")}
    most = steps.pop("postprocess")
    assert max(steps.values()) < most


def test_tokens_are_made_without_a_shuffle(spark):
    assert "Exchange" not in plan(entry.queries()["whitespace_tokens"](spark, SF))


def test_tokens_of_odd_texts(spark):
    texts = [None, "", " \n\t ", "one", " a  b c d\x1fe\x85f ", "é😀 x😀​y", "\x01a b\x01", "long " * 70_000]
    rows = [(k, t) for k, t in enumerate(texts)] * 2
    got = sorted(labeling.tokens(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = sorted((k, p, m[0], m.start(), m.end()) for k, t in rows for p, m in enumerate(re.finditer(r"[^\s\x1c-\x1f]+", t or "")))
    assert got and list(map(tuple, got)) == want
