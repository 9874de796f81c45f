"""The text kernel against plain loops over regular expressions, and its time on long notes."""

import random
import re
import time
import timeit

import pytest
from pyspark.sql import functions as F

from notesift.functions import clean, extract, kernel
from notesift.functions import constants as C
from notesift.operators import notes as path

RNG = random.Random(7)
PIECES = [*list(C.ABBREVIATIONS)[:60], *C.MEDICATIONS[:12], *C.DIAGNOSES[:12], "5mg", "é", "😀", " ", " ", "x", "/", "2", "İ", "K", "ſ", "ı", "ASPIRIN", "\n", "\x01", "\x02", "SSN 123-45-6789"]


def mixed(n):
    return "".join(RNG.choice(PIECES) for _ in range(n))


TEXTS = [mixed(RNG.randrange(1, 60)) for _ in range(150)] + ["", "HTN", "w/o w/", "A&OA&O", "aspirinaspirin", "ſepsis SEPSİS", mixed(3000)]


def by_regex(text, keys, any_case, whole):
    found = []
    for k, key in enumerate(keys):
        pattern = re.escape(key)
        for m in re.finditer(rf"(?<![A-Za-z]){pattern}(?![A-Za-z])" if whole else pattern, text, re.IGNORECASE if any_case else 0):
            found.append((m.start(), m.end(), k))
    return sorted(found)


@pytest.mark.parametrize(("keys", "any_case", "whole"), [(list(C.ABBREVIATIONS), False, True), ([*C.MEDICATIONS, *C.DIAGNOSES], True, False)])
def test_one_pass_finds_what_a_pass_for_each_key_finds(keys, any_case, whole):
    looked = tuple(k.lower() if any_case else k for k in keys)
    for text in TEXTS:
        assert sorted(kernel.occurrences(text, looked, any_case, whole)) == by_regex(text, keys, any_case, whole), text


def test_replacing_from_right_to_left():
    for text in TEXTS:
        found = sorted(by_regex(text, list(C.ABBREVIATIONS), False, True), key=lambda x: -x[0])
        want = text
        for start, end, k in found:
            want = want[:start] + f"<{k}>" + want[end:]
        got = kernel.replaced(text, [x[0] for x in found], [x[1] for x in found], [f"<{x[2]}>" for x in found])
        assert got == want


def test_columns(spark):
    frame = spark.createDataFrame([(k, t) for k, t in enumerate([*TEXTS, None])], "id int, t string")
    found = clean.find_abbreviations(F.col("t"))
    rows = frame.select("t", found.alias("f"), clean.expand(F.col("t"), found).alias("x"), extract.medications(F.col("t")).alias("m"), kernel.find_patterns(F.col("t"), [("N", "[0-9]+"), ("S", "DM([0-9])")]).alias("n")).collect()
    keys = sorted(C.ABBREVIATIONS, key=len, reverse=True)
    for r in rows:
        if r.t is None:
            assert r.f is r.x is r.m is r.n is None
            continue
        want = sorted(by_regex(r.t, keys, False, True), key=lambda x: (-x[0], x[2]))
        assert [(s.start, s.end, s.label, s.ord) for s in r.f] == [(a, b, C.ABBREVIATIONS[keys[k]], k) for a, b, k in want]
        text = r.t
        for a, b, k in want:
            text = f"{text[:a]}{keys[k]} ({C.ABBREVIATIONS[keys[k]]}){text[b:]}"
        assert r.x == text
        assert sorted((s.text, s.start, s.end) for s in r.m) == sorted((r.t[a:b], a, b) for a, b, _ in by_regex(r.t, C.MEDICATIONS, True, False))
        numbers = [(m.group(), "N", m.start(), m.end(), 0) for m in re.finditer("[0-9]+", r.t)]
        assert [tuple(s) for s in r.n] == numbers + [(m[1], "S", m.start(1), m.end(1), 1) for m in re.finditer("DM([0-9])", r.t)]


def test_windows(spark):
    text = "é" * 50 + "No evidence of sepsis" + " word" * 30
    got = spark.createDataFrame([(text, [(65, 71), (0, 3)])], "t string, e array<struct<start:int,end:int>>").select(extract.windows(F.col("t"), F.col("e")).alias("w")).first().w
    for w, (a, b) in zip(got, [(65, 71), (0, 3)], strict=True):
        assert w.before == text[max(a - C.NEGATION_CHARS, 0) : a] and w.after == text[b : b + C.NEGATION_CHARS]
        low, high = max(a - C.CONTEXT, 0), min(b + C.CONTEXT, len(text))
        assert w.context == ("..." if low else "") + text[low:high] + ("..." if high < len(text) else "")


def test_time_follows_the_length(spark):
    """A dense note of a million characters: each step in seconds, where a pass over the text for each match would take an hour."""
    line = "HTN, CHF w/o DM2 or DM, SpO2 98 s/p I&D/C. Mr. Smith takes ASA PO BID, metformin 500mg twice daily for sepsis, SSN 123-45-6789.\n"
    frame = spark.createDataFrame([("warm " + line,), (line * (1_000_000 // len(line)),)], "t string")
    steps = {"expand": lambda t: clean.expand(t, clean.find_abbreviations(t)), "terms": lambda t: F.size(extract.medications(t)), "cut": lambda t: F.size(kernel.find_patterns(t, [("N", "[0-9]+")]))}
    for name, step in steps.items():
        made = frame.select(step(F.col("t")).alias("x"))
        began = time.time()
        made.write.format("noop").mode("overwrite").save()
        assert time.time() - began < 30, name


def test_patterns_that_begin_words_are_found_at_the_same_places():
    """Trying only the places where a word begins with a fit character gives what a search gives, overlaps and boundaries included."""
    rng = random.Random(3)
    bits = ["1", "12", "2024-01-02", "01/02/2023", "January", " 5, 2024", "May 2020", "mg", " mg", "5 mL", "every 6 hours", "é", "_", " ", "\n", "x", "٣", "3.5", "/", "-", "Q8H", ","]
    for pattern, flags, begins in ((C.DOSAGE, re.IGNORECASE, r"\d"), (C.DATE, 0, r"\dJFMASOND")):
        whole, start = re.compile(pattern, flags), re.compile(rf"[{begins}](?<!\w.)")
        hits = 0
        for _ in range(4000):
            text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
            want = [m.span() for m in whole.finditer(text)]
            assert [m.span() for m in kernel.matches(text, whole, start)] == want
            hits += len(want)
        assert hits > 300


def test_words_without_matches_are_passed_quickly():
    """A search that stops at each letter took several times as long."""
    text = "lorem ipsum dolor sit amet consectetur " * 40_000
    took = lambda f: min(timeit.repeat(f, number=1, repeat=3))
    for pattern, flags, begins in ((C.DOSAGE, re.IGNORECASE, r"\d"), (C.DATE, 0, r"\dJFMASOND")):
        whole, start = re.compile(pattern, flags), re.compile(rf"[{begins}](?<!\w.)")
        assert 1.5 * took(lambda: list(kernel.matches(text, whole, start))) < took(lambda: list(whole.finditer(text)))  # noqa: B023


@pytest.mark.parametrize("how", [{}, {"preserve": False}, {"expand_abbrevs": False}, {"mask_phi": False}])
def test_expansion_and_masking_take_one_worker(spark, how):
    """The steps at once give what they give one by one, and a task of the path has two workers at most: this one and that of Unicode's composed form."""
    frame = spark.createDataFrame([(k, t) for k, t in enumerate([*TEXTS, *[f"{t}\nMr. Smith SSN 123-45-6789 call 555-123-4567" for t in TEXTS[:40]], None])], "doc_id int, text string")
    done = path.preprocess(frame, **how).select("doc_id", "cleaned_text", "abbreviations_expanded", "phi_spans")
    text = spark.createDataFrame(frame.select("doc_id", clean.clean_text(F.col("text")).alias("t")).collect(), "doc_id int, t string")
    if how.get("expand_abbrevs", True):
        text = text.withColumn("a", clean.find_abbreviations(F.col("t"))).withColumn("t", clean.expand(F.col("t"), F.col("a"), how.get("preserve", True)))
    text = spark.createDataFrame(text.collect(), text.schema)
    if how.get("mask_phi", True):
        text = text.withColumn("p", clean.detect_phi(F.col("t"))).withColumn("t", clean.mask(F.col("t"), F.col("p")))
    got, want = ({r.doc_id: r for r in some.collect()} for some in (done, text))
    for k, r in want.items():
        assert (got[k].cleaned_text, got[k].abbreviations_expanded, got[k].phi_spans) == (r.t, getattr(r, "a", []), getattr(r, "p", []))
    plan = done.select("doc_id", "cleaned_text")._jdf.queryExecution().executedPlan().toString()
    assert 1 <= plan.count("ArrowEvalPython") <= 2
