"""Goldens of the text operators, each against a value worked out by hand."""

import pytest
from pyspark.sql import functions as F

from notesift.functions import clean, extract, spans
from notesift.functions import constants as C


def value(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


def places(found):
    return [(s.text, s.start, s.end) for s in found]


@pytest.mark.parametrize(
    ("text", "preserve", "want"),
    [
        ("DM2", True, "DM (diabetes mellitus)2 (type 2 diabetes mellitus)"),
        ("DM2", False, "diabetes mellituspe 2 diabetes mellitus"),
        ("I&D/C", True, "I&D (incision and drainage)/C (discharge)"),
        ("xHTN HTNx HTN", True, "xHTN HTNx HTN (hypertension)"),
        ("", True, ""),
    ],
)
def test_expansion(spark, text, preserve, want):
    assert value(spark, text, lambda t: clean.expand(t, clean.find_abbreviations(t), preserve)) == want


@pytest.mark.parametrize(
    ("text", "kind", "want"),
    [
        ("Patient: John Smith\nDate of Evaluation", "NAME", [("John Smith\nDate", 9, 24)]),
        ("Attending: Dr. Sarah Thompson\nAdmission Date: ", "NAME", [("Sarah Thompson\nAdmission", 15, 39)]),
        ("Patient: John Smith\nMRN: MRN-123456", "NAME", [("John Smith", 9, 19)]),
        ("MRN: 123456", "MRN", []),
        ("MRN-123456", "MRN", [("MRN-123456", 0, 10)]),
        ("call (743) 555-3824", "PHONE", []),
        ("95-year-old", "AGE_OVER_89", []),
        ("95 year old", "AGE_OVER_89", [("95 year", 0, 7)]),
    ],
)
def test_protected_information(spark, text, kind, want):
    assert [(s.text, s.start, s.end) for s in value(spark, text, clean.detect_phi) if s.label == kind] == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("metformin 500mg twice daily", [("500mg twice daily", 10, 27)]),
        ("25mg PO BID", [("25mg PO BID", 0, 11)]),
        ("25mg PO (by mouth) BID (twice daily)", [("25mg PO", 0, 7)]),
        ("5 grams", [("5 g", 0, 3)]),
        ("10 units subcutaneous at bedtime", [("10 units", 0, 8)]),
        ("325mg PO every 4 hours PRN", [("325mg PO every 4 hours PRN", 0, 26)]),
    ],
)
def test_dosages(spark, text, want):
    assert places(value(spark, text, extract.dosages)) == want


def test_whitespace_and_artifacts(spark):
    assert value(spark, "a\n \n \nb", clean.normalize_whitespace) == "a\n\n\nb"
    assert value(spark, "é Page 1 of 3 ** x ** y", clean.clean_text) == "é y"
    # composed before control characters go, so these two stay apart
    assert value(spark, "\ufeffe\x01\u0301 “a”… ", clean.clean_text) == 'e\u0301 "a"...'


def test_sections(spark):
    text = "intro\n\nALLERGIES:\nNKDA.\n\nPLAN:\n\nRest"
    got = [(s.name, s.start, s.end, s.text) for s in value(spark, text, clean.detect_sections)]
    assert got == [("Allergies", 6, 24, "NKDA."), ("Plan", 24, 36, "Rest")]
    assert value(spark, "HPI (history of present illness):", clean.detect_sections) == []
    assert value(spark, "PLAN:\na\nPLAN:\nb", lambda t: clean.section_map(clean.detect_sections(t))) == {"Plan": "b"}


def test_paragraphs(spark):
    assert value(spark, "A one. B two.\nC three.", clean.split_sentences) == ["A one. B two. C three."]
    assert value(spark, "x\n\nMEDICATIONS:\n1. a\nBP 120 b\ny Dr. Z", clean.split_sentences) == ["x", "MEDICATIONS:", "1. a", "BP 120 b", "y Dr. Z"]


@pytest.mark.parametrize(
    ("text", "start", "end", "want"),
    [
        ("No evidence of pneumonia", 15, 24, (True, "pre")),
        ("Pneumonia was ruled out", 0, 9, (True, "post")),
        ("Patient has pneumonia", 12, 21, (False, "none")),
        ("Patient denies chest pain", 15, 25, (True, "pre")),
        ("Now has sepsis", 8, 14, (True, "pre")),
    ],
)
def test_negation(spark, text, start, end, want):
    got = value(spark, text, lambda t: extract.negation(t, F.lit(start), F.lit(end)))
    assert (got.negated, got.trigger_type) == want


@pytest.mark.parametrize(
    ("text", "label"),
    [("Patient takes metformin daily", "MEDICATION"), ("Take 500mg twice daily", "DOSAGE"), ("Admitted on 01/15/2022", "DATE"), ("Diagnosed with type 2 diabetes mellitus", "DIAGNOSIS")],
)
def test_rules_find_labels(spark, text, label):
    assert label in {s.label for s in value(spark, text, extract.rule_entities)}


def test_rules_inside_words_and_run_on(spark):
    assert places(value(spark, "asepsis", extract.rule_entities)) == [("sepsis", 1, 7)]
    assert places(value(spark, "heparinsulin glargine", extract.rule_entities)) == [("insulin glargine", 5, 21)]
    assert value(spark, "", extract.rule_entities) == []


def test_most_confident(spark):
    rows = [(0, 10, 0.5), (5, 20, 0.9), (12, 15, 0.95), (20, 25, 0.1)]
    kind = extract.ENTITY
    frame = spark.createDataFrame([([("", "X", a, b, 0, c, "model") for a, b, c in rows],)], f"e array<{kind}>")
    got = frame.select(spans.most_confident(F.col("e"), kind).alias("x")).first().x
    assert [(s.start, s.end) for s in got] == [(12, 15), (20, 25)]


def test_offsets_count_code_points(spark):
    text = "é😀 500mg é"
    (s,) = value(spark, text, extract.dosages)
    assert text[s.start : s.end] == s.text == "500mg"


def test_tables():
    assert len(C.ABBREVIATIONS) == 140 and len(C.TAGS) == 11 and len(C.SECTIONS) == 16
