import hashlib
import random
import unicodedata
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from notesift.llm import fingerprints

ODD = ["é", "é", "ế", "ế", "ệ", "ệ", "ệ", "ǖ", "ǖ", "Å", "Å", "Å", "각", "각", "각", "क़", "क़", "à֮̕b", "à֮̕b", "̈́", "̈́", "ﬁ", "ß", "SS", "ΟΔΟΣ", "οδος", "İ", "\U0001d15e", "x̣́̀", "́", "😀"]


def folded(text):
    out = unicodedata.normalize("NFC", text or "")
    return " ".join(out.upper().lower().replace("ς", "σ").split())


def test_composition_is_canonical_equivalence(spark):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(ODD + list("ab ")) for _ in range(6)) for _ in range(150)]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, t string").repartition(2)
    got = {r.id: r.c for r in frame.select("id", fingerprints.composed(F.col("t")).alias("c")).collect()}
    for k, t in enumerate(texts):
        # equivalent to the text itself, and composed wherever nothing stands between
        assert unicodedata.normalize("NFC", got[k]) == unicodedata.normalize("NFC", t)
        if not any(unicodedata.combining(c) for c in unicodedata.normalize("NFC", t)):
            assert got[k] == unicodedata.normalize("NFC", t)
    by = {}
    for k, t in enumerate(texts):
        assert by.setdefault(unicodedata.normalize("NFD", t), got[k]) == got[k]


DOCS = [
    (50, "Hello   World"), (40, "hello world\n"), (30, "café"), (20, "CAFÉ"), (10, ""), (9, None),
    (5_000_000, "far away " * 4000), (4_000, "One two three"), (5_000, "another one"), (3, "😀😀😀é"), (2, "one two three"),
]


def tie(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), tie(r[1]), r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        after, third = rows[(k + 1) % len(rows)][1], len(t) // 3
        edit = t[: len(t) - third] + after[:third]
        out.append((i, len(t), hashlib.sha256(edit.encode()).hexdigest(), float(folded(t) == folded(edit)), float(folded(t) == folded(after))))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [DOCS, DOCS[:1], [], [*DOCS, *DOCS[:4], (None, "no id"), (None, None)], [(k * 700, f"t{k % 3}") for k in range(60)]])
def test_edited_against_brute_force(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, canon string, bucket int")
    got = fingerprints.edited(docs).collect()
    assert sorted([(r.id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got], key=str) == brute(rows)
    texts = {}
    for r in fingerprints.groups(docs).collect():
        texts.setdefault(r.fingerprint, set()).add(r.first)
    assert all(len(x) == 1 for x in texts.values())
    assert len(texts) == len({folded(t) for _, t in rows})


HASHED = [random.Random(k).randrange(-(2**63), 2**63) for k in range(300)]
IDS = {
    "far apart": [1, 2**60],
    "ends": [-(2**63), 2**63 - 1, 0],
    "hashed": HASHED,
    "outlier": [*range(200), 2**62],
    "outliers": [-(2**63), *range(1000, 1200), 2**63 - 1, 2**63 - 2],
    "no ids": [None] * 150 + [3, 4],
    "one id": [7] * 100 + [8, 6, None],
    "alike as floats": [2**62 + k for k in range(120)],
}


@pytest.mark.parametrize("ids", IDS.values(), ids=IDS.keys())
def test_any_ids(spark, monkeypatch, ids):
    monkeypatch.setattr(fingerprints, "SPAN", 10)
    rows = [(i, f"text {k % 41} " + "x" * (k % 7)) for k, i in enumerate(ids)]
    got = fingerprints.edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted([(r.id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got], key=str) == brute(rows)


def test_ranges_rise_and_stay_small(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "SPAN", 10)
    for ids in (HASHED, IDS["outlier"], [None] * 300):
        rows = spark.createDataFrame([(i, k * 2**55 - 2**62) for k, i in enumerate(ids)], "id long, tie long")
        got = sorted((r.id or 0, r.b) for r in rows.select("id", fingerprints.ranges(rows).alias("b")).collect())
        assert ids[0] is None or [b for _, b in got] == sorted(b for _, b in got)
        assert max(Counter(b for _, b in got).values()) <= 40


def test_unequal_texts_in_a_bucket_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "digest", lambda text: F.lpad(F.length(text).cast("string"), 32, "0"))
    rows = [(1, "aaa"), (2, "bbb"), (3, "AAA"), (4, "cc"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first = {r.id: r.first for r in fingerprints.groups(docs).collect()}
    assert first == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_no_python_in_the_plan(spark):
    plan = fingerprints.edited(spark.createDataFrame(DOCS, "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
