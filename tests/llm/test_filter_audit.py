import re
from itertools import permutations

import pytest

from notesift.llm import filter_audit

WORDS = " ".join(f"w{k}" for k in range(120))


def brute(docs, labels):
    """The report, by applying every order to every document."""
    docs = [(i, t or "", p or "") for i, t, p in docs]
    fails = []
    for i, t, _ in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        repeated = i is not None and any(j is not None and j < i and u == t for j, u, _ in docs)
        one = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), repeated)
        fails.append("".join(x for x, f in zip("ABCDE", one, strict=True) if f))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = {}
    for part in {p for _, _, p in docs}:
        mine = [(i, f) for (i, _, p), f in zip(docs, fails, strict=True) if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                redundant = sum(x in f for _, f in mine) - len(gone)
                alone = sum(f == x for _, f in mine)
                out[part, order, step] = [len(left), len(gone), redundant, alone, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
    for part in {p for _, _, p in docs}:
        for x in "ABCDE":
            here = [k for k in out if k[0] == part and k[1][k[2] - 1] == x]
            total = sum(out[k][1] for k in here)
            for k in here:
                out[k].append(total)
    return out


ROWS = [
    *[(k, WORDS, "en") for k in range(40, 0, -1)],
    *[(k, f"{WORDS} unlike {k}", "de") for k in range(100, 130)],
    *[(k, f"{WORDS} unlike {k - 100}", "en") for k in range(200, 215)],
    (300, None, None), (301, "", None), (302, "", "fr"), (303, "A" * 500, ""), (304, "the " * 500, "fr"), (305, WORDS + " $", "en"), (306, WORDS.upper(), "en"),
    (None, WORDS, "en"), (None, "", "en"), (7, WORDS, "en"), (7, WORDS, "xx"), (0, WORDS + " ", "en"), (307, "É" * 40 + " ABC", "en"), (308, "word word x " * 60, "zz"),
    (309, "long text of many words " * 100_000, "en"), (310, "long text of many words " * 100_000, "en"), (-5, "a\x0bb\x0cc\x1cd\x85e", "en"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (300, None, 1), (304, 0, 1), (None, 1, 1), (9999, 1, 1), (120, 1, None), (305, 1, 0)]


@pytest.mark.parametrize("rows,labels,partitions", [(ROWS, LABELS, 1), (ROWS, LABELS, 7), (ROWS, LABELS, 40), (ROWS, [], 5), ([], LABELS, 4)])
def test_against_every_order(spark, rows, labels, partitions):
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, lang string, mask int, run int, part string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = filter_audit.audit(docs, marks).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r[0], r[1], r[2]): list(r[3:]) for r in got} == brute(rows, labels)
    assert len(got) == 600 * len({p or "" for _, _, p in rows})


def test_texts_of_one_fingerprint(spark, monkeypatch):
    """With a fingerprint that all texts share, copies still meet over every boundary."""
    monkeypatch.setattr(filter_audit.F, "xxhash64", lambda *c: filter_audit.F.lit(1).cast("long"))
    rows = [(k, f"{WORDS} {k % 3}", "en") for k in range(60)] + [(k, f"only {k}", "en") for k in range(60, 70)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = filter_audit.marked(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r.id for r in got if r["mask"] & filter_audit.REPEATED) == list(range(3, 60))
