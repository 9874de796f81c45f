import random
import re

import numpy as np
import pytest

from notesift.llm import minhash, simhash


def shingle_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)])


def brute(rows):
    """Result rows, from all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    label = {i: i for i, _ in rows if i is not None}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for k, (i, _) in enumerate(rows):
        for m in range(k):
            j = rows[m][0]
            common = len(sets[k] & sets[m])
            if i is not None and j is not None and common and 100 * common >= 80 * (len(sets[k]) + len(sets[m]) - common):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return sorted((str(i), len(s), str(None if i is None else root(i)), i is None or root(i) == i) for (i, _), s in zip(rows, sets, strict=True))


def changed(rng, words, share):
    return " ".join(f"new{rng.random()}" if rng.random() < share else w for w in words)


def corpus(seed=5):
    rng = random.Random(seed)
    rows, at = [], 0
    for size in (5, 9, 20, 40, 70, 120, 400, 1500):
        for _ in range(6):
            words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
            for share in (0, 0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.2):
                rows.append((at, changed(rng, words, share)))
                at += 1
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [(1000 + k, " ".join(f"q{rng.randrange(10**6)}" for _ in range(60)) + " " + passage) for k in range(40)]
    rng.shuffle(rows)
    return rows


ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "one two three four"), (8, "é ü İ K x"), (9, "É ü İ K x"), (10, "a a a a a a"), (11, "a a a a"),
    (12, "long text here " * 300_000), (13, "long text here " * 300_001), (None, "one"), (None, None), (14, "twice " * 9), (14, "twice " * 9), (20, "alpha beta gamma delta"), (20, "one two three"), (15, "alpha beta gamma delta"),
    (16, "a\x1cb\x85c d e f"), (17, "a\x0bb c d e f"),
]


def found(spark, rows, **how):
    docs = spark.createDataFrame([(*r, 3, "x") for r in rows], "doc_id long, text string, n int, component string")
    return sorted((str(r.id), r.n, str(r.component), r.kept) for r in minhash.near_duplicates(docs, **how).collect())


@pytest.mark.parametrize("rows", [ODD, []])
def test_defined_results(spark, rows):
    assert found(spark, rows) == brute(rows)


def test_against_all_pairs(spark):
    rows = corpus()
    assert found(spark, rows) == brute(rows)


def test_hot_buckets_and_few_partners(spark, monkeypatch):
    """A group of texts about the threshold apart: stars fail, partners are left out at first, buckets are dealt into parts."""
    rng = random.Random(2)
    words = [f"w{k}" for k in range(300)]
    rows = [(k, changed(rng, words, 0.028)) for k in range(150)]
    monkeypatch.setattr(simhash, "BUCKET", 40)
    monkeypatch.setattr("notesift.llm.common.HOT", 20)
    assert found(spark, rows, most=1) == brute(rows)


def just_alike(rng, n):
    """Two sets of about ``n`` hashes of a similarity of 0.8 or little more."""
    union = rng.integers(0, 2**64, size=n + n // 8 * 2 or n + 1, dtype=np.uint64)
    cut = max((len(union) - int(np.ceil(0.8 * len(union)))) // 2, 0)
    return np.sort(union[cut:]), np.sort(union[: len(union) - cut])


def test_recall_at_the_threshold():
    """Pairs of sets that are just alike meet in a band and pass the comparison of their least hashes."""
    rng = np.random.default_rng(0)
    for n, tries in ((4, 300), (9, 300), (45, 400), (65, 400), (90, 400), (300, 300), (2000, 100)):
        missed = passed = 0
        for _ in range(tries):
            x, y = just_alike(rng, n)
            with np.errstate(over="ignore"):
                p, q = minhash.signature(x).reshape(minhash.BANDS, -1), minhash.signature(y).reshape(minhash.BANDS, -1)
            missed += not (p == q).all(axis=1).any()
            least = [(h[: minhash.LEAST] >> np.uint64(32)).astype(np.uint32).tobytes() for h in (x, y)]
            passed += sum(len(f) for f in minhash.partners(np.array([1, 2]), np.array([1, 2]), np.array([len(x), len(y)]), least, 80, 4))
        assert missed <= 0.01 * tries, n
        assert passed == tries, n


def test_densified_bins_agree_as_sets_do():
    rng = np.random.default_rng(1)
    shares = []
    for _ in range(400):
        x = np.sort(rng.integers(0, 2**64, size=20, dtype=np.uint64))
        with np.errstate(over="ignore"):
            shares.append((minhash.signature(x) == minhash.signature(x[:16])).mean())
    assert abs(np.mean(shares) - 0.8) < 0.02
