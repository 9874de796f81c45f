"""Groups of the pipeline against Jaccard similarity of all pairs."""

import random

import numpy as np
import pytest

from notesift.llm import simhash


def brute(rows):
    sets = [set(simhash.shingles(t, 5)) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)), key=lambda g: rows[g][0])
                group[b] = a
    return {rows[k][0]: rows[find(k)][0] for k in range(len(rows))}


def corpus(seed):
    rng = random.Random(seed)
    rows = [(0, ""), (1, None)]
    for k in range(120):
        n = rng.choice((3, 8, 10, 15, 40, 68, 80, 120, 300))
        words = [f"t{k}w{i}" for i in range(n)]
        rows.append((len(rows), " ".join(words)))
        rows.append((len(rows), " ".join([*words, "more"])))
        for _ in range(3):  # similarity from 0.7 to 0.9
            other = list(words)
            for _ in range(max(1, n * rng.choice((2, 3, 4)) // 100)):
                other[rng.randrange(n)] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(other)))
    rows.append((len(rows), rows[2][1]))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_are_those_of_all_pairs(spark, seed):
    rows = corpus(seed)
    got = {r.id: r.component for r in simhash.verified_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_prefixes_of_alike_sets_meet():
    rng = np.random.default_rng(0)
    for _ in range(2000):
        n = int(rng.integers(4, 65))
        x = rng.integers(0, 2**63, n, dtype=np.uint64)
        y = np.sort(np.concatenate([x[: -(-9 * n // 10)], rng.integers(0, 2**63, n // 12, dtype=np.uint64)]))
        x = np.sort(x)
        if simhash.alike(len(np.intersect1d(x, y)), len(x), len(y)):
            assert np.intersect1d(x[: simhash.prefix(len(x))], y[: simhash.prefix(len(y))]).size


def test_equal_texts_are_searched_once(spark, monkeypatch):
    # two shingles that have few bits in common: near the fingerprint zero of empty texts, but not alike
    near = next(t for k in range(20_000) if 0 < int(np.bitwise_count(simhash.fingerprint(t := f"a{k} b{k} c{k} d{k} e{k} f{k}", 5, 8)).sum()) <= simhash.LOOSE)
    rows = [(k, "" if k % 2 else " \t") for k in range(300)] + [(300, near), (301, near.upper()), (302, near + " more")]
    counts, stored = {}, simhash.stored

    def counted(df, label):
        found = stored(df, label)
        counts[label] = found[0].count()
        return found

    monkeypatch.setattr(simhash, "stored", counted)
    got = {r.id: r.component for r in simhash.verified_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: 0 for k in range(300)} | {300: 300, 301: 300, 302: 302}
    assert counts["near-pairs"] <= 3 and counts["doubtful"] <= 3


def test_pairs_apart_are_those_of_all_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, (4, 8), dtype=np.uint64)
    fps = base[rng.integers(0, 4, 300)] ^ (np.uint64(1) << rng.integers(0, 64, (300, 8), dtype=np.uint64))
    grp = rng.integers(0, 9, 300).astype(np.uint64)
    cells = [np.append(f, g).astype(">u8").tobytes() for f, g in zip(fps, grp, strict=True)]
    all_ = {(i, j) for i in range(300) for j in range(i + 1, 300) if grp[i] != grp[j] and np.bitwise_count(fps[i] ^ fps[j]).sum() <= 14}
    assert all_ and set(map(tuple, simhash._apart(cells, 8, 14).tolist())) == all_
    assert len(simhash._apart([c[:64] + bytes(8) for c in cells], 8, 512)) == 0


def test_large_buckets_are_spanned_by_blocks():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 2**64, (1000, 8), dtype=np.uint64)
    fps[500:900] = fps[rng.integers(0, 40, 400)] ^ (np.uint64(1) << rng.integers(0, 64, (400, 8), dtype=np.uint64))
    calls = []

    def near(a, b):
        calls.append(len(a))
        return simhash._within(fps[a], fps[b], 16)

    got = simhash.spanned(1000, near)
    assert len(got) == 400
    label = simhash.joined(np.arange(1000), got[:, 0], got[:, 1])
    i, j = simhash._within(fps, fps, 16)
    assert (label[i] == label[j]).all() and len(np.unique(label)) == 600
    assert len(calls) < 100  # not one for each member without a link


def test_sets_of_short_texts_are_told_from_their_beginning():
    words = [f"w{k}" for k in range(400)]
    for text in ("", None, "one two", " ".join(words[:84]), " ".join(words[:85]), " ".join(words), "again and again " * 2000, "again and again " * 2000 + " ".join(words)):
        whole = simhash.shingle_set(text, 5)
        found = simhash.small_set(text, 5, 80)
        assert (found is None) == (not 0 < len(whole) <= 80)
        assert found is None or (found == whole).all()
