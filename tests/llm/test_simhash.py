import numpy as np
import pytest

from notesift.llm import simhash

BASE = " ".join(f"w{k}" for k in range(300))


def brute(rows):
    import re

    import xxhash

    prints = {}
    for k, (_, text) in enumerate(rows):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        prints[k] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if bin(prints[a] ^ prints[b]).count("1") <= 4 and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[group[k]] = min(i, least.get(group[k], i))
    return sorted((str(i), f"{prints[k]:016x}", str(least.get(group[k]))) for k, (i, _) in enumerate(rows))


ROWS = [
    (7, BASE),
    (3, BASE),
    (3, BASE),
    (9, BASE.replace("w7 ", "x7 ")),
    (11, BASE.upper()),
    (1, None),
    (2, ""),
    (4, " \t\n"),
    (5, "one two"),
    (6, "é ü İstanbul K"),
    (8, "one two three four five"),
    (10, "long " * 70_000),
]


@pytest.mark.parametrize("rows", [ROWS, []])
def test_against_brute_force(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, fp string, key int, component string")
    got = simhash.near_duplicates(docs).collect()
    assert sorted((str(r.id), r.fp.hex(), str(r.component)) for r in got) == brute(rows)


def test_null_id_keeps_its_row(spark):
    docs = spark.createDataFrame([(None, BASE), (5, BASE), (None, "alone here")], "doc_id long, text string")
    got = simhash.near_duplicates(docs).collect()
    assert sorted((str(r.id), str(r.component)) for r in got) == [("5", "5"), ("None", "5"), ("None", "None")]


def test_forest_spans_the_links_of_a_bucket():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**64, size=20, dtype=np.uint64)
    flips = np.array([[1 << int(b) for b in rng.integers(0, 64, size=3)] for _ in range(900)], dtype=np.uint64)
    fps = np.unique(base[rng.integers(0, 20, 900)] ^ np.bitwise_xor.reduce(flips, axis=1))[:, None]

    def groups(n, pairs):
        label = list(range(n))
        for _ in range(n):
            before = list(label)
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
            if label == before:
                return label
        return label

    links = [(a, b) for a in range(len(fps)) for b in np.flatnonzero(np.bitwise_count(fps[a] ^ fps).ravel() <= 4) if a < b]
    for small in (0, 10_000):
        got = simhash.forest(fps, simhash.pivots(1), 4, small=small)
        assert len(got) < len(fps)
        assert groups(len(fps), got.tolist()) == groups(len(fps), links)


def test_split_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 3)
    rows = [(k, BASE.replace(f"w{k} ", f"x{k} ")) for k in range(1, 30)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.id), r.fp.hex(), str(r.component)) for r in got) == brute(rows)


def test_masks_meet_every_pair_within_the_radius():
    rng = np.random.default_rng(1)
    for n in (10, 10**9):
        masks = simhash.exact_masks(n, 4)
        for _ in range(200):
            x = int(rng.integers(0, 2**63))
            y = x
            for b in rng.choice(64, 4, replace=False):
                y ^= 1 << int(b)
            assert any(x & int(m) == y & int(m) for m in masks[:, 0])


def test_wide_mode_catches_four_fifths(spark):
    rows = [(k, " ".join(f"d{k}w{i}" for i in range(300))) for k in range(60)]
    for k in range(60):
        words = rows[k][1].split()
        for at in (37, 120, 201):
            words[at] = "changed"
        rows.append((100 + k, " ".join(words)))
    got = {r.id: r.component for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **simhash.WIDE).collect()}
    assert sum(got[100 + k] == k for k in range(60)) == 60
    assert len(set(got.values())) == 60
