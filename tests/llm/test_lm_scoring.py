import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from notesift.llm import lm_scoring


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def brute(rows):
    """The same model with dictionaries, over words and pairs themselves."""
    out_of = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    one, two = Counter(), Counter()
    for i, text in rows:
        if not out_of(i):
            own = tokens(text)
            one.update(own)
            two.update(zip(own, own[1:], strict=False))
    after = defaultdict(dict)
    for (a, b), c in two.items():
        after[a][b] = c
    total = {a: sum(x.values()) for a, x in after.items()}
    tally = np.zeros((4, lm_scoring.BUCKETS), dtype=int)
    for a, x in after.items():
        for c in x.values():
            if c <= 4:
                tally[c - 1, int(math.log2(total[a]))] += 1
    cut, n, v = lm_scoring.discounts(tally), sum(one.values()), len(one)
    uni = lambda w: (one[w] + 1) / (n + v + 1)

    def p(a, w):
        if a not in total:
            return uni(w)
        d = cut[:, int(math.log2(total[a]))]
        rest = sum(d[min(c, 3) - 1] for c in after[a].values()) / total[a]
        c = after[a].get(w, 0)
        return (c - d[min(c, 3) - 1] if c else 0) / total[a] + rest * uni(w)

    result = []
    for i, text in rows:
        own = tokens(text)
        base = sum(math.log10(uni(w)) for w in own)
        score = math.log10(uni(own[0])) + sum(math.log10(p(a, w)) for a, w in zip(own, own[1:], strict=False))
        result.append((i, out_of(i), len(own), sum(one[w] > 0 for w in own), n, base, score))
    return result, after, p, one


def corpus(n):
    rng = random.Random(n)
    vocabulary = [f"w{k}" for k in range(40)] + ["Éa", "ÉA", "x y", "😀"]
    return [(k, " ".join(rng.choice(vocabulary[: 4 + k % 40]) for _ in range(rng.randint(0, 30)))) for k in range(n)]


@pytest.mark.parametrize("batch", [200, 10**7])
@pytest.mark.parametrize("rows", [corpus(80) + [(None, "w1 w2 w3"), (3, "w1 w2"), (500, None), (501, " \n"), (9, "z " * 30_000)], [(2, "only")], []])
def test_against_brute_force(spark, monkeypatch, rows, batch):
    monkeypatch.setattr(lm_scoring, "BATCH", batch if len(rows) > 2 else 10**7)
    if len(rows) > 2 and batch == 200:
        monkeypatch.setattr(lm_scoring, "BATCH", 9_000)
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, batch string, score double")
    got = lm_scoring.scored(docs).collect()
    key = lambda r: (str(r[0]), r[2], r[5])
    want = sorted(brute(rows)[0], key=key)
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=key), want, strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_probabilities_add_up_to_one():
    rows = corpus(80)
    _, after, p, one = brute(rows)
    for a in [*list(after)[:10], "never"]:
        assert sum(p(a, w) for w in one) + p(a, "an unknown word") == pytest.approx(1)


def test_held_out_copies_score_better_than_the_base(spark):
    rows = corpus(60)
    held = [k for k in range(1000, 1400) if zlib.crc32(str(k).encode()) % 7 == 2]
    source = "the same long sentence that many of the documents have in common with each other today"
    rows += [(k, source) for k in range(100, 130)] + [(held[0], source)]
    got = {r.id: r for r in lm_scoring.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held[0]].held_out and got[held[0]].score > got[held[0]].base_score + 5


def test_counts_beyond_32_bits():
    values = np.array([0, 5, 2**32 - 2, 2**32 - 1, 2**32, 6_000_000_000, 7, 2**53], dtype=np.int64)
    payload = b"head" + lm_scoring.packed(values) + lm_scoring.packed(values[:2])
    got, end = lm_scoring.unpacked(payload, len(values), 4)
    assert got.tolist() == values.tolist()
    assert lm_scoring.unpacked(payload, 2, end)[0].tolist() == [0, 5]


def test_pairs_of_two_batches_add_up_beyond_32_bits():
    made = lm_scoring.Batch.of(["one two"], [True])
    made.pairs, made.counts = made.pairs * 3_000_000_000, made.counts * 3_000_000_000
    ((_, payload),) = made.requests(1)
    replies, (tokens, _), _ = lm_scoring.solved([payload, payload])
    k = len(made.hashes)
    end = 16 * k
    for _ in range(3):
        _, end = lm_scoring.unpacked(replies[0], k, end)
    pairs, _ = lm_scoring.unpacked(replies[0], len(made.pairs), end)
    assert set(pairs.tolist()) == {6_000_000_000} and tokens == 18_000_000_000
