import bisect
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from notesift.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def reference(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [0]


TEXTS = [
    "plain words here", "", None, " ", "  ", "a  b", "a   b", "a \n b", "x\n\n y", "end ", "end  \n", "\n\n\n", "don't we'll 're s",
    "a\tb \tc", "café \U0001f600   x", "a  b", "<|endoftext|> a <|endoftext|>b", "中文 text", "a\r\n b\x1c c", "word " * 5000, "A,b.C;d " + "zz" * 9000,
]


def encoded(texts):
    encoder = packing.Encoder(PATH)
    assert encoder.fast is not None
    return [np.frombuffer(encoder.encode(t), "<u4").tolist() for t in texts]


def references(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_are_the_tokenizers():
    rng = random.Random(3)
    odd = list("ab Z1.,'\n\t\r\x0b\x85\xa0\u3000\u2028é漢\U0001f600\u0301²½\u200d_-<|>s re ll ve") + ["<|endoftext|>"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(odd) for _ in range(rng.randrange(1, 40))) for _ in range(4000)]
    texts += [x * 30_000 for x in ("a", " ", "\n", "ab ", "é", "!?", "x\n \n", "7")]
    assert encoded(texts) == references(texts)


def test_ids_of_the_supplied_documents():
    import pyarrow.parquet as pq

    texts = [x or "" for x in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()]
    assert encoded(texts) == references(texts)


def test_other_vocabularies_go_to_the_tokenizer():
    encoder = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert encoder.fast is None
    assert np.frombuffer(encoder.encode("Plain words"), "<u4").tolist() == encoder.tokenizer.encode("Plain words", add_special_tokens=False).ids


def check_rows(rows, docs, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.id].append(r)
        by_sequence[r.sequence_id].append(r)
    for key, text in docs:
        ids, own = reference(text), sorted(by_doc[key], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            assert r.start == at and r.crc == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
        assert all(r.length == capacity for r in own[1:])
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


def test_round_trip(spark):
    docs = list(enumerate(TEXTS * 3))
    table = spark.createDataFrame([(k, t, 1, "s") for k, t in docs], "doc_id long, text string, length int, offset string")
    rows = packing.packed(table, PATH, 256).collect()
    sequences = check_rows(rows, docs, 256)
    assert sequences <= -(-sum(r.length for r in rows) // 256) + 1


def test_empty_table_null_and_repeated_ids(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    rows = packing.packed(spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string"), PATH).collect()
    assert sorted((r.length, r.offset, r.sequence_id) for r in rows) == [(3, 0, 0), (3, 3, 0), (3, 6, 0)]


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_length_and_stays_near_the_bound(seed):
    rng = random.Random(seed)
    sizes = [min(512, max(1, int(rng.expovariate(1 / rng.choice([20, 90, 300]))))) for _ in range(4000)]
    counts = Counter(sizes)
    made = packing.plan(counts, 512)
    used = Counter()
    for pattern, n in made:
        assert sum(pattern) <= 512 and n > 0
        for x in pattern:
            used[x] += n
    assert used == counts
    assert sum(n for _, n in made) <= -(-sum(sizes) // 512) * 1.01 + 1


def best_fit(counts, capacity):
    """Sequences of best-fit decreasing, piece by piece."""
    gaps = []
    for x in sorted(counts.elements(), reverse=True):
        at = bisect.bisect_left(gaps, x)
        bisect.insort(gaps, (gaps.pop(at) if at < len(gaps) else capacity) - x)
    return len(gaps)


@pytest.mark.parametrize("seed", range(8))
def test_plan_never_has_more_than_best_fit(seed):
    rng = random.Random(seed)
    kinds = [lambda: rng.randint(1, 512), lambda: rng.randint(150, 380), lambda: rng.choice((31, 97, 130, 260, 300, 411)), lambda: max(1, min(512, int(rng.lognormvariate(4.5, 1))))]
    counts = Counter(kinds[seed % 4]() for _ in range(3000))
    assert sum(n for _, n in packing.plan(counts, 512)) <= best_fit(counts, 512)


def test_plan_takes_exact_triples():
    assert sorted(packing.plan({6: 2, 4: 2, 3: 2, 7: 1, 2: 1, 1: 2}, 10), key=str) and sum(n for _, n in packing.plan({5: 1, 2: 2, 1: 1}, 10)) == 1
