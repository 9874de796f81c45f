"""Rows of subwords against a plain version."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from notesift.functions import constants as C
from notesift.operators import labeling, subwords

PATH, FRAME = public_tokenizers.path("word_bpe_49k.json"), (49406, 49407, 0)
RECORDS = [(1, "Patient takes metformin 500mg twice daily for hypertension".split(), [0, 0, 3, 7, 8, 8, 0, 1]), (2, [], []), (3, ["word"] * 40, list(range(11)) * 3 + [0] * 7), (4, ["electroencephalography"] * 9, [5] * 9)]


def plain(tokens, tags, size):
    encoder, ids, words, labels = Tokenizer.from_file(PATH), [], [], []
    for k, word in enumerate(tokens):
        for j, i in enumerate(encoder.encode([word], is_pretokenized=True, add_special_tokens=False).ids):
            ids.append(i)
            words.append(k)
            labels.append(tags[k] if j == 0 else -100)
    whole = len(set(words))
    ids, words, labels = ids[: size - 2], words[: size - 2], labels[: size - 2]
    pad = size - 2 - len(ids)
    return [49406, *ids, 49407] + [0] * pad, [1] * (len(ids) + 2) + [0] * pad, [None, *words, None] + [None] * pad, [-100, *labels, -100] + [-100] * pad, whole - len(set(words))


@pytest.mark.parametrize("size", [2, 5, 16, 64])
def test_rows(spark, size):
    frame = spark.createDataFrame(RECORDS, "doc_id long, tokens array<string>, tag_ids array<int>")
    got = {r.doc_id: tuple(r)[1:] for r in subwords.dataset(frame, PATH, FRAME, size).collect()}
    assert got == {k: plain(w, t, size) for k, w, t in RECORDS}
    assert all(len(cell) == size for row in got.values() for cell in row[:4])


def test_labels_come_back_from_first_subwords(spark):
    frame = spark.createDataFrame(RECORDS, "doc_id long, tokens array<string>, tag_ids array<int>")
    rows = labeling.first_subwords(subwords.placed(subwords.dataset(frame, PATH, FRAME, 4096)))
    got = sorted((r.doc_id, r.word_id, r.label) for r in rows.collect())
    assert got == [(k, n, t) for k, _, tags in RECORDS for n, t in enumerate(tags)]
    assert C.IGNORED not in {x[2] for x in got}
