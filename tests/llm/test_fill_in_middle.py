import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from notesift.llm import fill_in_middle as fim


def plain_version(i, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    d = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (i, len(units), "plain", None, None, text)
    if h[3] % 100 < 20:
        return (i, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (i, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


TEXTS = ["", None, "a", "one two", "naïve café — 北京 😀 x", "\n\r\t \x0b", "has <P> inside", "<M>", "<S", ">P<", "é" * 300, "abc" * 400, "ends with <P", "日本語", "a1b2 C3", "K İ ſ"]
ROWS = [(k, TEXTS[k % len(TEXTS)]) for k in range(600)] + [(None, "no id here"), (None, None), (7, "twice"), (7, "twice"), (-(2**63), "least"), (2**63 - 1, "most"), (9, "long text, " * 300_000)]


@pytest.mark.parametrize("rows", [ROWS, []])
def test_against_plain_version(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, form string, n int")
    got = fim.transformed(docs)
    key = lambda r: (str(r[0]), *map(str, r[1:]))
    assert sorted(map(tuple, got.collect()), key=key) == sorted((plain_version(i, t) for i, t in rows), key=key)
    back = got.select("id", fim.restored(got.fim, got.form).alias("text")).collect()
    assert sorted((str(r.id), r.text) for r in back) == sorted((str(i), t or "") for i, t in rows)


def test_all_forms_occur():
    forms = [plain_version(k, "some words to cut")[2] for k in range(600)]
    assert {f: forms.count(f) > 30 for f in set(forms)} == {"plain": True, "spm": True, "psm": True}


def test_slices_of_a_batch_change_nothing():
    ids, texts = [r[0] for r in ROWS[:100]], [r[1] or "" for r in ROWS[:100]]
    sliced = fim.arranged(pa.array([0, *ids]).slice(1), pa.array(["before", *texts]).slice(1), "1", 10, 20)
    assert sliced.column(5).to_pylist() == [plain_version(i, t)[5] for i, t in zip(ids, texts, strict=True)]


def test_cuts_of_random_bytes():
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab é日😀1 "), size=rng.integers(0, 40))) for _ in range(500)]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    h = rng.integers(0, 2**32, size=(2, 500))
    n, low, high, prefix, middle = fim.cuts(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets, *h)
    for k, t in enumerate(texts):
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
        a, b = sorted(int(x[k]) % (len(units) + 1) for x in h)
        assert (n[k], prefix[k], middle[k]) == (len(units), len("".join(units[:a])), len("".join(units[a:b])))
        assert raw[k][: low[k] - offsets[k]].decode() == "".join(units[:a])
        assert raw[k][high[k] - offsets[k] :].decode() == "".join(units[b:])
