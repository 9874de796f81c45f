import random

import numpy as np
import pytest
import xxhash

from notesift.llm import decontamination as dec

ITEMS = [
    (1, "A train leaves Paris at 9 with 120 passengers and travels 300 km before Anna boards it with 120 bags. How far is it?"),
    (2, "The quick brown fox jumps over the lazy dog while seven old men look on in silence from the hill."),
    (3, "Short item has six words"),
    (4, "tiny one"),
    (5, ""),
    (6, None),
]


def found(text, items=ITEMS):
    with np.errstate(over="ignore"):
        return dec.leaks(dec.Items.of([x for x in items if x[1] is not None]), dec.Templates(), text)


def ids(text):
    return {x[0] for x in found(text)}


def test_verbatim_and_re_parameterised():
    for text in (
        ITEMS[0][1],
        f"Intro here. {ITEMS[0][1]} More text follows",
        "A train leaves Rome at 7 with 90 passengers and travels 45 miles before Peter boards it with 90 bags. How far is it?",
        "a train leaves paris AT 9, with 120 passengers and travels 300km before anna boards it with 120 bags".replace("paris", "Lyon").replace("anna", "Eva"),
    ):
        assert ids(text) == {1}, text
    assert ids("x " * 50 + ITEMS[1][1].upper() + " y" * 50) == {2}
    assert ids("before: Short item has six words, after") == {3}


def test_slots_must_keep_their_values():
    other = "A train leaves Rome at 7 with 90 passengers and travels 45 miles before Peter boards it with 91 bags. How far is it?"
    got = found(other)
    assert all(end - start < 23 for _, start, end in got)
    same = found(other.replace("91", "90"))
    assert max(e - s for _, s, e in same) > max([e - s for _, s, e in got], default=0)


def test_clean_texts():
    rng = random.Random(0)
    words = " ".join(ITEMS[0][1].split() + ITEMS[1][1].split()).split()
    for _ in range(200):
        rng.shuffle(words)
        assert found(" ".join(words)) == []
    for text in (None, "", "tiny one", "\n\n", "7 8 9 10 11 12 13 14 15 16 17 18 19 20", "Anna Bert Carl Dora Emil Fritz Gerd Hans Ida Jan Karl Lars Max Nils"):
        assert found(text) == []


def brute(text, items, run=13):
    """Items of which ``run`` template tokens in a row occur, for texts without slots."""
    words = [w.strip(".,?!").lower() for w in (text or "").split()]
    out = set()
    for i, q in items:
        own = [w.strip(".,?!").lower() for w in q.split()]
        n = min(run, len(own))
        grams = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
        if len(own) >= 5 and any(tuple(own[k : k + n]) in grams for k in range(len(own) - n + 1)):
            out.add(i)
    return out


def test_frames_against_brute_force(spark):
    rng = random.Random(1)
    words = [f"{a}{b}" for a in "bcdfgh" for b in ("ana", "oro", "ilu")]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice((6, 12, 30))))) for k in range(40)]
    rows = []
    for k in range(120):
        text = [rng.choice(words) for _ in range(60)]
        if k % 3 == 0:
            own = rng.choice(items)[1].split()
            n = rng.choice((len(own), 13, 12, 9))
            text[20:20] = own[:n]
        rows.append((k, " ".join(text)))
    rows += [(None, items[0][1]), (500, None), (501, ""), (7, rows[7][1]), (900, "pad word " * 40_000 + items[2][1])]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, item string, start int")
    benchmark = spark.createDataFrame([*items, (None, "a b c d e f"), (99, None)], "item_id long, text string")
    got = dec.matched(docs, benchmark, ["doc_id", "item", "text"]).collect()
    assert sorted((str(r.doc_id), sorted({x.item for x in r["leaks"]})) for r in got) == sorted((str(i), sorted(brute(t, items))) for i, t in rows)
    for part in (dec.matched(docs.limit(0), benchmark, ["doc_id"]).collect(),):
        assert part == []
    assert all(r["leaks"] == [] for r in dec.matched(docs, benchmark.limit(0), ["doc_id"]).collect())


def test_blocks_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(1, ITEMS[0][1]), (2, ITEMS[1][1]), (3, "none")], "doc_id long, text string")
    benchmark = spark.createDataFrame([x for x in ITEMS if x[1]], "item_id long, text string")
    whole = sorted(map(str, dec.matched(docs, benchmark, ["doc_id"]).collect()))
    monkeypatch.setattr(dec, "BLOCK", 2)
    assert sorted(map(str, dec.matched(docs, benchmark, ["doc_id"]).collect())) == whole


@pytest.mark.parametrize("n", [1, 7])
def test_windows_need_their_size(n):
    assert len(dec.windows(np.arange(n, dtype=np.uint64), 8)) == 0


def test_codes_of_tokens():
    """Codes follow the rules for outer punctuation, ends, units and capitals, whichever way a token is taken apart."""

    def plain(token):
        ends = token[-1] == "\x02" or token.rstrip("\x02)\"'”’»")[-1:] in (".", "!", "?", ":")
        word = dec.OUTER.sub("", token)
        flags = dec.ENDS * ends
        if dec.NUMBER.match(word):
            flags |= dec.NUMERIC
        else:
            flags |= dec.UNIT * (word.lower() in dec.UNITS) | dec.CAPITAL * (word[:1].isupper() and not word[1:].isupper())
        return xxhash.xxh64_intdigest(word.lower().encode("utf-8", "surrogatepass")) & ~15 | flags

    rng = random.Random(6)
    cores = ["word", "Word", "WORD", "w", "W", "İx", "ß", "miles", "Km", "été", "\u0345a", "a_b", "a-b", "12", "3.5", "x2", "", "中文", "ǅa", "ªb"]
    outer = ["", "", ".", ",", "?", "\x02", ".\x02", ":", ")", ".)", "_", '"', "!?", ",\x02", "»", ";"]
    for _ in range(4000):
        token = rng.choice(outer) + rng.choice(cores) + rng.choice(outer)
        if token:
            assert dec.code(token) == plain(token), token


def test_new_tokens_are_coded_once(monkeypatch):
    """A text with tokens not seen before isn't gone through twice."""
    asked = []
    known = dec.code
    monkeypatch.setattr(dec, "code", lambda token: asked.append(token) or known(token))
    templates = dec.Templates()
    assert templates.raw(["a", "b", "a"]).tolist() == [known("a"), known("b"), known("a")] and asked == ["a", "b"]
    templates.raw(iter_once := ["b", "c"])
    assert asked == ["a", "b", "c"] and iter_once == ["b", "c"]
