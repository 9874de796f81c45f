"""What expressions can't do in time that follows the length of a text: many keys in one pass, places of matches, cuts by code point, replacements.

Arrow UDFs over whole batches; each text takes one pass, however many matches it holds.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

#: Texts that are worked on at a time: what Python holds of a batch follows from these, not from its rows.
SLICE = 256
SPAN = StructType().add("text", StringType()).add("label", StringType()).add("start", IntegerType()).add("end", IntegerType()).add("ord", IntegerType())
PLACED = StructType().add("token", StringType()).add("start", IntegerType()).add("end", IntegerType())
WORD = StructType().add("token", StringType()).add("start", IntegerType()).add("end", IntegerType()).add("tag", StringType()).add("tag_id", IntegerType())
#: What words are made of.
WORDS = r"[^\s\x1c-\x1f]+"
WORD_PATTERN = re.compile(WORDS)
#: Code points that match an ASCII letter in another case but aren't lowered to it, one for one.
FOLDED = {"\u0130": "i", "\u0131": "i", "\u017f": "s"}


@lru_cache(maxsize=16)
def automaton(keys: tuple[str, ...]) -> ahocorasick.Automaton:
    """An Aho-Corasick automaton that says which keys end at a place."""
    made = ahocorasick.Automaton()
    for k, key in enumerate(keys):
        made.add_word(key, k)
    made.make_automaton()
    return made


def occurrences(text: str, keys: tuple[str, ...], any_case: bool, whole: bool) -> list[tuple[int, int, int]]:
    """``start``, ``end`` and number of the key of all matches; those of one key don't overlap, those of several may.

    With ``any_case`` the keys are in lower case; with ``whole`` no ASCII letter
    may stand on either side of a match.
    """
    seen, last, found = text, {}, []
    if any_case:
        for c, plain in () if text.isascii() else FOLDED.items():
            seen = seen.replace(c, plain)
        seen = seen.lower()
    for at, k in automaton(keys).iter(seen):
        end = at + 1
        start = end - len(keys[k])
        if whole and (_letter(text, start - 1) or _letter(text, end)) or start < last.get(k, 0):
            continue
        last[k] = end
        found.append((start, end, k))
    return found


def _letter(text: str, at: int) -> bool:
    return 0 <= at < len(text) and text[at].isascii() and text[at].isalpha()


def replaced(text: str, starts: Iterable[int], ends: Iterable[int], values: Iterable[str]) -> str:
    """``text`` with each span replaced in the order given, which goes from right to left; a span may reach into those replaced before."""
    edge, after = len(text), []
    for start, end, value in zip(starts, ends, values, strict=True):
        if end > edge:
            after = ["".join(reversed(after))[end - edge :]]
        else:
            after.append(text[end:edge])
        after.append(value)
        edge = start
    after.append(text[:edge])
    return "".join(reversed(after))


def sliced(f: Callable[..., pa.Array]) -> Callable[..., pa.Array]:
    """``f`` by slices of its columns."""

    def run(*columns: pa.Array) -> pa.Array:
        n = len(columns[0])
        return f(*columns) if n <= SLICE else pa.concat_arrays([f(*[c.slice(at, SLICE) for c in columns]) for at in range(0, n, SLICE)])

    return run


def _lists(counts: list[int | None], values: pa.Array) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([n or 0 for n in counts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array([n is None for n in counts]))


#: Of a text the ``start``, ``end``, label and place ``ord`` of matches.
Hits = Callable[[str], Iterable[tuple[int, int, str, int]]]


def _spans(texts: list[str | None], found: Iterable[Iterable[tuple[int, int, str, int]]]) -> pa.ListArray:
    """Spans of each text from its matches."""
    counts, cells = [], ([], [], [], [], [])
    for t, of in zip(texts, found, strict=True):
        if t is None:
            counts.append(None)
            continue
        n = len(cells[0])
        for start, end, label, ord_ in of:
            for cell, v in zip(cells, (t[start:end], label, start, end, ord_), strict=True):
                cell.append(v)
        counts.append(len(cells[0]) - n)
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
    return _lists(counts, pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], ["text", "label", "start", "end", "ord"]))


def _found(texts: pa.Array, hits: Hits) -> pa.ListArray:
    some = texts.to_pylist()
    return _spans(some, (() if t is None else hits(t) for t in some))


def key_hits(keys: list[str], labels: list[str], ords: list[int], any_case: bool, whole: bool = False) -> Hits:
    """All matches of ``keys``, from right to left; each key has its label and its place ``ord``."""
    looked = tuple(k.lower() if any_case else k for k in keys)

    def hits(t: str) -> list[tuple[int, int, str, int]]:
        found = [(start, end, labels[k], ords[k]) for start, end, k in occurrences(t, looked, any_case, whole)]
        return sorted(found, key=lambda h: (-h[0], h[3]))

    return hits


def find_keys(text: Column, keys: list[str], labels: list[str], ords: list[int], any_case: bool, whole: bool = False) -> Column:
    """Spans of what ``key_hits`` finds."""
    hits = key_hits(keys, labels, ords, any_case, whole)
    return F.arrow_udf(lambda texts: sliced(lambda some: _found(some, hits))(texts), ArrayType(SPAN))(text)


def matches(text: str, pattern: re.Pattern, start: re.Pattern | None) -> Iterator[re.Match]:
    """Matches left to right and without overlap; with ``start`` only its places are tried, which is faster where a set of characters is looked for."""
    if start is None:
        yield from pattern.finditer(text)
        return
    end = 0
    for m in start.finditer(text):
        if m.start() >= end and (found := pattern.match(text, m.start())):
            yield found
            end = found.end()


def pattern_hits(patterns: list[tuple[str, str]], flags: int = 0, first: int = 0, anywhere: str | None = None, begins: str | None = None) -> Hits:
    """Matches of each pattern (a label and a regular expression), left to right and without overlap within one.

    Of an expression with a group the group is the span. Places ``ord`` begin with
    ``first``. The expression ``anywhere`` matches, without length, where any pattern
    does: only patterns that match at one of these places are looked for. With
    ``begins``, a set of word characters as in ``[...]``, each match begins a word with one of these.
    """
    start = begins and re.compile(rf"[{begins}](?<!\w.)")
    where = anywhere and re.compile(anywhere, flags)
    made = [(re.compile(pattern, flags), label, first + k) for k, (label, pattern) in enumerate(patterns)]

    def hits(t: str) -> Iterator[tuple[int, int, str, int]]:
        some = made
        if where:
            places, some = [m.start() for m in where.finditer(t)], []
            if places:
                some = [x for x in made if any(x[0].match(t, at) for at in places)]
        for pattern, label, ord_ in some:
            group = min(pattern.groups, 1)
            for m in matches(t, pattern, start):
                yield m.start(group), m.end(group), label, ord_

    return hits


def find_patterns(text: Column, patterns: list[tuple[str, str]], flags: int = 0, first: int = 0, anywhere: str | None = None, begins: str | None = None) -> Column:
    """Spans of what ``pattern_hits`` finds."""
    hits = pattern_hits(patterns, flags, first, anywhere, begins)
    return F.arrow_udf(lambda texts: sliced(lambda some: _found(some, hits))(texts), ArrayType(SPAN))(text)


def longest(hits: Hits) -> Hits:
    """Of the matches those of ``spans.longest``: without overlaps, left to right; a strictly longer one wins."""

    def some(t: str) -> list[tuple[int, int, str, int]]:
        out: list[tuple[int, int, str, int]] = []
        for h in sorted(hits(t), key=lambda h: (h[0], -h[1], h[3])):
            if not out or h[0] >= out[-1][1]:
                out.append(h)
            elif h[1] - h[0] > out[-1][1] - out[-1][0]:
                out[-1] = h
        return out

    return some


#: What is looked for, and what stands in place of a match, from its text and its label.
Step = tuple[Hits, Callable[[str, str], str]]


def _rewritten(texts: pa.Array, steps: list[Step]) -> pa.StructArray:
    now, spans = texts.to_pylist(), []
    for hits, value in steps:
        found = [[] if t is None else list(hits(t)) for t in now]
        spans.append(_spans(now, found))
        order = [sorted(of, key=lambda h: (-h[0], h[3])) for of in found]
        now = [t and replaced(t, [h[0] for h in of], [h[1] for h in of], [value(t[h[0] : h[1]], h[2]) for h in of]) for t, of in zip(now, order, strict=True)]
    return pa.StructArray.from_arrays([pa.array(now, pa.string()), *spans], ["text", *[f"found{k}" for k in range(len(steps))]])


def rewritten(text: Column, steps: list[Step]) -> Column:
    """``text`` after ``steps``, each of which replaces matches in what the one before left; their spans are ``found0``, ``found1`` and so on.

    All steps take one worker, and its results leave by slices: what a task's
    Python holds is a batch that came in and a slice, however many steps there are.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for at in range(0, max(len(texts), 1), SLICE):
                yield _rewritten(texts.slice(at, SLICE), steps)

    kind = StructType().add("text", StringType())
    for k in range(len(steps)):
        kind = kind.add(f"found{k}", ArrayType(SPAN))
    return F.arrow_udf(run, kind)(text)


def tags_of(words: list[tuple[int, int]], entities: list[tuple[int, int, str]]) -> list[str]:
    """The tag of each word: of the first entity that holds it, or most of it.

    Words (``start``, ``end``) stand in order, entities (``start``, ``end``, label) by their starts.
    """
    out, low = [], 0
    for start, end in words:
        while low < len(entities) and entities[low][1] <= start:
            low += 1
        tag = "O"
        for k in range(low, len(entities)):
            a, b, label = entities[k]
            if a >= end:
                break
            inside = a <= start and end <= b
            if b > start and (inside or 2 * (min(b, end) - max(a, start)) > end - start):
                tag = ("B-" if (start == a if inside else start <= a) else "I-") + label
                break
        out.append(tag)
    return out


def _words(texts: pa.Array) -> pa.ListArray:
    counts, cells = [], ([], [], [])
    for t in texts.to_pylist():
        places = [m.span() for m in WORD_PATTERN.finditer(t or "")]
        counts.append(len(places))
        for cell, some in zip(cells, ([t[a:b] for a, b in places], [a for a, _ in places], [b for _, b in places]), strict=True):
            cell.extend(some)
    kinds = (pa.string(), pa.int32(), pa.int32())
    return _lists(counts, pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], PLACED.names))


def words(text: Column) -> Column:
    """The words of ``text`` with their places, none for a null; results leave by slices, as those of ``rewritten``."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for at in range(0, max(len(texts), 1), SLICE):
                yield _words(texts.slice(at, SLICE))

    return F.arrow_udf(run, ArrayType(PLACED))(text)


def tag_words(text: Column, entities: Column, ids: dict[str, int]) -> Column:
    """The words of ``text`` with their places and the tags that ``entities`` (label, start, end) give them; a tag that ``ids`` don't have is 0."""

    def tagged(texts: pa.Array, labels: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        counts, cells = [], ([], [], [], [], [])
        for t, *of in zip(*[c.to_pylist() for c in (texts, labels, starts, ends)], strict=True):
            if t is None:
                counts.append(None)
                continue
            known = [(a, b, label) for label, a, b in zip(*[x or [] for x in of], strict=True) if None not in (label, a, b)]
            places = [m.span() for m in WORD_PATTERN.finditer(t)]
            tags = tags_of(places, sorted(known, key=lambda e: e[0]))
            for cell, some in zip(cells, ([t[a:b] for a, b in places], [a for a, _ in places], [b for _, b in places], tags, [ids.get(x, 0) for x in tags]), strict=True):
                cell.extend(some)
            counts.append(len(places))
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32())
        return _lists(counts, pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], WORD.names))

    run = F.arrow_udf(lambda texts, labels, starts, ends: sliced(tagged)(texts, labels, starts, ends), ArrayType(WORD))
    return run(text, *[entities[c] for c in ("label", "start", "end")])


@F.arrow_udf(ArrayType(StringType()))
def _cut(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    return sliced(_parts)(texts, starts, ends)


def _parts(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    counts, out = [], []
    for t, a, b in zip(texts.to_pylist(), starts.to_pylist(), ends.to_pylist(), strict=True):
        some = None if t is None or a is None or b is None else [t[i:j] for i, j in zip(a, b, strict=True)]
        counts.append(None if some is None else len(some))
        out.extend(some or [])
    return _lists(counts, pa.array(out, pa.string()))


def cut(text: Column, starts: Column, ends: Column) -> Column:
    """The parts of ``text`` between ``starts`` and ``ends`` (arrays of code points, neither below 0)."""
    return _cut(text, starts, ends)


@F.arrow_udf(StringType())
def _splice(texts: pa.Array, starts: pa.Array, ends: pa.Array, values: pa.Array) -> pa.Array:
    return sliced(_spliced)(texts, starts, ends, values)


def _spliced(texts: pa.Array, starts: pa.Array, ends: pa.Array, values: pa.Array) -> pa.Array:
    rows = zip(texts.to_pylist(), starts.to_pylist(), ends.to_pylist(), values.to_pylist(), strict=True)
    return pa.array([None if None in row else replaced(*row) for row in rows], pa.string())


def splice(text: Column, starts: Column, ends: Column, values: Column) -> Column:
    """``text`` with its spans replaced, in the order of the arrays, which goes from right to left."""
    return _splice(text, starts, ends, values)
