"""Benchmark questions in documents, also with other numbers, names and units.

Texts become templates: numbers, names (capitalised words) and units after a number
are typed placeholders, other words are literal, without case and outer punctuation.
A capital may be a name or the start of a sentence, so two words agree if both have
one, or if they are equal. Windows of template tokens, and of plain tokens, are
joined by hash with those of the benchmark; each gives a diagonal, whose tokens are
compared, and a slot must keep its value: where the item repeats a number or a name,
so must the document. A document leaks if a run has 13 tokens, or an entire shorter
item, and 4 literal ones among them, or if all tokens of such a run are equal.

Items of fewer than 5 tokens must occur token by token; those of fewer than 3 are
ordinary phrases and are not searched. The item side is collected in blocks of a fixed number of items, each of which is matched
with all documents, so its memory doesn't grow with the benchmark.

Defined results: null and empty texts and items match nothing; repeated items
are reported under each id; null ids are kept; repeated rows are tested each by
itself; an empty table gives no rows, an empty benchmark no leaks. Other columns
are kept as asked, whatever their names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notesift.llm.common import stored, unused

#: Tokens in a window, in a run that counts, and literal ones that it needs.
WINDOW, RUN, LITERAL = 8, 13, 4
#: Literal tokens that are enough where an item of at most RUN tokens occurs whole.
WHOLE = 3
#: Tokens of the shortest item that is searched by template, and by plain tokens.
TEMPLATE, PLAIN = 4, 3
#: Items that are held in memory at once.
BLOCK = 5_000
#: Tokens of a worker's cache; it is cleared when full.
CACHE = 300_000
UNITS = frozenset(
    "mm cm m km meter meters metre metres kilometer kilometers kilometre kilometres inch inches ft foot feet yard yards mile miles "
    "mg g kg gram grams kilogram kilograms oz ounce ounces lb lbs pound pounds ton tons ml l liter liters litre litres gallon gallons cup cups "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros usd eur gbp yen rupees percent degrees mph kmh km/h m/s hz khz mhz ghz w kw watt watts volt volts joules kb mb gb tb".split()
)
NUMBER = re.compile(r"[+-]?\d[\d.,:/]*\Z")
ATTACHED = re.compile(r"(?<=\d)(?=[^\W\d_%])")
ANY_ATTACHED = re.compile(r"\d[^\W\d_%]")
OUTER = re.compile(r"\A[\W_]+|[\W_]+\Z")
#: What may follow a plain word in its token, and what of it ends a sentence or line.
AFTER, STOPS = "\x02.,;:!?", "\x02.:!?"
CAPITAL, ENDS, NUMERIC, UNIT = 1, 2, 4, 8
#: Codes of the placeholders.
NUMBER_SLOT, NAME_SLOT, UNIT_SLOT = np.uint64(1), np.uint64(2), np.uint64(3)
BASE = np.uint64(0x9E3779B97F4A7C15)


def code(token: str) -> int:
    """A hash of the literal token with flags in the low bits."""
    word = token.rstrip(AFTER)
    if word.isalpha():  # most tokens: a word, and what ends it
        lower = word.lower()
        flags = ENDS * (token[-1] in STOPS) | UNIT * (lower in UNITS) | CAPITAL * (word[0].isupper() and not word[1:].isupper())
        return xxhash.xxh64_intdigest(lower.encode("utf-8", "surrogatepass")) & ~15 | flags
    ends = token[-1] == "\x02" or token.rstrip("\x02)\"'”’»")[-1:] in (".", "!", "?", ":")
    word = OUTER.sub("", token)
    flags = ENDS * ends
    if NUMBER.match(word):
        flags |= NUMERIC
    else:
        flags |= UNIT * (word.lower() in UNITS) | CAPITAL * (word[:1].isupper() and not word[1:].isupper())
    return xxhash.xxh64_intdigest(word.lower().encode("utf-8", "surrogatepass")) & ~15 | flags


class Codes(dict[str, int]):
    """Codes of the tokens seen so far."""

    def __missing__(self, token: str) -> int:
        self[token] = found = code(token)
        return found


class Templates:
    """Template tokens of texts; codes of raw tokens are looked up."""

    def __init__(self) -> None:
        self.known = Codes()

    def tokens(self, text: str | None) -> list[str]:
        text = text or ""
        if ANY_ATTACHED.search(text):
            text = ATTACHED.sub(" ", text)
        return text.replace("\n", "\x02 ").split()

    def raw(self, tokens: list[str]) -> np.ndarray:
        if len(self.known) > CACHE:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))

    def codes(self, tokens: list[str]) -> np.ndarray:
        return Coded.of(self.raw(tokens)).template


@dataclass
class Coded:
    """Tokens as plain codes, whether they have a capital, and as template codes, where it is a name inside a sentence only."""

    plain: np.ndarray
    capital: np.ndarray
    template: np.ndarray

    @classmethod
    def of(cls, raw: np.ndarray) -> Coded:
        flags = (raw & np.uint64(15)).astype(np.uint8)
        plain = raw | np.uint64(15)
        out = plain.copy()
        inside = np.zeros(len(raw), dtype=bool)
        inside[1:] = (flags[:-1] & ENDS) == 0
        number = (flags & NUMERIC) > 0
        after = np.zeros(len(raw), dtype=bool)
        after[1:] = number[:-1]
        capital, unit = (flags & CAPITAL) > 0, ((flags & UNIT) > 0) & after
        out[capital & inside] = NAME_SLOT
        out[unit] = UNIT_SLOT
        out[number] = NUMBER_SLOT
        return cls(plain, capital & ~unit, out)

    def loose(self, names: np.ndarray) -> np.ndarray:
        """Codes that are the same for all tokens that may agree: words that the items write with a capital are names as well."""
        out = self.template.copy()
        out[self.capital | ((out > UNIT_SLOT) & names[self.plain >> np.uint64(44)])] = NAME_SLOT
        return out


@cache
def worker_templates() -> Templates:
    """One for each worker process, whose tasks share the cache."""
    return Templates()


def windows(codes: np.ndarray, size: int) -> np.ndarray:
    n = len(codes) - size + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        h = h * BASE + codes[k : k + n]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


@dataclass
class Items:
    """A block of the benchmark: its template windows by size."""

    ids: list[int]
    tokens: list[list[str]] = field(default_factory=list)
    codes: list[Coded] = field(default_factory=list)
    names: np.ndarray = field(default_factory=lambda: np.zeros(1 << 20, dtype=bool))
    tables: dict[tuple[bool, int], dict[int, list[tuple[int, int]]]] = field(default_factory=dict)
    bitmaps: dict[tuple[bool, int], np.ndarray] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list[tuple[int, str | None]]) -> Items:
        made, templates = cls([i for i, _ in rows]), Templates()
        with np.errstate(over="ignore"):
            for _, text in rows:
                tokens = templates.tokens(text)
                made.tokens.append(tokens)
                made.codes.append(coded := Coded.of(templates.raw(tokens)))
                made.names[coded.plain[coded.capital] >> np.uint64(44)] = True
            tables = defaultdict(lambda: defaultdict(list))
            for k, coded in enumerate(made.codes):
                size = min(WINDOW, len(coded.plain))
                for loose, least in ((True, TEMPLATE), (False, PLAIN)):
                    for at, h in enumerate(windows(coded.loose(made.names) if loose else coded.plain, size).tolist() if size >= least else ()):
                        tables[loose, size][h].append((k, at))
        for key, table in tables.items():
            made.tables[key] = dict(table)
            made.bitmaps[key] = np.zeros(1 << 20, dtype=bool)
            made.bitmaps[key][np.fromiter(table, dtype=np.uint64, count=len(table)) >> np.uint64(44)] = True
        return made


def slot_value(token: str) -> str:
    return OUTER.sub("", token).lower()


def consistent_runs(item: Coded, item_tokens: list[str], doc: Coded, doc_tokens: list[str], at: int, i: int, n: int) -> Iterator[tuple[int, int]]:
    """Parts (offset, length) of ``n`` tokens from ``at`` in the item and ``i`` in the document that agree and keep their slots' values."""
    x, y = item.template[at : at + n], doc.template[i : i + n]
    typed = (x == y) & ((x == NUMBER_SLOT) | (x == UNIT_SLOT))
    named = item.capital[at : at + n]
    agree = (typed | (item.plain[at : at + n] == doc.plain[i : i + n]) | (named & doc.capital[i : i + n])).tolist()
    kinds = np.where(typed, x, np.where(named, NAME_SLOT, np.uint64(0))).tolist()
    start, slots = 0, {}
    for k in range(n + 1):
        same = k < n and agree[k]
        if same and kinds[k]:
            key, value = (kinds[k], slot_value(item_tokens[at + k])), slot_value(doc_tokens[i + k])
            same = slots.setdefault(key, value) == value
        if not same:
            if k > start:
                yield start, k - start
            start, slots = k + 1, {}


def longest(equal: np.ndarray) -> int:
    """The longest row of true values."""
    cuts = np.flatnonzero(~np.concatenate([[False], equal, [False]]))
    return int(np.diff(cuts).max()) - 1


def leaks(items: Items, templates: Templates, text: str | None) -> list[tuple[int, int, int]]:
    """``(item id, first token, end)`` of every run that counts."""
    tokens = templates.tokens(text)
    if len(tokens) < PLAIN or not items.tables:
        return []
    coded, diagonals = Coded.of(templates.raw(tokens)), set()
    loose = coded.loose(items.names)
    for key, table in items.tables.items():
        h = windows(loose if key[0] else coded.plain, key[1])
        hits = np.flatnonzero(items.bitmaps[key][h >> np.uint64(44)])
        for i, x in zip(hits.tolist(), h[hits].tolist(), strict=True):
            for k, at in table.get(x, ()):
                diagonals.add((k, i - at))
    found = set()
    for k, shift in diagonals:
        item, at = items.codes[k], max(0, -shift)
        n, need = min(len(item.plain) - at, len(tokens) - shift - at), min(RUN, len(item.plain))
        short = len(item.plain) <= RUN
        if np.count_nonzero(item.plain[at : at + n] == coded.plain[shift + at : shift + at + n]) < min(WHOLE if short else LITERAL, need):
            continue  # too few equal tokens for either rule
        for off, length in consistent_runs(item, items.tokens[k], coded, tokens, at, shift + at, n) if n >= need else ():
            if length < need:
                continue
            p, q = at + off, shift + at + off
            equal = item.plain[p : p + length] == coded.plain[q : q + length]
            literal = int((equal & (item.template[p : p + length] > UNIT_SLOT)).sum())
            if (literal >= (WHOLE if short else LITERAL) and need >= TEMPLATE) or longest(equal) >= need:
                found.add((items.ids[k], q, q + length))
    return sorted(found, key=lambda x: (x[1], x[0], x[2]))


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Items]:
    """The benchmark, BLOCK items at a time at most (about: dealt by hash)."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null and id is not null")
    n = rows.count()
    parts = -(-n // (BLOCK // 2))
    for k in range(parts):
        part = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k)
        yield Items.of([(r.id, r.text) for r in part.collect()])


LEAKS = "array<struct<item:long,start:long,end:long>>"


def searched(spark: SparkSession, items: Items) -> Callable[[Column], Column]:
    """A function of a text column: the leaks of a block of items."""
    shared = spark.sparkContext.broadcast(items)  # at most about BLOCK items
    kind = pa.list_(pa.struct([("item", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf(LEAKS)
    def search(texts: pa.Array) -> pa.Array:
        with np.errstate(over="ignore"):
            got = [leaks(shared.value, worker_templates(), x.as_py()) for x in texts]
        return pa.array([[dict(zip(("item", "start", "end"), x, strict=True)) for x in row] for row in got], kind)

    return search


def with_leaks(docs: DataFrame, benchmark: DataFrame, name: str = "leaks", text_col: str = "text") -> DataFrame:
    """``docs`` and the array ``name`` (which no column may have) of item, start and end in tokens."""
    out = docs.withColumn(name, F.array().cast(LEAKS))
    for k, items in enumerate(blocks(benchmark)):
        if k:  # one block in memory at a time
            out, _ = stored(out, "leaks")
        found = searched(docs.sparkSession, items)(F.col(text_col))
        out = out.withColumn(name, F.concat(name, found) if k else found)
    return out


def matched(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``leaks``."""
    return with_leaks(docs.select(*keep, F.col(text_col).alias("searched text")), benchmark, "leaks", "searched text").drop("searched text")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that leak; its columns may have any names."""
    name = unused("leaks", docs)
    return with_leaks(docs, benchmark, name, text_col).where(F.size(name) == 0).drop(name)
