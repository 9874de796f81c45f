"""Exact fingerprints of canonical texts, with DataFrame functions only.

A text is put into composed Unicode form, its case is folded, runs of white space
become one space and the ends are trimmed; two chained xxhash64 of the result are
the fingerprint. Equal fingerprints are a bucket, inside which the canonical
texts themselves are compared: should unequal ones ever meet, all but the least
get a number after the digest.

Most texts are composed already, which one look at their characters shows. The
others are decomposed, their marks ordered and then composed again, by tables
that are built from the Unicode data of Python when the plan is made.

Defined results: a null text counts as empty; empty texts share a fingerprint;
null ids come last in the order of documents; rows that share an id, or have none,
are ordered by a hash of their texts, then by these; repeated rows each get their
own result; an empty table gives no rows. Columns other than
the id and the text are not read.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notesift.llm.common import discard, stored

#: Rows in a range of the order, about.
SPAN = 4096
#: Rows of two numbers that are broadcast at most.
SMALL = 1_000_000
#: White space of ASCII, and all of it; a single plain space needs no replacement.
ASCII_SPACE, ANY_SPACE = r"\t\n\x0B\f\r\x1c-\x1f", r"\t\n\x0B\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _ranges(points: list[int]) -> str:
    """A regular expression's class."""
    out, start = [], None
    points = sorted(set(points))
    for k, p in enumerate(points):
        start = p if start is None else start
        if k + 1 == len(points) or points[k + 1] != p + 1:
            out.append(f"\\x{{{start:X}}}" + (f"-\\x{{{p:X}}}" if p > start else ""))
            start = None
    return "[" + "".join(out) + "]"


@cache
def unicode_tables() -> dict:
    """What normalisation needs: classes of characters and pairs, by rule from the Unicode data."""
    norm, chars = unicodedata.normalize, [chr(p) for p in range(0x80, sys.maxunicode + 1) if not 0xD800 <= p < 0xE000]
    hangul = range(0xAC00, 0xD7A4)
    marks = {c: unicodedata.combining(c) for c in chars if unicodedata.combining(c)}
    split = [(c, norm("NFD", c)) for c in chars if ord(c) not in hangul and norm("NFD", c) != c]
    # a pair composes if its first canonical decomposition is that pair and composing gives the character back
    pairs = []
    for c, _ in split:
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<") and norm("NFC", c) == c:
            pairs.append(("".join(chr(int(x, 16)) for x in parts), c))
    syllables = [(norm("NFD", chr(p)), chr(p)) for p in hangul]
    seconds = {p[0][1] for p in pairs} | {s[2] for s, _ in syllables if len(s) == 3} | {s[1] for s, _ in syllables}
    not_composed = [c for c, _ in split if norm("NFC", c) != c]
    # longer results first, so that what composes twice is found whole
    syllables.sort(key=lambda x: -len(x[0]))
    depth = lambda c: len(norm("NFD", c))
    pairs.sort(key=lambda x: (depth(x[1]), x[1]))
    return {
        # none of them is below U+0300, so one comparison settles most characters
        "look": r"[\x{300}-\x{10FFFF}&&" + _ranges([ord(c) for c in {*marks, *seconds, *not_composed}]) + "]",
        "marks": marks,
        "mark": _ranges([ord(c) for c in marks]),
        "rest": _ranges([ord(c) for c in marks]).replace("[", "[^", 1),
        "split": split,
        "pairs": pairs,
        "syllables": syllables,
        "jamo": _ranges([ord(s[0]) for s, _ in syllables] + [ord(s[1]) for s, _ in syllables] + [ord(s[2]) for s, _ in syllables if len(s) == 3]),
    }


def _replaced(text: Column, table: list[tuple[str, str]]) -> Column:
    """``text`` with every pair of ``table`` replaced, one after the other."""
    pairs = F.split(F.lit("\n".join(f"{a}\t{b}" for a, b in table)), "\n")
    return F.aggregate(pairs, text, lambda acc, p: F.replace(acc, F.substring_index(p, "\t", 1), F.substring_index(p, "\t", -1)))


def composed(text: Column) -> Column:
    """Canonical composition (NFC up to the place of marks that do not compose); equivalent texts become equal."""
    t = unicode_tables()
    apart = _replaced(text, t["split"])
    order = F.str_to_map(F.lit("\n".join(f"{c}\t{k:03d}" for c, k in t["marks"].items())), F.lit("\n"), F.lit("\t"))
    parts = F.regexp_extract_all(apart, F.lit(f"{t['rest']}+|{t['mark']}+"), F.lit(0))

    def sorted_run(s: Column) -> Column:
        keyed = F.transform(F.split(s, ""), lambda c, k: F.struct(F.element_at(order, c).alias("o"), k.alias("k"), c.alias("c")))
        run = F.array_join(F.transform(F.array_sort(keyed), lambda x: x["c"]), "")
        return F.when((F.length(s) > 1) & s.rlike("^" + t["mark"]), run).otherwise(s)

    ordered = F.array_join(F.transform(parts, sorted_run), "")
    joined = _replaced(ordered, t["pairs"])
    return F.when(joined.rlike(t["jamo"]), _replaced(_replaced(joined, [(c, s) for s, c in t["syllables"] if len(s) == 2]), t["syllables"])).otherwise(joined)


def canonical(text: Column) -> Column:
    """Composed, case-folded, with single spaces and trimmed; null becomes empty."""
    text = F.coalesce(text, F.lit(""))
    plain = F.length(text) == F.octet_length(text)  # ASCII
    whole = F.when(text.rlike(unicode_tables()["look"]), composed(text)).otherwise(text)
    spaced = lambda t, kinds: F.regexp_replace(t, f"[ {kinds}]{{2,}}|[{kinds}]", " ")
    folded = F.replace(F.lower(F.upper(whole)), F.lit("ς"), F.lit("σ"))
    return F.trim(F.when(plain, spaced(F.lower(text), ASCII_SPACE)).otherwise(spaced(folded, ANY_SPACE)))


def digest(text: Column) -> Column:
    """128 bits: xxhash64 of the canonical text, and of it after a constant."""
    one = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.concat(one(F.xxhash64(text)), one(F.xxhash64(F.lit(1), text)))


def source(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def collisions(docs: DataFrame, **cols: str) -> DataFrame | None:
    """``digest``, ``canon`` and ``number`` (from 1) of unequal texts that share a digest; None without any.

    Only buckets of two rows or more bring their texts, and copies are combined
    before they are dealt out.
    """
    hashed = source(docs, **cols).select(canonical(F.col("text")).alias("canon")).withColumn("digest", digest(F.col("canon")))
    shared, path = stored(hashed.groupBy("digest").count().where("count > 1").select("digest"), "buckets")
    n = shared.count()
    texts = hashed.join(F.broadcast(shared) if n <= SMALL else shared, "digest", "left_semi").select("digest", "canon").distinct()
    unequal = texts.groupBy("digest").agg(F.sort_array(F.collect_list("canon")).alias("all")).where(F.size("all") > 1)
    found, kept = stored(unequal.select("digest", F.posexplode("all").alias("number", "canon")).withColumn("number", F.col("number") + 1), "collisions")
    discard(docs.sparkSession, path)
    if found.count():
        return found
    discard(docs.sparkSession, kept)
    return None


def named(rows: DataFrame, found: DataFrame | None, canon: str, name: str) -> DataFrame:
    """``rows`` with the fingerprint ``name`` of the column ``canon``."""
    rows = rows.withColumn(name, digest(F.col(canon)))
    if found is None:
        return rows
    number = found.where("number > 1").select(F.col("digest").alias(name), F.col("canon").alias(canon), F.concat(F.lit("-"), "number").alias("suffix"))
    return rows.join(number, [name, canon], "left").withColumn(name, F.concat(name, F.coalesce("suffix", F.lit("")))).drop("suffix")


def groups(docs: DataFrame, **cols: str) -> DataFrame:
    """``id``, ``fingerprint`` and ``first`` (the least id with an equal canonical text) of every row."""
    rows = named(source(docs, **cols).select("id", canonical(F.col("text")).alias("canon")), collisions(docs, **cols), "canon", "fingerprint")
    rows = rows.select("id", "fingerprint")
    return rows.join(rows.groupBy("fingerprint").agg(F.min("id").alias("first")), "fingerprint").select("id", "fingerprint", "first")


def ranges(rows: DataFrame) -> Column:
    """A number for each row of ``rows`` (``id``, ``tie``) that rises with the id and has about SPAN rows; below zero, by ``tie``, for null ids.

    Quantiles of the ids cut them into a few hundred intervals, and each interval
    into equal parts, all in floating point: ids may be sparse or at the ends of
    their type, and outliers stretch the outermost intervals only.
    """
    n, nulls = rows.agg(F.count("id"), F.count_if(F.col("id").isNull())).first()
    value = F.col("id").cast("double")
    ends = [10.0**-k for k in range(3, 8)]
    shares = sorted({0.0, 1.0, *(k / 256 for k in range(1, 256)), *ends, *(1 - x for x in ends)})
    cuts = sorted(set(rows.where("id is not null").select(value.alias("v")).approxQuantile("v", shares, 1e-4))) if n > SPAN else []
    parts = max(1, n // (SPAN * max(1, len(cuts))))
    edge = F.array(*[F.lit(x) for x in cuts]) if cuts else F.array().cast("array<double>")
    which = F.size(F.filter(edge, lambda x: x <= value))
    low, high = F.get(edge, which - 1), F.get(edge, which)
    inside = F.least(F.lit(parts - 1), F.floor((value - low) / (high - low) * parts))
    null_parts = nulls // SPAN + 1
    by_tie = F.floor((F.col("tie").cast("double") / 2.0**64 + 0.5) * null_parts)
    return F.when(F.col("id").isNull(), -1 - by_tie).otherwise(which.cast("long") * parts + F.coalesce(inside, F.lit(0))).cast("long")


def with_next(docs: DataFrame, **cols: str) -> tuple[DataFrame, Window]:
    """``id``, ``text`` and ``next``, the text of the document after it in descending order of ids (of the last: the first's).

    Documents are dealt out once, by ranges of ids; the first of each range goes
    to the range before it as well. Also returns the window, for more columns of
    the next row without another exchange.
    """
    rows = source(docs, **cols).withColumn("tie", F.xxhash64("text"))
    rows = rows.withColumn("bucket", ranges(rows))
    # the complement of the hash falls as it rises, so the greatest has the least of it
    heads = rows.groupBy("bucket").agg(F.max(F.struct("id", F.bitwise_not("tie").alias("tie"))).alias("head"))
    across = Window.orderBy(F.desc("bucket"))  # a row for each range of SPAN ids
    heads = heads.withColumn("above", F.lag("bucket").over(across))
    heads, _ = stored(heads, "heads")
    n_heads = heads.count()
    last = heads.agg(F.min("bucket")).first()[0]
    heads = heads.select("bucket", F.col("head.id").alias("id"), F.bitwise_not("head.tie").alias("tie"), F.coalesce("above", F.lit(last)).alias("above"))
    side = F.broadcast(heads) if n_heads <= SMALL else heads
    same = F.expr("r.bucket = h.bucket and r.tie = h.tie and r.id <=> h.id")
    both = rows.alias("r").join(side.alias("h"), same, "left").select("r.id", "r.text", "r.tie", "r.bucket", "h.above")
    dealt = both.select(
        "id",
        "text",
        "tie",
        F.explode(
            F.when(F.col("above").isNull(), F.array(F.struct(F.col("bucket"), F.lit(0).alias("guest")))).otherwise(
                F.array(F.struct(F.col("bucket"), F.lit(0).alias("guest")), F.struct(F.col("above").alias("bucket"), F.lit(1).alias("guest")))
            )
        ).alias("at"),
    ).select("id", "text", "tie", "at.bucket", "at.guest")
    window = Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("id"), "tie", "text")
    return dealt.withColumn("next", F.lead("text").over(window)), window


def edited(docs: DataFrame, **cols: str) -> DataFrame:
    """Fingerprints of every text, of the text with its last third replaced by the next one's beginning, and their likeness.

    Likeness of exact fingerprints is 1 for equal canonical texts and else 0.
    """
    found = collisions(docs, **cols)
    rows, window = with_next(docs, **cols)
    rows = named(rows.withColumn("canon", canonical(F.col("text"))), found, "canon", "fingerprint")
    rows = rows.withColumn("next_fingerprint", F.lead("fingerprint").over(window)).where("guest = 0")
    third = F.floor(F.length("text") / 3).cast("int")
    rows = rows.withColumn("edit", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - third), F.substring(F.col("next"), F.lit(1), third)))
    rows = named(rows.withColumn("edit_canon", canonical(F.col("edit"))), found, "edit_canon", "edited_fingerprint")
    like = lambda same, other: F.when(same, F.when(F.col("canon") == other, 1.0).otherwise(0.0)).otherwise(0.0)
    return rows.select(
        "id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edit"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        like(F.col("fingerprint") == F.col("edited_fingerprint"), F.col("edit_canon")).alias("near_edited"),
        like(F.col("fingerprint") == F.col("next_fingerprint"), canonical(F.col("next"))).alias("near_next"),
    )
