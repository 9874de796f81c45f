"""Cleaning, abbreviations, protected information, sections and paragraphs, as functions of text columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from notesift.functions import constants as C
from notesift.functions import kernel, spans

#: Regular expressions here count all of Unicode's white space, and only a line feed ends a line.
U = "(?Ud)"
STRIP = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


@F.arrow_udf(StringType())
def _nfc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        for at in range(0, max(len(texts), 1), kernel.SLICE):
            yield pa.array([None if x is None else unicodedata.normalize("NFC", x) for x in texts.slice(at, kernel.SLICE).to_pylist()], pa.string())


def fix_encoding(text: Column) -> Column:
    """Composed Unicode form, without byte order marks and nulls; only texts with characters that may combine leave the JVM."""
    composed = F.when(text.rlike(r"[\x{300}-\x{10FFFF}]"), _nfc(F.when(text.rlike(r"[\x{300}-\x{10FFFF}]"), text))).otherwise(text)
    return F.translate(composed, "﻿\x00", "")


def remove_control_chars(text: Column) -> Column:
    return F.regexp_replace(text, r"[\p{Cc}&&[^\n\t\r]]", "")


def fix_ehr_artifacts(text: Column) -> Column:
    for pattern in C.ARTIFACTS:
        text = F.regexp_replace(text, U + pattern, "")
    return text


def normalize_whitespace(text: Column) -> Column:
    text = F.regexp_replace(F.translate(text, "\t", " "), " {2,}", " ")
    return F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), " +\n", "\n")


def normalize_punctuation(text: Column) -> Column:
    return F.replace(F.translate(text, "‘’“”–—", "''\"\"--"), F.lit("…"), F.lit("..."))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, STRIP, "")


def clean_text(text: Column) -> Column:
    for step in (fix_encoding, remove_control_chars, fix_ehr_artifacts, normalize_whitespace, normalize_punctuation, strip):
        text = step(text)
    return text


def _abbreviations() -> tuple[list[str], list[str], list[int]]:
    every = sorted(C.ABBREVIATIONS, key=len, reverse=True)
    return every, [C.ABBREVIATIONS[key] for key in every], list(range(len(every)))


def find_abbreviations(text: Column) -> Column:
    """Spans whose ``label`` is the expansion, from right to left; ``ord`` follows the length of the key."""
    return kernel.find_keys(text, *_abbreviations(), any_case=False, whole=True)


def expand(text: Column, found: Column, preserve: bool = True) -> Column:
    return spans.spliced(text, found, lambda s: F.concat(s["text"], F.lit(" ("), s["label"], F.lit(")")) if preserve else s["label"])


PHI = [*C.PHI.items(), ("NAME", f"{C.NAME[0]}({C.NAME[1]})")]


def detect_phi(text: Column) -> Column:
    return spans.longest(kernel.find_patterns(text, PHI))


def mask(text: Column, found: Column) -> Column:
    return spans.spliced(text, found, lambda s: F.lit(C.PLACEHOLDER))


def expanded_and_masked(text: Column, expand_abbrevs: bool = True, mask_phi: bool = True, preserve: bool = True) -> tuple[Column, dict[str, Column]]:
    """A struct whose ``text`` is that of ``expand`` and then ``mask``, worked out at once, and how to read ``abbreviations_expanded`` and ``phi_spans`` from it, given as ``rewritten``."""
    steps, names = [], []
    if expand_abbrevs:
        value = (lambda found, full: f"{found} ({full})") if preserve else (lambda found, full: full)
        steps.append((kernel.key_hits(*_abbreviations(), any_case=False, whole=True), value))
        names.append("abbreviations_expanded")
    if mask_phi:
        steps.append((kernel.longest(kernel.pattern_hits(PHI)), lambda found, kind: C.PLACEHOLDER))
        names.append("phi_spans")
    read = {name: F.col(f"rewritten.found{k}") for k, name in enumerate(names)}
    return kernel.rewritten(text, steps), {name: read.get(name, spans.empty()) for name in ("abbreviations_expanded", "phi_spans")}


def detect_sections(text: Column, bodies: bool = True) -> Column:
    """``name``, ``start`` (of the header), ``end`` and ``text`` (the body, unless ``bodies`` aren't wanted) of each section."""
    line = lambda headers: r"^\s*(?:" + "|".join(headers) + r")\s*:?\s*$"
    anywhere = "(?=" + line([x for p in C.SECTIONS.values() for x in p]) + ")"
    found = kernel.find_patterns(text, [(name, line(p)) for name, p in C.SECTIONS.items()], re.IGNORECASE | re.MULTILINE, anywhere=anywhere)
    ordered = F.transform(F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("a"), s["ord"].alias("b"), s.alias("s")))), lambda k: k["s"])

    def section(every: Column, s: Column, k: Column) -> Column:
        after = F.coalesce(F.get(every, k + 1)["start"], F.length(text))
        place = [s["label"].alias("name"), s["start"].alias("start"), after.alias("end")]
        if not bodies:
            return F.struct(*place)
        body = strip(F.substring(text, s["end"] + 1, F.greatest(after - s["end"], F.lit(0))))
        return F.struct(*place, body.alias("text"))

    return spans.bound(ordered, lambda every: F.transform(every, lambda s, k: section(every, s, k)))


def section_map(sections: Column) -> Column:
    """Bodies by name; of equal names the last."""
    names = lambda every: F.array_distinct(F.transform(every, lambda s: s["name"]))
    last = lambda every: F.transform(names(every), lambda n: F.element_at(F.filter(every, lambda s: s["name"] == n), -1)["text"])
    return spans.bound(sections, lambda every: F.map_from_arrays(names(every), last(every)))


def line_kind(line: Column) -> Column:
    """Of a stripped line: blank, header, list, vitals or prose."""
    return (
        F.when(line == "", "blank")
        .when(line.rlike(C.HEADER_LINE), "header")
        .when(line.rlike(C.LIST_LINE), "list")
        .when(line.rlike(C.VITALS_LINE), "vitals")
        .otherwise("prose")
    )


def split_sentences(text: Column) -> Column:
    """Paragraphs: headers, list items and vitals by themselves, other lines joined until a blank or one of these."""
    for word in C.PROTECTED:
        text = F.replace(text, F.lit(word), F.lit(word.replace(".", "\x02")))
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.struct(strip(x).alias("line"), line_kind(strip(x)).alias("kind")))
    strings = F.array().cast("array<string>")
    flushed = lambda a: F.when(F.size(a["now"]) > 0, F.concat(a["out"], F.array(F.array_join(a["now"], " ")))).otherwise(a["out"])

    def step(a: Column, x: Column) -> Column:
        prose, blank = x["kind"] == "prose", x["kind"] == "blank"
        part = F.regexp_replace(x["line"], r"(?U)(?<=[.!?])\s+(?=[A-Z])", " ")
        out = F.when(prose, a["out"]).when(blank, flushed(a)).otherwise(F.concat(flushed(a), F.array(x["line"])))
        return F.struct(out.alias("out"), F.when(prose, F.concat(a["now"], F.array(part))).otherwise(strings).alias("now"))

    joined = F.aggregate(lines, F.struct(strings.alias("out"), strings.alias("now")), step, flushed)
    back = F.transform(joined, lambda s: strip(F.replace(s, F.lit("\x02"), F.lit("."))))
    return F.filter(back, lambda s: s != "")


