"""Rule entities, negation, merging and routing, as functions of columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from notesift.functions import constants as C
from notesift.functions import kernel, spans

ENTITY = "struct<text:string,label:string,start:int,end:int,ord:int,confidence:double,source:string>"


def find_terms(text: Column, terms: dict[str, list[str]], first: int = 0) -> Column:
    """Every term anywhere, in any case, in one pass; ``terms`` has those of each label, whose places ``ord`` begin with ``first``."""
    each = [(term, label, first + k) for k, (label, some) in enumerate(terms.items()) for term in some]
    return kernel.find_keys(text, *map(list, zip(*each, strict=True)), any_case=True)


def dosages(text: Column) -> Column:
    return kernel.find_patterns(text, [("DOSAGE", C.DOSAGE)], re.IGNORECASE, begins=r"\d")


def dates(text: Column) -> Column:
    return kernel.find_patterns(text, [("DATE", C.DATE)], first=1, begins=r"\dJFMASOND")


def medications(text: Column) -> Column:
    return find_terms(text, {"MEDICATION": C.MEDICATIONS}, 2)


def diagnoses(text: Column) -> Column:
    return find_terms(text, {"DIAGNOSIS": C.DIAGNOSES}, 3)


def rule_entities(text: Column) -> Column:
    return spans.longest(F.concat(dosages(text), dates(text), find_terms(text, {"MEDICATION": C.MEDICATIONS, "DIAGNOSIS": C.DIAGNOSES}, 2)))


def judged(before: Column, after: Column) -> Column:
    """``negated``, ``trigger`` and ``trigger_type`` by the words at the end of what stands before a mention, else at the beginning of what follows."""
    words = lambda t: F.filter(F.split(F.regexp_replace(F.lower(t), r"(?U)[\s\x1c-\x1f]+", " "), " "), lambda w: w != "")
    last = lambda w: F.array_join(F.slice(w, F.greatest(F.lit(1), F.size(w) - (C.NEGATION_WORDS - 1)), C.NEGATION_WORDS), " ")
    pre = spans.bound(words(before), last)
    post = F.array_join(F.slice(words(after), 1, C.NEGATION_WORDS), " ")
    by_length = lambda triggers: F.array(*map(F.lit, sorted(triggers, key=len, reverse=True)))
    # the windows are worked out once, not for each trigger, and so are the hits
    hit = lambda triggers, window: spans.bound(window, lambda w: F.get(F.filter(by_length(triggers), lambda t: F.contains(w, t)), F.lit(0)))

    def verdict(h: Column) -> Column:
        return F.struct(
            (h["pre"].isNotNull() | h["post"].isNotNull()).alias("negated"),
            F.coalesce(h["pre"], h["post"], F.lit("")).alias("trigger"),
            F.when(h["pre"].isNotNull(), "pre").when(h["post"].isNotNull(), "post").otherwise("none").alias("trigger_type"),
        )

    return spans.bound(F.struct(hit(C.PRE_TRIGGERS, pre).alias("pre"), hit(C.POST_TRIGGERS, post).alias("post")), verdict)


def windows(text: Column, entities: Column, sides: bool = True) -> Column:
    """For each entity what stands ``before`` and ``after`` it (unless ``sides`` aren't wanted), and its ``context``: all cut from the text in one pass."""
    size = F.length(text)
    low = lambda by: F.transform(entities, lambda e: F.greatest(e["start"] - by, F.lit(0)))
    high = lambda by: F.transform(entities, lambda e: e["end"] + by)
    starts = F.concat(low(C.NEGATION_CHARS), entities["end"], low(C.CONTEXT)) if sides else low(C.CONTEXT)
    ends = F.concat(entities["start"], high(C.NEGATION_CHARS), high(C.CONTEXT)) if sides else high(C.CONTEXT)

    def one(cuts: Column, e: Column, k: Column) -> Column:
        n = (F.size(cuts["parts"]) / 3).cast("int")
        part = F.get(cuts["parts"], 2 * n + k if sides else k)
        cut = F.concat(F.when(e["start"] > C.CONTEXT, "...").otherwise(""), part, F.when(e["end"] + C.CONTEXT < cuts["size"], "...").otherwise(""))
        if not sides:
            return F.struct(cut.alias("context"))
        return F.struct(F.get(cuts["parts"], k).alias("before"), F.get(cuts["parts"], n + k).alias("after"), cut.alias("context"))

    cuts = F.struct(kernel.cut(text, starts, ends).alias("parts"), size.alias("size"))
    return spans.bound(cuts, lambda c: F.transform(entities, lambda e, k: one(c, e, k)))


def negations(text: Column, entities: Column) -> Column:
    """What ``judged`` says of each entity."""
    return F.transform(windows(text, entities), lambda w: judged(w["before"], w["after"]))


def negation(text: Column, start: Column, end: Column) -> Column:
    """What ``judged`` says of one mention."""
    return F.element_at(negations(text, F.array(F.struct(start.alias("start"), end.alias("end")))), 1)


def scored_terms(text: Column) -> Column:
    """A stand-in for a trained tagger: dictionary terms, some of them procedures, with fixed confidences.

    It is not a neural model; it makes the accepted, flagged and fallback paths observable.
    """
    procedures = ["chest X-ray", "echocardiogram", "colonoscopy", "lumbar puncture", "dialysis"]
    levels = {"MEDICATION": 0.97, "DIAGNOSIS": 0.75, "PROCEDURE": 0.5}
    found = find_terms(text, {"MEDICATION": C.MEDICATIONS[:12], "DIAGNOSIS": C.DIAGNOSES[:12], "PROCEDURE": procedures})
    level = F.create_map(*[x for k, v in levels.items() for x in (F.lit(k), F.lit(v))])
    return as_entities(found, lambda s: F.element_at(level, s["label"]), "model")


def as_entities(found: Column, confidence, source: str) -> Column:
    return F.transform(
        found,
        lambda s: F.struct(
            s["text"].alias("text"), s["label"].alias("label"), s["start"].alias("start"), s["end"].alias("end"), s["ord"].alias("ord"),
            confidence(s).cast("double").alias("confidence"), F.lit(source).alias("source"),
        ),
    )


def deduplicated(entities: Column) -> Column:
    """One of equal text (without case), label and place: the last of the model's, else the first; sorted by these."""
    key = lambda e: F.struct(e["start"].alias("s"), e["end"].alias("e"), e["label"].alias("l"), F.lower(e["text"]).alias("t"))
    rank = lambda e, k: F.when(e["source"] == "model", F.lit(-1_000_000_000) - k).otherwise(k)
    keyed = F.array_sort(F.transform(entities, lambda e, k: F.struct(key(e).alias("key"), rank(e, k).alias("rank"), e.alias("e"))))
    first = lambda every: F.filter(every, lambda x, k: (k == 0) | (x["key"] != F.get(every, k - 1)["key"]))
    return F.transform(spans.bound(keyed, first), lambda x: x["e"])


def route(confidence: Column) -> Column:
    return F.when(confidence >= C.ACCEPT, "auto_accepted").when(confidence >= C.FLAG, "flagged").otherwise("fallback")


def section_at(sections: Column, start: Column) -> Column:
    inside = F.filter(sections, lambda s: (s["start"] <= start) & (start < s["end"]))
    return F.coalesce(F.get(inside, F.lit(0))["name"], F.lit("Unknown"))


def kept(model: Column, rules: Column) -> Column:
    """Entities of both kinds, deduplicated and without overlaps."""
    return spans.most_confident(deduplicated(F.concat(model, rules)), ENTITY)


def finished(entities: Column, around: Column, sections: Column) -> Column:
    """``entities`` with negation, section, context and status; ``around`` has the ``windows`` of each."""

    def one(secs: Column, e: Column, w: Column) -> Column:
        return F.struct(
            e["text"].alias("text"), e["label"].alias("label"), e["start"].alias("start"), e["end"].alias("end"),
            F.round(e["confidence"], 4).alias("confidence"), judged(w["before"], w["after"])["negated"].alias("negated"),
            section_at(secs, e["start"]).alias("section"), e["source"].alias("source"), w["context"].alias("context_snippet"),
            route(e["confidence"]).alias("status"),
        )

    return spans.bound(sections, lambda secs: F.zip_with(entities, around, lambda e, w: one(secs, e, w)))
