"""Synthetic labelled notes by arithmetic on their ids: text and the spans of its entities together.

A note type is a list of parts; a part is text with placeholders, or a choice among
the variants of a template. Templates are compiled into pieces once, on the driver;
which variant, value and entity a note has follows from its id, so any executor can
make any note again. Entities of a note are drawn from a keyed permutation of their
pool: none comes twice before the pool is used up, then the permutation starts anew.
A placeholder's trailing digits are ignored, and one without values is written as its
name in brackets. Notes of a null id have no text and no entities.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notesift.functions import constants as C
from notesift.functions.spans import settled

# Variants of the sections; names in capitals are entities, in small letters values without a label.
TEMPLATES = {
    "history": (
        "A {age} year old {gender} comes in with {DIAGNOSIS}, noticed first on {DATE} and getting worse for {duration}. Takes {MEDICATION} {DOSAGE} at home.",
        "{age} year old {gender}, known for {DIAGNOSIS}, brought in on {DATE} because of {symptom}. {MEDICATION} {DOSAGE} was prescribed earlier but taken irregularly.",
        "This {gender} of {age} years has {DIAGNOSIS} with a sudden worsening. At the visit on {DATE} the treatment was {MEDICATION} {DOSAGE}, and {PROCEDURE} was done.",
        "Referred on {DATE} for {symptom}: {gender}, aged {age}, earlier {DIAGNOSIS}. Treated with {MEDICATION} {DOSAGE} as well as {MEDICATION2} {DOSAGE2}.",
    ),
    "past": (
        "1. {DIAGNOSIS}\n2. {DIAGNOSIS2}\n3. {DIAGNOSIS3}",
        "{DIAGNOSIS} since {DATE}. {DIAGNOSIS2}. {DIAGNOSIS3}, after {PROCEDURE}.",
        "Notable for {DIAGNOSIS} with {DIAGNOSIS2}. Underwent {PROCEDURE} on {DATE}.",
    ),
    "drugs": (
        "1. {MEDICATION} {DOSAGE}\n2. {MEDICATION2} {DOSAGE2}\n3. {MEDICATION3} {DOSAGE3}",
        "{MEDICATION} {DOSAGE}, {MEDICATION2} {DOSAGE2}, {MEDICATION3} {DOSAGE3}.",
        "Taken at home:\n- {MEDICATION} {DOSAGE}\n- {MEDICATION2} {DOSAGE2}\n- {MEDICATION3} {DOSAGE3}\n- {MEDICATION4} {DOSAGE4}",
    ),
    "plan": (
        "1. {DIAGNOSIS} - keep {MEDICATION} {DOSAGE}, plan {PROCEDURE}.\n2. {DIAGNOSIS2} - unchanged, no new measures.\n3. {DIAGNOSIS3} - begin {MEDICATION2} {DOSAGE2}.",
        "Impression: {gender}, {age} years, having {DIAGNOSIS} and {DIAGNOSIS2}.\nPlan:\n- Keep {MEDICATION} {DOSAGE}\n- Request {PROCEDURE}\n- Visit again after {weeks} weeks",
        "Problems:\n# {DIAGNOSIS}: begin {MEDICATION} {DOSAGE}, awaiting {PROCEDURE}.\n# {DIAGNOSIS2}: keep {MEDICATION2} {DOSAGE2}.\n# {DIAGNOSIS3}: watch, new blood tests on {DATE}.",
    ),
    "course": (
        "Came to the ward on {DATE} for {DIAGNOSIS}. {PROCEDURE} on the first day revealed {finding}, so {MEDICATION} {DOSAGE} was begun. Better by day {day}. From {DATE2} on {MEDICATION2} {DOSAGE2} was given for {DIAGNOSIS2}.",
        "The stay was mostly about {DIAGNOSIS}. After {PROCEDURE} on {DATE} came {MEDICATION} {DOSAGE}. Under {MEDICATION2} {DOSAGE2} there was no change of {DIAGNOSIS2}.",
    ),
    "operation": (
        "Preoperative Diagnosis: {DIAGNOSIS}\nPostoperative Diagnosis: {DIAGNOSIS}\nProcedure: {PROCEDURE}\nDate of Surgery: {DATE}\n\nIn general anesthesia and after the usual checks: {step}. No incidents; brought awake to the recovery room.",
    ),
    "discharge": ("Discharge Medications:\n1. {MEDICATION} {DOSAGE}\n2. {MEDICATION2} {DOSAGE2}\n3. {MEDICATION3} {DOSAGE3}\n4. {MEDICATION4} {DOSAGE4}",),
    "negative": (
        "Patient denies {DIAGNOSIS} in the past.",
        "No evidence of {DIAGNOSIS} in the images.",
        "Does not take {MEDICATION} now, not using it.",
        "{DIAGNOSIS} was ruled out.",
        "Without {DIAGNOSIS} so far.",
        "No {DIAGNOSIS} reported.",
    ),
    "allergies": ("None known.", "Latex (itching).", "Codeine (vomiting).", "NKDA."),
    "specimens": ("One sample for pathology.", "None taken.", "Tissue given to the laboratory."),
}
# A second negative, or none as often.
TEMPLATES["another"] = ("",) * len(TEMPLATES["negative"]) + tuple("\n" + v for v in TEMPLATES["negative"])
SKELETONS = {
    "Discharge Summary": "DISCHARGE SUMMARY\n\nPatient: {patient}\nMRN: {mrn}\nAttending: {doctor}\nAdmission Date: {DATE}\nDischarge Date: {DATE2}\n\nHISTORY OF PRESENT ILLNESS:\n{@history}\n\nPAST MEDICAL HISTORY:\n{@past}\n\nMEDICATIONS ON ADMISSION:\n{@drugs}\n\nHOSPITAL COURSE:\n{@course}\n\nASSESSMENT AND PLAN:\n{@plan}\n\n{@discharge}\n\nPERTINENT NEGATIVES:\n{@negative}{@another}\n",
    "Progress Note": "PROGRESS NOTE\n\nDate: {DATE}\nProvider: {doctor}\n\nSUBJECTIVE:\nTells of {symptom}. Is on {MEDICATION} {DOSAGE}, last taken today.\n\nOBJECTIVE:\nVitals: T {degrees}.{tenth}F, HR {pulse}, BP {systolic}/{diastolic}, RR {breaths}, SpO2 {oxygen}%\nGeneral: awake, calm.\n\nASSESSMENT AND PLAN:\n{@plan}\n",
    "History and Physical": "HISTORY AND PHYSICAL\n\nPatient: {patient}\nDate of Evaluation: {DATE}\nReferring Physician: {doctor}\n\nCHIEF COMPLAINT:\n{symptom}, {duration}.\n\nHISTORY OF PRESENT ILLNESS:\n{@history}\n\nPAST MEDICAL HISTORY:\n{@past}\n\nCURRENT MEDICATIONS:\n{@drugs}\n\nALLERGIES:\n{@allergies}\n\nREVIEW OF SYSTEMS:\nReports {symptom}. {@negative}\n\nPHYSICAL EXAMINATION:\nVitals: T {degrees}.{tenth}F, HR {pulse}, BP {systolic}/{diastolic}\nGeneral: looks well.\nHeart: regular, no added sounds.\nLungs: clear on both sides.\n\nASSESSMENT AND PLAN:\n{@plan}\n",
    "Consult Note": "{field} CONSULT NOTE\n\nConsulting Physician: {doctor}\nDate: {DATE}\n\nREASON FOR CONSULTATION:\nAdvice is asked on {DIAGNOSIS}, together with {DIAGNOSIS2}.\n\nHISTORY OF PRESENT ILLNESS:\n{@history}\n\nRELEVANT HISTORY:\n{@past}\n\nCURRENT MEDICATIONS:\n{@drugs}\n\nRECOMMENDATIONS:\n1. Add {PROCEDURE} to the workup.\n2. Begin {MEDICATION} {DOSAGE}.\n3. See {specialty} after {weeks} weeks.\n4. We stay involved.\n\n{@negative}\n",
    "Operative Note": "OPERATIVE NOTE\n\nSurgeon: {doctor}\nPatient: {patient}\nDate of Surgery: {DATE}\n\n{@operation}\n\nESTIMATED BLOOD LOSS: {fifties}0 mL\n\nSPECIMENS: {@specimens}\n\nPOSTOPERATIVE PLAN:\n1. {MEDICATION} {DOSAGE} against pain.\n2. {MEDICATION2} {DOSAGE2} against clots.\n3. Visit on {DATE}.\n4. Look out for {DIAGNOSIS}.\n",
}
#: Values of placeholders that aren't entities: a list, or the ends of a range of numbers, before which a text may stand.
VALUES: dict[str, list[str] | tuple[str, int, int]] = {
    "patient": C.POOL_PATIENT_NAMES, "doctor": C.POOL_DOCTOR_NAMES, "mrn": ("MRN-", 100_000, 999_999), "age": ("", 25, 92), "gender": ["woman", "man"],
    "duration": [f"{n} {unit}" for unit in ("days", "weeks", "months") for n in range(2, 13)],
    "symptom": ["a stiff neck", "loss of appetite", "night sweats", "blurred vision", "joint pain", "a dry cough", "heartburn", "numb fingers", "swollen ankles", "poor sleep"],
    "finding": ["a narrowed vessel", "a normal result", "fluid on both sides", "a small shadow", "a thickened wall", "raised markers"],
    "step": ["the cut was placed in the middle and the layers parted", "the instrument went in freely and gave a good view", "bleeding was stopped and the layers closed", "both ends were joined without tension"],
    "field": ["CARDIOLOGY", "NEUROLOGY", "UROLOGY", "HEMATOLOGY", "RHEUMATOLOGY", "ONCOLOGY"],
    "weeks": ("", 1, 8), "day": ("", 2, 7), "degrees": ("", 97, 101), "tenth": ("", 0, 9), "pulse": ("", 60, 110), "systolic": ("", 100, 180), "diastolic": ("", 60, 100),
    "breaths": ("", 12, 24), "oxygen": ("", 92, 100), "fifties": ["5", "10", "15", "20", "25", "30"],
}
#: For numbers that follow from an id and a purpose: ids are taken modulo the first; two multipliers modulo a prime.
IDS, APART, FACTORS, PRIME = 1_000_003, 7919, (69_621, 16_807), 2_147_483_647


#: All lists that values and entities are taken from, by name.
LISTS = C.POOLS | {name: made for name, made in VALUES.items() if isinstance(made, list)}


@dataclass(frozen=True)
class Piece:
    """Text; or a place in the list ``pool``, with a label if it is an entity; or ``before`` and one of ``n`` numbers from ``low``."""

    text: str | None = None
    label: str | None = None
    pool: int | None = None
    before: str | None = None
    low: int = 0
    n: int = 1
    purpose: int = 0


@dataclass(frozen=True)
class Choice:
    """One of some lists of pieces; ``purpose`` tells it apart from other choices and values."""

    variants: list[list[Piece]]
    purpose: int = 0


def compiled(template: str, purpose: Iterator[int]) -> list[Choice]:
    """A template's choices in order; what stands between placeholders of templates is a choice of one."""
    out: list[Choice] = [Choice([[]])]
    for part in re.split(r"(\{@?\w+\})", template):
        m = re.fullmatch(r"\{(@?)(\w+?)\d*\}", part)
        if m and m[1]:
            parts = [[p for c in compiled(v, purpose) for p in c.variants[0]] for v in TEMPLATES[m[2]]]
            out += [Choice(parts, next(purpose)), Choice([[]])]
        elif m:
            out[-1].variants[0].append(placeholder(m[2], next(purpose)))
        elif part:
            out[-1].variants[0].append(Piece(text=part))
    return [c for c in out if c.variants != [[]]]


def placeholder(name: str, purpose: int) -> Piece:
    if name in C.POOLS:
        at = list(LISTS).index(name)
        return Piece(label=name, pool=at, purpose=2 * at)
    if name in LISTS:
        return Piece(pool=list(LISTS).index(name), purpose=purpose)
    if name in VALUES:
        before, low, high = VALUES[name]
        return Piece(before=before, low=low, n=high - low + 1, purpose=purpose)
    return Piece(text=f"[{name}]")


def notes_compiled() -> dict[str, list[Choice]]:
    """The choices of each note type; purposes up to 99 are those of entities, which use two each."""
    purpose = count(100)
    return {kind: compiled(SKELETONS[kind], purpose) for kind in C.NOTE_TYPES}


def drawn(i: Column, purpose: Column | int) -> Column:
    """A number below PRIME."""
    purpose = purpose if isinstance(purpose, Column) else F.lit(purpose)
    out = F.pmod(i.cast("long"), F.lit(IDS).cast("long")) + purpose * APART
    for factor in FACTORS:
        out = (out * F.lit(factor).cast("long")) % F.lit(PRIME).cast("long")
    return out


def steps(n: int) -> list[int]:
    """Steps that visit all of ``n`` places."""
    return [a for a in range(1, n + 1) if gcd(a, n) == 1]


def nth(values: Column, at: Column) -> Column:
    return F.element_at(values, (at + 1).cast("int"))


def listed(values: list, kind: str) -> Column:
    """A constant array, which the optimizer folds into one literal."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def note_type(i: Column) -> Column:
    """Types take turns."""
    return nth(listed(C.NOTE_TYPES, "string"), F.pmod(i, F.lit(len(C.NOTE_TYPES))))


PIECE = "array<struct<text:string,label:string,pool:int,before:string,low:int,n:int,purpose:int>>"


def pieces(i: Column, choices: list[Choice]) -> Column:
    """The pieces of the variants that note ``i`` has."""
    return F.concat(*[nth(listed([[vars(p) for p in v] for v in c.variants], PIECE), drawn(i, c.purpose) % len(c.variants)) for c in choices])


def written(i: Column, p: Column, before: Column) -> Column:
    """The text of a piece; ``before`` entities of its label stand before it in the note."""
    lists, strides = listed(list(LISTS.values()), "array<string>"), listed([steps(len(x)) for x in LISTS.values()], "array<int>")
    pool = nth(lists, p["pool"])
    number = F.concat(p["before"], (drawn(i, p["purpose"]) % p["n"] + p["low"]).cast("string"))
    stride = nth(nth(strides, p["pool"]), drawn(i, p["purpose"]) % F.size(nth(strides, p["pool"])))
    entity = nth(pool, (before * stride + drawn(i, p["purpose"] + 1)) % F.size(pool))
    value = nth(pool, drawn(i, p["purpose"]) % F.size(pool))
    return F.when(p["label"].isNotNull(), entity).when(p["pool"].isNotNull(), value).when(p["before"].isNotNull(), number).otherwise(p["text"])


def generate(ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id``, ``note_type``, ``text`` and ``entities`` (text, label, start, end) for every id."""
    i, notes = F.col(id_col), list(notes_compiled().values())
    every = F.when(F.lit(False), F.array().cast(PIECE))
    for k, choices in enumerate(notes):
        every = every.when(F.pmod(i, F.lit(len(notes))) == k, pieces(i, choices))
    made = settled(ids.select(i.alias("doc_id"), note_type(i).alias("note_type"), every.alias("pieces")))
    made = settled(made.select("*", F.col("pieces.label").alias("labels")))
    earlier = lambda p, k: F.size(F.filter(F.slice("labels", F.lit(1), k), lambda x: x == p["label"]))
    made = settled(made.select("doc_id", "note_type", "labels", F.transform("pieces", lambda p, k: written(F.col("doc_id"), p, F.when(p["label"].isNotNull(), earlier(p, k)))).alias("texts")))
    made = settled(made.select("*", F.transform("texts", F.length).alias("lengths")))
    start = F.aggregate("lengths", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)), lambda a: F.slice(a, F.lit(1), F.size(a) - 1))
    made = settled(made.select("*", start.alias("starts")))
    placed = F.zip_with(F.arrays_zip("texts", "labels"), F.arrays_zip("starts", "lengths"), lambda t, at: F.struct(t["texts"].alias("text"), t["labels"].alias("label"), at["starts"].alias("start"), (at["starts"] + at["lengths"]).alias("end")))
    return made.select("doc_id", "note_type", F.array_join("texts", "").alias("text"), F.filter(placed, lambda p: p["label"].isNotNull()).alias("entities"))
