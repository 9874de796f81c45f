"""Clinical notes made of ``documents`` by one expression that Spark and other SQL engines share.

The supplied texts hold hardly anything that the operators look for, so every
note gets headers, protected information, dosages, negations and damage by
arithmetic on its id, followed by the whole of its own text. Edge rows stand
beside the table's rows, under negative ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notesift.functions import constants as C
from notesift.functions.spans import settled


def pick(values: list[str], factor: int) -> str:
    """A value by the id times ``factor``, which has no divisor in common with their number."""
    cases = " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values[:-1]))
    return f"(CASE (doc_id * {factor}) % {len(values)} {cases} ELSE '{values[-1]}' END)"


NL = "chr(10)"
TRIGGERS = ["No evidence of", "denies", "without signs of", "absence of", "Now has", "diagnosed with", "negative for"]
AFTERS = ["was ruled out", "unlikely", "not seen", "is improving", "was excluded"]

#: Header, sections, entities, negations, abbreviations, damage, lists, vitals and protected information.
NOTE = " || ".join(
    [
        "'Patient: '", pick(C.POOL_PATIENT_NAMES, 5), NL, "'MRN: MRN-'", "CAST(100000 + (doc_id * 7919) % 900000 AS VARCHAR(10))", NL,
        "'Attending: '", pick(C.POOL_DOCTOR_NAMES, 2), NL, "'Admission Date: '", pick(C.POOL_DATES, 3), NL, NL,
        pick(["HISTORY OF PRESENT ILLNESS:", "HPI:", "Chief Complaint", "SUBJECTIVE:", "Reason for Visit:"], 3), NL,
        "'Patient '", pick(TRIGGERS, 3), "' '", pick(C.POOL_DIAGNOSES, 7), "'. The '", pick(C.DIAGNOSES, 3), "' '", pick(AFTERS, 2), "' today. Seen on '", pick(C.POOL_DATES, 7), "'.'", NL,
        "'HTN, CHF w/o DM2 or DM, SpO2 98 s/p I&D/C. Mr. '", pick(["Smith", "Lee", "Garcia"], 2), "' takes ASA PO BID.  A '", pick(C.POOL_PROCEDURES, 7), "' was done.'", NL, NL,
        "'MEDICATIONS:'", NL, "'1. '", pick(C.POOL_MEDICATIONS, 7), "' '", pick(C.POOL_DOSAGES, 3), NL, "'2. '", pick(C.MEDICATIONS, 7), "' '", pick(C.POOL_DOSAGES, 7), NL, "'- asepsis, 5 grams'", NL, NL, NL, NL,
        "'Vitals: T 98.6F, HR 72, BP 120/80'", NL, pick(["Page 1 of 3", "=====", "[12:34:56]", "** DRAFT ** kept", "<<UNSIGNED>> kept", "plain"], 5), NL,
        "'SSN 123-45-6789 call 555-123-4567 or (743) 555-3824, zip 90210, a 95 year old, a.b@c.org'", NL,
        "'“Quoted” – it’s cafe'", "'́'", "'…'", NL, pick(["PLAN:", "A/P:", "MEDICATIONS:", "Follow-up"], 3), NL, "chr(9)", "'rest and fluids'", NL, "text",
    ]
)

#: Empty, blank and unmatched texts, and matches at both ends.
EDGES = {-1: "", -2: "   ", -3: "nothing to see", -4: "sepsis treated with aspirin"}

#: The notes as a query over ``documents``.
SQL = f"SELECT doc_id, {NOTE} AS text FROM documents" + "".join(f" UNION ALL SELECT CAST({k} AS BIGINT), '{v}'" for k, v in EDGES.items())


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id`` and ``text`` of the notes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    edges = spark.createDataFrame(list(EDGES.items()), "doc_id long, text string")
    return settled(docs.select("doc_id", F.expr(NOTE).alias("text"))).unionByName(edges)
