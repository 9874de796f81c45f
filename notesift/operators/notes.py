"""The document path: preprocessing, extraction, merging, formatting. All of it stays within rows, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notesift.functions import clean, extract
from notesift.functions import constants as C
from notesift.functions.spans import settled
from notesift.operators import scoring

#: A function of the text's column, or a model that runs on executors.
Scorer = Callable[[Column], Column] | scoring.Model


def preprocess(notes: DataFrame, expand_abbrevs: bool = True, mask_phi: bool = True, preserve: bool = True, bodies: bool = True) -> DataFrame:
    """Adds cleaned_text, abbreviations_expanded, phi_spans, sentences and sections; what follows sees the masked text."""
    out = settled(notes.withColumn("cleaned_text", clean.clean_text(F.col("text"))))
    found, spans = clean.expanded_and_masked(F.col("cleaned_text"), expand_abbrevs, mask_phi, preserve)
    out = settled(out.withColumn("rewritten", found)).withColumn("cleaned_text", F.col("rewritten.text")).withColumns(spans).drop("rewritten")
    return out.withColumn("sentences", clean.split_sentences(F.col("cleaned_text"))).withColumn("sections", clean.detect_sections(F.col("cleaned_text"), bodies))


def summary(done: DataFrame) -> DataFrame:
    return done.select(
        "doc_id",
        "cleaned_text",
        F.size("sentences").cast("long").alias("num_sentences"),
        F.size("sections").cast("long").alias("num_sections"),
        F.array_join(F.transform("sections", lambda s: s["name"]), "|").alias("sections_found"),
        F.size("phi_spans").cast("long").alias("phi_masked_count"),
        F.size("abbreviations_expanded").cast("long").alias("abbreviations_expanded_count"),
    )


def proposed(done: DataFrame, scorer: Scorer = extract.scored_terms) -> DataFrame:
    """Adds ``model`` and ``rules``: what the scorer and the rules find; rows that a model fails on have its ``error``."""
    rules = extract.as_entities(extract.rule_entities(F.col("cleaned_text")), lambda s: F.lit(C.RULE_CONFIDENCE), "rules")
    if isinstance(scorer, scoring.Model):
        return settled(scoring.scored(settled(done), scorer).withColumn("rules", rules))
    return settled(settled(done).withColumn("rules", rules).withColumn("model", scorer(F.col("cleaned_text"))))


def unified(done: DataFrame, scorer: Scorer = extract.scored_terms) -> DataFrame:
    """Adds ``kept``: of what the scorer and the rules find the entities without doubles and overlaps."""
    return settled(proposed(done, scorer).withColumn("kept", extract.kept(F.col("model"), F.col("rules"))).drop("model", "rules"))


def extracted(done: DataFrame, scorer: Scorer = extract.scored_terms) -> DataFrame:
    """Adds ``merged``: entities of the scorer and the rules after postprocessing; those that a model fails on are left with its ``error``."""
    out = unified(done, scorer)
    out = settled(out.withColumn("around", extract.windows(F.col("cleaned_text"), F.col("kept"))))
    out = out.withColumn("merged", extract.finished(F.col("kept"), F.col("around"), F.col("sections"))).drop("kept", "around")
    return settled(out)


def formatted(done: DataFrame) -> DataFrame:
    """The output document, but for its time stamps: what is flagged goes to a list of its own."""
    public = lambda e: F.struct(*[e[c].alias(c) for c in ("text", "label", "start", "end", "confidence", "negated", "section", "source", "context_snippet")])
    flagged = F.filter("merged", lambda e: e["status"] == "flagged")
    accepted = F.filter("merged", lambda e: e["status"] != "flagged")
    fallback = F.size(F.filter("merged", lambda e: e["status"] == "fallback"))
    return done.select(
        F.col("doc_id"),
        F.lit("Unknown").alias("note_type"),
        F.lit(C.MODEL_VERSION).alias("model_version"),
        F.transform(accepted, public).alias("entities"),
        F.transform(flagged, public).alias("flagged_for_review"),
        F.struct(
            F.size("merged").cast("long").alias("total_entities"),
            (F.size(accepted) - fallback).cast("long").alias("auto_accepted"),
            F.size(flagged).cast("long").alias("flagged"),
            fallback.cast("long").alias("fallback_used"),
        ).alias("processing_metadata"),
    )


def run(notes: DataFrame, scorer: Scorer = extract.scored_terms, **how: bool) -> DataFrame:
    """The output documents of ``notes`` that aren't blank and that the scorer didn't fail on."""
    done = preprocess(notes.where(clean.strip(F.coalesce("text", F.lit(""))) != ""), bodies=False, **how)
    found = extracted(done.select("doc_id", "cleaned_text", "sections"), scorer)
    return formatted(found.where("error is null") if isinstance(scorer, scoring.Model) else found)


def exploded(df: DataFrame, column: str, *fields: str) -> DataFrame:
    """A row for each element: ``doc_id``, its ``ord`` from 0 and the fields."""
    # else the filter for empty arrays, which the optimizer adds, would work the array out again
    each = settled(df.select("doc_id", column)).select("doc_id", F.posexplode(column).alias("ord", "x"))
    return each.select("doc_id", "ord", *[F.col(f"x.{f}").alias(f) for f in fields])
