"""The registered queries: each operator over the clinical carrier, with flat results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notesift.functions import clean, extract
from notesift.functions import constants as C
from notesift.functions.spans import settled
from notesift.operators import evaluation, generator, labeling, scoring, serving, tagger
from notesift.operators import notes as path
from notesift.operators import subwords as subwords_of
from notesift.plans.carrier import notes
from notesift.sources import jsonl
from notesift.streaming import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _text(name: str, step: Callable) -> None:
    QUERIES[name] = lambda spark, sf: notes(spark, sf).select("doc_id", step(F.col("text")).alias("text"))


for _name, _step in {
    "clean_text": clean.clean_text, "fix_encoding": clean.fix_encoding, "remove_control_chars": clean.remove_control_chars, "fix_ehr_artifacts": clean.fix_ehr_artifacts,
    "normalize_whitespace": clean.normalize_whitespace, "normalize_punctuation": clean.normalize_punctuation,
    "expand_abbrev_text": lambda t: clean.expand(t, clean.find_abbreviations(t)), "expand_abbrev_replaced": lambda t: clean.expand(t, clean.find_abbreviations(t), False),
    "mask_phi": lambda t: clean.mask(t, clean.detect_phi(t)),
}.items():
    _text(_name, _step)


def _spans(name: str, found: Callable) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return path.exploded(notes(spark, sf).select("doc_id", found(F.col("text")).alias("s")), "s", "text", "label", "start", "end").drop("ord")

    QUERIES[name] = run


for _name, _step in {
    "expand_abbrev_spans": clean.find_abbreviations, "phi_spans": clean.detect_phi, "extract_dosage": extract.dosages, "extract_date": extract.dates,
    "extract_medication": extract.medications, "extract_diagnosis": extract.diagnoses, "rule_entities": extract.rule_entities,
}.items():
    _spans(_name, _step)


def _counts(source: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: QUERIES[source](spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


QUERIES["phi_type_counts"] = _counts("phi_spans")
QUERIES["rule_entity_counts"] = _counts("rule_entities")


@query
def sections(spark: SparkSession, sf: str) -> DataFrame:
    return path.exploded(notes(spark, sf).select("doc_id", clean.detect_sections(F.col("text")).alias("s")), "s", "name", "start", "end", "text")


@query
def section_name_counts(spark: SparkSession, sf: str) -> DataFrame:
    return sections(spark, sf).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query
def section_map(spark: SparkSession, sf: str) -> DataFrame:
    found = settled(notes(spark, sf).select("doc_id", clean.detect_sections(F.col("text")).alias("s")))
    return found.select("doc_id", F.explode(clean.section_map(F.col("s"))).alias("name", "text"))


@query
def sentences(spark: SparkSession, sf: str) -> DataFrame:
    found = settled(notes(spark, sf).select("doc_id", clean.split_sentences(F.col("text")).alias("s")))
    return found.select("doc_id", F.posexplode("s").alias("ord", "sentence"))


@query
def line_class_counts(spark: SparkSession, sf: str) -> DataFrame:
    lines = notes(spark, sf).select(F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.select(clean.line_kind(clean.strip(F.col("line"))).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query
def preprocess_note(spark: SparkSession, sf: str) -> DataFrame:
    return path.preprocess(notes(spark, sf)).select("doc_id", "cleaned_text")


@query
def preprocess_summary(spark: SparkSession, sf: str) -> DataFrame:
    return path.summary(path.preprocess(notes(spark, sf)))


@query
def negation(spark: SparkSession, sf: str) -> DataFrame:
    found = settled(notes(spark, sf).withColumn("e", extract.rule_entities(F.col("text"))))
    judged = settled(found.select("doc_id", "e", extract.negations(F.col("text"), F.col("e")).alias("n")))
    each = judged.select("doc_id", F.inline(F.arrays_zip("e", "n")))
    return each.select("doc_id", F.col("e.text").alias("entity"), F.col("e.start").alias("start"), "n.negated", "n.trigger", "n.trigger_type")


@query
def negation_batch(spark: SparkSession, sf: str) -> DataFrame:
    return negation(spark, sf).groupBy("trigger_type", "trigger").agg(F.count(F.lit(1)).alias("n"))


@query
def whitespace_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return labeling.tokens(notes(spark, sf))


def generated(spark: SparkSession, sf: str) -> DataFrame:
    return generator.generate(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id"))


@query
def generate_notes(spark: SparkSession, sf: str) -> DataFrame:
    return generated(spark, sf).select("doc_id", "note_type", "text")


@query
def generated_spans(spark: SparkSession, sf: str) -> DataFrame:
    return path.exploded(generated(spark, sf), "entities", "text", "label", "start", "end")


@query
def entity_label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return jsonl.label_counts(generated(spark, sf))


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    """Every third document loses its last two characters of each entity, so that partial overlaps occur."""
    shorter = lambda e: F.struct(e["label"].alias("label"), e["start"].alias("start"), (e["end"] - F.when(F.col("doc_id") % 3 == 0, 2).otherwise(0)).alias("end"))
    return labeling.tagged_words(generated(spark, sf).withColumn("entities", F.transform("entities", shorter)))


@query
def bio_tags(spark: SparkSession, sf: str) -> DataFrame:
    return labeling.by_word(tagged(spark, sf))


@query
def bio_records(spark: SparkSession, sf: str) -> DataFrame:
    rows = labeling.word_records(tagged(spark, sf))
    flat = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    offsets = F.array_join(F.transform("char_offsets", lambda x: F.concat_ws("-", x[0].cast("string"), x[1].cast("string"))), " ")
    return rows.select("doc_id", flat("tokens").alias("tokens"), flat("tags").alias("tags"), flat("tag_ids").alias("tag_ids"), offsets.alias("char_offsets"))


@query
def bio_join_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Notes without annotations."""
    made = generated(spark, sf)
    return made.select("doc_id").join(made.where("doc_id % 11 <> 4").select("doc_id"), "doc_id", "left_anti")


@query
def tag_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return labeling.tag_histogram(bio_tags(spark, sf)).select("tag", "n")


@query
def tag_counts(spark: SparkSession, sf: str) -> DataFrame:
    return bio_tags(spark, sf).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    return labeling.class_weights(bio_tags(spark, sf)).select("tag", F.round("weight", 6).alias("weight"))


@query
def split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Of the documents alone: edge rows of the carrier belong to no split."""
    return labeling.splits(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def subwords(spark: SparkSession, sf: str) -> DataFrame:
    """Special tokens around the words, of which every longer one has two parts."""
    place = lambda pos, word: F.struct(pos.alias("pos"), word.cast("int").alias("word_id"))
    ends = F.array(*[place(F.lit(pos), F.lit(None)) for pos in (0, 100_000)])
    parts = lambda w, k: F.when(F.length(w["token"]) > 4, F.array(place(k * 2 + 1, k), place(k * 2 + 2, k))).otherwise(F.array(place(k * 2 + 1, k)))
    words = F.flatten(F.transform("words", parts))
    return settled(tagged(spark, sf).select("doc_id", F.when(words.isNull(), ends).otherwise(F.concat(words, ends)).alias("places"))).select("doc_id", F.inline("places"))


@query
def align_first_subword(spark: SparkSession, sf: str) -> DataFrame:
    return labeling.first_subwords(subwords(spark, sf)).select("doc_id", "pos", "word_id")


@query
def align_labels(spark: SparkSession, sf: str) -> DataFrame:
    return labeling.align_labels(subwords(spark, sf), bio_tags(spark, sf))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Gold tags and the same with drops, shifts and other kinds, by place."""
    gold = bio_tags(spark, sf).withColumn("k", F.col("doc_id") * 31 + F.col("pos"))
    pred = F.expr("CASE WHEN k % 7 = 0 THEN 0 WHEN k % 11 = 0 THEN 5 WHEN k % 13 = 0 AND tag_id > 0 THEN (tag_id % 10) + 1 ELSE tag_id END")
    true = F.expr("CASE WHEN k % 29 = 0 THEN -100 ELSE tag_id END")
    return gold.select("doc_id", "pos", "token", "start", "end", true.cast("int").alias("true_id"), pred.cast("int").alias("pred_id"))


@query
def bio_decode(spark: SparkSession, sf: str) -> DataFrame:
    rows = predictions(spark, sf).withColumn("tag", evaluation.tag_of("pred_id")).withColumn("conf", F.expr("0.5D + (pos % 10) / 20.0D"))
    return labeling.decode(rows).withColumn("confidence", F.round("confidence", 4))


for _name, _step in {
    "ner_prf": evaluation.ner_prf, "ner_report": evaluation.ner_report, "error_cases": evaluation.errors, "error_distribution": evaluation.error_distribution,
    "confusion_matrix": evaluation.confusion, "top_confused_pairs": evaluation.top_confused, "entity_prf": evaluation.entity_prf,
    "top_fp_words": lambda p: evaluation.top_words(p, "false_positive"), "top_fn_words": lambda p: evaluation.top_words(p, "false_negative"), "sample_errors": evaluation.sample_errors,
}.items():
    QUERIES[_name] = lambda spark, sf, step=_step: step(predictions(spark, sf))


def extracted(spark: SparkSession, sf: str) -> DataFrame:
    return path.extracted(path.preprocess(notes(spark, sf)))


def _source(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf).withColumnRenamed("text", "cleaned_text")


def _sectioned(spark: SparkSession, sf: str) -> DataFrame:
    return settled(_source(spark, sf).withColumn("sections", clean.detect_sections(F.col("cleaned_text"), False)))


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    """Rules and the stand-in tagger over the raw carrier."""
    return path.extracted(_sectioned(spark, sf))


def _unified(source: DataFrame) -> DataFrame:
    """A row for each entity of ``_raw``, as far as merging makes it, with the columns of ``source``."""
    each = path.unified(source)
    return each.select(*source.drop("cleaned_text").columns, F.inline("kept")).withColumn("confidence", F.round("confidence", 4))


@query
def dedup_entities(spark: SparkSession, sf: str) -> DataFrame:
    rows = path.proposed(_source(spark, sf)).select("doc_id", extract.deduplicated(F.concat("model", "rules")).alias("e"))
    return path.exploded(rows, "e", "text", "label", "start", "end", "confidence", "source").drop("ord")


@query
def resolve_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return _unified(_source(spark, sf)).select("doc_id", "text", "label", "start", "end", "confidence", "source")


@query
def confidence_routing(spark: SparkSession, sf: str) -> DataFrame:
    kept = path.unified(_source(spark, sf)).select(F.inline("kept"))
    return kept.groupBy(extract.route(F.col("confidence")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query
def entity_section_join(spark: SparkSession, sf: str) -> DataFrame:
    return _unified(_sectioned(spark, sf)).select("doc_id", "text", "start", extract.section_at(F.col("sections"), F.col("start")).alias("section"))


@query
def context_snippet(spark: SparkSession, sf: str) -> DataFrame:
    kept = path.unified(_source(spark, sf))
    around = settled(kept.select("doc_id", "kept", extract.windows(F.col("cleaned_text"), F.col("kept"), False).alias("around")))
    return around.select("doc_id", F.inline(F.arrays_zip("kept", "around"))).select("doc_id", "kept.text", "kept.start", F.col("around.context").alias("context_snippet"))


@query
def postprocess(spark: SparkSession, sf: str) -> DataFrame:
    return path.exploded(_raw(spark, sf), "merged", "text", "label", "start", "end", "confidence", "negated", "section", "source", "context_snippet", "status").drop("ord")


@query
def format_output(spark: SparkSession, sf: str) -> DataFrame:
    rows = path.formatted(_raw(spark, sf))
    return rows.select("doc_id", "note_type", "model_version", "processing_metadata.*", F.size("entities").cast("long").alias("n_entities"), F.size("flagged_for_review").cast("long").alias("n_flagged"))


@query
def batch_extract(spark: SparkSession, sf: str) -> DataFrame:
    """The whole document path: preprocessing, extraction, merging and formatting."""
    return path.run(notes(spark, sf)).select("doc_id", "processing_metadata.*")


@query
def scorer_stub(spark: SparkSession, sf: str) -> DataFrame:
    found = _source(spark, sf).select("doc_id", extract.scored_terms(F.col("cleaned_text")).alias("model"))
    return path.exploded(found, "model", "text", "label", "start", "end", "confidence").drop("ord")


def tried(spark: SparkSession, sf: str) -> DataFrame:
    """The carrier's notes through a scorer that fails on some of them, on others once."""
    return scoring.scored(notes(spark, sf), scoring.TRIAL, "text")


@query
def batch_stats(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.batch_stats(tried(spark, sf))


@query
def batch_log_events(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.log_events(tried(spark, sf))


@query
def audit_log_events(spark: SparkSession, sf: str) -> DataFrame:
    return serving.audit_events(notes(spark, sf))


@query
def retry_counters(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.retries(tried(spark, sf))


def tagger_records(spark: SparkSession, sf: str) -> DataFrame:
    """Generated notes as words and tags, with their split; entities are whole, unlike those of ``bio_tags``."""
    rows = labeling.word_records(labeling.tagged_words(generated(spark, sf))).drop("char_offsets")
    return rows.withColumn("split", labeling.split_of(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")))


def fitted(records: DataFrame) -> tagger.Trained:
    """A tagger fitted to the training split, with class weights as the tags' counts give them."""
    part = lambda name: records.where(F.col("split") == name)
    tags = part("train").select("doc_id", F.explode(F.arrays_zip("tags", "tag_ids")).alias("t")).select("doc_id", F.col("t.tags").alias("tag"))
    counted = {r.tag: (r.n, r.weight) for r in labeling.class_weights(tags).collect()}  # a row for each tag
    return tagger.trained(part("train"), part("val"), [counted[t][1] if counted[t][0] else 0.0 for t in C.TAGS])


@query
def ner_training(spark: SparkSession, sf: str) -> DataFrame:
    """Scores on the test split of a tagger trained on the others."""
    records = tagger_records(spark, sf).persist(StorageLevel.DISK_ONLY)
    made = fitted(records)
    return evaluation.ner_prf(tagger.tagged(records.where("split = 'test'"), made.weights))


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def subword_rows(spark: SparkSession, sf: str, size: int = 128) -> DataFrame:
    import public_tokenizers

    records = labeling.word_records(tagged(spark, sf))
    return subwords_of.dataset(records, public_tokenizers.path("word_bpe_49k.json"), (49406, 49407, 0), size)


@query
def subword_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """Generated notes as rows of 128 subwords with the labels of their words."""
    return subword_rows(spark, sf)


@query
def subword_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The words whose labels the rows carry, read back from the first subwords: those of ``bio_tags`` but for words that were cut off."""
    places = subwords_of.placed(subword_rows(spark, sf, 4096))
    return labeling.first_subwords(places).select("doc_id", F.col("word_id").alias("pos"), F.col("label").alias("tag_id"))


@query
def model_extract(spark: SparkSession, sf: str) -> DataFrame:
    """The document path over the carrier's notes with a tagger that was trained on generated ones."""
    records = tagger_records(spark, sf).persist(StorageLevel.DISK_ONLY)
    made = tagger.model(fitted(records).weights, word_tokenizer(), f"tagger of {sf}")
    records.unpersist()
    return path.run(notes(spark, sf), made).select("doc_id", "processing_metadata.*")


@query
def request_counter(spark: SparkSession, sf: str) -> DataFrame:
    return serving.request_counter(spark.read.parquet(f"{sf}/events.parquet"))


@query
def latency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return serving.latency_histogram(spark.read.parquet(f"{sf}/events.parquet"))


@query
def health(spark: SparkSession, sf: str) -> DataFrame:
    return serving.health(spark)


def conversation_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The turns as JSON lines with their order; first turns come once more, cut short, and so aren't JSON."""
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    line = F.to_json(F.struct(F.col("conv_id").cast("string").alias("document_id"), "text"))
    return rows.withColumn("line", line).select(F.col("turn").alias("ord"), F.explode(F.expr("if(turn = 0, array(line, left(line, length(line) - 3)), array(line))")).alias("value"))


@query
def src_jsonl_lastwins(spark: SparkSession, sf: str) -> DataFrame:
    rows = jsonl.parsed(conversation_lines(spark, sf)).where("bad is null")
    return jsonl.last_wins(rows, "document_id", "ord").select("document_id", "text")


@query
def src_jsonl_bad_lines(spark: SparkSession, sf: str) -> DataFrame:
    return jsonl.line_counts(jsonl.parsed(conversation_lines(spark, sf)))


@query
def request_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """What the stream of requests has added up once all have arrived."""
    made = sinks.totals(spark.read.parquet(f"{sf}/events.parquet"))
    return made.select("endpoint", "status", "n", "seconds", F.explode("buckets").alias("b")).select("endpoint", "status", "n", "seconds", "b.le", F.col("b.n").alias("n_le"))


@query
def eval_report(spark: SparkSession, sf: str) -> DataFrame:
    pairs = predictions(spark, sf)
    return jsonl.report(evaluation.ner_prf(pairs), evaluation.error_distribution(pairs), evaluation.entity_prf(pairs), names=["overall", "errors", "by_type"])
