"""Set-based operators, plans, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from notesift.functions import constants as C
from notesift.functions import extract
from notesift.operators import evaluation, generator, labeling, notes, serving
from notesift.plans import carrier, oracles
from notesift.sources import jsonl
from notesift.streaming import notes as stream

SF = "/root/testdata/sf0.001"
TAGS = "I-X B-X I-X I-Y I-X O B-Y B-Y I-Y".split()


def test_decoding_of_stray_tags(spark):
    rows = [(1, k, f"w{k}", k * 3, k * 3 + 2, t, 0.9 - k / 100) for k, t in enumerate(TAGS)]
    frame = spark.createDataFrame(rows, 'doc_id long, pos int, token string, start int, end int, tag string, conf double')
    got = sorted((r.start, r.end, r.label, r.text) for r in labeling.decode(frame).collect())
    assert got == [(3, 8, "X", "w1 w2"), (18, 20, "Y", "w6"), (21, 26, "Y", "w7 w8")]


def test_chunks_start_at_strays(spark):
    frame = spark.createDataFrame([(1, k, t) for k, t in enumerate(TAGS)], "doc_id long, pos int, true string")
    got = sorted((r.kind, r.s, r.e) for r in evaluation.chunks(frame, "true").collect())
    assert got == [("X", 0, 0), ("X", 1, 2), ("X", 4, 4), ("Y", 3, 3), ("Y", 6, 6), ("Y", 7, 8)]


def test_split_sizes_are_exact(spark):
    got = {r.split: r["count"] for r in labeling.splits(spark.range(500).withColumnRenamed("id", "doc_id")).groupBy("split").count().collect()}
    assert got == {"train": 350, "val": 75, "test": 75}


def test_every_label_occurs_on_the_carrier(spark):
    found = entry.queries()
    assert {r.label for r in found["rule_entity_counts"](spark, SF).collect()} == {"DOSAGE", "DATE", "MEDICATION", "DIAGNOSIS"}
    assert {r.label for r in found["phi_type_counts"](spark, SF).collect()} == {*C.PHI, "NAME"}


def test_documents_are_read_without_other_columns(spark):
    plan = notes.run(carrier.notes(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Exchange" not in plan


def test_entry_gives_rows(spark):
    rows = entry.entry(spark).limit(5).collect()
    assert rows and rows[0].processing_metadata.total_entities >= 0


SHORT = ["clean_text", "phi_type_counts", "rule_entity_counts", "section_name_counts", "line_class_counts", "negation_batch", "tag_histogram", "class_weights", "ner_report", "entity_prf", "top_fp_words", "batch_stats", "request_counter", "latency_histogram", "src_jsonl_lastwins"]


@pytest.mark.parametrize("name", SHORT)
def test_against_the_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "events", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame = entry.queries()[name](spark, SF)
    order = sorted(frame.columns)
    found = con.execute(oracles.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == order
    want = sorted(repr(tuple(r[names.index(c)] for c in order)) for r in found.fetchall())
    assert sorted(repr(tuple(r[c] for c in order)) for r in frame.collect()) == want and want


def test_json_lines(spark, tmp_path):
    rows = spark.createDataFrame([("a", "t", "one", 1), ("a", "t", "two", 2), (None, None, None, 3)], "document_id string, note_type string, text string, ord int")
    assert {(r.document_id, r.text) for r in jsonl.with_ids(jsonl.last_wins(rows, "document_id", "ord"), "ord").collect()} == {("a", "two"), ("doc_3", "")}
    jsonl.write(rows.drop("ord"), str(tmp_path / "notes"))
    assert jsonl.read(spark, str(tmp_path / "notes")).count() == 3


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    source = carrier.notes(spark, SF).limit(20).select(F.col("doc_id").cast("string").alias("document_id"), F.lit("x").alias("note_type"), "text")
    jsonl.write(source, str(tmp_path / "in"))
    stream.run(stream.read(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    batch = notes.run(source.withColumnRenamed("document_id", "doc_id"))
    got = {r.doc_id: json.loads(r.e) for r in spark.read.json(str(tmp_path / "out")).select("doc_id", F.to_json("entities").alias("e")).collect()}
    assert got == {r.doc_id: json.loads(r.e) for r in batch.select("doc_id", F.to_json("entities").alias("e")).collect()}


def test_windowed_counts(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    live = stream.request_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")))
    run = live.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == events.count()


def test_requests_without_id_or_text(spark):
    rows = [(None, "sepsis", 1), (None, " ", 2), ("n7", "aspirin 5mg", 3), (None, "no sepsis", 4), (None, None, 5)]
    made = serving.batch_extract(spark.createDataFrame(rows, "doc_id string, text string, place int"), "place").collect()
    assert sorted(r.doc_id for r in made) == ["doc_1", "doc_4", "n7"]


def test_rule_duplicates_keep_the_first(spark):
    one = lambda text, start, source, conf: (text, "X", start, start + 3, 0, conf, source)
    rows = [one("abc", 5, "model", 0.1), one("ABC", 5, "model", 0.2), one("abc", 5, "rules", 0.8), one("q q", 9, "rules", 0.3), one("Q q", 9, "rules", 0.4)]
    frame = spark.createDataFrame([(rows,)], f"e array<{extract.ENTITY}>")
    got = frame.select(extract.deduplicated(F.col("e")).alias("e")).first().e
    assert [(r.text, r.confidence) for r in got] == [("ABC", 0.2), ("q q", 0.3)]


def test_a_note_is_made_once(spark):
    """The plan has the carrier's note once for the documents and once for its edges at most."""
    plan = entry.queries()["postprocess"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HISTORY OF PRESENT ILLNESS:") <= 2


def test_health_knows_how_long_it_runs(spark):
    row = serving.health(spark, False).first()
    assert row.status == "degraded" and row.uptime_seconds > 0


def test_split_and_dataset_sinks(spark, tmp_path):
    records = spark.range(20).select(F.col("id").alias("doc_id"), F.array(F.lit("a")).alias("tokens"))
    jsonl.write_splits(records, labeling.splits(records.select("doc_id")), str(tmp_path / "splits"))
    back = spark.read.json(str(tmp_path / "splits"))
    assert {r.split: r["count"] for r in back.groupBy("split").count().collect()} == {"train": 14, "val": 3, "test": 3}
    assert back.select("doc_id").distinct().count() == 20
    made = generator.generate(spark.range(10), "id")
    counts = {r.label: r.n for r in jsonl.write_dataset(made, str(tmp_path / "set")).withColumnRenamed("count(1)", "n").collect()}
    read = jsonl.read(spark, str(tmp_path / "set/annotations.jsonl"), jsonl.ANNOTATION)
    assert {r.label: r["count"] for r in read.select(F.explode("entities").alias("e")).groupBy("e.label").count().collect()} == counts
    assert jsonl.read(spark, str(tmp_path / "set/notes.jsonl")).where("text is not null").count() == 10
