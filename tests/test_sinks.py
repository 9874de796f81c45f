"""Restarted streams, cuts without ranks, lines that aren't JSON."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from notesift.operators import labeling
from notesift.sources import jsonl
from notesift.streaming import notes as stream
from notesift.streaming import sinks

SF = "/root/testdata/sf0.001"


def test_a_restarted_stream_gives_each_document_once(spark, tmp_path, monkeypatch):
    place = {k: str(tmp_path / k) for k in ("in", "out", "state")}
    note = lambda a, b: spark.range(a, b).select(F.concat(F.lit("n"), "id").alias("document_id"), F.lit("x").alias("note_type"), F.lit("Takes metformin 5mg.").alias("text"))
    note(0, 30).repartition(3).write.json(place["in"])
    once = {"left": True}

    def dies_after_writing(batch):
        made = sinks.document_path.run(batch)
        if once.pop("left", False):
            made.limit(7).write.mode("overwrite").json(f"{place['out']}/batch=0")  # what a killed attempt leaves
            raise RuntimeError("executor lost")
        return made

    with pytest.raises(Exception, match="executor lost"):
        sinks.write_batches(stream.read(spark, place["in"]), place["out"], place["state"], prepared=dies_after_writing).awaitTermination()
    note(30, 45).write.mode("append").json(place["in"])
    for _ in range(2):
        sinks.documents(stream.read(spark, place["in"]), place["out"], place["state"]).awaitTermination()
    got = [r.doc_id for r in sinks.read_batches(spark, place["out"], "doc_id string, note_type string").collect()]
    assert sorted(got) == sorted(f"n{k}" for k in range(45))


def test_live_metrics_after_batches_and_a_restart(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    place = {k: str(tmp_path / k) for k in ("in", "out", "state")}
    for part in range(3):  # later files hold earlier times too: nothing is too late to count
        events.where(F.pmod(F.xxhash64("event_id" if "event_id" in events.columns else "ts"), F.lit(3)) == part).write.mode("append").parquet(place["in"])
        sinks.metrics(spark.readStream.schema(events.schema).parquet(place["in"]), place["out"], place["state"]).awaitTermination()
    key = lambda r: (r.endpoint, r.status)
    assert sorted(sinks.current(spark, place["out"]).collect(), key=key) == sorted(sinks.totals(events).collect(), key=key)
    assert sinks.current(spark, place["out"]).agg(F.sum("n")).first()[0] == events.count()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 70_000])
def test_exact_sizes(spark, n):
    ids = spark.range(n).withColumnRenamed("id", "doc_id")
    made = labeling.splits(ids)
    got = {r.split: r["count"] for r in made.groupBy("split").count().collect()}
    a, b = int(n * 0.7), int(n * 0.15)
    assert got == {k: v for k, v in {"train": a, "val": b, "test": n - a - b}.items() if v}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan


def test_cuts_against_sorting(spark):
    values = sorted([5, 5, 5, -(2**63), 2**63 - 1, 0, -1, 1, 2**40, 2**40 + 1, 2**40 + 2, -(2**40), 7, 7])
    frame = spark.createDataFrame([(v,) for v in values], "h long")
    for rank, cut in zip(range(16), labeling.cuts(frame, list(range(16))), strict=True):
        below = sum(v <= cut for v in values)
        want = min(rank, len(values))
        while 0 < want < len(values) and values[want - 1] == values[want]:  # equal values stay together
            want += 1
        assert below == want, rank


def test_rows_that_share_an_id_stay_together(spark):
    made = labeling.splits(spark.range(300).select((F.col("id") % 40).alias("doc_id")))
    assert made.distinct().count() == 40 and made.count() == 300


def test_lines_that_are_not_json(spark, tmp_path):
    lines = ['{"document_id": "a", "text": "one"}', '{"document_id": "a", "text": "tw', "", "  ", "[1, 2]", "nonsense", '{"document_id": "b", "text": 5, "more": [1]}', '{"document_id": "c"}']
    (tmp_path / "notes.jsonl").write_text("\n".join(lines))
    rows = jsonl.read_lines(spark, str(tmp_path / "notes.jsonl"))
    got = {r.document_id: r.text for r in rows.where("bad is null").collect()}
    assert got == {"a": "one", "b": "5", "c": None}
    assert {r.bad for r in rows.where("bad is not null").collect()} == {lines[1], "[1, 2]", "nonsense"}
    assert tuple(jsonl.line_counts(rows).first()) == (3, 3)


@pytest.mark.parametrize("name", ["batch_stats", "retry_counters", "src_jsonl_bad_lines", "request_metrics"])
def test_registered_with_sql(name):
    assert name in entry.queries() and name in entry.oracle_sql()
