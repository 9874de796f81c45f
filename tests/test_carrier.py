"""Notes hold the whole of every document."""

from notesift.plans import carrier

SF = "/root/testdata/sf0.001"


def test_every_document_is_there_to_its_end(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    made = {r.doc_id: r.text for r in carrier.notes(spark, SF).collect()}
    assert max(map(len, texts.values())) > 10_000
    assert all(made[k].startswith("Patient: ") and made[k].endswith("\n" + t) for k, t in texts.items())
    assert {k: t for k, t in made.items() if k not in texts} == carrier.EDGES
