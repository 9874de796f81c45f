"""Notes by template: draws without replacement, placeholders, variants and offsets."""

from collections import defaultdict
from itertools import count

from pyspark.sql import functions as F

from notesift.functions import constants as C
from notesift.operators import generator


def rows(spark, n=400):
    return generator.generate(spark.range(n), "id").collect()


def test_spans_are_the_places_of_their_texts(spark):
    for r in rows(spark, 60):
        assert r.entities and all(r.text[e.start : e.end] == e.text and e.text in C.POOLS[e.label] for e in r.entities)
        assert [e.start for e in r.entities] == sorted(e.start for e in r.entities)
        assert "{" not in r.text


def test_no_entity_comes_twice_before_its_pool_is_used_up(spark):
    most = 0
    for r in rows(spark):
        seen = defaultdict(list)
        for e in r.entities:
            seen[e.label].append(e.text)
        for label, texts in seen.items():
            assert len(set(texts)) == min(len(texts), len(C.POOLS[label]))
            most = max(most, len(texts))
    assert most > 8


def test_all_variants_values_and_entities_occur(spark):
    made = rows(spark, 2000)
    for variants in generator.TEMPLATES.values():
        for v in variants:
            words = max(v.replace("}", "{").split("{")[::2], key=len)
            assert any(words in r.text for r in made), v
    for label, pool in C.POOLS.items():
        assert {e.text for r in made for e in r.entities if e.label == label} == set(pool)
    for name in ("doctor", "finding", "field"):
        assert all(any(x in r.text for r in made) for x in generator.VALUES[name])
    assert all("[specialty]" in r.text for r in made if r.note_type == "Consult Note")


def test_templates_are_compiled(spark):
    (c,) = generator.compiled("On {DATE12} at {age}: {what}.", count(100))
    kinds = [(p.text, p.label, p.before) for p in c.variants[0]]
    assert kinds == [("On ", None, None), (None, "DATE", None), (" at ", None, None), (None, None, ""), (": ", None, None), ("[what]", None, None), (".", None, None)]
    first, choice = generator.compiled("Has {@negative}", count(100))
    assert len(first.variants) == 1 and len(choice.variants) == len(generator.TEMPLATES["negative"])
    assert generator.compiled("", count(100)) == []


def test_every_step_visits_the_whole_pool():
    for n in (1, 2, 20, 25):
        assert all(len({k * a % n for k in range(n)}) == n for a in generator.steps(n))


def test_odd_ids_and_repeated_rows(spark):
    ids = spark.createDataFrame([(None,), (-7,), (2**63 - 1,), (-(2**63),), (3,), (3,)], "id long")
    got = generator.generate(ids, "id").collect()
    assert got[0].text is None and got[0].entities is None
    assert all(r.text and r.entities for r in got[1:])
    assert got[4] == got[5]
    assert generator.generate(ids.where(F.lit(False)), "id").count() == 0
