"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notesift.llm import decontamination, fill_in_middle, filter_audit, fingerprints, line_dedup, lm_scoring, main_text, minhash, packing, quality, secret_scan, simhash, toxicity, training
from notesift.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.packed(table(spark, sf_dir, "documents"), tokenizer_path(), 2048)
    return found.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


@query
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.digests(secret_scan.secrets(table(spark, sf_dir, "documents")))
    return found.withColumnRenamed("id", "doc_id")


@query
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text.main_text(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learned(docs, table(spark, sf_dir, "labels"))
    found = toxicity.scored(docs, model, ["doc_id"])
    return found.withColumn("held_out", training.held_out(F.col("doc_id")))


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.learned(docs, table(spark, sf_dir, "labels"))
    found = quality.scored(docs, model)
    return found.select(
        F.col("id").alias("doc_id"),
        training.held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", F.col("lines before").alias("n_lines"), F.col("lines removed").alias("n_removed"))


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.matched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        "doc_id",
        (F.size("leaks") > 0).alias("leaks"),
        F.array_sort(F.array_distinct(F.transform("leaks", lambda x: x.item))).alias("items"),
        F.array_join(F.transform("leaks", lambda x: F.concat_ws(":", x.item.cast("string"), x.start.cast("string"), x.end.cast("string"))), ",").alias("spans"),
    )


@query
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scored(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle.transformed(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2("fim", 256).alias("output_sha256"), F.sha2(fill_in_middle.restored(F.col("fim"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE_SQL["op13_fill_in_middle"] = r"""
with units as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as d from documents
), drawn as (
  select *, cast(len(u) as bigint) as n, cast('0x' || d[1:8] as bigint) as h1, cast('0x' || d[9:16] as bigint) as h2, cast('0x' || d[17:24] as bigint) as h3, cast('0x' || d[25:32] as bigint) as h4 from units
), cut as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from drawn
), parts as (
  select doc_id, text, n, form, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:n], '') as s from cut
)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256
from parts
"""


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL["op11_filter_audit"] = r"""
with texts as (
  select doc_id, coalesce(text, '') as t, coalesce(lang, '') as part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), failed as (
  select doc_id, part,
    [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
     regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) over (partition by t), false)] as f from texts
), known as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by 1
), cells as (
  select part, f, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from failed left join known using (doc_id) group by all
), ks as (select unnest([1, 2, 3, 4, 5]) as k),
orders as (
  select [a.k, b.k, c.k, d.k, e.k] as o from ks a, ks b, ks c, ks d, ks e where len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
), steps as (
  select o, array_to_string(list_transform(o, lambda x: chr(64 + x)), '') as filter_order, s.k as step, o[s.k] as own, o[1:s.k - 1] as before from orders, ks s
), judged as (
  select *, f[own] as fails, len(list_filter(before, lambda x: f[x])) > 0 as earlier, len(list_filter(f, lambda x: x)) as fs from cells, steps
), summed as (
  select part, filter_order, step, own,
    sum(case when fails or earlier then 0 else n end) as kept, sum(case when fails and not earlier then n else 0 end) as removed, sum(case when fails and earlier then n else 0 end) as redundant,
    sum(case when fails and fs = 1 then n else 0 end) as unique_fails, sum(case when fails and not earlier then good else 0 end) as good_lost, sum(case when fails and not earlier then toxic else 0 end) as toxic_lost
  from judged group by all
)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
  cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, own) as bigint) as shapley from summed
"""


@query
def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


ORACLE_SQL["op12_minhash"] = r"""
with recursive listed as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), words as (
  select doc_id, len(w) as total, unnest(w) as w0, generate_subscripts(w, 1) as pos from listed
), runs as (
  select doc_id, total, pos, w0, lead(w0, 1) over o as w1, lead(w0, 2) over o as w2, lead(w0, 3) over o as w3 from words window o as (partition by doc_id order by pos)
), shingles as materialized (
  select distinct doc_id, concat_ws(' ', w0, w1, w2, w3) as s from runs where pos = 1 or pos <= total - 3
), sizes as materialized (
  select doc_id, count(*) as n from shingles group by 1
), common as (
  select x.doc_id as a, y.doc_id as b, count(*) as c from shingles x join shingles y on x.s = y.s and x.doc_id < y.doc_id group by all
), links as materialized (
  select a, b from common join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * c >= 80 * (p.n + q.n - c)
), ways as materialized (select a, b from links union select b, a from links),
reach(node, root) as (
  select doc_id, doc_id from documents union select b, root from reach join ways on a = node
)
select d.doc_id, coalesce(max(n), 0) as n_shingles, min(root) as component_id, d.doc_id = min(root) as kept
from documents d left join sizes using (doc_id) join reach on node = d.doc_id group by d.doc_id
"""
