"""Entity-level scores and token-level error analysis of ``doc_id, pos, token, true_id, pred_id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notesift.functions import constants as C


def tag_of(column: str) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, C.TAGS)), F.when(F.col(column).between(0, len(C.TAGS) - 1), F.col(column))), F.lit("O"))


def kind_of(tag: Column) -> Column:
    return F.when(tag == "O", "O").otherwise(F.substring_index(tag, "-", -1))


def named(pairs: DataFrame) -> DataFrame:
    """Without ignored positions, with ``true`` and ``pred`` tags."""
    return pairs.where(F.col("true_id") != C.IGNORED).withColumn("true", tag_of("true_id")).withColumn("pred", tag_of("pred_id"))


def chunks(rows: DataFrame, tag: str) -> DataFrame:
    """Entities ``doc_id, kind, s, e``; an I without its own label before it starts one."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    kind = kind_of(F.col(tag))
    rows = rows.select("doc_id", "pos", tag, kind.alias("kind"), F.lag(kind, 1, "O").over(order).alias("prev"))
    begins = (F.col("kind") != "O") & ((F.substring(tag, 1, 1) == "B") | (F.col("kind") != F.col("prev")))
    rows = rows.withColumn("g", F.sum(begins.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("kind <> 'O'")
    return rows.groupBy("doc_id", "g", "kind").agg(F.min("pos").alias("s"), F.max("pos").alias("e")).drop("g")


SCORES = ("precision", "recall", "f1")


def _ratios(digits: int | None = 4, tp: str = "tp", fp: str = "fp", fn: str = "fn") -> list[Column]:
    t, p, n = F.col(tp), F.col(tp) + F.col(fp), F.col(tp) + F.col(fn)
    precision, recall = F.when(p > 0, t / p).otherwise(0.0), F.when(n > 0, t / n).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return [(x if digits is None else F.round(x, digits)).alias(c) for x, c in zip((precision, recall, f1), SCORES, strict=True)]


def _matches(pairs: DataFrame) -> DataFrame:
    """Entities of both tags, each counted once; ``pairs`` are worked out and dealt by document once."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    rows = named(pairs).select("doc_id", "pos", *[F.struct(F.substring(c, 1, 1).alias("first"), kind_of(F.col(c)).alias("kind")).alias(c) for c in ("true", "pred")])
    rows = rows.select("*", *[F.lag(f"{c}.kind", 1, "O").over(order).alias(f"{c} prev") for c in ("true", "pred")])
    begins = lambda c: ((F.col(f"{c}.kind") != "O") & ((F.col(f"{c}.first") == "B") | (F.col(f"{c}.kind") != F.col(f"{c} prev")))).cast("int")
    rows = rows.select("*", *[F.sum(begins(c)).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(f"{c} g") for c in ("true", "pred")])
    sides = F.array(*[F.struct(F.lit(c == "true").alias("gold"), F.col(f"{c}.kind").alias("kind"), F.col(f"{c} g").alias("g")) for c in ("true", "pred")])
    each = rows.select("doc_id", "pos", F.inline(sides)).where("kind <> 'O'")
    entities = each.groupBy("doc_id", "gold", "g", "kind").agg(F.min("pos").alias("s"), F.max("pos").alias("e"))
    both = entities.groupBy("doc_id", "kind", "s", "e").agg(F.bool_or("gold").alias("gold"), F.bool_or(~F.col("gold")).alias("found"))
    return both.select("kind", (F.col("gold") & F.col("found")).cast("long").alias("tp"), (~F.col("gold")).cast("long").alias("fp"), (~F.col("found")).cast("long").alias("fn"))


def ner_prf(pairs: DataFrame) -> DataFrame:
    """Micro precision, recall and F1 of entities."""
    total = _matches(pairs).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    return total.select("tp", "fp", "fn", *_ratios())


def ner_report(pairs: DataFrame) -> DataFrame:
    """The same by kind, with the averages over all entities (micro), over kinds (macro), and over kinds by their support (weighted)."""
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    kinds = _matches(pairs).groupBy("kind").agg(*sums).select("kind", "tp", "fp", "fn", *_ratios(None))
    support = F.sum(F.col("tp") + F.col("fn"))
    means = [F.avg(c).alias(f"macro {c}") for c in SCORES]
    weighted = [F.when(support > 0, F.sum(F.col(c) * (F.col("tp") + F.col("fn"))) / support).otherwise(0.0).alias(f"weighted {c}") for c in SCORES]
    rows = kinds.rollup("kind").agg(*sums, *means, *weighted)
    rows = rows.select("*", *_ratios(None), (F.col("tp") + F.col("fn")).alias("support"))
    row = lambda name, prefix: F.struct(name.alias("kind"), *[F.round(F.col(prefix + c), 4).alias(c) for c in SCORES])
    averages = F.array(row(F.lit("micro avg"), ""), row(F.lit("macro avg"), "macro "), row(F.lit("weighted avg"), "weighted "))
    each = rows.where("kind is not null or tp is not null").select("tp", "fp", "fn", "support", F.explode(F.when(F.col("kind").isNull(), averages).otherwise(F.array(row(F.col("kind"), "")))).alias("r"))
    return each.select("r.kind", "tp", "fp", "fn", "support", *[f"r.{c}" for c in SCORES])


def _error() -> Column:
    return F.when((F.col("true") == "O"), "false_positive").when(F.col("pred") == "O", "false_negative").otherwise("misclassified")


def errors(pairs: DataFrame) -> DataFrame:
    """Wrong tokens with their kind of error and seven words around."""
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(-3, 3)
    rows = pairs.withColumn("words", F.array_join(F.collect_list("token").over(order), " "))
    wrong = named(rows).where(F.col("true") != F.col("pred"))
    return wrong.select("doc_id", "pos", F.col("token").alias("text"), F.col("true").alias("true_label"), F.col("pred").alias("pred_label"), F.col("words").alias("context"), _error().alias("error_type"))


def error_distribution(pairs: DataFrame) -> DataFrame:
    wrong = counted(pairs).where(F.col("true") != F.col("pred"))
    return wrong.groupBy(_error().alias("error_type")).agg(F.sum("n").alias("n"))


def counted(pairs: DataFrame) -> DataFrame:
    """How often each two tags meet: a row for 121 at most, from which other counts follow."""
    return named(pairs).groupBy("true", "pred").agg(F.count(F.lit(1)).alias("n"))


def confusion(pairs: DataFrame) -> DataFrame:
    return counted(pairs).withColumnsRenamed({"true": "true_label", "pred": "pred_label"})


def top_confused(pairs: DataFrame, k: int = 10) -> DataFrame:
    wrong = confusion(pairs).where("true_label <> pred_label and true_label <> 'O'")
    return wrong.orderBy(F.desc("n"), "true_label", "pred_label").limit(k)


def entity_prf(pairs: DataFrame) -> DataFrame:
    """Token-level scores by kind of entity."""
    row = lambda kind, **n: F.struct(kind.alias("kind"), *[n.get(c, F.lit(0).cast("long")).alias(c) for c in ("tp", "fp", "fn")])
    true, pred, n = kind_of(F.col("true")), kind_of(F.col("pred")), F.col("n")
    sides = F.when(F.col("true") == F.col("pred"), F.array(row(true, tp=n))).otherwise(F.array(row(true, fn=n), row(pred, fp=n)))
    each = counted(pairs).select(F.inline(sides)).where("kind <> 'O'")
    total = each.groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return total.select("kind", "tp", "fp", "fn", *_ratios())


def top_words(pairs: DataFrame, error_type: str, k: int = 10) -> DataFrame:
    """The words most often wrong in this way; ties by first occurrence."""
    rows = errors(pairs).where(F.col("error_type") == error_type).groupBy(F.col("text").alias("word")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "pos")).alias("first"))
    return rows.orderBy(F.desc("n"), "first").limit(k).select("word", "n")


def sample_errors(pairs: DataFrame, k: int = 20) -> DataFrame:
    return errors(pairs).orderBy("doc_id", "pos").limit(k)
