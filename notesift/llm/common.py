"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where none is set, a single-machine session, as in tests, gets one; a cluster must set it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = made.get() if made.isDefined() else None
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="notesift-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # the shuffles of this write aren't read again
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that ``stored`` has written and nothing reads any more."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def word_lists(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words (`[^\\x20\\x09-\\x0D]+`) of ``text`` in order, those of about ``size`` bytes at a time."""
    at = 0
    while at < len(text):
        end = min(at + size, len(text))
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        yield text[at:end].split()
        at = end


#: Rows of a key that are joined in one task; more are dealt into parts.
HOT = 1 << 14


def joined_hot(rows: DataFrame, side: DataFrame, key: str, spread: list[str], how: str = "inner", counts: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """``rows`` joined with ``side`` on ``key``, where a key of ``rows`` may hold a large share of them and ``side`` has few rows for it.

    Keys of over ``limit`` rows, by ``counts`` (the key and ``count``) if given, are
    dealt into parts by a hash of the columns ``spread``, and the rows of ``side``
    are copied for each part.
    """
    limit = limit or HOT
    hot = (counts or rows.groupBy(key).count()).where(F.col("count") > limit).select(F.col(key), F.ceil(F.col("count") / limit).cast("int").alias("parts"))
    hot, path = stored(hot, "hot-keys")
    n = hot.count()
    if not n:
        discard(rows.sparkSession, path)
        return rows.join(side, key, how)
    hot = F.broadcast(hot) if n <= 100_000 else hot
    parts = F.coalesce("parts", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("part", F.pmod(F.xxhash64(*spread), parts).cast("int")).drop("parts")
    copies = side.join(hot, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return dealt.join(copies, [key, "part"], how).drop("part")


def unused(name: str, df: DataFrame) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


#: Links up to which a round of ``connected`` broadcasts the least neighbours.
FEW_LINKS = 1 << 17


def connected(edges: DataFrame, label: str = "links") -> DataFrame:
    """Components of the undirected graph with the long columns ``a`` and ``b``.

    Returns ``node`` and ``root`` (the least node reachable) for every node with
    a link to another. Nulls and loops are ignored; repeated links are harmless.
    Alternates a large star (greater neighbours move to the least one) with a
    small star until nothing changes, a logarithmic number of rounds; each round
    aggregates before it shuffles and is written to the shared folder.
    """
    spark = edges.sparkSession
    now, path = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label
    )
    seen = None
    while True:
        n, total = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == (n, total) or not n:
            break
        seen = (n, total)
        side = F.broadcast if n <= FEW_LINKS else lambda x: x
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(side(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(side(low), "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        before = path
        now, path = stored(small, label)
        discard(spark, before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
