"""Tokens, tags, decoding, splits and weights: joins, windows and aggregations by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notesift.functions import constants as C
from notesift.functions import kernel
from notesift.functions.spans import settled


def tokens(notes: DataFrame) -> DataFrame:
    """``doc_id``, ``pos``, ``token``, ``start``, ``end`` of whitespace tokens: made within the row, without a shuffle."""
    made = settled(notes.select("doc_id", kernel.words(F.col("text")).alias("words")))
    return made.select("doc_id", F.posexplode("words").alias("pos", "w")).select("doc_id", "pos", "w.token", "w.start", "w.end")


def bio_tags(words: DataFrame, entities: DataFrame) -> DataFrame:
    """``tag`` and ``tag_id`` of every token: of the first entity that holds it, or most of it.

    ``entities`` has doc_id, ord, label, start, end.
    """
    e = entities.select(F.col("doc_id").alias("e_doc"), F.col("start").alias("es"), F.col("end").alias("ee"), "label", F.col("ord").alias("eo"))
    both = words.join(e, (F.col("doc_id") == F.col("e_doc")) & (F.col("es") < F.col("end")) & (F.col("ee") > F.col("start")), "left")
    inside = (F.col("es") <= F.col("start")) & (F.col("end") <= F.col("ee"))
    overlap = F.least("ee", "end") - F.greatest("es", "start")
    fits = inside | (overlap * 2 > F.col("end") - F.col("start"))
    first = F.when(inside, F.col("start") == F.col("es")).otherwise(F.col("start") <= F.col("es"))
    tag = F.when(fits, F.concat(F.when(first, "B-").otherwise("I-"), "label"))
    order = Window.partitionBy("doc_id", "pos").orderBy(tag.isNull(), "es", "eo")
    chosen = both.withColumn("tag", tag).withColumn("rn", F.row_number().over(order)).where("rn = 1")
    ids = F.create_map(*[x for t, k in C.TAG_IDS.items() for x in (F.lit(t), F.lit(k))])
    known = chosen.withColumn("tag", F.coalesce("tag", F.lit("O")))
    return known.select("doc_id", "pos", "token", "start", "end", "tag", F.coalesce(F.try_element_at(ids, F.col("tag")), F.lit(0)).alias("tag_id"))


def tagged_words(notes: DataFrame) -> DataFrame:
    """``words`` (token, start, end, tag, tag_id) of each of ``notes`` (``doc_id``, ``text``, ``entities``): what ``bio_tags`` gives, without leaving the row."""
    return settled(notes.select("doc_id", kernel.tag_words(F.col("text"), F.col("entities"), C.TAG_IDS).alias("words")))


def by_word(tagged: DataFrame) -> DataFrame:
    """A row for each of the ``words`` of ``tagged_words``."""
    each = tagged.select("doc_id", F.posexplode("words").alias("pos", "w"))
    return each.select("doc_id", "pos", "w.token", "w.start", "w.end", "w.tag", "w.tag_id")


def word_records(tagged: DataFrame) -> DataFrame:
    """Parallel arrays for every document with ``words``, as ``bio_records`` gives them."""
    some = tagged.where(F.size("words") > 0)
    return some.select("doc_id", F.col("words.token").alias("tokens"), F.col("words.tag").alias("tags"), F.col("words.tag_id").alias("tag_ids"), F.transform("words", lambda x: F.array(x["start"], x["end"])).alias("char_offsets"))


def bio_records(tagged: DataFrame) -> DataFrame:
    """Parallel arrays for every document."""
    rows = tagged.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "tag", "tag_id", "start", "end"))).alias("t"))
    take = lambda f: F.transform("t", lambda x: x[f])
    return rows.select(
        "doc_id", take("token").alias("tokens"), take("tag").alias("tags"), take("tag_id").alias("tag_ids"), F.transform("t", lambda x: F.array(x["start"], x["end"])).alias("char_offsets")
    )


def tag_histogram(tagged: DataFrame) -> DataFrame:
    """Counts of all tags, absent ones too."""
    every = tagged.sparkSession.createDataFrame(list(C.TAG_IDS.items()), "tag string, tag_id int")
    counts = tagged.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(every).join(counts, "tag", "left").select("tag", "tag_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def class_weights(tagged: DataFrame, smoothing: float = 0.1) -> DataFrame:
    """Inverse frequencies, divided by their mean; absent tags get a huge weight."""
    n = tag_histogram(tagged)
    over = Window.partitionBy(F.lit(1))  # a row for each of 11 tags
    raw = F.sum("n").over(over) / (len(C.TAGS) * F.col("n") + smoothing)
    return n.withColumn("raw", raw).select("tag", "tag_id", "n", (F.col("raw") / F.avg("raw").over(over)).alias("weight"))


#: Bits of a hash that one pass of the search for a cut resolves.
STEP = 16


def cuts(hashes: DataFrame, ranks: list[int]) -> list[int]:
    """For each of ``ranks`` a value of the column ``h`` that so many rows don't exceed.

    Counts of the upper bits say in which cell of values a cut lies, and only rows of
    that cell are counted by further bits, until the cut falls between two cells. A
    pass returns at most 2**STEP rows for each rank; equal values stay together.
    """
    u = F.col("h").bitwiseXOR(F.lit(-(2**63)))  # in the order of unsigned numbers
    found = {r: -(2**63) - 1 for r in ranks if r <= 0}
    search = {r: (0, r) for r in ranks if r > 0}
    for level in range(64 // STEP):
        if not search:
            break
        shift = 64 - STEP * (level + 1)
        top = F.shiftrightunsigned(u, shift + STEP) if level else F.lit(0).cast("long")
        cell = F.shiftrightunsigned(u, shift).bitwiseAND(F.lit(2**STEP - 1))
        inside = hashes.where(top.isin(sorted({p for p, _ in search.values()})))
        rows = sorted((r.top, r.cell, r.n) for r in inside.groupBy(top.alias("top"), cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect())
        for rank, (prefix, left) in list(search.items()):
            mine = [(c, n) for t, c, n in rows if t == prefix]
            if sum(n for _, n in mine) < left:  # more than there are
                found[rank] = 2**63 - 1
                del search[rank]
                continue
            for c, n in mine:
                if n >= left:
                    break
                left -= n
            here = (prefix << STEP) | c
            if n == left or not shift:
                found[rank] = ((here + 1) << shift) - 1 - 2**63
                del search[rank]
            else:
                search[rank] = (here, left)
    return [found[r] for r in ranks]


def splits(notes: DataFrame, seed: int = 42, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """``split`` of every document, with exact sizes, by the order of a hash; rows that share an id stay together.

    The order is never made: two cuts are found by counting, and each row is compared with them.
    """
    return notes.select("doc_id", split_of(notes, seed, train, val).alias("split"))


def split_of(notes: DataFrame, seed: int = 42, train: float = 0.7, val: float = 0.15) -> Column:
    """The split by ``doc_id``, for any rows with ids of ``notes``."""
    h = F.xxhash64("doc_id", F.lit(seed))
    keyed = notes.select(h.alias("h"))
    total = keyed.count()
    a, b = int(total * train), int(total * val)
    first, second = cuts(keyed, [a, a + b])
    below = lambda cut: F.lit(False) if cut < -(2**63) else h <= F.lit(cut)
    return F.when(below(first), "train").when(below(second), "val").otherwise("test")


def first_subwords(subwords: DataFrame) -> DataFrame:
    """Of runs of ``word_id`` the first position; null ids (special tokens) are dropped."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    return subwords.withColumn("prev", F.lag("word_id").over(order)).where("word_id is not null and not (word_id <=> prev)").drop("prev")


def align_labels(subwords: DataFrame, tagged: DataFrame) -> DataFrame:
    """``label`` of every subword: its word's tag for the first, else the ignored id."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    rows = subwords.withColumn("first", F.col("word_id").isNotNull() & ~F.col("word_id").eqNullSafe(F.lag("word_id").over(order)))
    tags = tagged.select("doc_id", F.col("pos").alias("word_id"), "tag_id")
    joined = rows.join(tags, ["doc_id", "word_id"], "left")
    return joined.select("doc_id", "pos", F.when(F.col("first"), F.coalesce("tag_id", F.lit(C.IGNORED))).otherwise(C.IGNORED).alias("label"))


def decode(tagged: DataFrame) -> DataFrame:
    """Entities of (doc_id, pos, token, start, end, tag, conf): an I goes on only after its own label; others close."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    begins = F.substring("tag", 1, 2) == "B-"
    rows = tagged.withColumn("label", F.expr("substr(tag, 3)")).withColumn("g", F.sum(begins.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    group = Window.partitionBy("doc_id", "g").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    goes = begins | ((F.substring("tag", 1, 2) == "I-") & (F.col("label") == F.first("label").over(group)))
    rows = rows.where("g > 0").withColumn("open", F.min(goes.cast("int")).over(group)).where("open = 1")
    out = rows.groupBy("doc_id", "g").agg(
        F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("w"), F.min_by("label", "pos").alias("label"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("conf").alias("confidence")
    )
    return out.select("doc_id", F.array_join(F.transform("w", lambda x: x["token"]), " ").alias("text"), "label", "start", "end", "confidence")
