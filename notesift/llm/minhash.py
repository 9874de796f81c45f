"""Near-duplicate documents by one-permutation hashing.

One hash of each distinct shingle places it in a bin, and the least hash of every
bin makes the signature; an empty bin walks a random order of its own until it
meets a full one and takes that one's value (optimal densification), so sets of
any size have whole signatures. Bands of a signature are buckets. In a bucket all
members are joined to its least one, and of these stars each document keeps the
one it shares most buckets with, so candidates are no more than documents. They
are confirmed on the full sets. Members of a bucket that are still in different
groups are then compared by the least hashes of their sets, which are whole sets
of moderate size; the best few partners of each are confirmed first, and more in
further rounds until none is left out. So a failed link to the centre of a star
loses no link to another member.

Equal sets are one node, named by its least id. Shingles are told apart by 64 bits.

Defined results: a null text and one without words have the empty set, which is
linked with nothing; a row with a null id keeps its row and its size, has no
component, is kept and links nothing; rows that share an id are one document, linked
by any of their texts, and come back as often as they went in; an empty table
gives an empty result; texts of any length are read in pieces. Columns other than
the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notesift.llm.common import connected, discard, joined_hot, stored, word_lists
from notesift.llm.simhash import MIX, SEED, SMALL, _mixed, split_hot

#: A pair at the threshold of 0.8 shares none of 48 bands of 6 bins with a probability of some 1e-6 if its bins are
#: independent, and some 1e-3 for sets so small that their bins repeat about 60 values.
BANDS, ROWS = 48, 6
BINS = BANDS * ROWS
#: Where each bin begins, and the order in which an empty one looks for a full one.
EDGES = np.array([k * 2**64 // BINS for k in range(BINS)], dtype=np.uint64)
WALKS = np.random.default_rng(SEED).permuted(np.tile(np.arange(BINS), (BINS, 1)), axis=1)
#: Least hashes by which members of a bucket are compared; sets up to this size are compared as a whole.
LEAST = 256
#: Of larger sets those pairs are confirmed that lie within so many standard deviations under the threshold.
DEVIATIONS = 4


def shingle_hashes(text: str | None, words: int = 4) -> np.ndarray:
    """Sorted distinct hashes of the shingles; the whole sequence makes one if there are fewer words."""
    with np.errstate(over="ignore"):
        tail, found = np.empty(0, dtype=np.uint64), []
        for some in word_lists((text or "").encode("utf-8", "surrogatepass").lower()):
            h = np.concatenate([tail, np.fromiter(map(xxhash.xxh64_intdigest, some), dtype=np.uint64, count=len(some))])
            if len(h) >= words:
                found.append(np.unique(_chained(h, words)))
            tail = h[max(len(h) - words + 1, 0) :]
        if not found and len(tail):
            found.append(_chained(tail, len(tail)))
        return np.unique(np.concatenate(found)) if found else tail


def _chained(h: np.ndarray, words: int) -> np.ndarray:
    """One hash for each run of ``words`` word hashes."""
    out = np.full(len(h) - words + 1, words, dtype=np.uint64)
    for k in range(words):
        out = _mixed(out * MIX[0] + h[k : k + len(out)], 1)
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """16 bits of the least hash of each bin, for a set that isn't empty."""
    at = np.searchsorted(hashes, EDGES)
    full = at < np.append(at[1:], len(hashes))
    sig = (hashes[np.minimum(at, len(hashes) - 1)] * MIX[2] >> np.uint64(48)).astype(np.uint16)
    if not full.all():
        own = np.arange(BINS)
        sig = sig[np.where(full, own, WALKS[own, full[WALKS].argmax(axis=1)])]
    return sig


def prints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``id``, ``n``, ``digest`` of the set and ``sig`` of every row; the last two null for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, sig = [], [], []
            for text in batch.column(1):
                h = shingle_hashes(text.as_py(), words)
                n.append(len(h))
                digest.append(xxhash.xxh128_digest(h.tobytes()) if len(h) else None)
                with np.errstate(over="ignore"):
                    sig.append(signature(h).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["id", "n", "digest", "sig"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n long, digest binary, sig binary")


def banded(nodes: DataFrame) -> DataFrame:
    """A row (``key``, ``node``) for each band of each signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                if not batch.num_rows:
                    continue
                sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
                key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(sig), 1))
                for k in range(ROWS):
                    key = _mixed(key * MIX[0] + sig[:, :, k], 1)
                node = batch.column(0).take(pa.array(np.repeat(np.arange(len(sig)), BANDS)))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), node], ["key", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "key long, node long")


def full_sets(docs: DataFrame, ends: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``node``, ``set`` (sorted hashes), its size ``n`` and ``least`` (upper halves of its least hashes) of the documents in ``ends``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                sets = [shingle_hashes(x.as_py(), words) for x in some.column(1)]
                least = [(h[:LEAST] >> np.uint64(32)).astype(np.uint32).tobytes() for h in sets]
                cells = [pa.array([len(h) for h in sets], pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary()), pa.array(least, pa.binary())]
                yield pa.RecordBatch.from_arrays([some.column(0), *cells], ["node", "n", "set", "least"])

    side = F.broadcast(ends) if ends.count() <= SMALL else ends
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text")).join(side, "node", "left_semi")
    return stored(texts.mapInArrow(run, "node long, n long, set binary, least binary"), "full-sets")[0]


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (``a``, ``b``) and whether their sets are ``alike``: percent of the union or more in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64)
                common = 0
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                found.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.bool_())], ["a", "b", "alike"])

    both = pairs
    for end, cell in (("a", "x"), ("b", "y")):
        both = joined_hot(both, sets.select(F.col("node").alias(end), F.col("set").alias(cell)), end, ["a", "b"], counts=pairs.groupBy(end).count())
    tested = both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, alike boolean")
    # documents that share an id may have several texts
    return stored(tested.groupBy("a", "b").agg(F.max("alike").alias("alike")), "confirmed")[0]


def stars(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """For each member of a shared bucket the least member of one: that with which it shares most. ``a`` < ``b``."""
    sizes = buckets.select("key", F.col("size").alias("count"))
    joined = joined_hot(rows, buckets.select("key", "hub"), "key", ["node"], counts=sizes).where("node <> hub")
    shared = joined.groupBy("node", "hub").count()
    best = shared.groupBy("node").agg(F.max(F.struct("count", (-F.col("hub")).alias("hub"))).alias("best"))
    return best.select((-F.col("best.hub")).alias("a"), F.col("node").alias("b"))


def partners(node: np.ndarray, root: np.ndarray, n: np.ndarray, least: list[bytes], percent: int, most: int) -> Iterator[np.ndarray]:
    """Pairs of members of one bucket in different groups that may be alike, at most ``most`` for each; a pair of equals says that more were left out."""
    names, counts = np.unique(root, return_counts=True)
    if len(names) == 1:
        return
    values = [np.frombuffer(x, dtype=np.uint32) for x in least]
    flat, length = np.concatenate(values), np.array([len(v) for v in values])
    starts = np.cumsum(length) - length
    _, ids = np.unique(flat, return_inverse=True)
    # up to here all hashes of a set are known
    reach = np.where(n <= length, 2**32, flat[starts + length - 1].astype(np.int64))
    marked = np.zeros(len(flat), dtype=bool)
    for k in np.flatnonzero(root != names[counts.argmax()]):  # every pair of groups has one of these
        own = ids[starts[k] : starts[k] + length[k]]
        marked[own] = True
        cut = np.minimum(reach, reach[k])
        inside = flat <= np.repeat(cut, length)
        common = np.add.reduceat(marked[ids] & inside, starts, dtype=np.int64)
        union = np.add.reduceat(inside, starts, dtype=np.int64) + np.searchsorted(values[k], cut, side="right") - common
        marked[own] = False
        slack = np.where((cut == 2**32), 1, DEVIATIONS * np.sqrt(percent * (100 - percent) * union) / 100)  # 1: for equal halves of hashes
        near = np.flatnonzero((common + slack >= union * percent / 100) & (root != root[k]))
        if len(near) > most:
            near = near[np.lexsort((node[near], -common[near] / union[near]))]
            _, first = np.unique(root[near], return_index=True)  # the best of each group, then the others
            first = np.sort(first)
            near = np.concatenate([near[first], np.delete(near, first)])[:most]
            yield np.array([[node[k], node[k]]])
        yield np.stack([np.full(len(near), node[k]), node[near]], axis=1)


def apart(members: DataFrame, percent: int, most: int) -> DataFrame:
    """Pairs (``a`` <= ``b``) of all buckets as ``partners`` gives them."""

    def solved(held: list[pa.RecordBatch], last: bool) -> tuple[pa.RecordBatch, list[pa.RecordBatch]]:
        """Pairs of the buckets that are complete, and the rows of the one that isn't."""
        t = pa.Table.from_batches(held)
        key = np.stack([t.column(k).to_numpy() for k in range(3)], axis=1)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        begins, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
        rest: list[pa.RecordBatch] = []
        if not last:
            rest = t.slice(begins[-1]).to_batches()
            begins, ends = begins[:-1], ends[:-1]
        node, root, n = (t.column(k).to_numpy() for k in (3, 4, 5))
        least, found = t.column(6).to_pylist(), [np.empty((0, 2), dtype=np.int64)]
        for a, b in zip(begins, ends, strict=True):
            found.extend(partners(node[a:b], root[a:b], n[a:b], least[a:b], percent, most))
        pairs = np.concatenate(found)
        return pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], ["a", "b"]), rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                begin = [held[0].column(k)[0].as_py() for k in range(3)]
                if begin != [batch.column(k)[batch.num_rows - 1].as_py() for k in range(3)]:
                    pairs, held = solved(held, False)
                    yield pairs
        if held:
            yield solved(held, True)[0]

    dealt = split_hot(members, ("root", "n", "least")).repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return dealt.select("key", "p", "q", "node", "root", "n", "least").mapInArrow(run, "a long, b long")


def unsettled(rows: DataFrame, buckets: DataFrame, sets: DataFrame, groups: DataFrame) -> DataFrame:
    """Members of buckets that hold several groups: ``key``, ``node``, ``root``, ``n`` and ``least``."""
    root = F.coalesce("root", "node").alias("root")
    members, path = stored(rows.join(groups, "node", "left").select("key", "node", root), "members")
    mixed = members.groupBy("key").agg((F.min("root") < F.max("root")).alias("mixed")).where("mixed").select("key")
    mixed, _ = stored(mixed, "mixed-buckets")
    sizes = buckets.join(mixed, "key").select("key", F.col("size").alias("count"))
    some = joined_hot(members, mixed, "key", ["node"], counts=sizes)
    found, _ = stored(some.join(sets.select("node", "n", "least"), "node"), "unsettled")
    discard(rows.sparkSession, path)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 80, most: int = 4) -> DataFrame:
    """``id``, ``n`` (size of the set), ``component`` (the least id reachable by links) and ``kept`` of every row of ``docs``."""
    every, _ = stored(prints(docs, id_col, text_col, words), "set-prints")
    named = every.where("id is not null and digest is not null")
    nodes, _ = stored(named.groupBy("digest").agg(F.min("id").alias("node"), F.first("sig").alias("sig")), "set-nodes")
    rows, path = stored(banded(nodes), "bands")
    buckets, _ = stored(rows.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    sizes = buckets.select("key", F.col("size").alias("count"))
    shared, _ = stored(joined_hot(rows, buckets.select("key"), "key", ["node"], counts=sizes), "shared-bands")
    discard(docs.sparkSession, path)

    pairs, _ = stored(stars(shared, buckets), "stars")
    ends, _ = stored(shared.select("node").distinct(), "candidates")
    sets = full_sets(docs, ends, id_col, text_col, words)
    tested = confirmed(pairs, sets, percent)
    links = tested.where("alike").select("a", "b").union(_same_id(named, nodes))
    groups = connected(links, "set-groups")
    while True:
        found, _ = stored(apart(unsettled(shared, buckets, sets, groups), percent, most).distinct(), "pairs-apart")
        more = found.where("a = b").limit(1).count()
        fresh, _ = stored(found.where("a <> b").join(tested, ["a", "b"], "left_anti"), "fresh-pairs")
        if fresh.limit(1).count():
            now = confirmed(fresh, sets, percent)
            tested, links = tested.unionByName(now), links.union(now.where("alike").select("a", "b"))
            groups = connected(links, "set-groups")
        if not more:
            break
        most *= 8
    roots = nodes.join(groups, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    out = joined_hot(every.select("id", "n", "digest"), roots, "digest", ["id"], how="left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    return out.select("id", "n", component.alias("component"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def _same_id(named: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between the nodes of texts that share an id."""
    several, _ = stored(named.groupBy("id").agg(F.count_distinct("digest").alias("texts")).where("texts > 1").select("id"), "shared-ids")
    ends = named.join(several, "id").select("id", "digest").distinct().join(nodes.select("digest", "node"), "digest")
    return ends.join(ends.groupBy("id").agg(F.min("node").alias("a")), "id").where("a <> node").select("a", F.col("node").alias("b"))
