"""Near-duplicate documents by SimHash, with pivot distance tables.

A fingerprint is 64 or more bits. Candidate pairs meet in buckets of equal bits;
there, precomputed Hamming distances to reference fingerprints (pivots) discard
every pair with a coordinate difference above the radius, which the triangle
inequality makes exact, and the Hamming distance verifies the survivors.

Defined results: a null text counts as empty; an empty text has the fingerprint
zero and is linked like any other; null ids keep their row, and a component
takes the least id that is not null; repeated rows come back as often as they
went in; an empty table gives an empty result. Columns other than the id and the
text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notesift.llm.common import connected, stored, unused

SEED = 42
#: Shingles hashed at once, so that memory is bounded for any length of text.
CHUNK = 1 << 16
#: Members of a bucket that meet in one task; larger buckets are split into pairs of parts.
BUCKET = 1 << 13
LANES = np.uint64(0x0101010101010101)
SHIFTS = np.arange(8, dtype=np.uint64)[:, None]
#: Odd multipliers and shifts that derive further words of a wide fingerprint.
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def shingles(text: str | None, words: int) -> list[bytes]:
    """Lower-cased (A-Z) shingles of ``words`` words, repeats included; the whole sequence if there are fewer."""
    seq = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not seq:
        return []
    if len(seq) < words:
        return [b" ".join(seq)]
    return list(map(b" ".join, zip(*(seq[k:] for k in range(words)), strict=False)))


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in ``h``; eight byte lanes are summed at a time."""
    lanes = (h[None, :] >> SHIFTS) & LANES
    sums = np.add.reduceat(lanes, np.arange(0, len(h), 255), axis=1)
    return sums.view(np.uint8).reshape(8, -1, 8).astype(np.int64).sum(axis=1).T.ravel()


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    if not k:
        return h
    h = h + MIX[2] * np.uint64(k)
    h = (h ^ (h >> np.uint64(30))) * MIX[0]
    h = (h ^ (h >> np.uint64(27))) * MIX[1]
    return h ^ (h >> np.uint64(31))


def fingerprint(text: str | None, words: int = 4, width: int = 1) -> np.ndarray:
    """``width`` words of 64 bits; a bit is 1 if set in over half of the shingles' hashes."""
    return _fingerprint(text, words, width)[0]


def _fingerprint(text: str | None, words: int, width: int) -> tuple[np.ndarray, bytes]:
    """The fingerprint, and a digest that texts with the same shingles in the same order share."""
    parts, seen = shingles(text, words), xxhash.xxh3_128()
    if not parts:
        return np.zeros(width, dtype=np.uint64), seen.digest()
    counts = np.zeros((width, 64), dtype=np.int64)
    for at in range(0, len(parts), CHUNK):
        some = parts[at : at + CHUNK]
        h = np.fromiter(map(xxhash.xxh64_intdigest, some, repeat(SEED)), dtype=np.uint64, count=len(some))
        seen.update(h)
        for k in range(width):
            counts[k] += _bit_counts(_mixed(h, k))
    return np.packbits(counts * 2 > len(parts), axis=1, bitorder="little").view(np.uint64).ravel(), seen.digest()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, width: int = 1, digest: bool = False) -> DataFrame:
    """``id`` and ``fp`` (binary, big-endian words) of every row; with ``digest`` also ``same``, which texts with the same shingles in the same order share."""
    names = ["id", "fp", "same"][: 2 + digest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                got = [_fingerprint(x.as_py(), words, width) for x in batch.column(1)]
                cells = [pa.array([fp.astype(">u8").tobytes() for fp, _ in got], pa.binary()), pa.array([same for _, same in got], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *cells][: len(names)], names)

    schema = "id long, " + ", ".join(f"{c} binary" for c in names[1:])
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pivots(width: int, count: int = 16) -> np.ndarray:
    """The reference fingerprints."""
    return np.random.default_rng(SEED).integers(0, 2**64, size=(count, width), dtype=np.uint64)


def distances(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances of ``fps`` to every reference: the pivot table."""
    out = np.empty((len(fps), len(refs)), dtype=np.int16)
    for k, ref in enumerate(refs):
        out[:, k] = np.bitwise_count(fps ^ ref).sum(axis=1, dtype=np.int16)
    return out


def _within(fa: np.ndarray, fb: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of wide fingerprints within ``radius``: their first half discards nearly all others (sums of 256 pass as 0), then all words count."""
    bits = np.bitwise_count(fa[:, None, 0] ^ fb[None, :, 0])
    for k in range(1, min((fa.shape[1] + 1) // 2, 4)):
        bits += np.bitwise_count(fa[:, None, k] ^ fb[None, :, k])
    i, j = np.nonzero(bits <= radius)
    keep = np.bitwise_count(fa[i] ^ fb[j]).sum(axis=1, dtype=np.int16) <= radius
    return i[keep], j[keep]


def _near(fa: np.ndarray, ta: np.ndarray, fb: np.ndarray, tb: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within ``radius``: pivot coordinates first, then the Hamming distance.

    Further coordinates are left out once one discards under a tenth, as for a
    radius far above their spread; the last test is exact in any case. For wide
    fingerprints, whose radius is far above it, all are left out.
    """
    if fa.shape[1] > 1:
        return _within(fa, fb, radius)
    i, j = np.nonzero(np.abs(ta[:, 0][:, None] - tb[:, 0][None, :]) <= radius)
    for k in range(1, ta.shape[1]):
        keep = np.abs(ta[i, k] - tb[j, k]) <= radius
        if keep.sum() > 0.9 * len(i):
            break
        i, j = i[keep], j[keep]
    keep = np.bitwise_count(fa[i] ^ fb[j]).sum(axis=1, dtype=np.int16) <= radius
    return i[keep], j[keep]


def _stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Edges from the least member to the others of each component of the pairs."""
    label = np.arange(n)
    while len(i):
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            break
    member = np.flatnonzero(label != np.arange(n))
    return np.stack([label[member], member], axis=1)


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (the least member of each group) when the groups of ``a`` and ``b`` are one."""
    while (apart := label[a] != label[b]).any():
        a, b = a[apart], b[apart]
        least = np.arange(len(label))
        np.minimum.at(least, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
        while (least != (least := least[least])).any():
            pass
        label = least[label]
    return label


def forest(fps: np.ndarray, refs: np.ndarray, radius: int, small: int = 256, block: int = 64) -> np.ndarray:
    """Edges (index pairs) that span the components of one bucket, at most one for each member."""
    table = distances(fps, refs[: 0 if fps.shape[1] > 1 else None])
    return spanned(len(fps), lambda a, b: _near(fps[a], table[a], fps[b], table[b], radius), small, block)


def spanned(n: int, near: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], small: int = 256, block: int = 64) -> np.ndarray:
    """Edges that span the components of ``n`` members; ``near`` gives the pairs between two arrays of members, by place in them.

    In a large bucket, what a search from ``block`` members finds leaves the unvisited
    rest, and members of one group aren't compared, so a dense group costs about its
    size rather than its square, and members without a link cost a call for each block.
    """
    rest = np.arange(n)
    if n <= small:
        i, j = near(rest, rest)
        keep = i < j
        return _stars(n, i[keep], j[keep])
    label, front = np.arange(n), np.arange(0)
    while len(front) or len(rest) > 1:
        if len(front):
            own = label[front] == label[front[0]]
            some, others = front[own][:block], front[~own]
            front = np.concatenate([front[own][block:], others])
        else:
            some, rest = rest[:block], rest[block:]
            others = some
        beside = np.concatenate([others, rest])
        if not len(beside):
            break  # what is left in front is one group
        i, j = near(some, beside)
        label = joined(label, some[i], beside[j])
        found = np.unique(j[j >= len(others)]) - len(others)
        front, rest = np.concatenate([front, rest[found]]), np.delete(rest, found)
    member = np.flatnonzero(label != np.arange(n))
    return np.stack([label[member], member], axis=1)


def exact_masks(n: int, radius: int) -> np.ndarray:
    """Bit masks for 64-bit fingerprints: any two within ``radius`` agree on one of them (pigeonhole).

    Of m blocks at least m - radius agree. m is the least number for which
    buckets of unrelated fingerprints stay small among ``n``.
    """
    for blocks in range(radius + 1, 4 * radius + 5):
        if n / 2.0 ** (64 * (blocks - radius) / blocks) <= 4096:
            break
    edge = [round(64 * k / blocks) for k in range(blocks + 1)]
    part = [((1 << edge[k + 1]) - 1) ^ ((1 << edge[k]) - 1) for k in range(blocks)]
    return np.array([[sum(part[k] for k in some)] for some in combinations(range(blocks), blocks - radius)], dtype=np.uint64)


def band_masks(n: int, radius: int, width: int, miss: float = 0.03) -> np.ndarray:
    """Bit masks for wide fingerprints: two at ``radius`` agree on none of them with probability ``miss``, nearer ones hardly ever."""
    bits = max(12, math.ceil(math.log2(max(n, 1) / 1024)))
    bands = math.ceil(math.log(miss) / math.log1p(-((1 - radius / (64 * width)) ** bits)))
    rng, order, out = np.random.default_rng(SEED + 1), np.empty(0, dtype=np.int64), []
    for _ in range(bands):
        if len(order) < bits:
            order = np.concatenate([order, rng.permutation(64 * width)])
        some, order = np.unique(order[:bits]), order[bits:]
        mask = [0] * width
        for bit in some.tolist():
            mask[bit // 64] |= 1 << (bit % 64)
        out.append(mask)
    return np.array(out, dtype=np.uint64)


def _matrix(fps: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(fps), dtype=">u8").astype(np.uint64).reshape(-1, width)


def _words(column: pa.Array, width: int) -> np.ndarray:
    return _matrix(column.to_pylist(), width)


def bucketed(fps: DataFrame, masks: np.ndarray) -> DataFrame:
    """A row (``key``, ``node``, ``fp``) for each fingerprint and mask."""
    width = masks.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    if not part.num_rows:
                        continue
                    fp = _words(part.column(1), width)
                    key = np.zeros((len(masks), len(fp)), dtype=np.uint64)
                    for k in range(width):
                        key = _mixed(key ^ (fp[None, :, k] & masks[:, None, k]), k + 1)
                    key = _mixed(key + np.arange(len(masks), dtype=np.uint64)[:, None], 1)
                    rows = pa.array(np.tile(np.arange(len(fp)), len(masks)))
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), part.column(0).take(rows), part.column(1).take(rows)], ["key", "node", "fp"])

    return fps.select("node", "fp").mapInArrow(run, "key long, node long, fp binary")


def split_hot(rows: DataFrame, columns: Sequence[str] = ("fp",)) -> DataFrame:
    """Adds ``p`` and ``q``: buckets over BUCKET members are dealt into parts, and every pair of parts meets."""
    hot = rows.groupBy("key").count().where(F.col("count") > BUCKET).select("key", F.ceil(F.col("count") / BUCKET).cast("int").alias("parts"))
    hot, _ = stored(hot, "hot-buckets")
    n = hot.count()
    if not n:
        return rows.select("key", F.lit(0).alias("p"), F.lit(0).alias("q"), "node", *columns)
    side = F.broadcast(hot) if n <= 100_000 else hot
    own = F.pmod(F.xxhash64("node", *columns), F.col("parts")).cast("int")
    return (
        rows.join(side, "key", "left")
        .withColumn("own", F.coalesce(own, F.lit(0)))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0)))))
        .select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "node", *columns)
    )


def bucket_edges(rows: DataFrame, width: int, radius: int) -> DataFrame:
    """Links (``a``, ``b``) that span what lies within ``radius`` in each bucket."""
    refs = pivots(width)
    return bucket_pairs(rows, lambda fps: forest(_matrix(fps, width), refs, radius))


#: Members of buckets whose pairs are all compared at once.
LITTLE = 32


def bucket_pairs(rows: DataFrame, find: Callable[..., np.ndarray], columns: Sequence[str] = ("fp",), near: Callable[..., np.ndarray] | None = None) -> DataFrame:
    """Pairs (``a``, ``b``) of what ``find`` gives as index pairs for the ``columns`` of each bucket (lists of bytes, or arrays of numbers).

    With ``near``, which says of the cells of first and second members whether they
    make a pair, the pairs of all buckets of LITTLE members at most are tested together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solved(key: np.ndarray, node: np.ndarray, *cells: list[bytes] | np.ndarray) -> pa.RecordBatch | None:
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            begins, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
            found, size = [], ends - begins
            if near is not None:
                few = (size > 1) & (size <= LITTLE)
                last = np.repeat(np.where(few, ends, begins + 1), size)  # what isn't in a small bucket has no partner
                partners = np.maximum(last - np.arange(len(key)) - 1, 0)
                i = np.repeat(np.arange(len(key)), partners)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(partners) - partners, partners)
                hit = near(*[c[i] for c in cells], *[c[j] for c in cells])
                found.append(np.stack([node[i[hit]], node[j[hit]]], axis=1))
                begins, ends = begins[size > LITTLE], ends[size > LITTLE]
            for a, b in zip(begins, ends, strict=True):
                if b - a > 1:
                    got = find(*[c[a:b] for c in cells])
                    if len(got):
                        found.append(node[a:b][got])
            if not found:
                return None
            pairs = np.concatenate(found)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        def arrays(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, *tuple[list[bytes] | np.ndarray, ...]]:
            t = pa.Table.from_batches(parts)
            key = np.stack([t.column(k).to_numpy() for k in range(3)], axis=1)
            cells = [t.column(k) for k in range(4, t.num_columns)]
            return key, t.column(3).to_numpy(), *[c.to_pylist() if pa.types.is_binary(c.type) else c.to_numpy() for c in cells]

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            first = [held[0].column(k)[0].as_py() for k in range(3)]
            if first == [batch.column(k)[batch.num_rows - 1].as_py() for k in range(3)]:
                continue  # one bucket so far
            key, node, *cells = arrays(held)
            last = np.flatnonzero((key != key[-1]).any(axis=1))[-1] + 1
            held = [batch.slice(batch.num_rows - (len(key) - last))]
            if (out := solved(key[:last], node[:last], *[c[:last] for c in cells])) is not None:
                yield out
        if held and (out := solved(*arrays(held))) is not None:
            yield out

    dealt = rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "node")  # stars have the least node
    return dealt.select("key", "p", "q", "node", *columns).mapInArrow(run, "a long, b long")


def components(prints: DataFrame, radius: int = 4, width: int = 1) -> DataFrame:
    """``fp`` and ``component`` of every distinct fingerprint in ``prints`` (``id``, ``fp``).

    With ``width`` 1 the search is exact. Copies of a fingerprint are one node,
    named by its least id; fingerprints that only rows with a null id have make
    no links and have a null component.
    """
    nodes, _ = stored(prints.groupBy("fp").agg(F.min("id").alias("node")), "fingerprints")
    n = nodes.count()
    masks = exact_masks(n, radius) if width == 1 else band_masks(n, radius, width)
    rows = bucketed(nodes.where("node is not null"), masks)
    found = connected(bucket_edges(split_hot(rows), width, radius), "near-links")
    return nodes.join(found, "node", "left").select("fp", F.coalesce("root", "node").alias("component"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, width: int = 1
) -> DataFrame:
    """``id``, ``fp`` and ``component`` (the least id reachable by links) of every row of ``docs``."""
    prints, _ = stored(fingerprints(docs, id_col, text_col, words, width), "prints")
    groups = components(prints, radius, width)
    return prints.join(groups, "fp").select("id", "fp", "component")


#: For documents that share four fifths of their five-word shingles (Jaccard), SimHash
#: bits differ with probability acos(2 * 0.8 / 1.8) / pi = 0.1515: 78 of 512 on average.
#: The radius adds most of a standard deviation (8), so that few such pairs are missed.
WIDE = {"words": 5, "width": 8, "radius": 84}
#: Radius of candidates that are verified afterwards: three standard deviations above the mean.
LOOSE = 102
#: Sets of at most so many shingles are compared with all that they may resemble, since
#: their fingerprints are majorities of few hashes; partners are a quarter larger at most.
FEW = 64
PARTNERS = FEW * 5 // 4


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    parts = set(shingles(text, words))
    return np.sort(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), dtype=np.uint64, count=len(parts)))


def alike(common: np.ndarray | int, m: np.ndarray | int, n: np.ndarray | int) -> np.ndarray | bool:
    """Jaccard similarity of 0.8 for sets of ``m`` and ``n`` elements, in whole numbers."""
    return 9 * common >= 4 * (m + n)


def prefix(size: int) -> int:
    """Of two sorted sets that are alike, one of this size and any other share an element among their first so many."""
    return size - -(-4 * size // 5) + 1


def small_set(text: str | None, words: int, most: int) -> np.ndarray | None:
    """The ``shingle_set`` of a text, None if it is empty or has over ``most`` elements, which the beginning of most texts tells."""
    if len(head := (text or "")[: 12 * most]) == 12 * most and len(set(shingles(head, words)[:-1])) > most:  # its last word may be cut
        return None
    some = shingle_set(text, words)
    return some if 0 < len(some) <= most else None


def shared_forest(sets: list[bytes]) -> np.ndarray:
    """Index pairs that span the components of sets that are alike."""
    each = [np.frombuffer(x, dtype=np.uint64) for x in sets]
    size = np.array([len(x) for x in each])
    rest, edges = np.arange(len(each)), []
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            k = front.pop()
            near = rest[alike(np.minimum(size[rest], size[k]), size[rest], size[k])]
            if not len(near):
                continue
            flat = np.concatenate([each[j] for j in near])
            at = np.minimum(np.searchsorted(each[k], flat), size[k] - 1)
            common = np.add.reduceat((each[k][at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(size[near])[:-1]]))
            hit = near[alike(common, size[near], size[k])]
            edges.extend((k, j) for j in hit)
            front.extend(hit)
            rest = np.setdiff1d(rest, hit, assume_unique=True)
    return np.array(edges, dtype=np.int64).reshape(-1, 2)


def short_edges(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """Links (``a``, ``b``) among texts of at most PARTNERS shingles: exact, by common elements of prefixes."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [small_set(x.as_py(), words, PARTNERS) for x in batch.column(1)]
            few = [k for k, some in enumerate(made) if some is not None]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(few, pa.int64())), pa.array([made[k].tobytes() for k in few], pa.binary())], ["node", "fp"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = [np.frombuffer(x.as_py(), dtype=np.int64)[: prefix(len(x.as_py()) // 8)] for x in batch.column(1)]
            rows = pa.array(np.repeat(np.arange(len(first)), [len(x) for x in first]).astype(np.int64))
            flat = np.concatenate([np.empty(0, dtype=np.int64), *first])
            yield pa.RecordBatch.from_arrays([pa.array(flat), batch.column(0).take(rows), batch.column(1).take(rows)], ["key", "node", "fp"])

    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    small, _ = stored(source.mapInArrow(sets, "node long, fp binary"), "short-sets")
    once = small.groupBy("fp").agg(F.min("node").alias("node"))  # equal sets are searched once
    same = small.withColumnRenamed("node", "b").join(once, "fp").where("b <> node").select(F.col("node").alias("a"), "b")
    rows, _ = stored(once.select("node", "fp").mapInArrow(keys, "key long, node long, fp binary"), "short-keys")
    return bucket_pairs(split_hot(rows), shared_forest).union(same).distinct()


def alike_pairs(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``pairs`` (``a``, ``b``) and whether the shingle sets of their texts are ``alike``."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                some = shingle_set(batch.column(1)[at].as_py(), words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), pa.array([some.tobytes()], pa.binary())], ["node", "set"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64)
                found.append(bool(alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.bool_())], ["a", "b", "alike"])

    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")).join(ends, "node", "left_semi")
    made, _ = stored(texts.mapInArrow(sets, "node long, set binary").distinct(), "shingle-sets")
    both = pairs.join(made.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(made.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    tested = both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long, alike boolean")
    # rows that share an id may have several texts
    return stored(tested.groupBy("a", "b").agg(F.max("alike").alias("alike")), "alike-pairs")[0]


def _apart(fps: list[bytes], width: int, radius: int, block: int = 64) -> np.ndarray:
    """All index pairs within ``radius`` whose groups, the word after the fingerprint, differ: members of one group aren't compared."""
    all_ = _matrix(fps, width + 1)
    order = np.argsort(all_[:, width], kind="stable")
    fp, grp, out = np.ascontiguousarray(all_[order, :width]), all_[order, width], [np.empty((0, 2), dtype=np.int64)]
    after = np.searchsorted(grp, grp, "right")  # where the next group begins
    for at in range(0, len(fp), block):
        begin = after[at]
        if begin == len(fp):
            break
        i, j = _within(fp[at : at + block], fp[begin:], radius)
        i, j = i + at, j + begin
        fits = j >= after[i]
        out.append(np.sort(order[np.stack([i[fits], j[fits]], axis=1)], axis=1))
    return np.concatenate(out)


def verified_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, width: int = 8, radius: int = LOOSE) -> DataFrame:
    """``id`` and ``component`` of every row: groups linked by a Jaccard similarity of 0.8 of shingle sets.

    Fingerprints within ``radius`` are candidates only. What spans a bucket's
    candidates is verified first; where a link fails, all pairs of candidates that
    are still in different groups are tested too, so no link between groups is lost.
    Texts of the same words are linked with the least id among them and searched once.
    """
    prints, _ = stored(fingerprints(docs, id_col, text_col, words, width, digest=True), "prints")
    every, _ = stored(prints.where("id is not null").distinct().withColumnRenamed("id", "node"), "nodes")
    once, _ = stored(every.groupBy("same").agg(F.first("fp").alias("fp"), F.min("node").alias("first"), F.count(F.lit(1)).alias("n")), "distinct-nodes")
    copies = every.join(once.where("n > 1").select("same", "first"), "same").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    nodes = once.select(F.col("first").alias("node"), "fp")
    # fingerprints are named by their least id; others with the same are candidates of it
    named, _ = stored(nodes.groupBy("fp").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")), "fingerprints")
    equal = nodes.join(named.where("n > 1"), "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    masks = band_masks(named.count(), radius, width)
    rows = bucketed(named.select(F.col("least").alias("node"), "fp"), masks)
    spanning, _ = stored(bucket_edges(split_hot(rows), width, radius).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").union(equal).distinct(), "near-pairs")
    tested = alike_pairs(spanning, docs, id_col, text_col, words)
    links = tested.where("alike").select("a", "b").union(short_edges(docs, id_col, text_col, words)).union(copies)
    links, _ = stored(links.distinct(), "alike-links")

    near = connected(spanning, "near-links")
    doubtful = near.join(tested.where("not alike").select(F.col("a").alias("node")).join(near, "node").select("root").distinct(), "root", "left_semi").select("node").distinct()
    groups = connected(links, "alike-groups")
    left = nodes.join(doubtful, "node", "left_semi").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    grouped = left.select("node", F.concat("fp", F.unhex(F.lpad(F.hex("root"), 16, "0"))).alias("fp"))
    grouped, _ = stored(grouped.distinct(), "doubtful")
    if grouped.count():
        wider = np.hstack([masks, np.zeros((len(masks), 1), dtype=np.uint64)])
        rest = bucket_pairs(split_hot(bucketed(grouped, wider)), lambda fps: _apart(fps, width, radius))
        rest, _ = stored(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "pairs-apart")
        links = links.union(alike_pairs(rest, docs, id_col, text_col, words).where("alike").select("a", "b"))
    found = connected(links, "alike-groups")
    return prints.join(found, prints.id == found.node, "left").select("id", F.coalesce("root", "id").alias("component"))


#: Rows of one number that are broadcast at most.
SMALL = 1_000_000


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """``docs`` with one row of each verified group of near-duplicates, that of the least id.

    Rows with a null id stay. Of rows that share an id one stays, that with the
    least text (the first for nulls), only if there are any is it looked for.
    """
    found, _ = stored(verified_groups(docs, id_col, text_col, **how), "near-duplicates")
    gone, _ = stored(found.where("id <> component").select("id").distinct(), "near-duplicates-gone")
    gone = gone.withColumnRenamed("id", "gone id")
    n = gone.count()
    kept = docs.join(F.broadcast(gone) if n <= SMALL else gone, F.col(id_col).cast("long") == F.col("gone id"), "left_anti")
    shared, _ = stored(found.where("id is not null").groupBy("id").count().where("count > 1").select(F.col("id").alias("shared id")), "shared-ids")
    m = shared.count()
    if not m:
        return kept
    side, here = F.broadcast(shared) if m <= SMALL else shared, F.col(id_col).cast("long") == F.col("shared id")
    place = unused("place", docs)
    once = kept.join(side, here, "left_semi").withColumn(place, F.row_number().over(Window.partitionBy(id_col).orderBy(text_col)))
    return kept.join(side, here, "left_anti").unionByName(once.where(F.col(place) == 1).drop(place))
