"""Log-probabilities of texts under a backoff automaton of smoothed bigrams.

A word that has successors in the training texts is a state. Its arcs carry the
interpolated probability of each successor seen after it; its failure arc leads
to the root with the weight of what was discounted; the root's arcs are the
add-one unigrams. One traversal from left to right carries the state and adds up
the weights. Discounts follow from the counts of counts (as in modified
Kneser-Ney), apart for each power of two of the state's count, so that states
whose successors never recur leave their mass to the unigrams.

The corpus is counted in two steps that no single task or driver has to hold:
documents are dealt into batches by ids and texts; a batch sends each shard (a range
of word hashes) its distinct words and successors with their counts, once; the
shard adds them up and sends back the totals for what the batch had asked, in
the same order. A batch then has the part of the automaton that its own texts
can reach. Successors of a word are told apart by 48 bits of their hash.

Defined results: a null or empty text is its end token alone; a null id is not
held out; repeated rows count and are scored each by itself; an empty table gives
no rows; texts are read whole. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notesift.llm.common import stored

#: Characters of text in a batch, about; its words and successors are held at once.
BATCH = 12_000_000
END = b"\n"  # no word has white space
SUCCESSOR = np.uint64((1 << 48) - 1)
BUCKETS = 40


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words, then the end."""
    out = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out.append(END)
    return out


def is_held_out(key: int | None, fold: int, rest: int) -> bool:
    return key is not None and zlib.crc32(str(key).encode()) % fold == rest


@dataclass
class Batch:
    """The distinct words and successors of some texts, in the order of their hashes."""

    hashes: np.ndarray  # of words, sorted
    counts: np.ndarray  # of words, in training texts
    first: np.ndarray  # index of the word that is followed, sorted
    second: np.ndarray  # index of the word that follows
    pairs: np.ndarray  # counts in training texts
    texts: list[np.ndarray]  # indexes of words

    @classmethod
    def of(cls, texts: list[str | None], training: list[bool]) -> Batch:
        known: dict[bytes, int] = {}
        rows = []
        for text in texts:
            tokens = words(text)
            rows.append(np.fromiter((known.setdefault(w, len(known)) for w in tokens), dtype=np.int64, count=len(tokens)))
        raw = np.fromiter(map(xxhash.xxh64_intdigest, known), dtype=np.uint64, count=len(known))
        hashes, place = np.unique(raw, return_inverse=True)
        rows, n = [place[r] for r in rows], len(hashes)
        counts = np.zeros(n, dtype=np.int64)
        keys, seen = [], []
        for r, learn in zip(rows, training, strict=True):
            if learn:
                np.add.at(counts, r, 1)
            keys.append(r[:-1] * n + r[1:])
            seen.append(np.full(len(r) - 1, learn))
        every = np.concatenate(keys) if keys else np.empty(0, dtype=np.int64)
        learned = np.concatenate(seen) if seen else np.empty(0, dtype=bool)
        pairs, where = np.unique(every, return_inverse=True)
        return cls(hashes, counts, pairs // max(n, 1), pairs % max(n, 1), np.bincount(where[learned], minlength=len(pairs)), rows)

    def edges(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each shard's range begins, among the words and among the pairs."""
        bound = (np.arange(shards, dtype=np.float64) / shards * 2.0**64).astype(np.uint64)
        at = np.append(np.searchsorted(self.hashes, bound), len(self.hashes))
        return at, np.searchsorted(self.first, at)

    def requests(self, shards: int) -> Iterator[tuple[int, bytes]]:
        at, by = self.edges(shards)
        for s in range(shards):
            a, b, c, d = at[s], at[s + 1], by[s], by[s + 1]
            if a == b:
                continue
            after = np.bincount(self.first[c:d] - a, minlength=b - a).astype("<u4")
            low = (self.hashes[self.second[c:d]] & SUCCESSOR).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            yield s, b"".join([np.array([b - a, d - c], "<u8").tobytes(), self.hashes[a:b].astype("<u8").tobytes(), self.counts[a:b].astype("<u4").tobytes(), after.tobytes(), np.ascontiguousarray(low).tobytes(), self.pairs[c:d].astype("<u4").tobytes()])


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (a >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + b * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _parsed(payload: bytes) -> tuple[np.ndarray, ...]:
    n, m = np.frombuffer(payload, "<u8", 2).astype(int)
    at, out = 16, []
    for kind, k in (("<u8", n), ("<u4", n), ("<u4", n)):
        out.append(np.frombuffer(payload, kind, k, at))
        at += out[-1].nbytes
    low = np.zeros((m, 8), dtype=np.uint8)
    low[:, :6] = np.frombuffer(payload, np.uint8, 6 * m, at).reshape(m, 6)
    out.append(low.view("<u8").ravel())
    out.append(np.frombuffer(payload, "<u4", m, at + 6 * m))
    return tuple(out)


#: Counts from here on are sent apart from the others, in 64 bits.
FULL = 2**32 - 1


def packed(values: np.ndarray) -> bytes:
    """Counts in 32 bits each; the places and values of those that don't fit follow."""
    big = np.flatnonzero(values >= FULL)
    return b"".join([np.minimum(values, FULL).astype("<u4").tobytes(), np.array([len(big), *big, *values[big]], "<u8").tobytes()])


def unpacked(payload: bytes, n: int, at: int) -> tuple[np.ndarray, int]:
    """``n`` counts that ``packed`` has written at ``at``, and where they end."""
    values = np.frombuffer(payload, "<u4", n, at).astype(np.int64)
    at += 4 * n
    k = int(np.frombuffer(payload, "<u8", 1, at)[0])
    big = np.frombuffer(payload, "<u8", 2 * k, at + 8).astype(np.int64)
    values[big[:k]] = big[k:]
    return values, at + 8 + 16 * k


def solved(payloads: list[bytes]) -> tuple[list[bytes], tuple[int, int], np.ndarray]:
    """Totals for each request in turn; then training tokens and types, and counts of counts by bucket."""
    parts = [_parsed(p) for p in payloads]
    words_, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    counts = np.bincount(place, np.concatenate([p[1] for p in parts]), len(words_)).astype(np.int64)
    owner = np.repeat(place, np.concatenate([p[2] for p in parts]))
    keys, where = np.unique(_mixed(words_[owner], np.concatenate([p[3] for p in parts])), return_inverse=True)
    pairs = np.bincount(where, np.concatenate([p[4] for p in parts]), len(keys)).astype(np.int64)
    of = np.zeros(len(keys), dtype=np.int64)
    of[where] = owner
    total = np.bincount(of, pairs, len(words_)).astype(np.int64)
    kinds = [np.bincount(of[(pairs == c) if c < 3 else (pairs >= 3)], minlength=len(words_)) for c in (1, 2, 3)]
    bucket = np.frexp(np.maximum(total, 1))[1] - 1
    tally = np.stack([np.bincount(bucket[of[pairs == c]], minlength=BUCKETS) for c in (1, 2, 3, 4)])
    replies, a, b = [], 0, 0
    for p in parts:
        w, q = place[a : a + len(p[0])], where[b : b + len(p[3])]
        a, b = a + len(p[0]), b + len(p[3])
        replies.append(b"".join([counts[w].astype("<u8").tobytes(), total[w].astype("<u8").tobytes(), *(packed(k[w]) for k in kinds), packed(pairs[q])]))
    return replies, (int(counts.sum()), int((counts > 0).sum())), tally


def discounts(tally: np.ndarray) -> np.ndarray:
    """Discounts of counts 1, 2 and 3 or more for every bucket, between 0 and the count."""
    n = tally.astype(float)
    y = n[0] / np.maximum(n[0] + 2 * n[1], 1)
    out = np.stack([c - (c + 1) * y * n[c] / np.maximum(n[c - 1], 1) for c in (1, 2, 3)])
    out = np.where(n[:3] > 0, out, np.array([[1.0], [1.5], [1.5]]))
    return np.clip(out, 0.05, np.array([[1.0], [1.95], [2.95]]))


@dataclass
class Automaton:
    """What a batch can reach: arcs in the order of their state and word, failure weights, and the root's arcs (all log10)."""

    keys: np.ndarray  # state times number of words, plus the word
    arcs: np.ndarray
    fail: list[float | None]
    root: list[float]

    @classmethod
    def of(cls, batch: Batch, replies: list[bytes], tokens: int, types: int, cut: np.ndarray, shards: int) -> tuple[Automaton, np.ndarray]:
        at, by = batch.edges(shards)
        n, m = len(batch.hashes), len(batch.pairs)
        counts, total, kinds, pairs = np.zeros(n), np.zeros(n), np.zeros((3, n)), np.zeros(m)
        used = [s for s in range(shards) if at[s] < at[s + 1]]
        for s, payload in zip(used, replies, strict=True):
            a, b, c, d = at[s], at[s + 1], by[s], by[s + 1]
            k = b - a
            counts[a:b] = np.frombuffer(payload, "<u8", k)
            total[a:b] = np.frombuffer(payload, "<u8", k, 8 * k)
            end = 16 * k
            for j in range(3):
                kinds[j, a:b], end = unpacked(payload, k, end)
            pairs[c:d], _ = unpacked(payload, d - c, end)
        unigram = (counts + 1) / (tokens + types + 1)
        own = cut[:, np.frexp(np.maximum(total, 1))[1] - 1]
        left = np.divide((own * kinds).sum(axis=0), total, out=np.ones(n), where=total > 0)
        seen = np.flatnonzero(pairs)
        first, second, c = batch.first[seen], batch.second[seen], pairs[seen]
        p = (c - own[np.minimum(c, 3).astype(int) - 1, first]) / total[first] + left[first] * unigram[second]
        fail = [x if s else None for x, s in zip(np.log10(np.maximum(left, 1e-300)).tolist(), (total > 0).tolist(), strict=True)]
        return cls(first * n + second, np.log10(p), fail, np.log10(unigram).tolist()), counts

    def arcs_along(self, text: np.ndarray) -> list[float | None]:
        """The arc from each word of ``text`` to the next, if there is one."""
        steps = text[:-1] * len(self.root) + text[1:]
        if not len(self.keys):
            return [None] * len(steps)
        at = np.minimum(np.searchsorted(self.keys, steps), len(self.keys) - 1)
        return [arc if hit else None for arc, hit in zip(self.arcs[at].tolist(), (self.keys[at] == steps).tolist(), strict=True)]

    def score(self, text: np.ndarray) -> float:
        """One traversal from the root."""
        fail, root, state = self.fail, self.root, -1
        out = 0.0
        for w, arc in zip(text.tolist(), [None, *self.arcs_along(text)], strict=True):
            if state < 0 or arc is None:
                if state >= 0:
                    out += fail[state]
                arc = root[w]
            out += arc
            state = w if fail[w] is not None else -1
        return out


def scored(docs: DataFrame, fold: int = 7, rest: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every row.

    Rows whose crc32 of the id as text is ``rest`` modulo ``fold`` are not learned from.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    chars = source.agg(F.sum(F.length("text") + 8)).first()[0] or 0
    batches = int(chars // BATCH) + 1
    shards = batches
    # by the text too, so that rows without an id are spread out
    dealt = source.withColumn("batch", F.pmod(F.xxhash64("id", "text"), F.lit(batches)).cast("int"))

    def learn(ids: list[int | None]) -> list[bool]:
        return [not is_held_out(k, fold, rest) for k in ids]

    def ask(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids = [None if pd.isna(k) else int(k) for k in rows["id"].tolist()]
        found = Batch.of(rows["text"].tolist(), learn(ids))
        return pd.DataFrame([(s, int(key[0]), p) for s, p in found.requests(shards)], columns=["shard", "batch", "payload"])

    def answer(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("batch")
        with np.errstate(over="ignore"):
            replies, (tokens, types), tally = solved(rows["payload"].tolist())
        out = pd.DataFrame({"shard": int(key[0]), "batch": rows["batch"].to_numpy(), "reply": replies, "tokens": 0, "types": 0, "tally": None})
        first = out.index[0]
        out.at[first, "tokens"], out.at[first, "types"], out.at[first, "tally"] = tokens, types, tally.ravel().tolist()
        return out

    asked = dealt.groupBy("batch").applyInPandas(ask, "shard int, batch int, payload binary")
    answered, _ = stored(asked.groupBy("shard").applyInPandas(answer, "shard int, batch int, reply binary, tokens long, types long, tally array<long>"), "lm-replies")
    tokens, types = answered.agg(F.sum("tokens"), F.sum("types")).first()
    each = answered.where("tally is not null").select(F.posexplode("tally").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"))
    tally = np.zeros(4 * BUCKETS, dtype=np.int64)
    for r in each.collect():  # 4 * BUCKETS numbers
        tally[r.at] = r.n
    tokens, types, cut = tokens or 0, types or 0, discounts(tally.reshape(4, BUCKETS))

    def traverse(rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        ids = [None if pd.isna(k) else int(k) for k in rows["id"].tolist()]
        if not ids:
            return pd.DataFrame({c: [] for c in names})
        training = learn(ids)
        batch = Batch.of(rows["text"].tolist(), training)
        automaton, counts = Automaton.of(batch, replies.sort_values("shard")["reply"].tolist(), tokens, types, cut, shards)
        known, base = counts > 0, np.array(automaton.root)
        out = [
            (k, not t, len(r), int(known[r].sum()), tokens, float(base[r].sum()), automaton.score(r))
            for k, t, r in zip(ids, training, batch.texts, strict=True)
        ]
        return pd.DataFrame(out, columns=names).astype({"id": "Int64"})

    names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("batch").cogroup(answered.select("batch", "shard", "reply").groupBy("batch")).applyInPandas(traverse, schema)
