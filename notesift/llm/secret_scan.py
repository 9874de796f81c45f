"""Secrets in texts, confirmed by their structure.

Three base patterns (assignments, access keys, hex runs) are reported as they
match. Candidates for key material are decoded (base64, its URL form, or hex) and
reported only if what comes out parses: a signed token needs a JSON header that
names its algorithm, a key needs DER whose nested lengths fill each other
exactly, or length-prefixed SSH fields. Base spans that parse are also listed as
confirmed.

Defined results: a null or empty text has no spans; a null id is kept; repeated
rows are scanned each by itself; texts are scanned whole, in time that follows their length;
an empty table gives no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Order of kinds that start at the same place.
KINDS = ("assign", "access", "hex", "signed_token", "private_key", "der", "ssh")

KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(rb"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
# runs are greedy, so a least length in the pattern drops the same matches as a test afterwards
ACCESS = re.compile(rb"AKIA[A-Z0-9]{14,}")
HEX = re.compile(rb"[0-9a-f]{16,}")
DOTTED = re.compile(rb"[A-Za-z0-9_.-]+")
BEGIN = re.compile(rb"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----")
END = re.compile(rb"-----END ([A-Z0-9 ]*PRIVATE KEY)-----")
RUN = re.compile(rb"[A-Za-z0-9+/_-]{40,}={0,2}")
#: Runs that go on in the next lines, which may be written as escapes; tried from the beginning of a run only.
BREAK = re.compile(rb"[ \t]*(?:\\r)?(?:\r?\n|\\n)[ \t]*")
WRAPPED = re.compile(rb"(?:(?<=\\n)|(?<![A-Za-z0-9+/_\\-]))[A-Za-z0-9+/_-]{40,}+(?:[ \t]*(?:\\r)?(?:\r?\n|\\n)[ \t]*[A-Za-z0-9+/_-]{4,}+)++={0,2}")
SSH_MAGIC = b"openssh-key-v1\0"
ANY_HEX = re.compile(rb"[0-9A-Fa-f]+\Z")


def unbase64(data: bytes) -> bytes | None:
    data = data.translate(bytes.maketrans(b"-_", b"+/")).rstrip(b"=")
    if len(data) % 4 == 1:
        return None
    try:
        return base64.b64decode(data + b"=" * (-len(data) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_fills(data: bytes, at: int, end: int, depth: int = 0) -> int | None:
    """Elements in ``data[at:end]`` if their lengths fill it exactly, constructed ones in turn; else None."""
    n = 0
    while at < end:
        if end - at < 2 or depth > 32:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size >= 0x80:
            k = size & 0x7F
            if not 1 <= k <= 4 or end - at < k:
                return None
            size, at = int.from_bytes(data[at : at + k], "big"), at + k
        if size > end - at:
            return None
        if tag & 0x20 and der_fills(data, at, at + size, depth + 1) is None:
            return None
        at, n = at + size, n + 1
    return n


def is_der_key(data: bytes) -> bool:
    """A SEQUENCE that fills the data and holds two elements or more, with an integer or an object identifier first or in its first element."""
    if len(data) < 24 or data[0] != 0x30 or der_fills(data, 0, len(data)) != 1:
        return False
    body = 2 + (data[1] & 0x7F if data[1] >= 0x80 else 0)
    if (der_fills(data, body, len(data), 1) or 0) < 2:
        return False
    first = data[body]
    inner = body + 2 + (data[body + 1] & 0x7F if data[body + 1] >= 0x80 else 0)
    return first in (0x02, 0x06) or first == 0x30 and data[inner : inner + 1] in (b"\x06", b"\x02")


def is_ssh_key(data: bytes) -> bool:
    """Length-prefixed fields that fill the data, the first an algorithm's name; or the private container of such keys."""
    if data.startswith(SSH_MAGIC):
        return is_ssh_container(data)
    fields, at = ssh_fields(data, 0, None)
    return at == len(data) and len(fields) > 1 and re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+", fields[0]) is not None


def ssh_fields(data: bytes, at: int, most: int | None) -> tuple[list[bytes], int]:
    """Fields from ``at`` on, ``most`` of them if given, and where they end (-1 if one doesn't fit)."""
    fields: list[bytes] = []
    while at + 4 <= len(data) and (most is None or len(fields) < most):
        size = int.from_bytes(data[at : at + 4], "big")
        if size > len(data) - at - 4:
            return fields, -1
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return fields, at


def is_ssh_container(data: bytes) -> bool:
    """Names of cipher and key derivation, its options, a number of keys, so many public keys, and a private part that fills the rest."""
    names, at = ssh_fields(data, len(SSH_MAGIC), 3)
    if len(names) < 3 or at < 0 or not all(re.fullmatch(rb"[a-z0-9@.-]+", x) for x in names[:2]):
        return False
    n = int.from_bytes(data[at : at + 4], "big")
    keys, at = ssh_fields(data, at + 4, n + 1) if 0 < n < 64 else ([], -1)
    return at == len(data) and len(keys) == n + 1 and len(keys[n]) >= 8 and all(is_ssh_key(k) for k in keys[:n])


def is_signed_token(data: bytes) -> bool:
    parts = data.split(b".")
    try:
        header, claims = (json.loads(unbase64(x) or b"") for x in parts[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(claims, dict)


def key_kind(data: bytes) -> str | None:
    """What a run of base64 or hex characters decodes to."""
    for raw in (unbase64(data), bytes.fromhex(data.decode()) if len(data) % 2 == 0 and ANY_HEX.match(data) else None):
        if raw and is_der_key(raw):
            return "der"
        if raw and is_ssh_key(raw):
            return "ssh"
    return None


def signed_tokens(data: bytes) -> Iterator[tuple[int, int]]:
    """Places of three parts between dots of which the first two parse; each run is split once."""
    for run in DOTTED.finditer(data):
        if b"eyJ" not in run[0]:
            continue
        parts, at, k = run[0].split(b"."), [run.start()], 0
        for part in parts:
            at.append(at[-1] + len(part) + 1)
        while k + 2 < len(parts):
            head = parts[k].find(b"eyJ")
            if head >= 0 and parts[k + 1] and is_signed_token(parts[k][head:] + b"." + parts[k + 1]):
                yield at[k] + head, at[k + 3] - 1
                k += 3
            else:
                k += 1


def armoured(data: bytes) -> Iterator[tuple[int, int]]:
    """Places of armoured private keys whose body parses: from a BEGIN to the next END of its kind, if no other BEGIN stands between."""
    ends, begins = defaultdict(list), defaultdict(list)
    for m in END.finditer(data):
        ends[m[1]].append(m.span())
    for m in BEGIN.finditer(data):
        begins[m[1]].append(m.span())
    for kind, some in begins.items():
        for k, (start, body) in enumerate(some):
            after = bisect_left(ends[kind], (body, 0))
            if after == len(ends[kind]) or (k + 1 < len(some) and some[k + 1][0] < ends[kind][after][0]):
                continue
            lines = data[body : ends[kind][after][0]].replace(b"\\r", b"").replace(b"\\n", b"\n").split()
            raw = unbase64(b"".join(x for x in lines if b":" not in x))
            if raw and (is_der_key(raw) or is_ssh_key(raw)):
                yield start, ends[kind][after][1]


def key_runs(data: bytes) -> Iterator[tuple[str, int, int]]:
    """Kinds and places of runs that decode to keys: over several lines (but for the last, which may be other text), else each by itself."""
    for start, end in [m.span() for m in WRAPPED.finditer(data)]:
        cuts = [m.span() for m in BREAK.finditer(data, start, end)]
        for stop in dict.fromkeys((end, cuts[-1][0])):
            if kind := key_kind(BREAK.sub(b"", data[start:stop])):
                yield kind, start, stop
                break
    for m in RUN.finditer(data):
        if kind := key_kind(m[0]):
            yield kind, *m.span()


def scan(text: str | None) -> list[tuple[str, int, int, bool]]:
    """Spans ``(kind, start, end, confirmed)`` in code points, by start and then by kind."""
    data = (text or "").encode("utf-8", "surrogatepass")
    low, found = data.lower(), []

    starts = set()
    for word in KEYWORDS:
        at = low.find(word)
        while at >= 0:
            starts.add(at)
            at = low.find(word, at + 1)
    done = 0
    for at in sorted(starts):
        if at >= done and (m := ASSIGN.match(data, at)):
            done = m.end()
            if len(m[2]) >= 12:
                found.append(("assign", *m.span(), is_signed_token(m[2]) or key_kind(m[2]) is not None))
    if b"AKIA" in data:
        found += [("access", *m.span(), False) for m in ACCESS.finditer(data)]
    found += [("hex", *m.span(), key_kind(m[0]) is not None) for m in HEX.finditer(data)]

    if b"eyJ" in data:
        found += [("signed_token", a, b, True) for a, b in signed_tokens(data)]
    blocks = sorted(armoured(data)) if b"PRIVATE KEY-----" in data else []
    found += [("private_key", a, b, True) for a, b in blocks]
    if max(map(len, data.split()), default=0) >= 40:
        for kind, a, b in dict.fromkeys(key_runs(data)):
            k = bisect_right(blocks, (a, len(data))) - 1
            if k < 0 or a >= blocks[k][1]:
                found.append((kind, a, b, True))

    if len(data) != len(text or ""):  # code points, counted from one place to the next
        places, at, n, by = sorted({x for f in found for x in f[1:3]}), 0, 0, {}
        for x in places:
            n += len(data[at:x].decode("utf-8", "surrogatepass"))
            at, by[x] = x, n
        found = [(k, by[a], by[b], c) for k, a, b, c in found]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in spans)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``spans`` (array of kind, start, end, confirmed) of every row."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("confirmed", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [[dict(zip(("kind", "start", "end", "confirmed"), s, strict=True)) for s in scan(x.as_py())] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(got, kind)], ["id", "spans"])

    schema = "id long, spans array<struct<kind:string,start:long,end:long,confirmed:boolean>>"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def digests(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans, as columns."""
    text = lambda keep: F.array_join(F.transform(F.filter("spans", keep), lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    base = lambda s: s.kind.isin(*KINDS[:3])
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long")
    return found.select(
        "id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(text(base), 256).alias("base_sha256"),
        text(lambda s: F.lit(True)).alias("spans"),
        text(lambda s: s.confirmed).alias("confirmed"),
    )


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
