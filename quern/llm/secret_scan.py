"""Secret scans with structural confirmation.

Base spans are three patterns (``assign``, ``access``, ``hex``). On top of them, candidates that look like encoded keys or
tokens are decoded and parsed, and only those whose structure holds are reported:

- ``pem``: a BEGIN line and the next END line of its label, whose body decodes to a DER key or to the OpenSSH private key
  container; or whose header names a cipher and its start value, and whose body decodes to whole cipher blocks;
- ``der``: base64 or hex that decodes to a DER private key: PKCS#1, PKCS#8, encrypted PKCS#8 or SEC1, where every nested
  length ends exactly where its parent ends;
- ``ssh``: base64 of the OpenSSH private key container, whose length-prefixed fields fit;
- ``jwt``: three base64url segments whose first decodes to a JSON object with ``alg`` and whose second is a JSON object.

Offsets are code points, ends exclusive. Spans are ordered by start, then kind in the order of ``KINDS``.

Defined results: null and empty texts have no spans; texts of any length are scanned whole; repeated rows are scanned each;
other columns are ignored (``redact`` keeps them); null ids pass through.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let_go, parts, placed, table

KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "jwt")
BASE = KINDS[:3]
ASSIGN = re.compile(
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
WORDS = ("passw", "secret", "token", "apikey", "api_key")  # one of them is in every text that ASSIGN matches, lower-cased
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
BLOB = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/]{40,}|[A-Za-z0-9_-]{40,})={0,2}(?![A-Za-z0-9+/_-])")
JWT = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
PEM = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*PRIVATE KEY)-----")
CIPHER = re.compile(r"DEK-Info:[ \t]*[A-Z0-9-]+,[ \t]*((?:[0-9A-Fa-f]{16}){1,2})[ \t]*", re.I)
# The shortest run of candidate characters that can hold more than assign and access spans: a signed token's, whose header is
# {"alg":""} (14 characters of base64), whose claims are {} (3), and two dots.
RUN = 19
_OTHER = bytes(range(256)).translate(
    bytes(c if chr(c) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-" else 32 for c in range(256))
)


def der_nodes(data: bytes, start: int, end: int, depth: int = 0) -> list[tuple[int, int, int]] | None:
    """(tag, first, last) of the DER values that fill data[start:end] exactly, their insides checked; None if they don't."""
    out = []
    while start < end:
        if end - start < 2 or depth > 8:
            return None
        tag, size, at = data[start], data[start + 1], start + 2
        if size & 128:
            n = size & 127
            if not 0 < n <= 4 or at + n > end:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + size > end:
            return None
        if tag & 0x20 and der_nodes(data, at, at + size, depth + 1) is None:
            return None
        out.append((tag, at, at + size))
        start = at + size
    return out


def is_der_key(data: bytes) -> bool:
    """Whether the bytes are one DER private key."""
    if len(data) < 16 or data[0] != 0x30:
        return False
    top = der_nodes(data, 0, len(data))
    if not top or len(top) != 1:
        return False
    parts = der_nodes(data, top[0][1], top[0][2]) or []
    tags = [p[0] for p in parts]
    if tags[:1] == [0x02]:
        version = data[parts[0][1] : parts[0][2]]
        if tags == [0x02] * 9 and version in (b"\x00", b"\x01"):
            return True  # PKCS#1
        if tags[1:3] == [0x30, 0x04] and version in (b"\x00", b"\x01"):
            inner = der_nodes(data, parts[1][1], parts[1][2]) or []
            return bool(inner) and inner[0][0] == 0x06  # PKCS#8
        return tags[1:2] == [0x04] and version == b"\x01"  # SEC1
    if tags == [0x30, 0x04]:
        inner = der_nodes(data, parts[0][1], parts[0][2]) or []
        return bool(inner) and inner[0][0] == 0x06  # encrypted PKCS#8
    return False


def is_ssh_key(data: bytes) -> bool:
    """Whether the bytes are an OpenSSH private key container with fields that fit."""
    mark = b"openssh-key-v1\x00"
    if not data.startswith(mark):
        return False
    at = len(mark)
    for _ in range(3):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    if at + 4 > len(data):
        return False
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    for _ in range(min(keys, 64) + 1):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at == len(data)


def unbase64(text: str) -> bytes | None:
    """The bytes of base64 in either alphabet, with or without padding."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _json_object(segment: str) -> dict | None:
    data = unbase64(segment)
    if not data or data.lstrip()[:1] != b"{":
        return None
    try:
        value = json.loads(data)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_pem_body(body: str) -> bool:
    """Whether what stands between BEGIN and END is a private key, plain or under a header that says how it is encrypted."""
    lines = body.splitlines()
    while lines and not lines[0].strip():
        del lines[0]
    header = []
    if lines and ":" in lines[0]:
        end = next((i for i, x in enumerate(lines) if not x.strip()), len(lines))
        header, lines = lines[:end], lines[end:]
    data = unbase64("".join("".join(lines).split()))
    if not data:
        return False
    if is_der_key(data) or is_ssh_key(data):
        return True
    cipher = next((m for x in header if (m := CIPHER.fullmatch(x))), None)
    return cipher is not None and any("ENCRYPTED" in x for x in header) and len(data) % (len(cipher[1]) // 2) == 0


def pem_blocks(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of confirmed blocks. An END goes with the last BEGIN of its label since the END before: each is read once."""
    begins: dict[str, tuple[int, int]] = {}
    for m in PEM.finditer(text):
        if m[1] == "BEGIN":
            begins[m[2]] = m.span()
        elif m[2] in begins:
            start, body = begins[m[2]]
            begins = {}
            if is_pem_body(text[body : m.start()]):
                yield start, m.end()


def added_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what decoding confirms."""
    out = []
    if "-----BEGIN " in text:
        out += [(a, b, "pem") for a, b in pem_blocks(text)]
    for m in BLOB.finditer(text):
        data = unbase64(m[0])
        if data and is_der_key(data):
            out.append((m.start(), m.end(), "der"))
        elif data and is_ssh_key(data):
            out.append((m.start(), m.end(), "ssh"))
    for m in HEX_KEY.finditer(text):
        if is_der_key(bytes.fromhex(m[0])):
            out.append((m.start(), m.end(), "der"))
    for m in JWT.finditer(text):
        head = _json_object(m[1])
        if head and isinstance(head.get("alg"), str) and _json_object(m[2]) is not None:
            out.append((m.start(), m.end(), "jwt"))
    return out


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """All spans of a text, ordered."""
    if not text:
        return []
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    runs = text.encode("ascii", "replace").translate(_OTHER).split()
    if max(map(len, runs), default=0) >= RUN:
        found += [(m.start(), m.end(), "hex") for m in LONG_HEX.finditer(text)]
        found += added_spans(text)
    elif "-----BEGIN " in text:
        found += added_spans(text)
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def show(spans: Iterable[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redact_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by its kind; spans that overlap go under the first one's kind."""
    out, at, merged = [], 0, []
    for a, b, kind in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, kind])
    for a, b, kind in merged:
        out += [text[at:a], f"[SECRET {kind}]"]
        at = b
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, spans array<struct<start,end,kind>>."""
    kind = docs.schema[id_col].dataType.simpleString()
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in parts(batches):
            found = [[{"start": a, "end": b, "kind": k} for a, b, k in scan(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, spans_type)], names=["id", "spans"])

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, f"id {kind}, spans array<struct<start:bigint,end:bigint,kind:string>>")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns, secrets in ``text_col`` replaced by their kind."""
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in parts(batches):
            texts = [t and ((s := scan(t)) and redact_text(t, s) or t) for t in batch.column(at).to_pylist()]
            columns = [pa.array(texts, batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    rows = placed(docs)
    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the spans of every text."""
    shown = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    join = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    return shown.select(
        F.col("id").alias("doc_id"),
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(join(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        join(F.col("spans")).alias("spans"),
    )
