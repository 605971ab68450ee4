"""Secret scan with structural confirmation.

Patterns alone find assignments, access ids and long hex runs; these are reported as they stand.
Beyond them, base64 and hex candidates are decoded and reported only if the bytes have the inner
structure of a key: DER whose nested lengths add up, an SSH key's length-prefixed fields, or a
signed token whose header is JSON that names an algorithm.

Defined results: a null text is empty; every input row gives one row; offsets count code points,
ends are exclusive; other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import named, small_batches, tidy

# The contract's base patterns and their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs of [0-9a-f]+ that are long enough
KINDS = ["assign", "access", "hex", "jwt", "pem", "der", "ssh"]
BASE = KINDS[:3]
SSH_MAGIC = b"openssh-key-v1\0"
NAMES = ("password", "passwd", "secret", "token", "api")

TOKEN = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*)?")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
B64_DER = re.compile(r"(?<![A-Za-z0-9+/])M[A-Za-z0-9+/]{38,}={0,2}")
B64_SSH = re.compile(r"(?<![A-Za-z0-9+/])(?:AAAA|b3BlbnNz)[A-Za-z0-9+/]{36,}={0,2}")
HEX_DER = re.compile(r"(?<![0-9A-Fa-f])30(?:[0-9A-Fa-f]{2}){20,}(?![0-9A-Fa-f])")


def decode64(s: str, url: bool = False) -> bytes | None:
    s = re.sub(r"[\s=]", "", s)
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the DER values that fill ``data`` to its last byte, or None."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data) or data[at] == 0:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
            if size < 0x80:
                return None
        if at + size > len(data):
            return None
        items.append((tag, data[at : at + size]))
        at += size
    return items


def is_der_key(data: bytes | None) -> bool:
    """One SEQUENCE that holds integers (or a version, an algorithm and a key) and ends where it says."""
    outer = der_items(data) if data else None
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = der_items(outer[0][1])
    if not inner or len(inner) < 2:
        return False
    tags = [t for t, _ in inner]
    numbers = tags[0] == 2 and tags.count(2) >= 2 and len(inner) >= 2
    wrapped = tags[0] == 2 and 4 in tags[1:3] or tags[:3] == [2, 0x30, 4]
    public = tags[:2] == [0x30, 3] and bool(der_items(inner[0][1]))
    return numbers or wrapped or public


class Fields:
    """Reads length-prefixed fields; ``ok`` tells whether all so far were there in full."""

    def __init__(self, data: bytes):
        self.data, self.at, self.ok = data, 0, True

    def take(self, n: int) -> bytes:
        part = self.data[self.at : self.at + n]
        self.ok, self.at = self.ok and len(part) == n, self.at + n
        return part

    def number(self) -> int:
        return int.from_bytes(self.take(4), "big")

    def field(self) -> bytes:
        return self.take(self.number())

    def ended(self) -> bool:
        return self.ok and self.at == len(self.data)


def is_public_ssh(data: bytes) -> bool:
    """Two or more fields from end to end, the first of which names a key type."""
    f = Fields(data)
    names, n = bool(re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+", f.field())), 1
    while names and f.ok and not f.ended():
        f.field()
        n += 1
    return names and f.ended() and n >= 2


def is_ssh_key(data: bytes | None) -> bool:
    """A public key, or the fields of a private key file: cipher, derivation, public keys, private part."""
    if not data:
        return False
    if not data.startswith(SSH_MAGIC):
        return is_public_ssh(data)
    f = Fields(data[len(SSH_MAGIC) :])
    cipher, derivation, _, n = f.field(), f.field(), f.field(), f.number()
    if not (f.ok and cipher and derivation and 1 <= n <= len(data) // 4):
        return False
    return all(is_public_ssh(f.field()) for _ in range(n)) and len(f.field()) >= 8 and f.ended()


def is_signed_token(s: str) -> bool:
    try:
        head = json.loads(decode64(s.split(".")[0], url=True) or b"")
    except (ValueError, RecursionError):  # the latter: a header nested too deep for any token
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def confirmed(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of what decodes to a secret's structure."""
    found = []
    if "eyJ" in text:
        found += [(m.start(), "jwt", m.end()) for m in TOKEN.finditer(text) if is_signed_token(m[0])]
    if "-----BEGIN " in text:
        found += [(m.start(), "pem", m.end()) for m in PEM.finditer(text) if is_der_key(decode64(m[2])) or is_ssh_key(decode64(m[2]))]
    found += [(m.start(), "der", m.end()) for m in B64_DER.finditer(text) if is_der_key(decode64(m[0]))]
    if "AAAA" in text or "b3BlbnNz" in text:
        found += [(m.start(), "ssh", m.end()) for m in B64_SSH.finditer(text) if is_ssh_key(decode64(m[0]))]
    if "30" in text:
        found += [(m.start(), "der", m.end()) for m in HEX_DER.finditer(text) if is_der_key(bytes.fromhex(m[0]))]
    return found


def base(text: str) -> list[tuple[int, str, int]]:
    low, found = text.lower(), []
    if any(n in low for n in NAMES):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return found + [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]


def listed(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{i}:{j}" for i, k, j in sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2])))


def secrets(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1):
                text = t.as_py() or ""
                own, more = base(text), confirmed(text)
                n = [sum(k == kind for _, k, _ in own) for kind in BASE]
                rows.append((*n, hashlib.sha256(listed(own).encode()).hexdigest(), listed(own + more), len(more)))
            columns = list(zip(*rows)) if rows else [()] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])

    small_batches(documents)
    chosen = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(tidy(run), f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_confirmed bigint")


def redacted(documents: DataFrame, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """The same rows and columns, with every span that ``secrets`` would report replaced by ``mask``."""
    at = documents.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, last = [], 0
        for i, _, j in sorted(base(text) + confirmed(text)):
            if j > last:
                out += [text[last : max(i, last)], mask] if i >= last else []
                last = j
        return "".join([*out, text[last:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column(0).flatten()
            columns[at] = pa.array([clean(t.as_py()) for t in columns[at]], pa.string())
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(columns, names)], ["row"])

    small_batches(documents)
    names = documents.columns
    # as one struct, since names with a dot can't be handed to Python as columns
    rows = documents.select(F.struct(*named(names)).alias("row"))
    return rows.mapInArrow(tidy(run), T.StructType([T.StructField("row", documents.schema)])).select("row.*")
