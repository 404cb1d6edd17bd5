"""Secret scans with structural confirmation.

Pattern matches (``assign``, ``access``, ``hex``) are reported as they are. Beyond them, base64 and hex runs are only
candidates: they are decoded, and a span is reported if the bytes parse as a private key (DER with every nested length
exact, or an OpenSSH key container), are the text of such a key in PEM form or, for dotted base64url triples, are a signed
token whose header names its algorithm. A key may be wrapped over lines, whose breaks may be escaped as in JSON.

A null text counts as empty and has no spans. Every row is scanned on its own and whole, so ties, repeated rows and skewed
keys need no care; a table without rows gives none. Columns of the input that bear the name of a result column are replaced.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewise.llm.common import blocks, schema_with, text_of

#: Kinds in the order in which spans with equal starts are listed. Fixed values.
KINDS = ("assign", "access", "hex", "pem", "key", "token", "hexkey")

#: Base patterns; fixed values.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s]++|\\++[nrt/])++)-----END \1-----")
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
#: Where the base64 of a DER sequence, an OpenSSH container or PEM text starts, wherever it stands; parts and gaps of wrapped base64.
START = re.compile(r"(?:M(?:[A-H]|I[E-T])|b3BlbnNzaC1rZXktdjEA|LS0tLS1CRUdJTi)(?=[A-Za-z0-9+/_-]{4})")
PART = re.compile(r"[A-Za-z0-9+/_-]+")
GAP = re.compile(r"(?:\s|\\+(?:[nrt]|(?=/)))+")
PADS = re.compile(r"={0,2}")
SPACE = re.compile(rb"[\s\x1c-\x1f\x85\xa0]*")
ESCAPES = re.compile(r"\\+[nrt]|[\\\s]")
TRIPLE = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_-]{10,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]{20,})(?![A-Za-z0-9_-])")
HEXRUN = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")

INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30
OPENSSH = b"openssh-key-v1\x00"
PEM_KEY = b"PRIVATE KEY-----"
#: A key's sequences have at most ten items; longer ones are no keys.
MOST_ITEMS = 16


def der_items(data: bytes, at: int = 0, end: int | None = None) -> list[tuple[int, int, int]] | None:
    """Tag, start and end of content of the items that fill ``data[at:end]`` exactly, or None; also None beyond ``MOST_ITEMS``."""
    items, end = [], len(data) if end is None else end
    while at < end:
        if at + 2 > end or len(items) == MOST_ITEMS:
            return None
        tag, length = data[at], data[at + 1]
        at += 2
        if length & 0x80:
            width = length & 0x7F
            if not 1 <= width <= 4 or at + width > end:
                return None
            length = int.from_bytes(data[at : at + width], "big")
            at += width
        if at + length > end:
            return None
        items.append((tag, at, at + length))
        at += length
    return items


def is_der_key(data: bytes, at: int = 0, end: int | None = None) -> bool:
    """Whether ``data[at:end]`` is one PKCS#1, PKCS#8 or SEC1 private key."""
    outer = der_items(data, at, end) if data[at : at + 1] == b"\x30" else None
    if not outer or len(outer) != 1:
        return False
    parts = der_items(data, *outer[0][1:])
    if not parts or parts[0][0] != INTEGER or parts[0][2] - parts[0][1] != 1:
        return False
    version, tags = data[parts[0][1]], [t for t, _, _ in parts]
    if version <= 1 and len(parts) >= 9 and all(t == INTEGER for t in tags[:9]):
        return True
    if version == 1 and len(parts) >= 2 and tags[1] == OCTETS and parts[1][2] - parts[1][1] >= 16:
        return True
    if version <= 1 and len(parts) >= 3 and tags[1:3] == [SEQUENCE, OCTETS]:
        algorithm = der_items(data, *parts[1][1:])
        return bool(algorithm) and algorithm[0][0] == OID
    return False


def der_length(head: bytes) -> int:
    """Bytes of the DER sequence that starts with ``head`` if a version number comes first in it, as in a private key, else 0."""
    if head[:1] != b"\x30" or len(head) < 9:
        return 0
    width = head[1] & 0x7F if head[1] & 0x80 else 0
    if width > 4 or head[1] == 0x80:
        return 0
    content = int.from_bytes(head[2 : 2 + width], "big") if width else head[1]
    return 2 + width + content if head[2 + width : 4 + width] == b"\x02\x01" and head[4 + width] <= 1 else 0


def openssh_length(data: bytes, start: int = 0) -> int:
    """Bytes of the OpenSSH container at ``start`` of ``data``, 0 if it isn't whole."""
    at = start + len(OPENSSH)
    for field in range(3):  # cipher, key derivation, its options
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 64:
        return 0
    for field in range(keys + 1):  # public keys, private part
        if at + 4 > len(data):
            return 0
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at - start if at <= len(data) else 0


def is_openssh_key(data: bytes) -> bool:
    """Whether ``data`` is an OpenSSH private key container with exact nested lengths."""
    if not data.startswith(OPENSSH):
        return False
    at, fields = len(OPENSSH), 0
    while fields < 3:  # cipher, key derivation, its options
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        fields += 1
    return at + 8 <= len(data) and 1 <= int.from_bytes(data[at : at + 4], "big") <= 64


def decoded(run: str) -> bytes:
    """Bytes of a base64 or base64url run, perhaps wrapped; empty if it is neither."""
    body = ESCAPES.sub("", run).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def is_key(data: bytes) -> bool:
    return is_der_key(data) or is_openssh_key(data)


def pem_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PEM.finditer(text) if is_key(decoded(m[2]))] if "PRIVATE KEY-----" in text else []


class Run:
    """Base64 characters from ``at`` of a text on, over gaps, as far as they go; each of their four readings is decoded at most once."""

    def __init__(self, text: str, at: int):
        parts, self.starts, self.ends, self.places, n = [], [], [], [], 0
        while m := PART.match(text, at):
            parts.append(m[0])
            self.starts.append(m.start())
            self.places.append(n)
            self.ends.append(m.end())
            n += len(m[0])
            at = gap.end() if (gap := GAP.match(text, m.end())) else m.end()
        self.text, self.end, self.readings = "".join(parts), self.ends[-1], {}

    def place(self, at: int) -> int:
        """Which of the run's characters stands at ``at`` of the text."""
        part = bisect_right(self.starts, at) - 1
        return self.places[part] + at - self.starts[part]

    def end_of(self, place: int) -> int:
        """Where the first ``place`` characters end in the text."""
        part = bisect_left(self.places, place) - 1
        return self.starts[part] + place - self.places[part]

    def reading(self, place: int) -> tuple[bytes, int, tuple[int, int]]:
        """The bytes of the reading to which a character belongs, its place in them, and start and end of the last key in PEM form there."""
        phase = place % 4
        if phase not in self.readings:
            end = len(self.text) - ((len(self.text) - phase) % 4 == 1)
            data = decoded(self.text[phase:end])
            pems = pem_spans(data.decode("latin-1")) if PEM_KEY in data else []
            self.readings[phase] = data, pems[-1] if pems else (-1, -1)
        data, pem = self.readings[phase]
        return data, place // 4 * 3, pem


def key_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of the keys in base64, perhaps wrapped or in PEM form below the base64.

    A run is joined once and decoded once per reading, and a start costs a walk over a few headers, so time grows with the text.
    """
    found, at, run = [], 0, None
    while m := START.search(text, at):
        at, size = m.start() + 1, 0
        if run is None or m.start() >= run.end:
            run = Run(text, m.start())
        place = run.place(m.start())
        data, begin, pem = run.reading(place)
        if m[0][0] == "M":
            size = der_length(data[begin : begin + 9])
            if begin + size > len(data) or not is_der_key(data, begin, begin + size):
                size = 0
        elif m[0][0] == "b":
            size = openssh_length(data, begin)
        elif pem[0] >= begin:
            size = pem[1] - begin
            size += SPACE.match(data, pem[1]).end() - pem[1]
        if size:
            at = PADS.match(text, run.end_of(place + -(-size * 4 // 3))).end()
            found.append((m.start(), at))
    # other runs that are keys as they stand, or hold PEM text
    held = iter(found.copy())
    near = next(held, None)
    for m in RUN.finditer(text):
        while near and near[1] <= m.start():
            near = next(held, None)
        if not (near and near[0] < m.end()):
            data = decoded(m[0])
            if is_key(data) or PEM_KEY in data and pem_spans(data.decode("latin-1")):
                found.append(m.span())
    return found


def is_signed_token(header: str, payload: str) -> bool:
    """Whether the header is a JSON object that names an algorithm and the payload is a JSON object."""
    try:
        head, body = json.loads(decoded(header)), json.loads(decoded(payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the three base kinds."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of what decoding confirms."""
    found = [(a, 3, b) for a, b in pem_spans(text)]
    found += [(a, 4, b) for a, b in key_spans(text)]
    found += [(m.start(), 5, m.end()) for m in TRIPLE.finditer(text) if is_signed_token(m[1], m[2])]
    found += [(m.start(), 6, m.end()) for m in HEXRUN.finditer(text) if is_key(bytes.fromhex(m[0]))]
    return found


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, plus ``found``: an array of (kind, start, end, base), by start, then kind.

    Offsets count code points and ends are exclusive. ``base`` marks the pattern kinds.
    """
    keep = [c for c in docs.columns if c not in (text, "found")]
    rows = docs.select(*keep, text_of(text).alias("_text"))
    span = T.StructType().add("kind", "string").add("start", "long").add("end", "long").add("base", "boolean")
    out = schema_with(rows.drop("_text"), "found", T.ArrayType(span))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "_text"):
            found = []
            for t in batch.column("_text").to_pylist():
                spans = sorted(base_spans(t) + confirmed_spans(t))
                found.append([{"kind": KINDS[k], "start": a, "end": b, "base": k < 3} for a, k, b in spans])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(found, kind)], [*keep, "found"])

    return rows.mapInArrow(scan, out)


def secret_digest(docs: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of the base spans and the list of all spans of each document."""
    found = find_secrets(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.array_join(F.transform(F.filter("found", lambda s: s["base"]), line), ",")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(base, 256).alias("base_sha256"),
        F.array_join(F.transform("found", line), ",").alias("spans"),
    )
