"""Secrets in texts: plain patterns, and encoded keys and signed tokens confirmed by their structure.

A base64, base64url or hex run is a candidate only. It is reported as a ``key`` when its bytes are a private key
whose nested lengths fit: DER sequences of PKCS#1, PKCS#8 or SEC1 (with their version and algorithm
fields), or OpenSSH's length-prefixed form. Three dotted base64url parts are reported as a ``signed``
token when the first decodes to a JSON object that names its algorithm and the second to a JSON object.

Spans are in code points, end exclusive, over the whole text. A null text is empty. Every row gives a row,
repeated ones too; a null id stays null. Columns other than the id and the text are ignored.
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

from .common import small_batches

# Fixed patterns of the base kinds: letters of the names in either case, ASCII only.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LENGTH = 6
KINDS = ("assign", "access", "hex", "key", "signed")

# Candidates of the encoded kinds. Encoded lines of a key may be wrapped.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}(?:\r?\n[A-Za-z0-9+/_-]+)*={0,2}")
HEXES = re.compile(r"[0-9A-Fa-f]{64,}")
# A whole dotted run of base64url, begun at its start only, so that a text is read once.
DOTTED = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]*+(?:\.[A-Za-z0-9_-]*+){2,}+")
# How a JSON object begins in base64url, and the same with blanks in front of it.
OBJECT, BLANK_OBJECT = "eyJ", re.compile(r"e[w-z]|[ICD]")
OPENSSH = b"openssh-key-v1\x00"
SEQUENCE, INTEGER, OCTETS, IDENTIFIER = 0x30, 0x02, 0x04, 0x06
KEY_BYTES = 16  # a secret shorter than this is no key


def der_item(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, first, end) of the DER value at ``at``, or None if its length is malformed or leaves the parent."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        width = size & 0x7F
        if not 1 <= width <= 4 or at + width > end:
            return None
        size, at = int.from_bytes(data[at : at + width]), at + width
        if size < 0x80 or size >> (8 * (width - 1)) == 0:
            return None  # not the shortest form, so not DER
    return (tag, at, at + size) if at + size <= end else None


def der_items(data: bytes, at: int, end: int, most: int = 16) -> list[tuple[int, int, int]] | None:
    """All values between ``at`` and ``end``, which they must fill exactly."""
    found = []
    while at < end and len(found) < most:
        item = der_item(data, at, end)
        if item is None:
            return None
        found.append(item)
        at = item[2]
    return found if at == end else None


def der_key(data: bytes) -> int:
    """Length of the private key in DER that ``data`` begins with, nested lengths and all; else 0."""
    outer = der_item(data, 0, len(data))
    if outer is None or outer[0] != SEQUENCE:
        return 0
    parts = der_items(data, outer[1], outer[2])
    if not parts or len(parts) < 3 or parts[0][0] != INTEGER or parts[0][2] - parts[0][1] != 1:
        return 0
    version, tags = data[parts[0][1]], [p[0] for p in parts]
    if tags[:9] == [INTEGER] * 9 and version <= 1:  # PKCS#1: modulus, exponents, primes and so on
        secret = parts[1]
    elif tags[1] == SEQUENCE and tags[2] == OCTETS and version <= 1:  # PKCS#8: algorithm, then the key
        algorithm = der_items(data, parts[1][1], parts[1][2])
        if not algorithm or algorithm[0][0] != IDENTIFIER:
            return 0
        secret = parts[2]
    elif tags[1] == OCTETS and version == 1 and tags[2] in (0xA0, 0xA1):  # SEC1: number, then curve or point
        secret = parts[1]
    else:
        return 0
    return outer[2] if secret[2] - secret[1] >= KEY_BYTES else 0


def openssh_key(data: bytes) -> int:
    """Length of an OpenSSH private key: cipher, derivation, options, a count of keys, those, the private part."""
    if not data.startswith(OPENSSH):
        return 0
    at = len(OPENSSH)

    def field() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4]) if at + 4 <= len(data) else len(data)
        value = data[at + 4 : at + 4 + size]
        at += 4 + size
        return value if at <= len(data) else None

    if not field() or not field() or field() is None or at + 4 > len(data):
        return 0
    keys, at = int.from_bytes(data[at : at + 4]), at + 4
    fits = 1 <= keys <= 16 and all(field() for _ in range(keys)) and len(field() or b"") >= KEY_BYTES
    return at if fits else 0


def key_length(data: bytes) -> int:
    return der_key(data) or openssh_key(data)


def encoded_end(text: str, size: int) -> int:
    """Where the base64 of ``size`` bytes ends in a run that may be wrapped; its end marks belong to it."""
    digits, at = -(-size * 4 // 3), 0
    while digits:
        digits -= text[at] not in "\r\n"
        at += 1
    return at + len(re.match("={0,2}", text[at : at + 2])[0])


def from_base64(text: str) -> bytes:
    """Bytes of base64 or base64url with or without its end marks; nothing if it is neither."""
    text = re.sub(r"[\r\n=]", "", text).replace("-", "+").replace("_", "/")
    text = text[: len(text) - (len(text) % 4 == 1)]
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def json_object(part: str) -> dict | None:
    try:
        value = json.loads(from_base64(part))
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_signed_header(part: str) -> str | None:
    """The algorithm that a token's header names."""
    header = json_object(part)
    algorithm = header.get("alg") if header else None
    return algorithm if isinstance(algorithm, str) else None


def signed_tokens(run: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the signed tokens in a dotted run, each three parts of it.

    A header begins with its part or, where something stands glued in front of it, at the part's first ``eyJ``. No part is
    decoded more often than twice as a header and once as a body, so a run takes time in proportion to its length.
    """
    parts, starts = run.split("."), [0]
    for part in parts:
        starts.append(starts[-1] + len(part) + 1)
    i = 0
    while i + 2 < len(parts):
        glued = parts[i].find(OBJECT)
        begins = [0] if BLANK_OBJECT.match(parts[i]) else []
        begins += [glued] if glued > 0 else []
        named = next(((at, found) for at in begins if (found := is_signed_header(parts[i][at:]))), None)
        if named and (parts[i + 2] or named[1].lower() == "none") and json_object(parts[i + 1]) is not None:
            yield starts[i] + named[0], starts[i + 3] - 1
            i += 3
        else:
            i += 1


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of every secret, by start and kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LENGTH]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for m in HEXES.finditer(text):
        if size := key_length(bytes.fromhex(m[0][: len(m[0]) & ~1])):
            found.append((m.start(), 3, m.start() + 2 * size))
    for m in BASE64.finditer(text):
        if size := key_length(from_base64(m[0])):
            found.append((m.start(), 3, m.start() + encoded_end(m[0], size)))
    found += [(m.start() + a, 4, m.start() + b) for m in DOTTED.finditer(text) for a, b in signed_tokens(m[0])]
    return sorted(found)


def span_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row: the id, a count per kind, all spans, and a digest of the base kinds' spans."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(text or "") for text in batch.column(1).to_pylist()]
            counts = [[sum(kind == k for _, kind, _ in one) for one in found] for k in range(len(KINDS))]
            base = [span_text([s for s in one if s[1] < 3]) for one in found]
            digests = [hashlib.sha256(text.encode()).hexdigest() for text in base]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *[pa.array(c, pa.int64()) for c in counts],
                    pa.array(digests, pa.string()),
                    pa.array([span_text(one) for one in found], pa.string()),
                ],
                ["id", *[f"n_{kind}" for kind in KINDS], "base_sha256", "spans"],
            )

    plain = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
    shape = ", ".join(f"n_{kind} bigint" for kind in KINDS)
    scanned = small_batches(plain).mapInArrow(rows, f"id bigint, {shape}, base_sha256 string, spans string")
    return scanned.withColumnRenamed("id", id_column)
