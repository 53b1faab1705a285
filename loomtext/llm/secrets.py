"""Secret scan: pattern candidates, confirmed by their structure where they have one.

Base spans are the matches of three patterns. Beyond them, candidates that look like base64 (in one
line, wrapped, or in a PEM frame), hex or a signed token are decoded, and reported only if the
decoded bytes parse to their end: the nested lengths of a private key in DER (PKCS#1, PKCS#8 plain
or encrypted, SEC 1, DSA), the fields of an OpenSSH private key, or a token with a header that
names an algorithm, a payload that is an object, and a signature. Public keys are no secrets.
Every pattern is read once from left to right, so time is linear in the text.

Kinds, in order of precedence at equal starts: assign, access, hex, pem, der, ssh, jwt.
Offsets count code points, ends exclusive. Defined cases: a null or empty text has no spans.
Repeated rows are scanned one by one. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomtext.llm.common import frugal, table

KINDS = ["assign", "access", "hex", "pem", "der", "ssh", "jwt"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: The same keywords without alternatives at the front, to find places worth the full pattern.
_KEYWORD = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
PEM_MARK = re.compile(r"-----(BEGIN|END) ((?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY)-----")
JWT = re.compile(r"(?<![A-Za-z0-9_.-])(eyJ[A-Za-z0-9_-]{5,})\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
HEXES = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){24,}(?![0-9A-Fa-f])")
_LONG = re.compile(r"[A-Za-z0-9+/_-]{40}")
#: What stands between the lines of wrapped base64, and a last line that is shorter.
_BREAK = re.compile(r"[ \t]*\r?\n[ \t]*")
_TAIL = re.compile(r"[ \t]*\r?\n[ \t]*([A-Za-z0-9+/_-]+={0,2})(?![A-Za-z0-9+/_=-])")
#: Base64 of a DER sequence and of an OpenSSH key begins so; the key's own first bytes.
_FIRST, _MAGIC = ("M", "b3BlbnNzaC1rZXktdjEA"), b"openssh-key-v1\0"
#: Object identifiers of password-based encryption begin with these (PKCS #5 and PKCS #12).
_ENCRYPTIONS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def unbase64(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64, padding optional; None if it isn't."""
    text = re.sub(r"\s+", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """The (tag, content) items that fill ``data`` exactly; None if the lengths don't nest."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size = int.from_bytes(data[at : at + n], "big")
            at += n
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def is_der_key(data: bytes | None) -> bool:
    """A private key in DER: one sequence over all bytes, in one of five layouts."""
    if not data or len(data) < 24 or data[0] != 0x30:
        return False
    outer = der_items(data)
    items = der_items(outer[0][1]) if outer and len(outer) == 1 else None
    if not items or len(items) < 2:
        return False
    tags = [t for t, _ in items]
    if tags == [0x30, 0x04]:  # PKCS#8, encrypted: algorithm identifier, octets
        inner = der_items(items[0][1])
        return bool(inner) and inner[0][0] == 0x06 and inner[0][1].startswith(_ENCRYPTIONS) and len(items[1][1]) >= 16
    if tags[0] != 0x02 or items[0][1] not in (b"\0", b"\1"):  # a version
        return False
    if all(t == 0x02 for t in tags[:6]) and len(tags) >= 6:  # DSA: 6 integers, RSA: 9, and others for more primes
        return len(tags) in (6, 9, 10) and all(t in (0x02, 0x30) for t in tags) and all(c for _, c in items) and max(len(c) for _, c in items) >= 16
    if tags[1] == 0x30:  # PKCS#8: version, algorithm identifier, key octets
        inner = der_items(items[1][1])
        return bool(inner) and inner[0][0] == 0x06 and len(tags) > 2 and tags[2] == 0x04 and bool(der_items(items[2][1]))
    return tags[1] == 0x04 and len(items[1][1]) >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])  # SEC 1: version, octets, curve, public point


def ssh_fields(data: bytes, count: int | None = None) -> tuple[list[bytes], int] | None:
    """So many length-prefixed fields (all, if None) and where they end; None if a length doesn't fit."""
    fields, at = [], 0
    while len(fields) != count and (count is not None or at < len(data)):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 > len(data) or at + 4 + size > len(data):
            return None
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return fields, at


def _is_public(blob: bytes) -> bool:
    found = ssh_fields(blob)
    return bool(found) and len(found[0]) >= 2 and found[0][0].startswith((b"ssh-", b"ecdsa-", b"sk-"))


def is_ssh_key(data: bytes | None) -> bool:
    """An OpenSSH private key: cipher, derivation, its options, public keys, and a private part of whole blocks that ends the data."""
    if not data or not data.startswith(_MAGIC):
        return False
    rest = data[len(_MAGIC) :]
    head = ssh_fields(rest, 3)
    if not head or not head[0][0]:
        return False
    at = head[1]
    count = int.from_bytes(rest[at : at + 4], "big")
    if not 1 <= count <= 64:
        return False
    keys = ssh_fields(rest[at + 4 :], count + 1)
    if not keys or at + 4 + keys[1] != len(rest) or not all(map(_is_public, keys[0][:-1])):
        return False
    private = keys[0][-1]
    if len(private) < 16 or len(private) % 8:
        return False
    if head[0][0] != b"none":
        return True
    kind = ssh_fields(private[8:], 1)
    return private[:4] == private[4:8] and bool(kind) and kind[0][0].startswith((b"ssh-", b"ecdsa-", b"sk-"))


def _object(part: str) -> dict | None:
    """The JSON object that the base64 holds."""
    data = unbase64(part)
    try:
        found = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def is_token(header: str, payload: str, signature: str) -> bool:
    """A signed token: a header that names an algorithm, an object as payload, a signature of at least 8 bytes."""
    head = _object(header)
    return head is not None and isinstance(head.get("alg"), str) and head["alg"].lower() != "none" and _object(payload) is not None and len(unbase64(signature) or b"") >= 8


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns."""
    out = []
    if _KEYWORD.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def is_pem_key(label: str, body: str) -> bool:
    """The body of a PEM frame; line ends may be written out as \\n. With a DEK-Info header it is a cipher's whole blocks."""
    body = body.replace("\\r", "").replace("\\n", "\n")
    headers = dict(re.findall(r"(?m)^[ \t]*([A-Za-z-]+):[ \t]*(.*?)\s*$", body))
    data = unbase64(re.sub(r"(?m)^[ \t]*[A-Za-z-]+:.*$", "", body))
    if "DEK-Info" in headers:
        iv = re.fullmatch(r"[A-Z0-9-]+,([0-9A-Fa-f]{16,32})", headers["DEK-Info"])
        return bool(iv and data) and len(data) >= 48 and len(data) % (len(iv[1]) // 2) == 0
    return is_ssh_key(data) if label.startswith("OPENSSH") else is_der_key(data)


def pem_spans(text: str) -> list[tuple[int, int, int]]:
    """Frames that hold a key, and nothing between a BEGIN and its END that is a BEGIN."""
    out, begun = [], None
    for m in PEM_MARK.finditer(text):
        if m[1] == "BEGIN":
            begun = m
        elif begun is not None:
            if begun[2] == m[2] and is_pem_key(m[2], text[begun.end() : m.start()]):
                out.append((begun.start(), 3, m.end()))
            begun = None
    return out


def _kind(encoded: str) -> int | None:
    data = unbase64(encoded)
    return 4 if is_der_key(data) else 5 if is_ssh_key(data) else None


def base64_spans(text: str) -> list[tuple[int, int, int]]:
    """Keys in base64, in one line or wrapped into lines of equal length and a shorter last one."""
    out: list[tuple[int, int, int]] = []
    lines = list(BASE64.finditer(text))
    i = 0
    while i < len(lines):
        first = last = i
        if lines[i][0].startswith(_FIRST):
            while last + 1 < len(lines) and len(lines[last][0]) == len(lines[first][0]) and _BREAK.fullmatch(text, lines[last].end(), lines[last + 1].start()) and len(lines[last + 1][0]) <= len(lines[first][0]):
                last += 1
            ends = [lines[last].end()]
            if len(lines[last][0]) == len(lines[first][0]) and (tail := _TAIL.match(text, ends[0])) and len(tail[1]) < len(lines[first][0]):
                ends.insert(0, tail.end())
            if last > first:
                ends.append(lines[first].end())
            for end in ends:  # with the short last line, without it, the first line alone
                if (kind := _kind(text[lines[first].start() : end])) is not None:
                    out.append((lines[first].start(), kind, end))
                    break
            else:
                last = first
            while last + 1 < len(lines) and out and lines[last + 1].start() < out[-1][2]:
                last += 1
            if out and out[-1][2] == lines[first].end():
                last = first
        i = last + 1
    return out


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of candidates whose decoded structure is a key's or a signed token's."""
    out = pem_spans(text) if "-----BEGIN " in text else []
    frames = list(out)
    if "eyJ" in text:
        out += [(m.start(), 6, m.end()) for m in JWT.finditer(text) if is_token(m[1], m[2], m[3])]
    if _LONG.search(text):
        out += base64_spans(text)
        for m in HEXES.finditer(text):
            if m[0].startswith(("30", _MAGIC.hex())):
                data = bytes.fromhex(m[0])
                if is_der_key(data) or is_ssh_key(data):
                    out.append((m.start(), 4 if data[0] == 0x30 else 5, m.end()))
    starts = [a for a, _, _ in frames]
    inside = lambda at: (k := bisect.bisect_right(starts, at)) and at < frames[k - 1][2]
    return [x for x in out if x[1] == 3 or not inside(x[0])]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(set(spans)))


def scan(text: str | None) -> tuple[int, int, int, str, str]:
    """n_assign, n_access, n_hex, the base spans and all spans, written out."""
    text = text or ""
    base = base_spans(text)
    counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
    return *counts, written(base), written(base + confirmed_spans(text))


@frugal
def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [scan(x.as_py()) for x in batch.column(1)]
        cols = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans"],
        )


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per row: counts of the base kinds, their spans, and all spans, as text."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_spans string, spans string"
    return docs.select("doc_id", "text").mapInArrow(_scan, schema)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "n_assign", "n_access", "n_hex", "sha2(base_spans, 256) base_sha256", "spans")
