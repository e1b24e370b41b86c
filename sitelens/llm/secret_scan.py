"""Secret scan: base patterns, then structural confirmation of encoded candidates.

Base kinds are found by pattern alone. Further kinds are reported only when their structure parses:

* ``jwt``: three base64url segments whose header is a JSON object with a string ``alg``, however it is spaced, and whose
  payload is a JSON object;
* ``pem``: an armoured private key whose body decodes to DER of exact nested lengths, to an OpenSSH key container with
  consistent length fields, or, below the headers of the old encrypted form, to whole blocks of the cipher named there;
* ``der``: a private key in DER, encrypted or not, in base64 of either alphabet or in hex of either case, on one line or wrapped, wherever in a run it
  begins: the outer length says how far it goes;
* ``ssh``: an OpenSSH private key container in base64, likewise.

Spans are counted in code points, the end exclusive. Each row is read on its own inside
mapInArrow: no shuffle, bounded batches, and a lost executor repeats only its own tasks.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.shared import for_python

#: Kinds in the order that breaks ties of start.
KINDS = ["assign", "access", "hex", "jwt", "pem", "der", "ssh"]
BASE = KINDS[:3]

_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_WORDS = re.compile(rb"(?i)passw|secret|token|api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX_RUN = re.compile(r"[0-9a-f]{32,}")
_HEX_ANY = re.compile(r"[0-9A-Fa-f]{64,}")
# What a brace, or white space before one, becomes in base64.
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(?:e[w-z0-9_-]|I[A-P]|[CD][Q-v])[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:[^-]|-(?!----))*)-----END \1-----")
_OLD_ENCRYPTED = re.compile(r"\s*Proc-Type: 4,ENCRYPTED\s+DEK-Info: [A-Z0-9-]+,([0-9A-Fa-f]{16,32})\s")
#: Where a container may begin: a SEQUENCE, or OpenSSH's magic; no letter or digit before it.
_B64_START = re.compile(r"(?<![A-Za-z0-9])(?:M(?=[A-Za-z0-9+/_-]{47})|b3BlbnNzaC1rZXk(?=[A-Za-z0-9+/_-]{33}))")
_B64_LINES = re.compile(r"[A-Za-z0-9+/_-]+(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)*")
#: A SEQUENCE in hex that begins with a version, or with the SEQUENCE of an algorithm.
_HEX_START = re.compile(r"(?i)30(?=(?:[0-7][0-9a-f]|81[0-9a-f]{2}|82[0-9a-f]{4}|83[0-9a-f]{6})(?:02010[01]|30[0-7][0-9a-f]06))")
#: Algorithms that encrypt keys with a password (PKCS#5 and PKCS#12), as the beginning of their OID.
_ENCRYPTS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
_SSH_MAGIC = b"openssh-key-v1\0"
#: 1 for each byte that is a letter of either base64, or a lower-case hex digit.
_B64_MARK = bytes(1 if chr(b).isalnum() and b < 128 or chr(b) in "+/-_" else 0 for b in range(256))
_HEX_MARK = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))
_HEX_ANY_MARK = bytes(1 if chr(b) in "0123456789abcdefABCDEF" else 0 for b in range(256))


def der_items(data: bytes, depth: int = 8) -> list[tuple[int, bytes]] | None:
    """Tag and content of each DER value in ``data``; None where a length doesn't fit.

    Constructed values are parsed too, down to ``depth``.
    """
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            width = n & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            n, at = int.from_bytes(data[at : at + width], "big"), at + width
        if at + n > len(data):
            return None
        body, at = data[at : at + n], at + n
        if tag & 0x20 and depth and der_items(body, depth - 1) is None:
            return None
        items.append((tag, body))
    return items


def is_private_der(data: bytes) -> bool:
    """PKCS#1, PKCS#8, DSA or SEC1 private keys: one SEQUENCE that starts with a version INTEGER."""
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = der_items(outer[0][1]) or []
    if len(inner) < 3 or inner[0][0] != 0x02 or inner[0][1] not in (b"\0", b"\1"):
        return False
    tags = [t for t, _ in inner[1:]]
    pkcs8 = tags[:2] == [0x30, 0x04]
    sec1 = tags[0] == 0x04
    numbers = len(tags) >= 5 and set(tags[:5]) == {0x02}
    return pkcs8 or sec1 or numbers


def is_encrypted_der(data: bytes) -> bool:
    """PKCS#8 with encryption: SEQUENCE of an algorithm SEQUENCE and an OCTET STRING."""
    outer = der_items(data)
    return bool(outer) and len(outer) == 1 and outer[0][0] == 0x30 and [t for t, _ in der_items(outer[0][1]) or []] == [0x30, 0x04]


def encrypts_key(data: bytes) -> bool:
    """The same by an algorithm that is known to encrypt keys, so that a signed digest is none."""
    if not is_encrypted_der(data):
        return False
    algorithm = der_items(der_items(data)[0][1])[0][1]
    first = (der_items(algorithm) or [(0, b"")])[0]
    return first[0] == 0x06 and first[1].startswith(_ENCRYPTS)


def der_size(data: bytes) -> int | None:
    """How many bytes the SEQUENCE has that ``data`` begins with, as its header tells."""
    if len(data) < 2 or data[0] != 0x30:
        return None
    n, width = data[1], 0
    if n & 0x80:
        width = n & 0x7F
        if not 1 <= width <= 4 or len(data) < 2 + width:
            return None
        n = int.from_bytes(data[2 : 2 + width], "big")
    return 2 + width + n


def openssh_size(data: bytes) -> int | None:
    """How many bytes the container of OpenSSH private keys has: cipher, kdf, options, then as many keys as it says."""
    if not data.startswith(_SSH_MAGIC):
        return None
    at = len(_SSH_MAGIC)

    def field() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4 + n
        return data[at - n : at] if at <= len(data) else None

    if not field() or not field() or field() is None or at + 4 > len(data):
        return None
    n_keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    return at if 1 <= n_keys <= 16 and all(field() for _ in range(n_keys)) and field() else None


def is_openssh(data: bytes) -> bool:
    return openssh_size(data) is not None


def _in_base64(text: str, at: int) -> tuple[str, int] | None:
    """Kind and end of the key container that begins at a place, on one line or more."""
    lines = _B64_LINES.match(text, at)
    head = lines[0][:16].split("\n")[0].replace("-", "+").replace("_", "/")
    first = _decoded(head[: len(head) // 4 * 4]) or b""
    size = der_size(first)
    if first[:1] == b"0" and size is None:
        return None
    # Letters in order with their places; a container in DER says how many it needs.
    need = len(lines[0]) if size is None else -(-size * 4 // 3)
    letters, places = [], []
    for k, c in enumerate(lines[0]):
        if len(letters) == need:
            break
        if not c.isspace():
            letters.append(c)
            places.append(at + k)
    if size is not None and len(letters) < need:
        return None
    run = "".join(letters).replace("-", "+").replace("_", "/")
    if size is not None:
        body = _decoded(run)
        if body is None or len(body) < size or not (is_private_der(body[:size]) or encrypts_key(body[:size])):
            return None
        kind = "der"
    else:
        body = _decoded(run) or _decoded(run[: len(run) // 4 * 4]) or b""
        size, kind = openssh_size(body), "ssh"
        if size is None:
            return None
    end = places[-(-size * 4 // 3) - 1] + 1
    while text[end : end + 1] == "=" and end - places[-(-size * 4 // 3) - 1] <= 2:
        end += 1
    return kind, end


def _in_hex(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Keys in a run of hex digits, one after the other."""
    at = a
    while m := _HEX_START.search(text, at, b):
        size = der_size(bytes.fromhex(text[m.start() : m.start() + 12]))
        end = m.start() + 2 * (size or 0)
        body = bytes.fromhex(text[m.start() : end]) if size and end <= b else b""
        if body and (is_private_der(body) or encrypts_key(body)):
            yield m.start(), end
            at = end
        else:
            at = m.start() + 1


def _decoded(run: str, url: bool = False) -> bytes | None:
    run = run.rstrip("=")
    try:
        padded = run + "=" * (-len(run) % 4)
        return base64.urlsafe_b64decode(padded) if url else base64.b64decode(padded, validate=True)
    except (binascii.Error, ValueError):
        return None


def is_jwt(token: str) -> bool:
    parts = token.split(".")
    try:
        header, payload = (json.loads(_decoded(p, url=True) or b"") for p in parts[:2])
    except (ValueError, RecursionError):  # not JSON, or nested deeper than any token is
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(payload, dict)


def spans(text: str) -> list[tuple[str, int, int]]:
    """All (kind, start, end) of a text, by start and then kind."""
    data = text.encode()
    found = []
    if _WORDS.search(data):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if b"\1" * 32 in data.translate(_HEX_MARK):
        found += [("hex", *m.span()) for m in _HEX_RUN.finditer(text)]
    if b"\1" * 64 in data.translate(_HEX_ANY_MARK):
        for run in _HEX_ANY.finditer(text):
            found += [("der", a, b) for a, b in _in_hex(text, *run.span())]
    if "." in text:
        found += [("jwt", *m.span()) for m in _JWT.finditer(text) if is_jwt(m[0])]
    armoured = []
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            lines = [x for x in m[2].splitlines() if ":" not in x]  # without the headers of old keys
            body = _decoded("".join("".join(lines).split()))
            old = _OLD_ENCRYPTED.match(m[2])
            blocks = body and old and len(body) >= 32 and len(body) * 2 % len(old[1]) == 0  # the IV is as long as a block
            if body and (is_openssh(body) or is_private_der(body) or is_encrypted_der(body) or blocks):
                found.append(("pem", *m.span()))
                armoured.append(m.span())
    if b"\1" * 48 in data.translate(_B64_MARK):
        past = 0
        for m in _B64_START.finditer(text):
            if m.start() < past or any(a <= m.start() < b for a, b in armoured):
                continue
            if held := _in_base64(text, m.start()):
                kind, past = held
                found.append((kind, m.start(), past))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id and ``found``, an array of (kind, start, end).

    Null and empty texts have none. Repeated rows come out as often as they go in, an empty table gives none. Where spans of
    several kinds begin at one place, the order of ``KINDS`` decides. Extra columns are not carried along.
    """
    for_python(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for b in batches:
            found = [[dict(zip(("kind", "start", "end"), s)) for s in spans(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(item))], ["id", "found"])

    out = rows.mapInArrow(run, f"id {kind}, found array<struct<kind: string, start: bigint, end: bigint>>")
    return out.withColumnRenamed("id", id_col)


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by base kind, and the spans as text."""

    def joined(kinds: list[str] | None):
        chosen = F.filter("found", lambda s: s["kind"].isin(*kinds)) if kinds else F.col("found")
        return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select(
        id_col, *[count(k) for k in BASE], F.sha2(joined(BASE), 256).alias("base_sha256"), joined(None).alias("spans")
    )
