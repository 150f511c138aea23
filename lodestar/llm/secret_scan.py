"""Secret scan with structural confirmation.

The base kinds are patterns: `assign`, `access` and `hex`. Further candidates, runs of base64, base64url or hex and PEM
blocks, are decoded and reported only if what they hold has the structure of a secret:

- `der`: a key or certificate encoding, of which all nested lengths fit to the last byte;
- `ssh`: a key blob of length-prefixed fields, the first a key type's name;
- `jwt`: three base64url parts, the first a JSON header with an alg, the second JSON;
- `pem`: a block between BEGIN and END lines of one label, whose body is one of the first two.

Base64 that is broken into lines is joined before it is decoded; where an encoding says how long it is, what follows
it in the last line is left out.

A null or empty text has none. Very long texts take time in proportion. Overlapping spans of several kinds are
all reported; base spans always stay. Repeated rows get equal spans. An empty table has no rows. Columns other than text
are passed through; the column of spans is named with underscores if its name is taken.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import Span, digest, found, ordered, redact

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "der", "ssh", "jwt", "pem")
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_ANY_HEX = re.compile(r"(?:(?<![0-9A-Za-z+/])|(?<=0x)|(?<=0X))(?:[0-9a-f]{64,}|[0-9A-F]{64,})(?![0-9A-Za-z+/=_-])")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
#: Lines of base64 of 40 characters or more, and one that may be shorter.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/]{40,}[ \t]*\r?\n[ \t]*)+[A-Za-z0-9+/]+={0,2}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
_SSH_TYPES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521", b"sk-ssh-ed25519@openssh.com")
_SSH_MAGIC = b"openssh-key-v1\x00"


def base_spans(text: str) -> list[Span]:
    """The matches of the base patterns; a match that fails its length is dropped, not tried again."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    out += [("access", *m.span()) for m in _ACCESS.finditer(text)] if "AKIA" in text else []
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return ordered(out, KINDS)


def decoded(run: str) -> bytes | None:
    """What a base64 or base64url run holds, or None."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _header(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the DER element at a place."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end or data[at] == 0:
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if size < 0x80:
            return None
    return (tag, at, at + size) if at + size <= end else None


def _elements(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    out = []
    while start < end:
        element = _header(data, start, end)
        if element is None:
            return None
        out.append(element)
        start = element[2]
    return out


def _nested(data: bytes, start: int, end: int, depth: int = 0) -> int | None:
    """How many elements an encoding has, if all its nested lengths fit."""
    if depth > 12:
        return None
    elements = _elements(data, start, end)
    if elements is None:
        return None
    count = len(elements)
    for tag, a, b in elements:
        if tag & 0x20:
            inner = _nested(data, a, b, depth + 1)
            if inner is None:
                return None
            count += inner
    return count


def is_der_key(data: bytes) -> bool:
    """One sequence to the last byte, with keys' parts: integers, an object id or an octet or bit string."""
    top = _header(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    parts = _elements(data, top[1], top[2])
    if not parts or _nested(data, top[1], top[2]) is None:
        return False
    tags = [tag for tag, _, _ in parts]
    integers = tags.count(0x02)
    rsa = integers == len(tags) and integers in (2, 6, 9)  # public, DSA or RSA private
    pkcs8 = tags[:3] == [0x02, 0x30, 0x04]
    encrypted = tags == [0x30, 0x04]
    sec1 = tags[:2] == [0x02, 0x04]
    spki = tags == [0x30, 0x03]
    certificate = tags == [0x30, 0x30, 0x03]
    return rsa and len(data) > 32 or pkcs8 or encrypted or sec1 or spki or certificate


def is_ssh_blob(data: bytes) -> bool:
    """Length-prefixed fields to the last byte, the first a type's name; or a private key file's beginning."""
    if data.startswith(_SSH_MAGIC):
        data = data[len(_SSH_MAGIC) :]
        at = 0
        for _ in range(3):  # cipher, kdf, kdf options
            size = int.from_bytes(data[at : at + 4], "big")
            at += 4 + size
            if at + 4 > len(data):
                return False
        return 1 <= int.from_bytes(data[at : at + 4], "big") <= 16
    fields, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return False
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return len(fields) >= 2 and fields[0] in _SSH_TYPES


def is_jwt(run: str) -> bool:
    parts = run.split(".")
    held = [decoded(p) for p in parts[:2]]
    if len(parts) != 3 or None in held:
        return False
    try:
        header, claims = (json.loads(h) for h in held)
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(claims, dict)


def _structure(data: bytes | None) -> str | None:
    if not data or len(data) < 24:
        return None
    return "der" if data[0] == 0x30 and is_der_key(data) else "ssh" if is_ssh_blob(data) else None


def _wrapped(run: str) -> tuple[str, int] | None:
    """The kind of what base64 in several lines holds, and at which character of the run it ends."""
    at = [i for i, c in enumerate(run) if c not in " \t\r\n"]
    body = "".join([run[i] for i in at])
    head = decoded(body[:12])
    top = _header(head, 0, 1 << 40) if head and head[0] == 0x30 else None
    sizes = [-(-top[2] // 3) * 4] if top else [len(body), len(body[: body.rfind(run[run.rfind("\n") + 1 :].strip())])]
    for size in sizes:  # a blob that does not tell its length: with or without the last line
        if 0 < size - 2 <= len(body) and (kind := _structure(decoded(body[:size]))):
            return kind, at[min(size, len(body)) - 1] + 1
    return None


def further_spans(text: str) -> list[Span]:
    """What decoding confirms."""
    out = [("jwt", *m.span()) for m in _JWT.finditer(text) if is_jwt(m[0])] if "eyJ" in text else []
    taken: list[tuple[int, int]] = []

    def free(start: int) -> bool:
        return not any(a <= start < b for a, b in taken)

    for m in _PEM.finditer(text) if "-----BEGIN " in text else ():
        if _structure(decoded(re.sub(r"\s", "", m[2]))):
            out.append(("pem", *m.span()))
            taken.append(m.span())
    runs = list(_BASE64.finditer(text))
    for m in _WRAPPED.finditer(text) if runs else ():
        if free(m.start()) and (found_ := _wrapped(m[0])):
            out.append((found_[0], m.start(), m.start() + found_[1]))
            taken.append((m.start(), m.start() + found_[1]))
    for m in runs:
        kind = _structure(decoded(m[0]))
        if kind and free(m.start()):
            out.append((kind, *m.span()))
    for m in _ANY_HEX.finditer(text):
        kind = _structure(bytes.fromhex(m[0])) if len(m[0]) % 2 == 0 else None
        if kind:
            out.append((kind, *m.span()))
    return ordered(out, KINDS)


def find(texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    return [(base_spans(t), further_spans(t)) for t in texts]


def scan(docs: DataFrame, spans: str = "secret_spans") -> DataFrame:
    """docs with a column of its spans: kind, start, end, and whether it is of a base kind."""
    return found(docs, find, spans)


def redacted(text: str | None) -> str | None:
    """text with its secrets replaced by their kinds."""
    return redact(text, [*base_spans(text or ""), *further_spans(text or "")])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document."""
    return digest(scan(docs.select("doc_id", F.col("text")), "_spans"), BASE, KINDS)
