"""Secret scan with structural confirmation.

Pattern matches of three base kinds are always reported.  Besides them, base64 and hex candidates are decoded and are
reported only if their inside is that of a secret: a signed token with a JSON header, a key in DER or in OpenSSH or PEM
armour whose nested lengths fit exactly, or text that itself holds an assigned secret or an access key.

Defined results: a null text counts as empty and has no spans; repeated rows each give a row; spans of equal start come in
the order of KINDS, so there are no other ties; a text is scanned whole, in time that grows with its length; other columns
stay, but one that has the name of the result is replaced; an empty table gives an empty table.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds in the order that breaks ties between spans of one start: the base kinds, then those confirmed by structure.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "pem", "jwt", "der", "ssh", "wrapped")

_ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: Marks of armour; a key lies between a BEGIN and the next mark, if that is the END of the same label.
_PEM = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*)PRIVATE KEY-----")
_ARMOUR = re.compile(r"[A-Za-z0-9+/=\s:,.-]*")
_BLANK_LINE = re.compile(r"\r?\n[ \t]*\r?\n")
_JWT = re.compile(r"(?<![A-Za-z0-9_.-])(eyJ[A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]{8,})")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}")
#: Parts of such a run in one alphabet, tried where the whole run is no secret: a word may be joined to a value.
_ONE_ALPHABET = (re.compile(r"[A-Za-z0-9+/]{24,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{24,}={0,2}"))
_ANY_HEX = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])")
#: Object identifiers of key algorithms in DER: RSA, EC public key, Ed25519 (fixed values).
_KEY_OIDS = (bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201"), bytes.fromhex("2b6570"))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of each base kind; those that are too short are dropped, without a retry."""
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def b64(value: str) -> bytes | None:
    value = value.rstrip("=").replace("-", "+").replace("_", "/")
    if len(value) % 4 == 1:
        return None
    try:
        return base64.b64decode(value + "=" * (-len(value) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, at: int = 0, end: int | None = None, depth: int = 0) -> list[tuple[int, bytes | list]] | None:
    """Tags and contents of a run of DER values that fills data[at:end] exactly, sequences and sets opened; else None."""
    end, out = len(data) if end is None else end, []
    while at < end:
        if end - at < 2 or depth > 8:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
            if size < 0x80:
                return None
        if at + size > end:
            return None
        if tag in (0x30, 0x31):
            inner = der_items(data, at, at + size, depth + 1)
            if inner is None:
                return None
            out.append((tag, inner))
        else:
            out.append((tag, data[at : at + size]))
        at += size
    return out


def is_der_key(data: bytes) -> bool:
    """Whether data is one DER sequence with the fields of a private key: PKCS#1, PKCS#8 or SEC 1."""
    if len(data) < 24 or data[0] != 0x30 or not (top := der_items(data)) or len(top) != 1 or not isinstance(top[0][1], list):
        return False
    fields = top[0][1]
    tags = [t for t, _ in fields]
    if tags[:1] != [0x02] or fields[0][1] not in (b"\0", b"\1"):
        return False
    if len(tags) == 9 and set(tags) == {0x02}:
        return True
    if tags[1:3] == [0x30, 0x04]:
        return any(t == 0x06 and v in _KEY_OIDS for t, v in fields[1][1])
    return fields[0][1] == b"\1" and tags[1:2] == [0x04] and all(t in (0xA0, 0xA1) for t in tags[2:]) and 16 <= len(fields[1][1]) <= 80


def is_ssh_key(data: bytes) -> bool:
    """Whether data is an OpenSSH private key: the magic, then length-prefixed fields that fit exactly."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at, fields = len(magic), 0
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if fields == 3:  # the number of keys
            if not 1 <= size <= 16:
                return False
            at, fields = at + 4, fields + 1
            continue
        at, fields = at + 4 + size, fields + 1
    return at == len(data) and fields >= 6


def is_jwt(header: str, payload: str) -> bool:
    """Whether the decoded header is a JSON object that names an algorithm, and the payload a JSON object."""
    try:
        head, body = (json.loads(b64(x) or b"") for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def inside(data: bytes, depth: int = 0) -> str | None:
    """The kind of secret that decoded bytes hold, if any; encoded layers are opened up to two deep."""
    if is_der_key(data):
        return "der"
    if is_ssh_key(data):
        return "ssh"
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    if not text.isprintable() and any(c < " " and c not in "\t\r\n" for c in text):
        return None
    if any(k in ("assign", "access") for _, _, k in base_spans(text)) or confirmed(text, depth + 1):
        return "wrapped"
    return None


def confirmed(text: str, depth: int = 0) -> list[tuple[int, int, str]]:
    """Spans that are secrets by their structure; where two would start together the outer form holds."""
    out: list[tuple[int, int, str]] = []
    if depth > 2:
        return out
    if "-----BEGIN " in text:
        marks = list(_PEM.finditer(text))
        for begin, end in zip(marks, marks[1:], strict=False):
            if (begin[1], end[1], begin[2]) != ("BEGIN", "END", end[2]) or not (armour := _ARMOUR.fullmatch(text, begin.end(), end.start())):
                continue
            body = b64(re.sub(r"\s", "", _BLANK_LINE.split(armour[0].rstrip())[-1]))
            if body and (is_der_key(body) or is_ssh_key(body) or "ENCRYPTED" in begin[2] + armour[0] and body[:1] == b"\x30" and der_items(body)):
                out.append((begin.start(), end.end(), "pem"))
    if "eyJ" in text:
        out += [(m.start(), m.end(), "jwt") for m in _JWT.finditer(text) if is_jwt(m[1], m[2])]
    holders: tuple[list[int], list[int]] = ([], [])

    def hold() -> None:
        """Starts of the spans so far, in order, and the furthest end up to each."""
        found = sorted(out)
        holders[0][:], holders[1][:] = [s for s, _, _ in found], accumulate((e for _, e, _ in found), max)

    def within(m) -> bool:
        i = bisect_right(holders[0], m.start()) - 1
        return i >= 0 and holders[1][i] >= m.end()

    def opened(m, decode) -> bool:
        if not within(m) and (data := decode(m[0])) and (kind := inside(data, depth)):
            out.append((m.start(), m.end(), kind))
            return True
        return False

    hold()
    for m in _BASE64.finditer(text):
        if not opened(m, b64):
            inner: list[tuple[int, int]] = []  # of the first alphabet, in order, so what the second finds needs a look at one
            for p in _ONE_ALPHABET:
                seen, at = list(inner), 0
                for part in p.finditer(text, *m.span()):
                    while at < len(seen) and seen[at][1] < part.end():
                        at += 1
                    held = at < len(seen) and seen[at][0] <= part.start()
                    if part.span() != m.span() and not held and opened(part, b64):
                        inner.append(part.span())
    hold()
    for m in _ANY_HEX.finditer(text):
        opened(m, lambda v: bytes.fromhex(v) if len(v) % 2 == 0 else None)
    return out


def spans(text: str) -> list[tuple[int, int, str]]:
    """All spans by start, then kind as listed in KINDS."""
    return sorted(base_spans(text) + confirmed(text), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]), False)


@F.pandas_udf(SPANS)
def _spans_of(texts):
    return texts.map(lambda t: [dict(zip(("start", "end", "kind"), s, strict=True)) for s in spans(t)] if t else [])


def scan(docs: DataFrame, text_col: str = "text", out_col: str = "secret_spans") -> DataFrame:
    """docs with out_col: array of (start, end, kind) of each whole text."""
    return docs.withColumn(out_col, _spans_of(F.col(text_col).cast("string")))


@F.pandas_udf(T.StringType())
def _masked(texts):
    return texts.map(lambda t: mask(t) if t else t)


def mask(text: str) -> str:
    """text with every secret replaced by [SECRET]; overlapping spans become one."""
    out, at = [], 0
    for s, e, _ in spans(text):
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with secrets masked in text_col; texts without any stay as they are, null stays null."""
    return docs.withColumn(text_col, _masked(F.col(text_col).cast("string")))


def digest(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, number of spans of each base kind, SHA-256 of the base spans and the string of all spans, as kind:start:end."""
    of = lambda kind: lambda x: x["kind"] == kind
    s = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
    found = scan(docs.select(key, F.col(text_col).alias("\0text")), "\0text", "\0spans").select(key, "\0spans")
    base = F.filter("\0spans", lambda x: x["kind"].isin(*BASE))
    return found.select(
        key,
        *[F.size(F.filter("\0spans", of(k))).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(s(base), 256).alias("base_sha256"),
        s(F.col("\0spans")).alias("spans"),
    )
