"""Secret scans with structural confirmation.

Three base kinds are plain patterns. Other candidates, armoured or bare base64, hex and tokens
of three dotted parts, are decoded and parsed: a private key counts only if its nested lengths
fill each other exactly and its members are those of a known encoding, a token only if its
header names a signature whose length the third part has. What merely looks random is left.

Texts are read whole, in Arrow batches. A linear-time pattern over the batch tells which rows
hold a candidate of a kind; only those are walked in Python.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import small_batches

#: The base kinds and their least lengths.
BASE = ("assign", "access", "hex")
ASSIGNED, ACCESS, HEX = 8, 16, 32
#: The confirmed kinds, in the order of spans with one start.
CONFIRMED = ("pem_key", "der_key", "ssh_key", "signed_token")
KINDS = BASE + CONFIRMED

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rf"AKIA[A-Z0-9]{{{ACCESS - 4},}}")
_HEX = re.compile(rf"(?<![0-9a-f])[0-9a-f]{{{HEX},}}")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----([^-]*(?:-(?!----)[^-]*)*)-----END \1-----")
_BARE64 = re.compile(r"(?<![A-Za-z0-9+/])(?:M|b3BlbnNzaC1rZXkt)[A-Za-z0-9+/]{40,}={0,2}")
_BAREHEX = re.compile(r"(?<![0-9A-Fa-f])(?:30|6[fF]70656[eE]73736)[0-9A-Fa-f]{62,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(ey[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: What a batch is searched for first; each holds for every text that has a span of its kinds.
_LIKELY = {
    "assign": "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]""",
    "access": rf"AKIA[A-Z0-9]{{{ACCESS - 4}}}",
    "hex": rf"[0-9a-f]{{{HEX}}}",
    "pem": "PRIVATE KEY-----",
    "bare": "(M|b3BlbnNzaC1rZXkt)[A-Za-z0-9+/]{40}|(30|6[fF]70656[eE]73736)[0-9A-Fa-f]{62}",
    "token": r"ey[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]",
}


def der_items(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the contents between at and end; None unless their lengths fill it exactly."""
    items = []
    while at < end:
        if at + 2 > end:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size >= 0x80:
            more = size & 0x7F
            # lengths of four bytes at most, in their shortest form
            if not 1 <= more <= 4 or at + more > end or data[at] == 0:
                return None
            size = int.from_bytes(data[at : at + more], "big")
            if size < 0x80:
                return None
            at += more
        if at + size > end:
            return None
        items.append((tag, at, at + size))
        at += size
    return items


_INT, _OCTETS, _OID, _SEQ = 0x02, 0x04, 0x06, 0x30


def is_private_key(data: bytes) -> bool:
    """Whether these bytes are one DER private key: PKCS#1, PKCS#8 (plain or encrypted), SEC 1 or DSA."""
    top = der_items(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != _SEQ:
        return False
    parts = der_items(data, *top[0][1:])
    if not parts:
        return False
    tags = [t for t, _, _ in parts]
    if any(a == b for t, a, b in parts if t == _INT):
        return False

    def named(part: tuple[int, int, int]) -> bool:
        inner = der_items(data, part[1], part[2])
        return part[0] == _SEQ and bool(inner) and inner[0][0] == _OID and inner[0][1] < inner[0][2]

    if tags[:2] == [_SEQ, _OCTETS] and len(tags) == 2:  # encrypted: what it is sealed with, then the box
        return named(parts[0]) and parts[1][2] - parts[1][1] >= 16 and (parts[1][2] - parts[1][1]) % 8 == 0
    if tags[0] != _INT or parts[0][2] - parts[0][1] != 1:
        return False
    version = data[parts[0][1]]
    if tags[:3] == [_INT, _SEQ, _OCTETS] and version in (0, 1):
        return named(parts[1]) and all(t in (0xA0, 0x81) for t in tags[3:]) and der_items(data, *parts[2][1:]) is not None
    if tags[:2] == [_INT, _OCTETS] and version == 1:
        return parts[1][2] - parts[1][1] in (20, 24, 28, 32, 48, 66) and all(t in (0xA0, 0xA1) for t in tags[2:])
    sizes = [b - a for _, a, b in parts]
    if set(tags) == {_INT} and version == 0 and len(tags) == 9:  # modulus, exponents, two primes, their exponents, coefficient
        return sizes[1] >= 48 and sizes[2] <= 9 and sizes[4] <= sizes[1] and sizes[4] + sizes[5] in range(sizes[1] - 1, sizes[1] + 4)
    if set(tags) == {_INT} and version == 0 and len(tags) == 6:
        return sizes[1] >= 64 and sizes[5] <= sizes[2] + 1
    return False


_SSH = b"openssh-key-v1\0"


def is_ssh_key(data: bytes) -> bool:
    """Whether these bytes are an openssh-key-v1 container whose length-prefixed members fill it exactly."""
    if not data.startswith(_SSH):
        return False
    at, members = len(_SSH), []

    def take() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if at + size > len(data):
            return None
        at += size
        return data[at - size : at]

    for _ in range(3):
        members.append(take())
    if None in members or not members[0].isascii() or not members[1].isascii():
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 16 or any(not take() for _ in range(keys)):
        return False
    box = take()
    return bool(box) and at == len(data) and len(box) % 8 == 0


#: Bytes of a signature by the algorithm that a token's header names; the others' follow their keys.
_SIGNED = {"HS256": (32,), "HS384": (48,), "HS512": (64,), "ES256": (64,), "ES256K": (64,), "ES384": (96,), "ES512": (132,), "EdDSA": (64, 114)}
_BY_KEY = ("RS256", "RS384", "RS512", "PS256", "PS384", "PS512")


def _url64(part: str) -> bytes | None:
    try:
        return base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)) if len(part) % 4 != 1 else None
    except (binascii.Error, ValueError):
        return None


def _object(part: str) -> dict | None:
    data = _url64(part)
    try:
        found = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def is_signed_token(header: str, claims: str, signature: str) -> bool:
    """Whether the parts are a JSON header naming a signature, a JSON object, and a signature as long as named."""
    head = _object(header)
    alg = head.get("alg") if head else None
    if not isinstance(alg, str) or not (alg in _SIGNED or alg in _BY_KEY):
        return False
    size = len(_url64(signature) or b"")
    return (size in _SIGNED[alg] if alg in _SIGNED else size >= 128 and size % 8 == 0) and _object(claims) is not None


def _plain64(text: str) -> bytes | None:
    try:
        return base64.b64decode(text, validate=True)
    except (binascii.Error, ValueError):
        return None


def _armoured(body: str) -> bool:
    """Whether the body between armour lines is a key; line breaks may be written as backslash n."""
    lines = [x.strip() for x in re.split(r"\r\n|[\r\n]|\\r\\n|\\n", body)]
    heads = [x for x in lines if ":" in x]
    data = _plain64("".join(x for x in lines if x and ":" not in x).replace(" ", ""))
    if not data:
        return False
    if any("ENCRYPTED" in x for x in heads):  # sealed in whole blocks of the named cipher
        sealed = re.search(r"DEK-Info: *[A-Z0-9-]+,([0-9A-Fa-f]+)", "\n".join(heads))
        return bool(sealed) and len(sealed[1]) in (16, 32) and len(data) % (len(sealed[1]) // 2) == 0
    return is_private_key(data) or is_ssh_key(data)


def base_spans(text: str, likely: set[str]) -> list[tuple[str, int, int]]:
    out = []
    if "assign" in likely:
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= ASSIGNED]
    if "access" in likely:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    if "hex" in likely:
        out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


def confirmed_spans(text: str, likely: set[str]) -> list[tuple[str, int, int]]:
    out = []
    if "pem" in likely:
        out += [("pem_key", *m.span()) for m in _PEM.finditer(text) if _armoured(m[2])]
    if "bare" in likely:
        held, at = list(out), 0
        bare = [(m, _plain64(m[0])) for m in _BARE64.finditer(text)]
        bare += [(m, bytes.fromhex(m[0][: len(m[0]) // 2 * 2])) for m in _BAREHEX.finditer(text)]
        for m, data in sorted(bare, key=lambda x: x[0].span()):
            while at < len(held) and held[at][2] <= m.start():
                at += 1
            kind = None if not data or (at < len(held) and held[at][1] < m.end()) else "der_key" if is_private_key(data) else "ssh_key" if is_ssh_key(data) else None
            if kind:
                out.append((kind, *m.span()))
    if "token" in likely:
        out += [("signed_token", *m.span()) for m in _TOKEN.finditer(text) if is_signed_token(*m.groups())]
    return out


_SPANS = "array<struct<kind:string,start:int,end:int>>"


def _scan(texts: pa.Array) -> pa.Array:
    texts = texts.fill_null("")
    hits: dict[int, set[str]] = {}
    for kind, pattern in _LIKELY.items():
        for i in pc.indices_nonzero(pc.match_substring_regex(texts, pattern)).to_pylist():
            hits.setdefault(i, set()).add(kind)
    rows = [[] for _ in range(len(texts))]
    for i, likely in hits.items():
        text = texts[i].as_py()
        found = base_spans(text, likely) + confirmed_spans(text, likely)
        rows[i] = [{"kind": k, "start": a, "end": b} for k, a, b in sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))]
    return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """docs with an array of (kind, start, end): code points, end exclusive, by start and then as KINDS lists them.

    Spans of one kind do not overlap, those of different kinds may. Null and empty texts have
    none. Rows are judged one by one: repeated rows and ids give what each row alone gives. An
    empty table gives an empty table. Other columns stay; one named as `out` is replaced.
    """
    small_batches(docs.sparkSession)
    scan = F.arrow_udf(_scan, _SPANS)
    return docs.withColumn(out, scan(F.col(text)))


def listed(spans: F.Column) -> F.Column:
    """Spans as kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def of_kind(spans: F.Column, *kinds: str) -> F.Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
