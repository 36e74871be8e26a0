import base64
import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from evidentia.llm import queries, secrets


def b64url(data):
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()


def token(alg, signature, head=None):
    return ".".join((b64url(json.dumps(head or {"alg": alg, "typ": "JWT"}).encode()), b64url(b'{"sub":"1"}'), b64url(b"\x07" * signature)))


def tlv(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else b"\x82" + n.to_bytes(2, "big")
    return bytes([tag]) + size + body


def number(size, rng):
    return tlv(2, bytes([rng.randrange(1, 128)]) + rng.randbytes(size - 1))


def keys():
    rng = random.Random(3)
    oid = tlv(0x30, tlv(6, b"\x2a\x86\x48\xce\x3d\x02\x01") + tlv(5, b""))
    rsa = tlv(0x30, tlv(2, b"\0") + number(128, rng) + tlv(2, b"\1\0\1") + number(128, rng) + b"".join(number(64, rng) for _ in range(5)))
    return {"rsa": rsa, "pkcs8": tlv(0x30, tlv(2, b"\0") + oid + tlv(4, rsa)), "ec": tlv(0x30, tlv(2, b"\1") + tlv(4, rng.randbytes(32)) + tlv(0xA0, tlv(6, b"\x2a\x03"))), "sealed": tlv(0x30, oid + tlv(4, rng.randbytes(64)))}


def ssh():
    def field(b):
        return len(b).to_bytes(4, "big") + b

    return b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"p" * 51) + field(b"q" * 136)


@pytest.mark.parametrize("name", ["rsa", "pkcs8", "ec", "sealed"])
def test_keys_need_their_nested_lengths(name):
    key = keys()[name]
    assert secrets.is_private_key(key)
    for broken in (key[:-1], key + b"\0", key[:1] + bytes([key[1] ^ 1]) + key[2:], tlv(0x31, key), b""):
        assert not secrets.is_private_key(broken)


def test_public_keys_and_plain_sequences_are_none():
    oid = tlv(0x30, tlv(6, b"\x2a\x03"))
    assert not secrets.is_private_key(tlv(0x30, oid + tlv(3, b"\0" + b"k" * 64)))
    assert not secrets.is_private_key(tlv(0x30, tlv(2, b"\0") + tlv(2, b"\5")))


def test_ssh_containers():
    key = ssh()
    assert secrets.is_ssh_key(key) and not secrets.is_ssh_key(key[:-1]) and not secrets.is_ssh_key(key + b"x" * 8) and not secrets.is_ssh_key(b"openssh-key-v1\0")


def test_tokens_need_a_signature_of_the_named_length():
    def ok(t):
        return secrets.is_signed_token(*t.split("."))

    assert ok(token("HS256", 32)) and ok(token("RS256", 256)) and ok(token("EdDSA", 64))
    assert not ok(token("HS256", 31)) and not ok(token("none", 32)) and not ok(token("RS256", 100)) and not ok(token("", 32, {"typ": "JWT"}))
    assert not ok("eyJub3Q.eyJqc29u.AAAA")


def slow_base(text):
    """The base kinds by a plain walk: every match, failing ones dropped."""
    text, out = text or "", []
    word = "|".join(("[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]", "[Pp][Aa][Ss][Ss][Ww][Dd]", "[Ss][Ee][Cc][Rr][Ee][Tt]", "[Tt][Oo][Kk][Ee][Nn]", "[Aa][Pp][Ii]_?[Kk][Ee][Yy]"))
    for m in re.finditer(rf"""({word})["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [(m.start(), 0, m.end())] if len(m[2]) >= 8 else []
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


TEXTS = [
    "Pass PassWord: 'hunter2hunter' and API_KEY=abcdefgh, apikey : short",
    "token=token:abcdefghij secret=secret=abcdefgh12",
    "é token\t= abcdefghij; ſecret=abcdefghijk toKen=abcdefghijk",
    "AKIAABCDEFGHIJKL AKIASHORT xAKIAAKIAAKIAAKIA1 AKIA" + "Z" * 40,
    "f" * 31 + " " + "0a" * 16 + "g" + "f" * 33,
    "secret" + " " * 50_000 + "x token" + " " * 50_000 + "=abcdefghi",
    None,
    "",
    "\x0b token=\x0babcdefghi",
]


def test_base_kinds_equal_a_plain_walk(spark):
    rng = random.Random(5)
    parts = ["token", "SECRET", "=", ":", " ", "'", "abcdefgh", "0123456789abcdef", "AKIA", "ABCDEFGH", "é", "\n", "api_key", "passwd", "."]
    texts = TEXTS + ["".join(rng.choice(parts) for _ in range(60)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.start, secrets.KINDS.index(s.kind), s.end) for s in r.secrets if s.kind in secrets.BASE] for r in secrets.find_secrets(df).collect()}
    assert got == {i: slow_base(t) for i, t in enumerate(texts)}


def test_confirmed_spans_in_texts(spark):
    key, box = keys()["rsa"], ssh()
    wrapped = "\n".join(re.findall(".{1,64}", base64.b64encode(key).decode()))
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{wrapped}\n-----END RSA PRIVATE KEY-----"
    sealed = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00112233445566778899AABBCCDDEEFF\n\n" + base64.b64encode(b"x" * 64).decode() + "\n-----END RSA PRIVATE KEY-----"
    junk = "-----BEGIN RSA PRIVATE KEY-----\nMIIBOgIBAAJBAK\n-----END RSA PRIVATE KEY-----"
    good = {"pem_key": [pem, pem.replace("\n", "\\n"), sealed], "der_key": [base64.b64encode(keys()["ec"]).decode(), key.hex(), key.hex().upper()], "ssh_key": [base64.b64encode(box).decode(), box.hex()], "signed_token": [token("HS256", 32)]}
    rows = [(i, f"é {s} end", k, len(s)) for i, (k, s) in enumerate((k, s) for k in good for s in good[k])]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string, secrets int")
    for r in secrets.find_secrets(df, out="found").collect():
        mine = [(s.kind, s.start, s.end) for s in r.found if s.kind not in secrets.BASE]
        assert mine == [(r.kind, 2, 2 + r.secrets)], r
    bad = [junk, "M" * 500, "30" * 200, token("HS256", 20), "ey" * 1000 + "." + "a" * 50 + "." + "b" * 43, pem.replace("RSA PRIVATE", "RSA PUBLIC", 1)]
    for r in secrets.find_secrets(spark.createDataFrame([(x,) for x in bad], "text string")).collect():
        assert not [s for s in r.secrets if s.kind not in secrets.BASE], r


def test_query_columns(spark, tmp_path):
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], None, None, None)] * 2, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_structural_secrets(spark, str(tmp_path)).collect()
    assert len(got) == len(TEXTS) + 2 and got[0].asDict().keys() == {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"}
    for r in got:
        spans = slow_base(TEXTS[r.doc_id or 0])
        text = ",".join(f"{secrets.BASE[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.spans == text
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in spans) for n in range(3))
    assert secrets.find_secrets(df.limit(0)).count() == 0
    assert secrets.find_secrets(df.withColumn("secrets", F.lit(1))).count() == len(got)
