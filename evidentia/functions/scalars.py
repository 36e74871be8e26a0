"""Scalar expressions: identifiers, lengths, URLs, addresses, payloads and syntax checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(source: str | Column, *parts: Column) -> Column:
    """source:sha256 of the source and ordered parts; each part carries its length, so borders are unambiguous. A null part differs from an empty one."""
    name = F.lit(source) if isinstance(source, str) else source
    coded = [F.coalesce(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string"), F.lit(";")), F.lit("-;")) for p in parts]
    return F.concat(name, F.lit(":"), F.sha2(F.concat(F.lit("v1|"), name, F.lit("|"), *coded), 256))


def fingerprint(value: Column) -> Column:
    return F.sha2(value, 256)


def text_lengths(text: Column) -> Column:
    """Bytes, code points and grapheme clusters of a text."""
    return F.struct(F.octet_length(text).cast("long").alias("bytes"), F.length(text).cast("long").alias("codepoints"), F.regexp_count(text, F.lit(r"\X")).cast("long").alias("graphemes"))


def versioned_id_ok(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^[a-z0-9][a-z0-9._-]*\.v[1-9][0-9]*$"), F.lit(False))


def split_mfa(value: Column) -> Column:
    """module, function and arity of `Module.function/arity`; nulls where it is none."""
    form = r"^(.+)\.([^./]+)/(\d+)$"
    ok = value.rlike(form)
    return F.struct(*(F.when(ok, F.regexp_extract(value, form, i).cast(kind)).alias(name) for i, (name, kind) in enumerate((("module", "string"), ("function", "string"), ("arity", "int")), 1)))


_URL = r"^(?i)(https?)://([^/?#:@]+)(?::(\d+))?(/[^?#]*)?(\?[^#]*)?$"


def normalize_url(url: Column) -> Column:
    """http and https addresses in lower-cased scheme and host with a path; null for others, for user information, fragments and ports out of range."""
    u = F.trim(url)
    port = F.regexp_extract(u, _URL, 3)
    ok = u.rlike(_URL) & ((port == "") | port.try_cast("int").between(1, 65535))
    path = F.regexp_extract(u, _URL, 4)
    return F.when(ok, F.concat(F.lower(F.regexp_extract(u, _URL, 1)), F.lit("://"), F.lower(F.regexp_extract(u, _URL, 2)), F.when(port == "", "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path), F.regexp_extract(u, _URL, 5)))


def url_origin(url: Column) -> Column:
    """scheme, host and port, which defaults to the scheme's."""
    u = normalize_url(url)
    scheme, host, port = (F.regexp_extract(u, _URL, i) for i in (1, 2, 3))
    return F.when(u.isNotNull(), F.struct(scheme.alias("scheme"), host.alias("host"), F.when(port != "", port.cast("int")).when(scheme == "https", 443).otherwise(80).alias("port")))


def canonical_path(path: Column) -> Column:
    """A path percent-decoded once, with `.` and `..` resolved from the root; null if an escape is malformed."""
    bad = path.rlike("%(?![0-9A-Fa-f]{2})")
    parts = F.split(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "/")
    empty = F.array().cast("array<string>")
    kept = F.aggregate(parts, empty, lambda acc, p: F.when((p == "") | (p == "."), acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)))
    return F.when(~bad, F.concat(F.lit("/"), F.array_join(kept, "/")))


def ip_to_int(ip: Column) -> Column:
    """A dotted address as a long; null if it is none."""
    octets = F.split(ip, r"\.")
    ok = ip.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.|$)){4}$") & ~ip.endswith(".")
    return F.when(ok, reduce(lambda a, b: a * 256 + b, (octets[i].try_cast("long") for i in range(4))))


def cidr_mask(prefix: Column) -> Column:
    """The network mask of a prefix of 0 to 32."""
    return F.lit(4294967296) - F.pow(F.lit(2), 32 - prefix).cast("long")


def payload_variants(value: Column) -> Column:
    """The distinct spellings of a payload: as it is, with a space on either side, doubled, in upper case, form-encoded."""
    return F.array_distinct(F.array(value, F.concat(F.lit(" "), value), F.concat(value, F.lit(" ")), F.concat(value, value), F.upper(value), F.url_encode(value)))


def route_params(path: Column) -> Column:
    """The `:name` and `*glob` tokens of a route, in order."""
    return F.transform(F.regexp_extract_all(path, F.lit(r"/([:*][A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)), lambda t: F.struct(F.when(t.startswith(":"), "param").otherwise("glob").alias("kind"), F.substring(t, 2, 1 << 20).alias("name")))


def input_signature(inputs: Column, keywords: Column) -> Column:
    """The entries of declared keywords, sorted by keyword."""
    return F.array_sort(F.map_entries(F.map_filter(inputs, lambda k, _: F.array_contains(keywords, k))))


def verdict_text(tool: Column, verdict: Column, findings: Column) -> Column:
    return F.concat(tool, F.lit(": "), verdict, F.lit(" ("), findings.cast("string"), F.when(findings == 1, F.lit(" finding)")).otherwise(F.lit(" findings)")))
