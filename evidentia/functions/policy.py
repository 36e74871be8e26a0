"""Scalar rules of plans, responses, messages and wire forms, all built-in expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import stable_id

#: Syntax of plan fields. Fixed values.
KEYWORD = r"^[A-Za-z][A-Za-z0-9_]*$"
METHOD = r"^[A-Z][A-Z0-9!#$%&'*+.^_`|~-]*$"
HEADER = r"^[!#$%&'*+.^_`|~0-9A-Za-z-]+$"
DELAY = r"^\d+(?:\.\d+)?(?:-\d+(?:\.\d+)?)?$"
#: Bytes of a bounded message and of a preview.
MESSAGE, PREVIEW = 4096, 240


def _fits(value: Column, pattern: str) -> Column:
    return F.coalesce(value.rlike(pattern), F.lit(False))


def valid_keyword(value: Column) -> Column:
    return _fits(value, KEYWORD)


def valid_method(value: Column) -> Column:
    """A method after upper-casing."""
    return _fits(F.upper(value), METHOD)


def valid_header(value: Column) -> Column:
    return _fits(value, HEADER)


def valid_delay(value: Column) -> Column:
    """Seconds or a range of seconds; no delay at all is valid."""
    return value.isNull() | _fits(value, DELAY)


def span_ok(file: Column, line: Column, end_line: Column, column: Column, end_column: Column) -> Column:
    """A relative path that never climbs, lines from one on, an end not before the start."""
    path = ~file.startswith("/") & (file != "") & ~F.array_contains(F.split(file, "/"), "..")
    columns = F.coalesce(column > 0, F.lit(True)) & F.coalesce(end_column > 0, F.lit(True))
    order = end_line.isNull() | (end_line > line) | ((end_line == line) & F.coalesce(end_column >= column, F.lit(True)))
    return F.coalesce(path & (line > 0) & columns & order, F.lit(False))


def cut_utf8(text: Column, most: int) -> Column:
    """The longest beginning of a text within `most` bytes that cuts no character."""
    raw = F.encode(text, "UTF-8")
    byte = lambda n: F.conv(F.hex(F.substring(raw, n, F.lit(1))), 16, 10).cast("int")
    # the byte after the cut begins a character unless it is a continuation
    inside = lambda n: F.coalesce(byte(n + 1).between(128, 191), F.lit(False))
    end = F.when(~inside(F.lit(most)), most).when(~inside(F.lit(most - 1)), most - 1).when(~inside(F.lit(most - 2)), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substring(raw, F.lit(1), end), "UTF-8"))


def bounded_message(message: Column) -> Column:
    """A message of MESSAGE bytes at most, the dots of a cut included."""
    return F.when(F.octet_length(message) <= MESSAGE, message).otherwise(F.concat(cut_utf8(message, MESSAGE - 3), F.lit("...")))


def preview(text: Column) -> Column:
    """The beginning of a text and whether more follows."""
    return F.struct(cut_utf8(text, PREVIEW).alias("preview"), (F.octet_length(text) > PREVIEW).alias("truncated"))


def request_id(action: Column, subject_type: Column, subject: Column) -> Column:
    return stable_id("request", action, subject_type, subject)


def replay_seed_id(request: Column) -> Column:
    return stable_id("replay", request)


def put_path(base: Column, keyword: Column) -> Column:
    """The address with a path segment more."""
    return F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), keyword)


def put_query(base: Column, name: Column, keyword: Column) -> Column:
    """The address with a parameter more."""
    return F.concat(base, F.when(F.contains(base, F.lit("?")), "&").otherwise("?"), name, F.lit("="), keyword)


def percent_encoded(value: Column) -> Column:
    return F.replace(F.replace(F.url_encode(value), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))


def render_template(template: Column, values: dict[str, Column]) -> Column:
    """(raw, percent, form): the template with each keyword replaced by its value as it is, percent-encoded and form-encoded."""
    put = lambda code: reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), code(kv[1])), values.items(), template)
    return F.struct(put(lambda v: v).alias("raw"), put(percent_encoded).alias("percent"), put(F.url_encode).alias("form"))


def route_path(path: Column, payload: Column, encode: bool = True) -> Column:
    """A route with its first token replaced by the payload; a route without a token stays."""
    token = r"/[:*][A-Za-z_][A-Za-z0-9_]*"
    before = F.regexp_extract(path, rf"^(.*?){token}", 1)
    after = F.regexp_extract(path, rf"^.*?{token}(.*)$", 1)
    return F.when(path.rlike(token), F.concat(before, F.lit("/"), percent_encoded(payload) if encode else payload, after)).otherwise(path)


def lock_directness(level: Column) -> Column:
    return F.when(level == 0, "direct").when(level > 0, "transitive")


def dependency_source(options: Column) -> Column:
    """Where a dependency comes from, by the options of its declaration: github, git, path, else the registry."""
    has = lambda k: F.map_contains_key(options, F.lit(k))
    return F.when(has("github"), "github").when(has("git"), "git").when(has("path"), "path").otherwise("hex")


def response_fields(response: Column) -> Column:
    """status, body and content type of an observation (map): the first key that is there, headers by name in any case."""
    first = lambda *keys: F.coalesce(*(F.try_element_at(response, F.lit(k)) for k in keys))
    header = F.element_at(F.map_values(F.map_filter(response, lambda k, _: F.lower(k).isin("content-type", "content_type"))), 1)
    return F.struct(first("status", "status_code").try_cast("int").alias("status"), first("body", "resp_body").alias("body"), header.alias("content_type"))


def seal(fields: Column) -> Column:
    """(json, digest): a row as JSON with its keys in order, and its SHA-256."""
    text = F.to_json(fields)
    return F.struct(text.alias("json"), F.sha2(text, 256).alias("digest"))


def verify_seal(text: Column, digest: Column) -> Column:
    return F.when(digest.isNull() | (digest == ""), "missing_digest").when(F.sha2(text, 256) == digest, "ok").otherwise("digest_mismatch")


def wire_value(value: Column) -> Column:
    """A raw value as what may leave: its size and digest, never itself."""
    return F.struct(F.octet_length(value).cast("long").alias("size"), F.sha2(value, 256).alias("sha256"))


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def _criteria(c: dict) -> list[Column]:
    """The tests of one side of a response filter, each false for a null."""

    def within(column: str, wanted) -> Column:  # noqa: ANN001
        if wanted == "all":
            return F.col(column).isNotNull()
        each = [F.col(column).between(*w) if isinstance(w, tuple) else F.col(column) == w for w in (wanted if isinstance(wanted, list) else [wanted])]
        return _any(each)

    out = [within(column, c[name]) for name, column in (("codes", "status"), ("lines", "lines"), ("words", "words"), ("size", "length")) if name in c]
    if "regex" in c:
        out.append(F.col("body").rlike(c["regex"]))
    if "time" in c:
        way, millis = c["time"]
        out.append(F.col("millis") > millis if way == "gt" else F.col("millis") < millis)
    return [F.coalesce(x, F.lit(False)) for x in out]


def response_filter(matchers: dict, filters: dict, matcher_mode: str = "or", filter_mode: str = "or") -> Column:
    """True for a response (status, lines, words, length, millis, body) to keep: it meets any or all matchers, and not any or all filters.

    Criteria: codes ("all", or numbers and (from, to) pairs), lines, words, size, regex, time
    ("gt" or "lt", milliseconds). A side without criteria matches nothing.
    """
    fold = {"or": _any, "and": lambda parts: reduce(lambda a, b: a & b, parts)}
    side = lambda c, mode: fold[mode](_criteria(c)) if c else F.lit(False)
    return side(matchers, matcher_mode) & ~side(filters, filter_mode)


def cache_partition(first: Column, direct: Column, served: Column, status: Column, first_key: Column, second_key: Column) -> Column:
    """One partition's value served to another: a hit of an equal key, where the direct answer differs; what proves neither is skipped."""
    leak = (status == "hit") & first_key.eqNullSafe(second_key) & served.eqNullSafe(first)
    return F.when(first.eqNullSafe(direct), "skip").when(served.eqNullSafe(direct), "pass").when(F.coalesce(leak, F.lit(False)), "violation").otherwise("skip")


def judged(holds: Column) -> Column:
    """The result of a predicate that the caller supplies (of authorization, of a pair of observations, or any other): null is skipped."""
    return F.when(holds.isNull(), "skip").when(holds, "pass").otherwise("violation")


#: `name=value` of an authentication header: a token or a quoted string. Fixed syntax.
_TOKEN = r"[!#$%&'*+.^_`|~0-9A-Za-z-]+"
_PARAM = rf'({_TOKEN})\s*=\s*({_TOKEN}|"(?:[^"\\]|\\.)*")'
HEADER_BYTES, HEADER_PARAMS = 16_384, 128


def auth_params(header: Column) -> Column:
    """(status, scheme, params): parsed, malformed, or incomplete beyond the bounds; params keep their order and duplicates, as (name, value, quoted)."""
    rest = F.regexp_extract(header, rf"^\s*{_TOKEN}\s+(.*?)\s*$", 1)
    names = F.regexp_extract_all(rest, F.lit(_PARAM), F.lit(1))
    raw = F.regexp_extract_all(rest, F.lit(_PARAM), F.lit(2))
    quoted = lambda v: v.startswith('"')
    bare = lambda v: F.when(quoted(v), F.regexp_replace(F.substr(v, F.lit(2), F.length(v) - 2), r"\\(.)", "$1")).otherwise(v)
    params = F.zip_with(names, raw, lambda n, v: F.struct(F.lower(n).alias("name"), bare(v).alias("value"), quoted(v).alias("quoted")))
    whole = header.rlike(rf"^\s*{_TOKEN}\s+{_PARAM}(?:\s*,\s*{_PARAM})*\s*$")
    status = F.when(header.isNull() | (F.octet_length(header) > HEADER_BYTES) | (F.size(names) > HEADER_PARAMS), "incomplete").when(whole, "parsed").otherwise("malformed")
    return F.struct(status.alias("status"), F.when(status == "parsed", F.lower(F.regexp_extract(header, rf"^\s*({_TOKEN})", 1))).alias("scheme"), F.when(status == "parsed", params).alias("params"))


def quoted_parameter(header: Column, scheme: str, name: str, value: Column) -> Column:
    """A header of the scheme whose parameter stands once, quoted, with the value it was given; malformed headers violate, too large ones are skipped."""
    a = auth_params(header)
    own = F.filter(a["params"], lambda p: p["name"] == name.lower())
    good = (a["scheme"] == scheme.lower()) & (F.size(own) == 1) & F.get(own, F.lit(0))["quoted"] & (F.get(own, F.lit(0))["value"] == value)
    return F.when(a["status"] == "incomplete", "skip").when(F.coalesce((a["status"] == "parsed") & good, F.lit(False)), "pass").otherwise("violation")


#: Kinds of unsafe control sequences, in the order that they are tried. Fixed values.
SEQUENCES = (("osc", "\\x1b\\][^\\x07\\x1b]*(?:\\x07|\\x1b\\\\)?"), ("csi", "\\x1b\\[[0-?]*[ -/]*[@-~]"), ("escape", "\\x1b"), ("c1", "[\\x{80}-\\x{9f}]"), ("control", "[\\x00-\\x08\\x0b-\\x1f\\x7f]"))


def terminal_sequences(text: Column, most: int = 16) -> Column:
    """The kinds of the first unsafe control sequences of a text, in order; colours, tabs and line breaks are safe."""
    found = F.regexp_extract_all(text, F.lit("|".join(p for _, p in SEQUENCES)), F.lit(0))
    unsafe = F.filter(found, lambda x: ~x.rlike("^\\x1b\\[[0-9;]*m$"))
    label = lambda x: reduce(lambda rest, k: F.when(x.rlike(f"^(?:{k[1]})$"), k[0]).otherwise(rest), reversed(SEQUENCES), F.lit("escape"))
    return F.transform(F.slice(unsafe, 1, most), label)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def canonical_ip(text: Column) -> Column:
    """(kind, value): a dotted address without leading zeros, an address with colons in its shortest form, else a host name in lower case without its last dot; nulls for none of these."""
    four = text.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?!$)|$)){4}$")
    name = F.lower(F.rtrim(text, F.lit(".")))
    host = name.rlike(r"^(?=.{1,253}$)(?:[a-z0-9_](?:[a-z0-9_-]{0,61}[a-z0-9_])?)(?:\.[a-z0-9_](?:[a-z0-9_-]{0,61}[a-z0-9_])?)*$") & ~name.rlike(r"^[0-9.]+$")

    def judged_by(six: Column) -> Column:
        kind = F.when(four, "ipv4").when(six.isNotNull(), "ipv6").when(host, "host")
        return F.struct(kind.alias("kind"), F.when(four, text).when(six.isNotNull(), compressed(six)).when(host, name).alias("value"))

    return _let(ipv6_groups(text), judged_by)


_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_GROUPS = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*"


def ipv6_groups(text: Column) -> Column:
    """The eight numbers of an address with colons; null if it is none. A dotted end counts as two groups."""
    dotted = F.regexp_extract(text, rf":({_OCTET}(?:\.{_OCTET}){{3}})$", 1)

    def hexadecimal(octet: Column) -> Column:
        pair = lambda i: F.lower(F.hex(octet[i].try_cast("int") * 256 + octet[i + 1].try_cast("int")))
        return F.when(F.size(octet) < 4, text).otherwise(F.concat(F.regexp_extract(text, "^(.*:)", 1), pair(0), F.lit(":"), pair(2)))

    def parted(halves: Column) -> Column:
        groups = lambda h: F.filter(F.split(h, ":"), lambda g: g != "")
        return _let(F.struct(groups(halves[0]).alias("l"), groups(F.coalesce(F.get(halves, F.lit(1)), F.lit(""))).alias("r"), (F.size(halves) == 2).alias("gap")), filled)

    def filled(h: Column) -> Column:
        free = 8 - F.size(h["l"]) - F.size(h["r"])
        zeros = F.when(h["gap"] & (free > 0), F.array_repeat(F.lit("0"), free)).otherwise(F.array().cast("array<string>"))
        return F.concat(h["l"], zeros, h["r"])

    # one double colon at most, and none of the single ones at an end
    form = rf"^(?:{_GROUPS})?(?:::(?:{_GROUPS})?)?$"
    whole = lambda plain: F.when(plain.rlike(form) & F.contains(plain, F.lit(":")), parted(F.split(plain, "::")))
    groups = _let(_let(F.split(dotted, r"\."), hexadecimal), whole)
    return _let(groups, lambda g: F.when(F.size(g) == 8, F.transform(g, lambda x: F.conv(x, 16, 10).cast("int"))))


def compressed(groups: Column) -> Column:
    """Eight groups as text: the first of the longest runs of two zeros or more is left out."""

    def shorter(text: Column) -> Column:
        out = text
        for n in range(2, 9):  # the longest run is tried last, so it is the one that counts
            run = ":".join(["0"] * n)
            at = rf"^((?:[0-9a-f]+:)*?){run}(?=:|$):?(.*)$"
            cut = F.concat(F.regexp_replace(F.regexp_extract(text, at, 1), ":$", ""), F.lit("::"), F.regexp_extract(text, at, 2))
            out = F.when(text.rlike(rf"(?:^|:){run}(?:$|:)"), cut).otherwise(out)
        return out

    return _let(F.array_join(F.transform(groups, lambda g: F.lower(F.hex(g))), ":"), shorter)


def masked(groups: Column, prefix: Column) -> Column:
    """The groups of an address with all bits beyond a prefix of 0 to 128 cleared."""

    def one(g: Column, i: Column) -> Column:
        size = F.pow(F.lit(2), 16 - F.least(F.greatest(prefix - 16 * i, F.lit(0)), F.lit(16))).cast("int")
        return (F.floor(g / size) * size).cast("int")

    return F.transform(groups, one)


def in_network(address: Column, network: Column, prefix: Column) -> Column:
    """True where an address's groups lie in the network of a prefix of 0 to 128 bits."""
    return masked(address, prefix) == masked(network, prefix)
