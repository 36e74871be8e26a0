"""Surrogates for personal data, by DataFrame operations only.

Entities are found by one pattern. Each distinct entity gets one surrogate for the whole table,
drawn from a keyed hash (HMAC), so the same person, address or number stays the same everywhere
and in each of its spellings (phone and card numbers are one whatever their separators). The
surrogate has the type and format of what it replaces: letters become letters of the same
script and case, digits digits, separators stay; phone numbers keep their country code, cards
their first digit and a right check digit, addresses stay valid and private ones private.

A person's name is found behind a title, with all its parts: given names, particles, surnames,
double names. Each of its words is one entity, whatever the title, and the same words are
replaced wherever else they stand in that text. A given name whose titles are all of one
gender keeps that gender; one that is seen with both is neutral. Particles, initials and
single letters before an apostrophe stay: they are format.

Surrogates are checked: two entities with one surrogate, or a surrogate that is an original of
the table, are drawn again with the next attempt, until all are distinct.

Only rows with entities are joined with their surrogates; other rows pass without a shuffle.
Equal texts are rendered once.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import staged

#: Titles by gender. Fixed values.
MALE = ("Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Господин")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mademoiselle", "Mme", "Señora", "Señorita", "Госпожа")
NEUTRAL = ("Dr", "Prof", "Professor")

#: Words of names that no one is known by. Fixed values.
PARTICLES = ("von", "van", "zu", "de", "der", "den", "del", "della", "di", "da", "dos", "du", "la", "le", "el", "al", "bin", "ibn", "y", "e")

_TOKEN = r"\p{L}\p{N}._%+\-"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLE = "|".join(sorted((*MALE, *FEMALE, *NEUTRAL), key=lambda x: (-len(x), x)))
EMAIL = rf"(?<![{_TOKEN}])[{_TOKEN}]++@[\p{{L}}\p{{N}}\-]++(?:\.[\p{{L}}\p{{N}}\-]++)*?\.\p{{L}}{{2,}}+"
PHONE = r"(?<![\p{L}\p{N}.+])(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\d)|(?<![\p{L}\p{N}.+])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<![\p{L}\p{N}.+\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\p{L}\d]|[.\-]\d)"
SSN = r"(?<![\p{L}\p{N}.+\-])\d{3}-\d{2}-\d{4}(?![\p{L}\d]|-\d)"
#: A number is a card's only with a right check digit; others stay.
CARD = r"(?<![\p{L}\p{N}.+\-])\d{4}(?:[ \-]\d{4}){3}(?![\p{L}\d])|(?<![\p{L}\p{N}.+\-])3\d{3}[ \-]\d{6}[ \-]\d{5}(?![\p{L}\d])|(?<![\p{L}\p{N}.+\-])\d{13,19}(?![\p{L}\d])"
IPV4 = rf"(?<![\p{{L}}\p{{N}}.+\-]){_OCTET}(?:\.{_OCTET}){{3}}(?![\p{{L}}\d]|\.\d)"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
KEY = r"(?<![\p{L}\p{N}])AKIA[0-9A-Z]{16}(?![\p{L}\p{N}])"
SECRET = r"(?i:(?<![\p{L}\p{N}])(?:token|password|passwd|secret|api_?key)\"? ?[=:] ?\"?)[0-9A-Za-z_\-+/]{8,}+"
_TITLES = rf"(?:(?:{_TITLE})(?!\p{{L}})\.?[ \u00a0])"
_WORD = rf"(?!(?:{_TITLE})(?!\p{{L}}))(?:\p{{Lu}}\.(?=[ \u00a0]\p{{Lu}})|\p{{Lu}}\p{{L}}*+(?:[\-'’]\p{{L}}++)*+)"
NAME = rf"(?<![\p{{L}}\p{{N}}]){_TITLES}++{_WORD}(?:[ \u00a0](?:(?:{'|'.join(PARTICLES)})[ \u00a0])*+{_WORD}){{0,3}}+"
#: In order of precedence: (type, pattern).
TYPES = (("email", EMAIL), ("key", KEY), ("secret", SECRET), ("ssn", SSN), ("phone", PHONE), ("card", CARD), ("ip", IPV4), ("iban", IBAN), ("name", NAME))
#: What every type begins with, tested once for each word: no letter or number before it, and a capital, a digit, `+`, `(`, the local part of an address or a secret's name.
START = rf"(?<![\p{{L}}\p{{N}}])(?=[\p{{Lu}}\d+(]|[{_TOKEN}]++@|(?i:token|pass|secret|api))"
PATTERN = rf"{START}(?:{'|'.join(p for _, p in TYPES)})"

#: Letters that surrogates of each script are made of. Fixed values.
LATIN = "abcdefghijklmnopqrstuvwxyz"
CYRILLIC = "абвгдежзиклмнопрстуфхцчшэюя"
GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
HAN = "安白北春东方高海和华江金林明南清山石天文西新雪阳月云正中"
SYLLABLES = ("ba", "ber", "dan", "del", "fa", "gor", "han", "jo", "kal", "ler", "lin", "ma", "mir", "nor", "pa", "rem", "ros", "sa", "ten", "vel", "vin", "wa", "yor", "zan")
SYLLABLES_CYRILLIC = ("ба", "бер", "ван", "дан", "за", "кал", "лер", "ли", "ма", "мир", "нор", "па", "рем", "рос", "са", "тен", "вел", "яр")
RESERVED = r"(?:^|\.)example\.(?:com|org|net)$"
KEY_DEFAULT = "surrogates"
#: Draws before the surrogates of what still collides get longer.
SAME_LENGTH = 8


def _kind(mention: Column) -> Column:
    return reduce(lambda rest, t: F.when(mention.rlike(rf"\A(?:{t[1]})\z"), t[0]).otherwise(rest), reversed(TYPES), F.lit("name"))


def _alnum(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def _part(kind: Column, value: Column, canon: Column, shape: Column, gender: Column | None = None) -> Column:
    gender = F.lit(None).cast("string") if gender is None else gender
    return F.struct(kind.alias("type"), value.alias("value"), canon.alias("canon"), shape.alias("shape"), gender.alias("gender"))


def _tokens(name: Column) -> Column:
    """A name's words and what stands between them."""
    return F.regexp_extract_all(name, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))


def _identifies(token: Column) -> Column:
    """True for a word of a name that is a name itself."""
    return token.rlike(r"\A\p{Lu}\p{L}+\z")


def _names_of(text: Column) -> Column:
    """The distinct words of the names that stand behind titles."""
    whole = F.regexp_extract_all(text, F.lit(NAME), F.lit(0))
    bare = F.transform(whole, lambda m: F.regexp_replace(m, rf"^{_TITLES}+", ""))
    return F.array_distinct(F.filter(F.flatten(F.transform(bare, _tokens)), _identifies))


def pattern_for(text: Column) -> Column:
    """The pattern of all mentions in a text: PATTERN, and the words of its names wherever they stand."""
    names = _names_of(text)
    again = F.concat(F.lit(rf"{PATTERN}|(?<![\p{{L}}\p{{N}}])(?=\p{{Lu}})(?:"), F.array_join(names, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    return F.when(F.size(names) > 0, again).otherwise(F.lit(PATTERN))


def _parts(m: Column) -> Column:
    """What a mention is made of, in order: (type or null for what stays, text, canonical form, what a surrogate is shaped after)."""
    none = F.lit(None).cast("string")

    def stays(value: Column) -> Column:
        return _part(none, value, none, none)

    kind = _kind(m)
    local, domain = F.regexp_extract(m, "^([^@]*)@", 1), F.regexp_extract(m, "@(.*)$", 1)
    host, top = F.regexp_extract(domain, r"^(.*)(\.[^.]*)$", 1), F.regexp_extract(domain, r"^(.*)(\.[^.]*)$", 2)
    email = F.array(_part(F.lit("email"), local, F.lower(m), _alnum(local)), stays(F.lit("@")), F.when(F.lower(domain).rlike(RESERVED), stays(host)).otherwise(_part(F.lit("domain"), host, F.lower(host), _alnum(host))), stays(top))
    lead = r"^((?i:(?:token|password|passwd|secret|api_?key)\"? ?[=:] ?\"?))(.*)$"
    secret = F.array(stays(F.regexp_extract(m, lead, 1)), _part(F.lit("secret"), F.regexp_extract(m, lead, 2), F.regexp_extract(m, lead, 2), _alnum(F.regexp_extract(m, lead, 2))))
    form = rf"^({_TITLES}*)(.*)$"
    titles, rest = F.regexp_extract(m, form, 1), F.regexp_extract(m, form, 2)
    tokens = _tokens(rest)
    gender = F.when(titles.rlike(rf"\b(?:{'|'.join(MALE)})\b"), "m").when(titles.rlike(rf"\b(?:{'|'.join(FEMALE)})\b"), "f")
    # only a first word with others after it is surely a given name
    given = F.when(F.coalesce(F.get(tokens, F.lit(1)), F.lit("")).rlike(r"^[ \u00a0]"), gender)
    word = lambda x, i: F.when(_identifies(x), _part(F.lit("name"), x, F.lower(x), F.lower(x), F.when(i == 0, given))).otherwise(stays(x))
    name = F.concat(F.array(stays(titles)), F.transform(tokens, word))
    no_card = (kind == "card") & (check_sum(_alnum(m)) != 0)
    return F.when(no_card, F.array(stays(m))).when(kind == "email", email).when(kind == "secret", secret).when(kind == "name", name).otherwise(F.array(_part(kind, m, F.when(kind == "ip", m).otherwise(_alnum(m)), F.when(kind == "ip", m).otherwise(_alnum(m)))))


def _number(stream: Column, i: Column) -> Column:
    """The i-th number of a stream of hexadecimal digits, 0 to 65535."""
    return F.conv(F.substring(stream, 4 * F.pmod(i - 1, F.lit(96)) + 1, F.lit(4)), 16, 10).cast("int")


def _pick(values: Column, n: int, v: Column) -> Column:
    return F.substring(values, (v % n + 1).cast("int"), F.lit(1))


def _fill(shape: Column, kind: Column, stream: Column) -> Column:
    """shape with each character replaced by one of its kind."""
    hexadecimal = kind.isin("secret") & shape.rlike("^[0-9a-f]+$")
    keep = F.when(kind == "phone", F.greatest(F.length(shape) - 10, F.lit(0))).when(kind == "card", 1).when(kind == "key", 4).when(kind == "iban", 2).otherwise(0)

    def one(i: Column) -> Column:
        c, v = F.substring(shape, i, F.lit(1)), _number(stream, i)
        digit = F.when((kind == "phone") & ((i == keep + 1) | (i == keep + 4)), (v % 8 + 2).cast("string")).otherwise((v % 10).cast("string"))
        return (
            F.when(i <= keep, c)
            .when(c.rlike("[0-9]"), digit)
            .when(hexadecimal, _pick(F.lit("abcdef"), 6, v))
            .when(c.rlike(r"\p{IsCyrillic}"), _pick(F.lit(CYRILLIC), len(CYRILLIC), v))
            .when(c.rlike(r"\p{IsGreek}"), _pick(F.lit(GREEK), len(GREEK), v))
            .when(c.rlike(r"\p{IsHan}"), _pick(F.lit(HAN), len(HAN), v))
            .otherwise(_pick(F.lit(LATIN), len(LATIN), v))
        )

    return F.when(F.length(shape) == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(shape), F.lit(1))), one), ""))


def check_sum(digits: Column) -> Column:
    """The sum, modulo ten, that is zero for a right check digit."""

    def one(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), one), F.lit(0), lambda a, x: a + x) % 10


def _card(shape: Column, filled: Column) -> Column:
    """filled with the last digit that gives it the check sum of shape."""
    head = F.substring(filled, F.lit(1), F.length(filled) - 1)
    return F.concat(head, F.pmod(check_sum(shape) - check_sum(F.concat(head, F.lit("0"))), F.lit(10)).cast("string"))


def _address(shape: Column, stream: Column) -> Column:
    octets = F.split(shape, r"\.")
    a, b = octets[0], octets[1]
    private = (a == "10") | (a == "127") | ((a == "192") & (b == "168")) | ((a == "172") & b.cast("int").between(16, 31))
    first = F.when(private, a).otherwise((_number(stream, F.lit(1)) % 100 + 11 + F.when(_number(stream, F.lit(1)) % 100 > 80, 60).otherwise(0)).cast("string"))
    second = F.when(private & (a == "192"), b).when(private & (a == "172"), (16 + _number(stream, F.lit(2)) % 16).cast("string")).otherwise((_number(stream, F.lit(2)) % 256).cast("string"))
    return F.concat_ws(".", first, second, (_number(stream, F.lit(3)) % 256).cast("string"), (1 + _number(stream, F.lit(4)) % 254).cast("string"))


def _named(shape: Column, gender: Column, stream: Column, longer: int) -> Column:
    """A made-up name of three syllables, in the script of shape; given names end as their gender does."""
    cyrillic = shape.rlike(r"\p{IsCyrillic}")

    def syllables(values: tuple[str, ...]) -> Column:
        listed = F.array(*map(F.lit, values))
        return F.concat(*(F.element_at(listed, (_number(stream, F.lit(i)) % len(values) + 1).cast("int")) for i in range(1, 4 + longer)))

    end = F.when(gender == "f", F.when(cyrillic, "ина").otherwise("ina")).when(gender == "m", F.when(cyrillic, "ор").otherwise("or")).otherwise("")
    return F.concat(F.when(cyrillic, syllables(SYLLABLES_CYRILLIC)).otherwise(syllables(SYLLABLES)), end)


def keyed_hash(key: str, message: Column) -> Column:
    """HMAC-SHA512 of a string under a key, in hexadecimal."""
    raw = key.encode()
    block = (hashlib.sha512(raw).digest() if len(raw) > 128 else raw).ljust(128, b"\0")
    inner, outer = (F.lit(bytes(x ^ y for x in block)) for y in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 512))), 512)


def with_surrogates(entities: DataFrame, key: str, attempt: int) -> DataFrame:
    """entities with the attempt-th draw for each in `drawn`: a function of the key, its type and its canonical form.

    The stream of hash digits and the filled shape are columns of their own, so each is computed once.
    """
    kind, shape, stream = F.col("type"), F.col("shape"), F.col("_stream")
    seed = F.concat_ws("\x1f", kind, "canon", F.lit(str(attempt)))
    longer = max(0, attempt - SAME_LENGTH + 1)
    streams = entities.withColumn("_stream", F.concat(*(keyed_hash(key, F.concat_ws("\x1f", F.lit(str(i)), seed)) for i in range(3))))
    filled = streams.withColumn("_filled", _fill(F.concat(shape, F.lit("0" * longer)) if longer else shape, kind, stream))
    drawn = F.when(kind == "name", _named(shape, F.col("gender"), stream, longer)).when(kind == "ip", _address(shape, stream)).when(kind == "card", _card(shape, F.col("_filled"))).otherwise(F.col("_filled"))
    return filled.withColumn("drawn", drawn).drop("_stream", "_filled")


def render(kind: Column, value: Column, drawn: Column) -> Column:
    """The surrogate in the spelling of value: its separators and its upper case."""
    whole = F.when(value == F.upper(value), F.upper(drawn)).when(F.substring(value, 1, 1) == F.upper(F.substring(value, 1, 1)), F.initcap(drawn)).otherwise(drawn)
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(acc: Column, c: Column) -> Column:
        d = F.substring(drawn, acc["at"], F.lit(1))
        d = F.when((c == F.upper(c)) & (c != F.lower(c)), F.upper(d)).otherwise(d)
        return F.when(c.rlike(r"[\p{L}\p{N}]"), F.struct(F.concat(acc["out"], d).alias("out"), (acc["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at")))

    filled = F.aggregate(F.split(value, ""), start, step, lambda acc: F.concat(acc["out"], F.substring(drawn, acc["at"], F.length(drawn))))
    return F.when(kind.isNull(), value).when(kind == "ip", drawn).when(kind == "name", whole).otherwise(filled)


def draw_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(type, canon, drawn) for distinct entities (type, canon, shape, gender): no two of a type share a surrogate, and none is an original."""
    pending, accepted = entities, None
    for attempt in range(64):
        drawn = staged(with_surrogates(pending, key, attempt), "drawn")
        first = drawn.groupBy("type", "drawn").agg(F.min("canon").alias("canon"))
        first = first.join(entities.select("type", F.col("shape").alias("drawn")), ["type", "drawn"], "left_anti")
        if accepted is not None:
            first = first.join(accepted.select("type", "drawn"), ["type", "drawn"], "left_anti")
        first = first.select("type", "canon", F.lit(True).alias("good"))
        state = staged(drawn.join(first, ["type", "canon"], "left"), "surrogates")
        good, pending = state.where("good").select("type", "canon", "drawn"), state.where("good is null").select("type", "canon", "shape", "gender")
        accepted = good if accepted is None else accepted.union(good)
        if pending.isEmpty():
            return accepted
    raise RuntimeError("surrogates still collide")


def find_mentions(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per part of a mention in each distinct text: (k, pos, sub, type, value, canon, shape, gender)."""
    # the outer explode keeps Spark from filtering by the size of what it would have to extract twice
    found = docs.where(F.col(text_col).rlike(PATTERN)).select(F.md5(F.col(text_col)).alias("k"), F.regexp_extract_all(F.col(text_col), pattern_for(F.col(text_col)), F.lit(0)).alias("m"))
    each = found.select("k", F.posexplode_outer("m").alias("pos", "mention")).groupBy("k", "pos").agg(F.min("mention").alias("mention"))
    return each.select("k", "pos", F.posexplode(_parts(F.col("mention"))).alias("sub", "part")).select("k", "pos", "sub", "part.*")


def replace_personal_data(docs: DataFrame, key: str = KEY_DEFAULT, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with surrogates in text_col, and the number of mentions replaced in count_col if that is given.

    A null text stays null with 0 mentions; a text without entities stays as it is. Repeated
    rows get equal texts. An empty table stays empty, texts of any length are read whole. No
    other column is read, and their names don't matter, but a column named count_col is
    replaced.
    """
    if count_col is not None:
        docs = docs.drop(count_col)
    parts = staged(find_mentions(docs, text_col), "mentions")
    entities = staged(parts.where("type is not null").groupBy("type", "canon").agg(F.min("shape").alias("shape"), F.when(F.min("gender") == F.max("gender"), F.min("gender")).alias("gender")), "entities")
    drawn = draw_surrogates(entities, key)
    done = parts.join(drawn, ["type", "canon"], "left").select("k", "pos", "sub", (F.col("type").isNotNull()).cast("int").alias("is"), render(F.col("type"), F.col("value"), F.col("drawn")).alias("out"))
    each = done.groupBy("k", "pos").agg(F.max("is").alias("is"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sub", "out"))), lambda x: x["out"]), "").alias("out"))
    new = each.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "out"))), lambda x: x["out"]).alias("new"), F.sum("is").cast("int").alias("found")).withColumnRenamed("k", "_k")
    text = F.col(text_col)
    has = F.coalesce(text.rlike(PATTERN), F.lit(False))
    counted = [] if count_col is None else [count_col]
    plain = docs.where(~has).select(*docs.columns, *(F.lit(0).alias(c) for c in counted))
    held = docs.where(has).select(F.struct(*docs.columns).alias("_row"), F.md5(text).alias("_k")).join(new, "_k")
    old = F.col("_row")[text_col]
    gaps = F.split(old, pattern_for(old), -1)
    changed = F.array_join(F.zip_with(gaps, F.col("new"), lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")
    return plain.union(held.select(*(changed.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns), *(F.col("found").alias(c) for c in counted)))
