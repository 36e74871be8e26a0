import random
import re
from collections import Counter

import pytest

from evidentia.llm import phrases, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def slow_counts(rows):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    return f, n


def slow_rows(rows, least=10, top=2000):
    f, n = slow_counts(rows)
    out = {}
    for (lang, w), a in f.items():
        if len(w) < 2 or a < least:
            continue
        score, _, left, right = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out[lang, w] = (" ".join(w), a, left, right, n[lang], score)
    longer = Counter()
    for (lang, w), row in out.items():
        if len(w) == 3:
            for part in (w[:2], w[1:]):
                longer[lang, part] = max(longer[lang, part], row[1])
    kept = {}
    for (lang, w), row in out.items():
        if not (len(w) == 2 and longer[lang, w] and 100 * longer[lang, w] >= 50 * row[1]):
            kept.setdefault(lang, []).append(row)
    return {(lang, i + 1): row for lang, found in kept.items() for i, row in enumerate(sorted(found, key=lambda r: (-r[5], -r[1], r[0].encode()))[:top])}


def table(seed, n=250):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(60)] + ["Ä", "ß", "New", "new", "\xa0", "a\x00b", "x" * 300]
    rows = []
    for i in range(n):
        w = [rng.choice(base) if rng.random() < 0.7 else "new york city" for _ in range(rng.randrange(0, 90))]
        text = "".join(x + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", " ?", "\x0b"]) for x in w)
        rows.append((i, text, rng.choice(["en", "en", "de", None, "und"]), "a", 0))
    return [*rows, *rows[:20], (None, None, "en", None, None), (7, "", "fr", "", 0), (8, "... \t", "es", "", 0), (9, "one two", "it", "", 0), (10, "lone " * 30_000, "la", "", 0)]


@pytest.mark.parametrize(("sample", "block"), [(1 << 30, 1 << 23), (3000, 1 << 23), (0, 500), (3000, 97)])
def test_counts_equal_brute_force_whatever_the_sample(spark, monkeypatch, sample, block):
    monkeypatch.setattr(phrases, "BLOCK", block)
    rows = table(1)
    f, n = slow_counts(rows)
    got = {(r.lang, r.phrase): r.c for r in phrases.frequent_phrases(spark.createDataFrame(rows, SCHEMA), sample=sample).collect()}
    want = {(lang, " ".join(w)): c for (lang, w), c in f.items() if c >= 10} | {(lang, ""): c for lang, c in n.items() if c}
    assert got == want


def test_each_phrase_is_counted_in_one_pass_only(spark):
    df = spark.createDataFrame(table(2), SCHEMA)
    got = phrases.frequent_phrases(df, sample=2000)
    assert got.count() == got.select("lang", "k", "phrase").distinct().count()


def test_full_bitmaps_count_more_and_not_less(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MOST_BITS", 1 << 15)
    monkeypatch.setattr(phrases, "SPARSE", 1)
    rows = table(3, 80)
    got = {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(spark.createDataFrame(rows, SCHEMA), sample=1000).collect()}
    assert got == slow_rows(rows)


def test_query_equals_brute_force(spark, tmp_path, monkeypatch):
    rows = table(4)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_toivonen_phrases(spark, str(tmp_path))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {(r.lang, r["rank"]): tuple(r)[2:] for r in got.collect()} == slow_rows(rows)
    few = phrases.collocations(spark.createDataFrame(rows, SCHEMA), top=7)
    assert {(r.lang, r["rank"]): tuple(r)[2:] for r in few.collect()} == slow_rows(rows, top=7)


def test_large_counts_are_exact(spark, monkeypatch):
    big = 3_000_000_000_017
    counts = [("en", 0, "", 9 * big), ("en", 1, "a", 3 * big), ("en", 1, "b", 2 * big + 1), ("en", 2, "a b", 2 * big)]
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *_: spark.createDataFrame(counts, "lang string, k int, phrase string, c long"))
    r = phrases.collocations(None).first()
    assert (r.a, r.l, r.r, r.score) == (2 * big, 3 * big, 2 * big + 1, 1_000_000 * 4 * big * big // (3 * big * (2 * big + 1)))


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame(table(5, 30), SCHEMA)
    assert phrases.collocations(df.limit(0)).count() == 0
    clash = df.withColumnsRenamed({"doc_id": "phrase", "source": "k", "n_chars": "c"})
    assert phrases.collocations(clash).count() == phrases.collocations(df).count() > 0
