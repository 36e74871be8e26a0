import os

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.staged(stage(spark, docs, SF), name)
        assert docs.columns == list(pipeline.COLUMNS)
        assert 0 < docs.count() <= 3 * n
    pieces = pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.where("length > 0 AND offset + length <= 2048").count() == pieces.count() > 0


ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "the red dog and the cat", "en", "a", 5), (3, "the dog " * 30_000, "en", None, 9), (4, "der hund und die katze " * 4, "de", "b", 1), (5, "der hund und die katze " * 4, "de", "b", 1), (6, "the dog and a cat by the sea Mr John Berg", "en", "b", 2)]


def test_stages_take_odd_rows_and_empty_tables(spark):
    """Null, empty and very long texts, repeated rows, null ids and further columns pass each stage or are rejected, and an empty table stays one."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    more = [(100 + i, f"the {w} and the dog of the house" if i % 2 else f"der {w} und die katze im haus", "en" if i % 2 else "de", "a", 1) for i, w in enumerate("abcdefghijklmnop")]
    docs = spark.createDataFrame([*ODD, *more], schema).selectExpr("*", "1 AS size", "2 AS score", "3 AS _n")
    empty = docs.limit(0)
    for name, stage in pipeline.STAGES[:-1]:
        before = docs.count()
        docs = pipeline.staged(stage(spark, docs, SF), name)
        empty = pipeline.staged(stage(spark, empty, SF), name)
        assert docs.columns == [*pipeline.COLUMNS, "size", "score", "_n"] == empty.columns and empty.count() == 0
        left = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "language_id":
            assert {d for d, _ in left} >= {None, 3, 4, 5, 6, 100} and not {d for d, _ in left} & {1, 2}
        if name == "simhash_near_dedup":
            assert [d for d, _ in left].count(4) == 1 and 5 not in {d for d, _ in left} and len(left) < before
        if name == "surrogates":
            assert not any("John" in t or "Berg" in t for _, t in left) and len(left) == before
            assert all(r.n_chars == len(r.text) for r in docs.collect())
    pieces = pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.count() > 0 and pipeline.STAGES[-1][1](spark, empty, SF).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stages_equal_brute_force(spark):
    """Each stage against a plain Python version of it on the rows that it was given."""
    import hashlib
    import re
    from collections import Counter

    import xxhash
    from tokenizers import Tokenizer

    from evidentia.llm import langid, mixing, packing

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = [tuple(r) for r in docs.collect()]
    out = []
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.staged(stage(spark, docs, SF), name)
        out.append([tuple(r) for r in docs.collect()])
    known, single, changed, mixed = out
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    names, scores = langid.predict(model, [t for _, t, *_ in before])
    assert sorted(known) == sorted(r for r, n, s in zip(before, names, scores, strict=True) if n != "und" and s >= pipeline.CERTAIN)
    assert sum(n == lang for n, (_, _, lang, *_) in zip(names, before, strict=True) if lang) > 0.95 * len(known)

    def bits(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        h = [xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in (zip(w, w[1:], w[2:], strict=False) if len(w) > 2 else [w] if w else [])]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    prints = {r[0]: bits(r[1]) for r in known}
    group = {d: d for d in prints}
    for _ in prints:
        new = {d: min(group[x] for x in prints if (prints[x] ^ prints[d]).bit_count() <= 2) for d in prints}
        if new == group:
            break
        group = new
    assert sorted(single) == sorted(r for r in known if group[r[0]] == r[0])
    assert [r[0] for r in sorted(changed)] == [r[0] for r in sorted(single)] and all(r[4] == len(r[1]) for r in changed)
    assert sum(a[1] != b[1] for a, b in zip(sorted(single), sorted(changed), strict=True)) > 0
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    total = Counter()
    for _, t, _, source, _ in changed:
        total[source] += size(t)
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(total))}
    stopped, level = set(), None
    while True:
        level = (sum(total.values()) - sum(3 * total[s] for s in stopped)) / max(1e-9, sum(weight[s] for s in total if s not in stopped))
        more = {s for s in total if s not in stopped and level * weight[s] > 3 * total[s]}
        if not more:
            break
        stopped |= more
    want = Counter()
    for r in changed:
        rate = 3.0 if r[3] in stopped else min(3.0, level * weight[r[3]] / total[r[3]]) if total[r[3]] else 0.0
        draw = int(hashlib.md5(f"{mixing.SEED}:{r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        want[r] = int(rate) + (draw < rate - int(rate))
    assert Counter(mixed) == +want
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    pieces = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    ids = Counter()
    for p in pieces:
        ids[p.doc_id] += p.length
    assert ids == Counter({d: n * (len(tokenizer.encode(t, add_special_tokens=False).ids) + 1) for (d, t, *_), n in Counter(mixed).items()})
    at = sorted((p.sequence_id * 2048 + p.offset, p.length) for p in pieces)
    assert all(a + n == b for (a, n), (b, _) in zip(at, at[1:], strict=False)) and at[0][0] == 0
