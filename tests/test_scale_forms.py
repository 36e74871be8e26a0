"""The forms that keep hot groups apart, against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from evidentia.operators import facts, policy, report


def ranks_of(spark, rows):
    got = report.latency_percentiles(spark.createDataFrame(rows, "k string, sample long"), ["k"]).collect()
    med = {r.k: r["median"] for r in report.upper_median(spark.createDataFrame(rows, "k string, sample long"), ["k"]).collect()}
    groups = defaultdict(list)
    for k, x in rows:
        if x is not None:
            groups[k].append(x)
    want = {}
    for k, xs in groups.items():
        xs.sort()
        want[k] = (xs[-(-len(xs) * 50 // 100) - 1], xs[-(-len(xs) * 95 // 100) - 1], len(xs), xs[len(xs) // 2])
    assert {r.k: (r.p50, r.p95, r.n, med[r.k]) for r in got} == want


@pytest.mark.parametrize("few", [1, 40])
def test_ranks_of_heavy_tails_and_ties(spark, monkeypatch, few):
    monkeypatch.setattr(report, "FEW", few)
    rng = random.Random(8)
    rows = [("tail", rng.randrange(1000)) for _ in range(2000)] + [("tail", 10**14)]
    rows += [("tied", 7)] * 1500 + [("tied", rng.randrange(20)) for _ in range(100)]
    rows += [("two", 1)] * 500 + [("two", 2)] * 500 + [("between", x) for x in [1] * 500 + list(range(2, 40)) + [99] * 500]
    rows += [("one", 5), ("none", None), ("same", 3), ("same", 3), ("neg", -(10**15)), ("neg", 4), ("neg", 10**15)]
    ranks_of(spark, rows)


def test_no_window_holds_more_than_few_samples(spark, monkeypatch):
    monkeypatch.setattr(report, "FEW", 100)
    seen = []
    inside = report._inside
    monkeypatch.setattr(report, "_inside", lambda rows, wanted, keys: seen.append(wanted) or inside(rows, wanted, keys))
    df = spark.range(20_000).select(F.lit("k").alias("k"), F.when(F.col("id") == 0, 10**14).otherwise(F.col("id")).alias("sample"))
    assert [tuple(r) for r in report.latency_percentiles(df, ["k"]).collect()] == [("k", 10_000, 19_000, 20_000)]
    assert seen[-1].agg(F.max("size")).first()[0] <= 100


def slow_tree(lines, leaf):
    lines = [f"{x}*{n}" for x, n in Counter(lines).items()]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    depth = next(d for d in range(20) if len(lines) <= leaf * 16**d)

    def node(prefix):
        own = [x for x in lines if sha(x).startswith(prefix)]
        if len(prefix) == depth:
            return sha("\n".join(sorted(own))) if own else None
        kids = [(prefix + d, node(prefix + d)) for d in "0123456789abcdef"]
        kids = [f"{p}:{h}" for p, h in kids if h]
        return sha("\n".join(sorted(kids))) if kids else None

    return node("")


@pytest.mark.parametrize("leaf", [1000, 10, 1])
def test_digest_trees(spark, monkeypatch, leaf):
    monkeypatch.setattr(facts, "LEAF", leaf)
    groups = {"a": [f"p{i}" for i in range(300)], "b": ["x"] * 50, None: ["y", "z", "y"], "c": ["one"]}
    rows = [(k, x) for k, xs in groups.items() for x in xs]
    got = {r.k: (r.digest, r.n) for r in facts.digest_tree(spark.createDataFrame(rows, "k string, line string").repartition(5), ["k"]).collect()}
    assert got == {k: (slow_tree(xs, leaf), len(xs)) for k, xs in groups.items()}
    whole = facts.digest_tree(spark.createDataFrame(rows, "k string, line string").select("line"), []).collect()
    assert [tuple(r) for r in whole] == [(slow_tree([x for xs in groups.values() for x in xs], leaf), len(rows))]
    assert facts.digest_tree(spark.createDataFrame([], "k string, line string"), ["k"]).count() == 0


def test_an_inventory_id_hangs_on_every_id_and_not_on_their_order(spark):
    ids = spark.createDataFrame([(f"f{i}",) for i in range(3000)], "id string")
    owners = spark.createDataFrame([("m", "p"), (None, "q")], "module string, package string")
    one, again = (policy.inventory_id(d, owners).first() for d in (ids, ids.orderBy(F.rand(1))))
    assert one == again and one.facts == 3000
    other = policy.inventory_id(ids.where("id <> 'f7'"), owners).first()
    assert other.inventory_id != one.inventory_id
    assert policy.inventory_id(ids.limit(0), owners.limit(0)).collect() == [(hashlib.sha256(b"").hexdigest(), 0)]


def test_meetings_of_small_and_large_sets(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), None if i % 50 == 0 else [f"v{rng.randrange(30)}" for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 14]))]) for i in range(300)]
    rows += [(1000 + i, "hot", ["x", f"y{i % 7}"]) for i in range(500)]
    got = {r.call_id: r.n for r in facts.meetings(spark.createDataFrame(rows, "call_id long, subject string, variables array<string>"), "variables").collect()}
    want = {i: sum(j != i and t == s and bool(set(v) & set(w or [])) for j, t, w in rows) for i, s, v in rows if v}
    assert got == want


def test_many_small_sets_form_no_pairs(spark):
    # 20,000 distinct sets of one subject that all share a member: 4 x 10^8 pairs, if there were any
    df = spark.range(20_000).select(F.col("id").alias("call_id"), F.lit("s").alias("subject"), F.array(F.lit("all"), F.concat(F.lit("own"), "id")).alias("variables"))
    got = facts.shared_variables(df)
    assert got.where("n <> 19999").count() == 0 and got.count() == 20_000


def test_leaks_by_runs_and_by_automata(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "GAMMA", "de", "la", "x_1", "é", "ß"]
    texts = [(i, rng.choice(["", " "]) + "".join(rng.choice(words) + rng.choice([" ", "-", ", ", "\n", ""]) for _ in range(25))) for i in range(150)] + [(7, "again alpha"), (900, None), (901, "")]
    literals = [(i, text[a : a + n]) for i in range(120) for text in [rng.choice(texts[:150])[1]] for a in [rng.randrange(60)] for n in [rng.choice([1, 3, 8, 20, 60])]]
    literals += [(500, "-alpha-de-"), (501, " Alpha, BETA "), (502, "nowhere to be found here"), (503, None), (504, ""), (1, "alpha")]
    want = {}
    for key, literal in literals:
        if literal is not None:
            want.setdefault(key, set()).update(d for d, t in texts if t is not None and literal.lower() in t.lower())
    got = report.leak_audit(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(literals, "literal_id long, literal string")).collect()
    assert {tuple(r) for r in got} == {(k, len(v)) for k, v in want.items() if v}


def test_a_literal_is_looked_up_by_its_rarest_run(spark):
    texts = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 5, "the one rare word in the text of the house").otherwise("in the text of the house we say the same of the house").alias("text"))
    literals = spark.createDataFrame([(1, "rare word in the text of the house"), (2, "say the same of the house"), (3, " the text of ")], "literal_id long, literal string")
    assert {tuple(r) for r in report.leak_audit(texts, literals).collect()} == {(1, 1), (2, 1999), (3, 2000)}


def test_sketches_unite_as_their_rows_would(spark):
    df = spark.range(60_000).select(F.pmod("id", F.lit(3)).alias("k"), F.pmod("id", F.lit(7)).alias("day"), (F.col("id") % 20_000).alias("a"), F.when(F.col("id") % 2 == 0, F.col("id") % 5).alias("b"))
    days = policy.distinct_sketches(df, ["k", "day"], ["a", "b"])
    told = {r.k: r for r in policy.sketch_estimates(policy.merge_sketches(days, ["k"], ["a", "b"]), ["a", "b"]).collect()}
    once = {r.k: r for r in policy.sketch_estimates(policy.distinct_sketches(df, ["k"], ["a", "b"]), ["a", "b"]).collect()}
    assert {k: (r.rows, r.a, r.b) for k, r in told.items()} == {k: (r.rows, r.a, r.b) for k, r in once.items()}
    assert all(abs(r.a - 20_000) <= 0.024 * 20_000 and r.b == 5 and r.rows == 20_000 for r in told.values())
    assert max(len(bytes(r.a)) for r in days.collect()) <= (1 << policy.PRECISION) + 64


def test_payloads_are_inert_and_marked():
    values = [v for vs in policy.PAYLOADS.values() for v in vs]
    assert len(values) == len(set(values)) and all(b"mk7" in (v if isinstance(v, bytes) else v.encode()) for v in values if v not in ("1' AND '1'='2", "0 UNION SELECT NULL,NULL", "1) OR (SELECT 7)=(7", "mk7' OR 'a'<'b", "gopher://mk7.example:9/_x", "{{ 'mk' ~ 7 }}"))
