"""Rules in full, against plain Python or cases on both sides of a clause."""

import random

from pyspark.sql import functions as F

from evidentia.functions import oracles
from evidentia.operators import correlate, facts, findings, resolution, windows


def test_imports_by_line_and_lists(spark):
    rng = random.Random(1)
    pick = lambda: [f"n{rng.randrange(5)}" for _ in range(rng.randrange(1, 3))]
    imports = [(f"f{rng.randrange(4)}", f"M{rng.randrange(4)}", rng.randrange(30), pick() if rng.random() < 0.4 else None, pick() if rng.random() < 0.3 else None) for _ in range(40)]
    calls = [(i, f"f{rng.randrange(5)}", f"n{rng.randrange(6)}", rng.randrange(30)) for i in range(300)]
    definitions = [("f0", "n1"), ("f2", "n3"), ("f2", "n3")]
    got = resolution.resolve_imports(spark.createDataFrame(calls, "call_id long, file string, name string, line int"), spark.createDataFrame(definitions, "file string, name string"), spark.createDataFrame(imports, "file string, module string, line int, only array<string>, except array<string>"))
    want = {}
    for i, file, name, line in calls:
        mods = {m for f, m, at, only, out in imports if f == file and at <= line and (only is None or name in only) and name not in (out or [])}
        kind = "local" if (file, name) in definitions else "imported" if len(mods) == 1 else "ambiguous_import" if mods else "local_or_imported"
        want[i] = (kind, min(mods) if kind == "imported" else None, len(mods))
    assert {r.call_id: (r.resolution, r.module, r.candidates) for r in got.collect()} == want
    assert {k for k, _, _ in want.values()} == {"local", "imported", "ambiguous_import", "local_or_imported"}


def test_aliases_replace_heads(spark):
    aliases = [("f", "M", "A", 3, "X.A"), ("f", "M", "A", 9, "Y.Z"), ("f", "N", "A", 1, "No")]
    calls = [(1, "f", "M", 2, "A.b"), (2, "f", "M", 3, "A.b"), (3, "f", "M", 20, "A"), (4, "f", "M", 9, "__MODULE__.C.d"), (5, "g", "M", 9, "A.b"), (6, "f", "M", 9, "B.A"), (7, "f", None, 9, "__MODULE__.x")]
    got = resolution.resolve_aliases(spark.createDataFrame(calls, "call_id long, file string, module string, line int, name string"), spark.createDataFrame(aliases, "file string, module string, short string, line int, target string"))
    assert {r.call_id: r.resolved for r in got.collect()} == {1: "A.b", 2: "X.A.b", 3: "Y.Z", 4: "M.C.d", 5: "A.b", 6: "B.A", 7: "__MODULE__.x"}


def test_control_regions_are_all_in_order(spark):
    rng = random.Random(2)
    spans = [("f", i, a, a + rng.randrange(0, 40), rng.choice(["if", "case"])) for i in range(80) for a in [rng.randrange(100)]] + [("f", 99, 5, 4, "if")]
    points = [("f", i, rng.randrange(140)) for i in range(60)] + [("g", 60, 5)]
    got = resolution.control_regions(spark.createDataFrame(points, "file string, point_id long, at long"), spark.createDataFrame(spans, "file string, scope_id long, first long, last long, kind string"))
    want = {p: sorted((a, z, k, s) for g, s, a, z, k in spans if g == f and a <= at <= z) for f, p, at in points}
    assert {r.point_id: [tuple(x) for x in r.regions] for r in got.collect()} == want


def test_deletes_end_what_was_written(spark):
    store = spark.createDataFrame([("k", 1, 10, "write"), ("k", 1, 20, "delete"), ("k", 2, 30, "write"), ("j", 5, 10, "write"), ("o", 7, 1, "write"), ("o", 8, 2, "write")], "key string, version long, at long, kind string")
    reads = [(1, "k", 1, 15, "joined"), (2, "k", 1, 25, "deleted"), (3, "k", None, 25, "deleted"), (4, "k", 2, 35, "joined"), (5, "k", None, 35, "ambiguous"), (6, "j", None, 11, "joined"), (7, "j", None, 9, "missing"), (8, "o", None, 3, "ambiguous"), (9, "o", 7, 3, "joined"), (10, "o", 9, 3, "missing"), (11, "x", None, 3, "missing")]
    got = correlate.store_versions(store, spark.createDataFrame([r[:4] for r in reads], "read_id long, key string, version long, at long"))
    assert {r.read_id: r.state for r in got.collect()} == {r[0]: r[4] for r in reads}


def test_pairs_of_calls_need_marker_recipient_and_time(spark):
    sends = spark.createDataFrame([(1, "m", 5, 0), (2, "m", 5, 0), (3, "m", 5, 0), (4, "m", 5, 0), (5, "m", 5, 0), (5, "m", 5, 0), (6, "m", 5, 0)], "id long, marker string, at long, recipient long")
    receives = spark.createDataFrame([(1, "m", 5, 0), (2, "other", 6, 0), (3, "m", 6, 1), (4, "m", 4, 0), (5, "m", 6, 0), (7, "m", 6, 0)], "id long, marker string, at long, receiver long")
    assert {r.id: r.state for r in correlate.pair_calls(sends, receives).collect()} == {1: "joined", 2: "mismatch", 3: "mismatch", 4: "mismatch", 5: "ambiguous", 6: "send_only", 7: "receive_only"}


def test_lineage_needs_one_owner_and_child(spark):
    stages = ["a", "b", "c"]
    rows = [(1, s, i, 7, 8) for i, s in enumerate(stages)] + [(2, s, i, 7 + (i == 2), 8) for i, s in enumerate(stages)] + [(3, s, -i, 7, 8) for i, s in enumerate(stages)] + [(4, s, i, 7, None if i == 1 else 8) for i, s in enumerate(stages)] + [(5, "b", 0, 7, 8)] + [(6, s, i, 7, 8) for i, s in enumerate([*stages, "c", "x"])]
    got = correlate.task_lineage(spark.createDataFrame(rows, "reference long, stage string, at long, owner long, child long"), stages, ("owner", "child"))
    assert {r.reference: r.joined for r in got.collect()} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}


def test_observations_stop_and_fail_where_work_falls(spark):
    rows = [("a", 0, None, 1, 10, "incomplete"), ("a", 1, 5, 2, None, "incomplete"), ("a", 2, 7, 3, 14, "accepted"), ("a", 3, 9, 3, 15, "incomplete"), ("b", 0, None, 0, 3, "incomplete"), ("b", 1, 4, 0, None, "incomplete"), ("b", 2, 4, 0, 2, "incomplete"), ("b", 3, 4, 0, 9, "incomplete"), ("c", 0, None, 0, None, "incomplete"), ("c", 1, 4, None, 6, "incomplete")]
    got = windows.incremental_observations(spark.createDataFrame(rows, "stream string, place int, bytes long, retained long, work long, status string")).orderBy("stream", "place").collect()
    assert [tuple(r) for r in got] == [("a", 0, "incomplete", 0, 1, 0), ("a", 1, "incomplete", 5, 2, None), ("a", 2, "accepted", 12, 3, 4), ("b", 0, "incomplete", 0, 0, 0), ("b", 1, "incomplete", 4, 0, None), ("b", 2, "work_decreased", 8, 0, -1), ("c", 0, "incomplete", 0, 0, None), ("c", 1, "incomplete", 4, None, None)]


def test_budgets_of_work(spark):
    rows = [("v", 1, 9, "s"), ("v", 2, None, "s"), ("m", 1, None, "s"), ("p", 1, 3, "s"), ("u", 1, 9, "t"), ("n", 1, -1, "s")]
    streams = spark.createDataFrame([(x,) for x in "vmpunz"], "stream string")
    got = windows.oracle_incremental_budget(spark.createDataFrame(rows, "stream string, place int, work long, unit string"), 5, "work", "s", streams)
    assert {r.stream: (r.result, r.place) for r in got.collect()} == {"v": ("violation", 1), "m": ("skip", None), "p": ("pass", None), "u": ("skip", None), "n": ("skip", None), "z": ("skip", None)}


def test_lengths_by_unit(spark):
    df = spark.createDataFrame([(0, None), (1, b"e\xcc\x81" * 6), (2, b"e\xcc\x81" * 7), (3, b"\xff"), (4, b"x" * ((1 << 20) + 1))], "i int, v binary")
    got = {r.i: tuple(r)[1:] for r in df.select("i", *(oracles.bounded_length(F.col("v"), 6, u).alias(u) for u in ("bytes", "codepoints", "graphemes"))).collect()}
    assert got == {0: ("skip",) * 3, 1: ("violation", "violation", "pass"), 2: ("violation",) * 3, 3: ("pass", "skip", "skip"), 4: ("violation", "skip", "skip")}
    try:
        oracles.bounded_length(F.col("v"), 6, "words")
    except KeyError:
        return
    raise AssertionError("an unknown unit is an error")


def test_oracle_options(spark):
    df = spark.createDataFrame([(1, "x <B>Hi</B>", "text/html", "<b>hi</b>"), (2, "<b>hi</b>", None, "<b>hi</b>"), (3, "<b>hi</b>", "text/plain", "<b>hi</b>")], "i int, body string, kind string, payload string")
    body, kind, payload = F.col("body"), F.col("kind"), F.col("payload")
    got = df.select("i", oracles.no_reflection(body, kind, payload).alias("a"), oracles.no_reflection(body, kind, payload, any_case=True).alias("b"), oracles.no_reflection(body, kind, payload, unknown="check").alias("c")).collect()
    assert [tuple(r) for r in got] == [(1, "pass", "violation", "pass"), (2, "skip", "skip", "violation"), (3, "pass", "pass", "pass")]
    raw = spark.createDataFrame([(b"ok\t\x1b[1m",), (b"\xff\xfe",), (b"\x07",), (None,)], "v binary")
    assert [r[0] for r in raw.select(oracles.terminal_safety(F.col("v"))).collect()] == ["pass", "violation", "violation", "skip"]
    assert [r[0] for r in spark.range(1).select(oracles.no_500(F.lit(None).cast("int"), missing="violation")).collect()] == ["violation"]


def test_seeds_of_the_first_keyword(spark):
    seeds = spark.createDataFrame([(1, 2, 1, "B", "x"), (2, 1, 5, "A", "y"), (3, 1, 4, "A", "y"), (4, 3, 1, "C", "z")], "seed_id long, place int, seq int, keyword string, value string")
    matches = spark.createDataFrame([(1, {"B": "x", "A": "y"}), (2, {"B": "x", "A": "no"}), (3, {"Q": "x"}), (4, None), (5, {"C": "z", "B": "x"})], "match_id long, input map<string,string>")
    assert {r.match_id: (r.keyword, r.seed_id) for r in findings.match_seeds(matches, seeds).collect()} == {1: ("A", 3), 2: ("B", 1), 3: (None, None), 4: (None, None), 5: ("B", 1)}


def test_wordlist_modes(spark):
    lists = spark.createDataFrame([("a", 0, "1"), ("a", 1, "2"), ("b", 0, "x"), ("c", 0, "p"), ("c", 1, "q")], "list string, place int, value string")
    rows = lambda mode: sorted(map(tuple, findings.expand_wordlists(lists, mode, ["a", "b", "c"]).collect()), key=repr)
    assert rows("clusterbomb") == [("1", "x", "p"), ("1", "x", "q"), ("2", "x", "p"), ("2", "x", "q")]
    assert rows("pitchfork") == [("1", "x", "p")]
    assert rows("sniper") == sorted([("1", None, None), ("2", None, None), (None, "x", None), (None, None, "p"), (None, None, "q")], key=repr)


def test_the_longest_prefix_wins_by_bytes(spark):
    df = spark.createDataFrame([(1, "a", "p"), (1, "a.b", "q"), (1, "a.b", "o"), (2, None, "z"), (2, "é", "r"), (2, "a", "s")], "id long, module string, package string")
    assert {tuple(r) for r in facts.longest_prefix(df, ["id"]).collect()} == {(1, "a.b", "o"), (2, "é", "r")}


def test_batches_are_full_but_the_last(spark):
    rows = [(f"10.0.0.{i:03d}", "tcp", [80]) for i in range(50)] + [("10.1.0.1", None, [80]), ("10.1.0.2", "tcp", [22, 80])]
    batches = windows.host_batches(spark.createDataFrame(rows, "ip string, protocol string, ports array<int>"), 16)
    stats = windows.plan_batch_stats(batches).collect()
    assert sorted((str(r.protocol), len(r.ports), r.batch, r.hosts, r.n_ports) for r in stats) == [("None", 1, 0, 1, 1), ("tcp", 1, 0, 16, 16), ("tcp", 1, 1, 16, 16), ("tcp", 1, 2, 16, 16), ("tcp", 1, 3, 2, 2), ("tcp", 2, 0, 1, 2)]
