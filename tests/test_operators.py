from pyspark.sql import functions as F

from evidentia.functions import oracles as o
from evidentia.functions import scalars as s
from evidentia.operators import correlate, facts, findings, graph, report, windows
from evidentia.sources import readers


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return frame.select(column.alias("x")).first()[0]


def test_stable_id_keeps_borders(spark):
    a = one(spark, s.stable_id("t", F.lit("ab"), F.lit("c")))
    assert a.startswith("t:") and a != one(spark, s.stable_id("t", F.lit("a"), F.lit("bc")))
    assert one(spark, s.stable_id("t", F.lit(None).cast("string"))) != one(spark, s.stable_id("t", F.lit("")))


def test_urls_and_paths(spark):
    assert one(spark, s.normalize_url(F.lit(" Http://Shop.Test:8080?tag=Red "))) == "http://shop.test:8080/?tag=Red"
    for bad in ("ftp://x/", "http://a@b/", "http://a/#x", "http://a:70000/"):
        assert one(spark, s.normalize_url(F.lit(bad))) is None
    assert one(spark, s.canonical_path(F.lit("/img/thumbs/%2E./%C3%A9/./x"))) == "/img/é/x"
    assert one(spark, s.canonical_path(F.lit("/../../top"))) == "/top"
    assert one(spark, s.canonical_path(F.lit("/a+b/./c"))) == "/a+b/c"
    assert one(spark, s.canonical_path(F.lit("/%zz"))) is None


def test_addresses(spark):
    assert one(spark, s.ip_to_int(F.lit("10.0.1.2"))) == 167772418
    assert one(spark, s.ip_to_int(F.lit("10.0.1.256"))) is None
    assert one(spark, s.cidr_mask(F.lit(0))) == 0 and one(spark, s.cidr_mask(F.lit(24))) == 4294967040


def test_small_scalars(spark):
    assert one(spark, s.versioned_id_ok(F.lit("a.check.v2"))) and not one(spark, s.versioned_id_ok(F.lit("a.v0")))
    assert tuple(one(spark, s.split_mfa(F.lit("A.B.run/2")))) == ("A.B", "run", 2)
    assert [tuple(x) for x in one(spark, s.route_params(F.lit("/u/:id/*rest")))] == [("param", "id"), ("glob", "rest")]
    assert one(spark, s.verdict_text(F.lit("t"), F.lit("refuted"), F.lit(0))) == "t: refuted (0 findings)"


def test_predicates(spark):
    assert one(spark, o.no_500(F.lit(503))) == "violation" and one(spark, o.no_500(F.lit(None).cast("int"))) == "skip"
    assert one(spark, o.no_reflection(F.lit("<p>x"), F.lit("text/html"), F.lit("<p>"))) == "violation"
    assert one(spark, o.no_reflection(F.lit("<p>x"), F.lit("application/json"), F.lit("<p>"))) == "pass"
    assert one(spark, o.no_reflection(F.lit("<p>x"), F.lit(None).cast("string"), F.lit("<p>"))) == "skip"
    assert one(spark, o.injection_signal(F.lit("ORA-00933: x"))) == "violation"
    assert one(spark, o.terminal_safety(F.lit("\x1b[31mred\x1b[0m\n\t"))) == "pass"
    assert one(spark, o.terminal_safety(F.lit("\x1b]0;t\x07"))) == "violation"
    assert one(spark, o.replay_verdict(F.lit(0), F.lit(1))) == "inconclusive"


def test_seed_precedence(spark):
    m = spark.createDataFrame([(1, "A", "same"), (2, "A", "missing")], "match_id long, keyword string, value string")
    seeds = spark.createDataFrame([("A", "same", 2), ("A", "same", 1)], "keyword string, value string, seed_id long")
    assert {r.match_id: r.seed_id for r in findings.seed_provenance(m, seeds).collect()} == {1: 1, 2: None}


def test_verdicts_fail_closed(spark):
    c = spark.createDataFrame([(1, True), (2, True), (3, False)], "id long, complete boolean")
    assert {r.id: r.verdict for r in findings.revalidate(c, spark.createDataFrame([(1,)], "id long"), ["id"]).collect()} == {1: "confirmed", 2: "refuted", 3: "inconclusive"}


def test_longest_owner_ends_at_a_border(spark):
    calls = spark.createDataFrame([(1, "a.b.c"), (2, "a.bc.d")], "call_id long, target string")
    owners = spark.createDataFrame([("a", "p"), ("a.b", "q")], "module string, package string")
    assert {r.call_id: r.package for r in facts.package_uses(calls, owners).collect()} == {1: "q", 2: "p"}


def test_as_of_and_scopes(spark):
    points = spark.createDataFrame([("f", 1, 5), ("f", 2, 1)], "file string, point_id long, at long")
    changes = spark.createDataFrame([("f", 3, "a"), ("f", 5, "b")], "file string, since long, value string")
    assert {r.point_id: r.value for r in facts.as_of(points, changes, ["file"]).collect()} == {1: "b", 2: None}
    spans = spark.createDataFrame([("f", 10, 0, 900), ("f", 11, 4, 6)], "file string, scope_id long, first long, last long")
    assert {r.point_id: r.scope_id for r in facts.enclosing_scope(points, spans).collect()} == {1: 11, 2: 10}


def test_reaching_definitions_tell_truncation(spark):
    b = spark.createDataFrame([("f", "x", i, i) for i in range(10)], "file string, variable string, at long, binding_id long")
    found = facts.reaching_definitions(spark.createDataFrame([("f", "x", 20, 99)], "file string, variable string, at long, use_id long"), b).collect()
    assert [r.binding_id for r in sorted(found, key=lambda r: r.rank)] == list(range(9, 1, -1)) and all(r.truncated for r in found)


def test_callbacks_and_suppressions(spark):
    f = spark.createDataFrame([("implements", "M", "I", None), ("callback", "I", None, "run/1"), ("definition", "d1", "M.run/1", None)], "kind string, subject string, object string, signature string")
    assert rows(facts.callback_implementations(f)) == [("I", "M", "run/1", "d1")]
    c = spark.createDataFrame([(1, 4, "# evidence-ignore: a.b -- fine"), (2, 5, "# evidence-ignore soon"), (3, 6, "plain")], "comment_id long, line long, text string")
    assert {r.comment_id: (r.valid, r.target_line) for r in facts.parse_suppressions(c).collect()} == {1: (True, 5), 2: (False, None)}


def test_pairs_need_one_of_each(spark):
    s_ = spark.createDataFrame([(1, "m", 1, 7), (2, "m", 5, 7), (3, "m", 1, 7), (3, "m", 2, 7), (4, "m", 1, 7), (5, "m", 1, None)], "id long, marker string, at long, recipient long")
    r_ = spark.createDataFrame([(1, "m", 2, 7), (2, "m", 3, 7), (3, "m", 9, 7), (4, "m", 2, 8), (5, "m", 2, None)], "id long, marker string, at long, receiver long")
    assert {r.id: r.joined for r in correlate.pair_messages(s_, s_, r_).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}
    assert {r.id: r.joined for r in correlate.pair_messages(s_, s_, r_, timed=False).collect()}[2]
    assert rows(correlate.pair_summary(correlate.pair_messages(s_, s_, r_))) == [(5, 1, 5)]


def test_broken_envelopes_decide_nothing(spark):
    e = spark.createDataFrame([(i, h) for i, h in ((1, True), (1, False), (2, True), (3, False), (4, True), (4, True), (4, True))], "session_id long, hit boolean")
    assert {r.session_id: r.verdict for r in correlate.session_verdict(e, 2).collect()} == {1: "confirmed", 2: "confirmed", 3: "refuted", 4: "inconclusive"}
    ended = spark.createDataFrame([(1, True), (2, False), (3, True), (4, True), (9, True)], "session_id long, complete boolean")
    assert {r.session_id: r.verdict for r in correlate.session_verdict(e, 2, ended).collect()} == {1: "confirmed", 2: "inconclusive", 3: "refuted", 4: "inconclusive", 9: "refuted"}


def test_findings_are_known_by_job_point_and_inputs(spark):
    m = spark.createDataFrame([(j, "http://h.test/x", 200, 5, i) for j, i in ((1, {"A": "1"}), (2, {"A": "1"}), (1, {"A": "1", "B": "2"}), (1, {"A": "1", "Z": "9"}), (1, {"Z": "9"}), (5, {"A": "1"}))], "job_id long, url string, status int, length int, input map<string,string>")
    jobs = spark.createDataFrame([(1, "GET", ["A", "B"]), (2, "PUT", ["A", "B"])], "job_id long, method string, keywords array<string>")
    points = spark.createDataFrame([(1, 0, "A", "url", None), (1, 1, "B", "header", "hOsT"), (2, 0, "C", "cookie", "sid"), (2, 1, "A", "header", "X-A")], "job_id long, place long, keyword string, location string, name string")
    got = [(r.category, r.evidence, r.id) for r in findings.findings_from_matches(m, jobs, points).collect()]
    by = {e: (c, i) for c, e, i in got}
    assert sorted(c for c, _, _ in got) == ["exposed_path", "exposed_path", "exposed_path", "matched_response", "matched_response", "vhost"]
    assert len({i for _, _, i in got}) == 5  # an undeclared keyword is no part of an identity
    assert by['matched HTTP 200, length=5, B="2"'][0] == "vhost" and "matched HTTP 200, length=5, A=nil" in by


def test_each_sign_of_an_error(spark):
    signs = {o.injection_signal: ("You have an error in your SQL syntax", "x ORA-01722 y", "sqlstate[hy000]", "Syntax error at or near 'from'", "Unclosed quotation mark after the character string", "OLE DB Provider"), o.sensitive_leak: ("Traceback (most recent call last)", "stack-trace", "Uncaught TypeException", "web/page.ex:7:3", "ArgumentError: bad")}
    none = {o.injection_signal: ("AORA-01722", "ORA-123", "SQLSTATE", "syntax error near x"), o.sensitive_leak: ("page.exe:7", "ArgumentError", "caught exception")}
    for rule, texts in signs.items():
        assert [one(spark, rule(F.lit(t))) for t in texts] == ["violation"] * len(texts)
        assert [one(spark, rule(F.lit(t))) for t in none[rule]] == ["pass"] * len(none[rule])


def test_incremental_budget_and_novelty(spark):
    c = spark.createDataFrame([(1, 0, 5, "incomplete"), (1, 1, 1, "done"), (1, 2, 9, "done")], "stream long, place long, bytes long, status string")
    assert [r.received for r in windows.incremental_samples(c).orderBy("place").collect()] == [5, 6]
    n = spark.createDataFrame([(1, ["l", "a"]), (2, ["l", "b"]), (3, ["l", "a"])], "seq long, items array<string>")
    assert [r.seq for r in windows.novelty_archive(n).collect()] == [1, 2]
    assert rows(windows.budget_prefix(c, "stream", ["place"], "bytes", 10, 6)) == [(1, 2, "max_bytes")]


def test_cycles_end(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a")], ["from", "to"])
    assert rows(graph.graph_slice(e, spark.createDataFrame([("a",)], ["root"]), 5)) == [("a", "a", 0), ("a", "b", 1)]


def test_medians(spark):
    d = spark.createDataFrame([("k", x) for x in (4, 1, 3, 2)], "k string, sample long")
    assert rows(report.upper_median(d, ["k"])) == [("k", 3)]


def test_ndjson_rejects(spark, tmp_path):
    import base64
    import json

    # Fixed names: the fields of a line.
    record = {"input": {"W": base64.b64encode(b"caf\xc3\xa9").decode()}, "position": 40, "status": 301, "length": 0, "words": 3, "lines": 2, "duration": 77, "content-type": "text/plain", "redirectlocation": "/new", "url": "http://one.test/p", "resultfile": "r", "host": "one.test"}
    changed = [record | {"length": -1}, record | {"words": 1.5}, record | {"host": None}, record | {"input": {"W": "?"}}, record | {"input": "W"}]
    (tmp_path / "x.ndjson").write_text("\n".join(["   ", json.dumps(record), "[1,", *map(json.dumps, changed)]) + "\n")
    ok, bad = readers.read_http_matches(spark, str(tmp_path))
    assert [(bytes(r.input["W"]).decode(), r.status, r.redirectlocation) for r in ok.collect()] == [("café", 301, "/new")]
    assert sorted(r.reason for r in bad.collect()) == ["invalid field"] * 5 + ["malformed JSON"]


def test_scan_lines(spark):
    d = spark.createDataFrame([("203.0.113.7   ->   [8443,8080,8443]",), ("2001:db8::5 -> [53]",), ("scan took 3 s",), ("host -> [1]",), ("203.0.113.8 -> [1;2]",), ("203.0.113.9 -> [ ]",)], ["value"])
    ok, bad = readers.read_scan_lines(d)
    assert rows(ok) == [("2001:db8::5", [53]), ("203.0.113.7", [8080, 8443])] and rows(bad) == [("203.0.113.8 -> [1;2]",), ("host -> [1]",)]


def test_limits_keep_nothing_beyond_the_total(spark):
    d = spark.createDataFrame([("a", 5), ("b", 50)], "path string, bytes long")
    kept, why = readers.source_limits(d, 10, 20, 100)
    assert rows(kept.select("path")) == [("a",)] and rows(why) == [("file_too_large", "b")]
    kept, why = readers.source_limits(d, 1, 20, 100)
    assert kept.count() == 0 and rows(why) == [("too_many_files", None)]
