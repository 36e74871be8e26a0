"""Odd rows of roll-ups, pages and maps."""

from evidentia.operators import contracts, facts, findings, policy, report


def test_pages_behind_a_key_are_those_of_offsets(spark):
    df = spark.createDataFrame([(f"f{i % 3}", i, f"o{i % 2}") for i in range(30)], "file string, line int, object string")
    order, seen, after = ["file", "line", "object"], [], None
    while True:
        page = [tuple(r) for r in facts.fact_page_after(df, order, after, 7).select(*order).collect()]
        if not page:
            break
        seen, after = seen + page, page[-1]
    assert seen == [tuple(r) for r in df.orderBy(*order).collect()]


def test_given_owners_go_before(spark):
    modules = spark.createDataFrame([("A", "p"), ("A", "q"), ("B", "p"), ("C", "r"), ("C", "r")], "module string, package string")
    given = spark.createDataFrame([("A", "mine"), ("B", "mine"), ("D", "mine")], "module string, package string")
    assert {tuple(r) for r in facts.derive_module_owners(modules).collect()} == {("B", "p"), ("C", "r")}
    assert {tuple(r) for r in facts.derive_module_owners(modules, given).collect()} == {("A", "mine"), ("B", "mine"), ("C", "r"), ("D", "mine")}


def test_replays_repeat_verdict_seed_and_findings(spark):
    schema = "case_id string, role string, verdict string, seed_id string, findings array<string>"
    runs = spark.createDataFrame([("c", "vulnerable", "confirmed", "s", ["a", "b"]), ("c", "fixed", "refuted", "s", None), ("c", "failure", "inconclusive", "s", []), ("d", "vulnerable", "confirmed", "s", ["a"]), ("d", "fixed", "confirmed", "s", ["a"])], schema)
    again = spark.createDataFrame([("c", "vulnerable", "confirmed", "s", ["b", "a"]), ("c", "fixed", "refuted", "s", []), ("c", "failure", "inconclusive", "t", []), ("d", "vulnerable", "confirmed", "s", ["a", "x"]), ("d", "odd", "refuted", "s", [])], schema)
    matrix = contracts.replay_matrix(runs, again)
    got = {r.case_id: r for r in matrix.collect()}
    assert (got["c"].vulnerable, got["c"].fixed, got["c"].failure, got["c"].replays, got["c"].replays_equal) == (True, True, True, 3, 2)
    assert (got["d"].fixed, got["d"].failure, got["d"].false_confirmations, got["d"].replays, got["d"].replays_equal) == (False, False, 1, 2, 0)
    checks = spark.createDataFrame([("c", True), ("d", True)], "case_id string, passed boolean")
    assert report.suite_summary(checks, matrix).first().status == "failed"
    assert report.suite_summary(checks, matrix.where("case_id = 'none'")).first().status == "passed"


def test_reports_name_results_in_their_order(spark):
    rows = [(1, 2, "b", "violation"), (1, 1, "a", "violation"), (1, 3, "c", "skip"), (2, 1, "a", "pass"), (2, 2, "b", "skip"), (3, 1, "a", "pass")]
    got = {r.input: (r.passed, r.skipped, r.violations, r.verdict) for r in contracts.oracle_report(spark.createDataFrame(rows, "input long, place int, name string, result string")).collect()}
    assert got == {1: ([], ["c"], ["a", "b"], "confirmed"), 2: (["a"], ["b"], [], "inconclusive"), 3: (["a"], [], [], "refuted")}


def test_context_maps_and_roles(spark):
    rows = [("f", "module", "M", None, 1), ("f", "module", "M", None, 2), ("f", "alias", "X.A", "A", 3), ("f", "alias", "Y.A", "A", 9), ("f", "role", "web", None, 1), ("g", "role", "web", None, 1), ("g", "module", "N", None, 1), ("h", "role", "job", None, 1)]
    df = spark.createDataFrame(rows, "file string, kind string, target string, name string, line int")
    got = {r.file: (r.modules, r.roles, r.aliases) for r in policy.context_maps(df).collect()}
    assert got == {"f": (["M"], ["web"], {"A": "Y.A"}), "g": (["N"], ["web"], {}), "h": ([], ["job"], {})}
    assert {r.role: (r.modules, r.files) for r in policy.project_roles(df).collect()} == {"web": (["M", "N"], ["f", "g"]), "job": ([], ["h"])}


def test_mutators_need_their_shape(spark):
    rows = [(1, "Html", "sanitize", 1, None, None), (2, None, "sanitize", 1, None, None), (3, "Html", "sanitize", 0, None, None), (4, "Plug.Conn", "put_resp_header", 3, "X-FRAME-options", None), (5, "Plug.Conn", "put_resp_header", 3, "x-mine", None), (6, "Other", "put_resp_header", 3, "x-frame-options", None), (7, "ssl", "connect", 3, None, {"verify": "verify_peer", "check_hostname": "true"}), (8, "ssl", "connect", 3, None, {"verify": "verify_none"})]
    df = spark.createDataFrame(rows, "call_id long, module string, function string, arity int, header string, options map<string,string>")
    got = sorted((r.call_id, r.mutator, r.change) for r in policy.mutation_candidates(df).collect())
    assert got == [(1, "SanitizerBypass", "bypass sanitize"), (4, "SecurityHeader", "remove x-frame-options"), (7, "TransportSecurity", "disable hostname verification"), (7, "TransportSecurity", "verify_peer to verify_none")]


def test_runs_compare_only_of_one_fixture(spark):
    schema = "name string, value double, fixture string, runtime string"
    before = spark.createDataFrame([("a", 6.0, "h", "r"), ("b", 6.0, "h", "r"), ("c", 6.0, "h", "r"), ("z", 6.0, "h", "r")], schema)
    after = spark.createDataFrame([("a", 3.0, "h", "r"), ("b", 3.0, "g", "r"), ("d", 3.0, "h", "r"), ("z", 0.0, "h", "r")], schema)
    assert {r.name: (r.comparable, r.speedup) for r in report.compare_measured(before, after).collect()} == {"a": (True, 2.0), "b": (False, None), "c": (False, None), "d": (False, None), "z": (True, None)}


def test_rollups_count_findings_and_name_effects(spark):
    verdicts = spark.createDataFrame([(1, "t", "x", "confirmed"), (2, "t", "x", "refuted"), (3, "t", "y", None)], "id long, tool string, action string, verdict string")
    found = spark.createDataFrame([(1,), (1,), (9,)], "validation_id long")
    effects = spark.createDataFrame([("t", "x", "none"), ("t", "y", "none"), ("t", "y", None)], "tool string, action string, effect string")
    assert {r.action: (r.confirmed, r.refuted, r.inconclusive, r.findings, r.effect) for r in findings.verdict_rollup(verdicts, found, effects).collect()} == {"x": (1, 1, 0, 2, "none"), "y": (0, 0, 0, 0, None)}
