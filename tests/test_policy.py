import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from evidentia.functions import policy as p
from evidentia.operators import facts, graph, policy, report, windows
from evidentia.sources import documents


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("x")).first().x


def test_addresses_with_colons(spark):
    rng = random.Random(1)
    texts = [str(ipaddress.IPv6Address(rng.getrandbits(128) & rng.getrandbits(128) & rng.getrandbits(128) & (rng.getrandbits(128) if i % 2 else 0xFFFF << 16 * rng.randrange(8)))) for i in range(200)]
    texts += [ipaddress.IPv6Address(t).exploded.upper() for t in texts[:50]] + ["::", "::1", "1::", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8"]
    bad = ["1:2:3", ":::", "1::2::3", "12345::", "1:2:3:4:5:6:7:8:9", "::1.2.3.400", "g::", "1:2:3:4:5:6:7::8:9", ":1:2:3:4:5:6:7:8", ""]
    df = spark.createDataFrame([(t,) for t in texts + bad], "t string").select("t", p.canonical_ip(F.col("t")).alias("c"), p.in_network(p.ipv6_groups(F.col("t")), p.ipv6_groups(F.lit("2000::")), F.lit(3)).alias("n"))
    for t, c, n in df.collect():
        if t in bad:
            assert c.kind != "ipv6", t
        else:
            want = ipaddress.IPv6Address(t)
            assert c.kind == "ipv6" and (c.value == want.compressed or "." in want.compressed), (t, c.value)
            assert n == (want in ipaddress.IPv6Network("2000::/3"))


def test_cut_texts_stay_whole_characters(spark):
    for text in ("a" * 300, "é" * 200, "中" * 100, "x" + "😀" * 80, "short", ""):
        got = one(spark, text, p.preview)
        cut = text.encode()[:240].decode(errors="ignore")
        assert (got.preview, got.truncated) == (cut, len(text.encode()) > 240)
    message = one(spark, "é" * 5000, p.bounded_message)
    assert len(message.encode()) <= 4096 and message.endswith("...") and set(message[:-3]) == {"é"}


def test_header_parameters(spark):
    got = one(spark, 'Digest realm="a \\"b\\"", nonce=abc ,realm=x', p.auth_params)
    assert (got.status, got.scheme) == ("parsed", "digest") and [tuple(x) for x in got.params] == [("realm", 'a "b"', True), ("nonce", "abc", False), ("realm", "x", False)]
    assert one(spark, 'Digest realm="open', p.auth_params).status == "malformed" and one(spark, "D a=" + "b" * 17_000, p.auth_params).status == "incomplete"
    quoted = lambda h: one(spark, h, lambda v: p.quoted_parameter(v, "Digest", "realm", F.lit("a")))
    assert [quoted(h) for h in ('Digest realm="a"', "Digest realm=a", 'Digest realm="b"', 'Digest realm="a", realm="a"', "Digest")] == ["pass", *["violation"] * 4]


def test_response_filter_modes(spark):
    df = spark.createDataFrame([(200, 5, 10, 100, 50, "ok"), (404, 5, 10, 100, 50, "ok"), (200, 9, 10, 100, 900, "ok"), (None, None, None, None, None, None)], "status int, lines int, words int, length int, millis int, body string")
    keep = lambda *a, **k: [r[0] for r in df.select(p.response_filter(*a, **k)).collect()]
    assert keep({"codes": [200]}, {}) == [True, False, True, False]
    assert keep({"codes": "all"}, {"time": ("gt", 100)}) == [True, True, False, False]
    assert keep({"codes": [(200, 299)], "lines": 5}, {}, matcher_mode="and") == [True, False, False, False]
    assert keep({"codes": "all"}, {"lines": 5, "size": 7}, filter_mode="and") == [True, True, True, False]
    assert keep({}, {}) == [False] * 4


def test_terminal_sequences_in_order(spark):
    text = "a\x1b[31mred\x1b[0m\x1b[2J\t\n\x1b]0;title\x07\x1bc\x07\u009b"
    assert one(spark, text, p.terminal_sequences) == ["csi", "osc", "escape", "control", "c1"]
    assert one(spark, "\x07" * 40, p.terminal_sequences) == ["control"] * 16


def test_scopes_equal_all_pairs(spark):
    rng = random.Random(2)
    spans = [("f", i, (a := rng.randrange(200)), a + rng.choice((0, 1, 5, 60))) for i in range(150)] + [("g", 900, 0, 1 << 40), ("f", 901, 9, 3)]
    points = [("f", i, rng.randrange(260)) for i in range(200)] + [("g", 500, 1 << 39), ("h", 501, 3)]
    s = spark.createDataFrame(spans, "file string, scope_id long, first long, last long")
    t = spark.createDataFrame(points, "file string, point_id long, at long")
    inner, held = {r.point_id: r.scope_id for r in facts.enclosing_scope(t, s).collect()}, {r.point_id: tuple(r)[1:] for r in facts.control_contexts(t, s).collect()}
    for file, i, at in points:
        own = [x for x in spans if x[0] == file and x[2] <= at <= x[3]]
        assert inner[i] == (max(own, key=lambda x: (x[2], -x[3], x[1]))[1] if own else None)
        order = sorted(own, key=lambda x: (x[2], x[3], x[1]))
        assert held.get(i) == ((len(own), order[0][1], order[-1][1]) if own else None)


def test_ranks_equal_sorted_lists(spark):
    rng = random.Random(3)
    rows = [(k, v) for k, values in (("a", [rng.randrange(10**12) for _ in range(301)]), ("b", [7] * 10), ("c", [1]), ("d", [*range(100), 10**15])) for v in values] + [("c", None)]
    df = spark.createDataFrame(rows, "k string, sample long")
    got = {r.k: tuple(r)[1:] for r in report.latency_percentiles(df, ["k"]).collect()}
    med = {r.k: r.median for r in report.upper_median(df, ["k"]).collect()}
    for k in "abcd":
        v = sorted(x for key, x in rows if key == k and x is not None)
        assert got[k] == (v[-(-len(v) * 50 // 100) - 1], v[-(-len(v) * 95 // 100) - 1], len(v)) and med[k] == v[len(v) // 2]


def test_peak_rate_over_bins(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.randrange(5000)) for _ in range(600)]
    got = {r.origin: (r.peak, r.requests, r.span) for r in windows.peak_rate(spark.createDataFrame(rows, "origin string, at long"), 100).collect()}
    for o in "ab":
        t = [x for k, x in rows if k == o]
        assert got[o] == (max(sum(a <= x < a + 100 for x in t) for a in t), len(t), max(t) - min(t))


def test_literals_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(report, "LITERALS", 3)
    literals = spark.createDataFrame([(i, x) for i, x in enumerate(["Abc", "bc d", "zz", "", "abc", "q", None])], "literal_id long, literal string")
    texts = spark.createDataFrame([(1, "xABC d"), (2, "nothing"), (3, None), (2, "abc")], "doc_id long, text string")
    assert {tuple(r) for r in report.leak_audit(texts, literals).collect()} == {(0, 2), (1, 1), (3, 2), (4, 2)}


def test_slices_stop_at_their_bounds(spark):
    edges = [("r", f"a{i}") for i in range(6)] + [("a0", "b"), ("a1", "b"), ("b", "c"), ("c", "r"), ("s", "b")]
    e = spark.createDataFrame(edges, "from string, to string")
    roots = spark.createDataFrame([("r",), ("s",), ("lone",)], "root string")
    whole, told = graph.bounded_slice(e, roots, depth=3)
    assert {(r.root, r["from"], r.to, r.depth) for r in whole.where("root = 's'").collect()} == {("s", "s", "b", 1), ("s", "b", "c", 2), ("s", "c", "r", 3)}
    assert {r.root: (r.nodes, r.edges, r.reasons) for r in told.collect()} == {"r": (9, 9, ["max_depth"]), "s": (4, 3, ["max_depth"]), "lone": (1, 0, [])}
    for cap, reason, most in (({"most_nodes": 4}, "max_nodes", 3), ({"most_edges": 4}, "max_edges", 4), ({"most_work": 2}, "max_work", 2)):
        some, told = graph.bounded_slice(e, roots, depth=1, **cap)
        r = {x.root: x for x in told.collect()}["r"]
        assert some.where("root = 'r'").count() == most and reason in r.reasons


def test_classification_of_names_and_dependencies(spark):
    rows = [(1, "definition", None, None, "App.can_read/2", None, None), (2, "definition", None, None, "App.Login.render/0", None, None), (3, "dependency", None, None, "x", None, "path"), (4, "call", "erlang", "send", None, "dynamic_dispatch", None), (5, "call", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "fact_id long, kind string, module string, function string, object string, resolution string, source string")
    got = sorted((r.fact_id, r.behavior, r.basis) for r in policy.classify_behaviors(df).collect())
    assert got == [(1, "authorization_boundary", "function_name"), (3, "non_registry_dependency", "dependency_source"), (4, "dynamic_dispatch", "dynamic_receiver"), (4, "process_message_send", "known_api")]


def test_complete_or_fail(spark):
    page = spark.createDataFrame([(1, 5, None)], "a int, total long, next_offset long")
    assert policy.complete_or_fail(page).collect() == [(1,)]
    with pytest.raises(Exception, match="one page"):
        policy.complete_or_fail(page.withColumn("next_offset", F.lit(7))).collect()


def test_files_and_artifacts(spark, tmp_path):
    for name in ("lib/a.ex", "lib/x/b.ex", "lib/.c.ex", "test/d.ex", "lib/e.txt"):
        f = tmp_path / "tree" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x" * len(name))
    got = documents.discover_sources(spark, str(tmp_path / "tree"), ["**/*.ex"], ["test/*.ex"]).collect()
    assert {(r.path, r.bytes) for r in got} == {("lib/a.ex", 8), ("lib/x/b.ex", 10)}
    xml = '<nmaprun><host><status state="up"/><address addr="1.2.3.4" addrtype="ipv4"/><ports><port portid="80" protocol="tcp"><state state="open"/></port></ports></host><host><status state="down"/></host></nmaprun>'
    (tmp_path / "scan.xml").write_text(xml)
    hosts = documents.read_hosts_xml(spark, str(tmp_path / "scan.xml"))
    assert sorted((r.ip or "", r.status, len(r.ports)) for r in hosts.collect()) == [("", "down", 0), ("1.2.3.4", "up", 1)]
    kept, failed = documents.xml_document_budgets(hosts, {"hosts": 1})
    assert kept.count() == 0 and failed.first().reason == "too many hosts"
    facts_ = spark.createDataFrame([("f1", "x"), ("f2", "y")], "id string, kind string")
    owners = spark.createDataFrame([("M", "p")], "module string, package string")
    manifest = documents.write_inventory_artifact(facts_, owners, str(tmp_path / "out"), 1000).first()
    assert manifest.facts == 2 and spark.read.parquet(str(tmp_path / "out" / manifest.inventory_id / "facts")).count() == 2
    with pytest.raises(ValueError, match="above"):
        documents.write_inventory_artifact(facts_, owners, str(tmp_path / "out2"), 3)


HOST = '<host starttime="5" endtime="x"><status state="up"/><address addr="1.2.3.4" addrtype="ipv4"/><ports><port portid="80" protocol="tcp"><state state="open"/><service name="http"><cpe> a:b </cpe><cpe/></service><script id="s" output="a &gt; b > c"/></port></ports><os><osmatch name="L" accuracy="9"><osclass><cpe>o:1</cpe></osclass></osmatch></os><hostscript><script id="h" output=""><table><elem>1</elem></table></script></hostscript></host>'
SCAN = f'<?xml version="1.0"?>\n<!-- c --><nmaprun args="a"><scaninfo type="x"/>{HOST}\n<taskprogress/><host><status state="down"/></host><runstats><hosts up="1"/></runstats></nmaprun>\n'


def test_a_scan_is_taken_whole_or_not_at_all(spark, tmp_path):
    scans = {
        "good": (SCAN, None),
        "none": ("<nmaprun></nmaprun>", None),
        "cut in a host": (SCAN[: SCAN.index("down")], "truncated"),
        "cut between": (SCAN[: SCAN.index("<runstats")], "truncated"),
        "open element": (SCAN.replace('<status state="up"/>', '<status state="up">'), "malformed"),
        "open between": (SCAN.replace("<taskprogress/>", "<taskprogress>"), "malformed"),
        "twice": (SCAN + SCAN, "malformed"),
        "more": (SCAN + "x", "malformed"),
        "before": ("x" + SCAN, "malformed"),
        "no ends": (SCAN.replace("</host>", ""), "malformed"),
        "no root": (SCAN.replace('<nmaprun args="a">', ""), "malformed"),
        "attribute": (SCAN.replace('addrtype="ipv4"', "addrtype=ipv4"), "malformed"),
    }
    for name, (text, _) in scans.items():
        (tmp_path / f"{name}.xml").write_text(text)
    hosts, failed = documents.xml_documents(documents.xml_pieces(spark, str(tmp_path)))
    stem = lambda r: r.document.rsplit("/", 1)[-1].replace("%20", " ")[:-4]
    assert {stem(r): r.reason for r in failed.collect()} == {k: why for k, (_, why) in scans.items() if why}
    rows = hosts.orderBy("status").collect()
    assert [(stem(r), r.status) for r in rows] == [("good", "down"), ("good", "up")]
    r = rows[1]
    assert (r.ip, r.started_at, r.ended_at, r.scripts, r.script_nodes, r.depth) == ("1.2.3.4", 5, None, 2, 2, 5)
    assert (r.ports[0].cpes, r.ports[0].scripts[0].output, r.os_matches[0].cpes, r.host_scripts[0].id) == (["a:b"], "a > b > c", ["o:1"], "h")
    for limit, why in (({"elements": 17}, "too many elements"), ({"depth": 4}, "too deep"), ({"scalar_bytes": 11}, "too long a value"), ({"script_nodes": 1}, "too many script_nodes"), ({"text_bytes": 40}, "too many text_bytes")):
        kept, over = documents.xml_document_budgets(hosts, limit)
        assert kept.count() == 0 and [x.reason for x in over.collect()] == [why]
    kept, over = documents.xml_document_budgets(hosts)
    assert kept.count() == 2 and over.count() == 0


def test_documents_hold_a_bounded_number_of_rows(spark):
    rows = [(i % 2, f"10.0.0.{i}", None, "up", "r", []) for i in range(25)]
    hosts = spark.createDataFrame(rows, "g int, ip string, hostname string, status string, reason string, ports array<struct<port int, protocol string, state string, service string>>")
    text = documents.write_hosts_json(hosts, ["g"], 4)
    assert sorted((r.g, r.piece) for r in text.collect()) == [(0, i) for i in range(4)] + [(1, i) for i in range(3)]
    assert documents.read_hosts_json(text.select("value"))[0].count() == 25
