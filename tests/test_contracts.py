from pyspark.sql import functions as F

from evidentia.operators import contracts, facts, lineage, rules


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_urls_are_allowed_by_host_and_segment(spark):
    schema = "scheme string, port int, host string, subdomains boolean, path string"
    allowed = spark.createDataFrame([("https", 443, "app.example", False, "/api"), ("https", 443, "open.example", True, "/")], schema)
    asked = {
        "https://app.example/api": True,
        "https://APP.example/api/x?q=1": True,
        "https://app.example/apix": False,
        "https://app.example/api/../admin": False,
        "https://app.example/a%70i/b": True,
        "https://x.app.example/api": False,
        "https://a.open.example": True,
        "https://open.example/": False,
        "http://a.open.example/": False,
        "https://a.open.example:8443/": False,
        "not an address": False,
        None: False,
    }
    found = contracts.authorize_urls(spark.createDataFrame([(u,) for u in asked], "url string"), allowed)
    assert {r.url: r.allowed for r in found.collect()} == asked
    none = contracts.authorize_urls(spark.createDataFrame([("https://app.example/api",)], "url string"), allowed.limit(0))
    assert [r.allowed for r in none.collect()] == [False]


def test_networks(spark):
    nets = spark.createDataFrame([("10.1.2.0", 24), ("192.168.9.9", 32), ("172.16.0.0", 12)], "base string, prefix int")
    asked = {"10.1.2.255": True, "10.1.3.0": False, "192.168.9.9": True, "192.168.9.8": False, "172.31.0.1": True, "172.32.0.1": False, "host": False}
    ips = spark.createDataFrame([(i,) for i in asked], "ip string")
    assert {r.ip: r.allowed for r in contracts.authorize_networks(ips, nets).collect()} == asked
    assert not any(r.allowed for r in contracts.authorize_networks(ips, nets.limit(0)).collect())
    every = contracts.authorize_networks(ips, spark.createDataFrame([("0.0.0.0", 0)], "base string, prefix int"))
    assert {r.ip for r in every.collect() if not r.allowed} == {"host"}


def test_action_contract_names_each_rule(spark):
    data = [(1, "t", "check.v1", "c", ["url"], "none"), (2, "t", "check", " ", ["url", "url"], "maybe"), (3, "u", "a.v2", "a", [], None), (4, "u", "a.v2", "a", ["ip"], "none"), (5, "w", "b.v1", None, ["ip"], "none")]
    found = contracts.action_contract(spark.createDataFrame(data, "action_id int, tool string, action string, name string, accepts array<string>, effect string"))
    assert rows(found) == [(1, ""), (2, "version,name,accepts,effect"), (3, "accepts,effect,duplicate"), (4, "duplicate"), (5, "name")]


def test_scope_of_addresses_networks_and_names(spark):
    targets = ["10.1.2.3", "10.2.0.1", "10.1.0.0/16", "10.1.4.0/24", "10.0.0.0/8", "a.corp", "b.corp", "2001:db8::9", "2001:DB8:0::/40", "2001:db8::/64", "2001:db9::1", "10.1.2", "10.1.2.3/x", "10.1.2.3/40", None]
    networks = spark.createDataFrame([("10.1.0.0", 16), ("2001:db8::", 48), ("bad", 3), ("10.9.0.0", 77)], "base string, prefix int")
    names = spark.createDataFrame([("a.corp",)], "hostname string")
    asked = spark.createDataFrame([(t,) for t in targets], "target string")
    assert {r.target for r in contracts.authorize_ips(asked, networks, names).where("allowed").collect()} == {"10.1.2.3", "10.1.0.0/16", "10.1.4.0/24", "a.corp", "2001:db8::9", "2001:db8::/64"}
    assert contracts.authorize_ips(asked, networks.limit(0), names.limit(0)).where("allowed").count() == 0


def test_one_denied_target_denies_the_plan(spark):
    plans = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "a"), ("r", "unknown")], "plan string, target string")
    allowed = spark.createDataFrame([("a", True), ("b", False)], "target string, allowed boolean")
    assert rows(contracts.scope_split(plans, allowed)) == [("p", 2, 1, False), ("q", 1, 0, True), ("r", 1, 1, False)]


def test_candidates_by_their_sites(spark):
    definitions = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "subject string")
    sites = [("a", 1), ("a", 1), ("b", 1), ("b", 2), *(("d", i) for i in range(33))]
    found = contracts.build_candidates(definitions, spark.createDataFrame(sites, "subject string, site int"))
    assert rows(found) == [("a", 1, "unique"), ("b", 2, "ambiguous"), ("c", 0, "no_site"), ("d", 33, "too_many_sites")]


def test_a_shell_call_is_a_match_and_a_port_only_if_spawned(spark):
    data = [("os", "cmd", 1, "dynamic", None), ("System", "cmd", 1, "dynamic", None), ("erlang", "open_port", 2, "literal", "spawn"), ("erlang", "open_port", 2, "literal", "fd")]
    found = rules.unsafe_exec(spark.createDataFrame(data, "module string, fn string, arity int, shape string, head string"))
    assert rows(found.select("module", "fn", "confidence")) == [("erlang", "open_port", "low"), ("os", "cmd", "medium")]


def test_reaching_definitions_equal_all_pairs(spark):
    data = [(i, "f", "xy"[i % 2], i // 5 % 9) for i in range(120)]
    uses = spark.createDataFrame(data, "use_id long, file string, variable string, at long")
    bindings = uses.where("use_id % 3 > 0").withColumnRenamed("use_id", "binding_id")
    want = []
    for u, _, v, at in data:
        held = sorted(((-b_at, b) for b, _, w, b_at in data if b % 3 and w == v and b_at <= at and b != u))
        want += [(u, b, i, len(held) > 8, len(held) > 1) for i, (_, b) in enumerate(held[:8], 1)]
    assert rows(facts.reaching_definitions(uses, bindings)) == sorted(want, key=repr)


def test_lineage_ends_where_the_trail_does(spark):
    findings = spark.createDataFrame([("f1", "ports", "open_port", "10.0.0.1:22")], "id string, source string, category string, locus string")
    seeds = lineage.promote_findings(findings, "web")
    seed = seeds.first().seed_id
    checked = spark.createDataFrame([(1, seed), (2, "other")], "validation_id int, seed_id string")
    assert rows(lineage.finding_lineage(seeds, findings, checked)) == [(1, seed, "f1", "open_port", "10.0.0.1:22"), (2, "other", None, None, None)]


def test_a_store_joins_one_write_with_one_read(spark):
    data = [(1, 1, 5, "write", "a"), (1, 2, 6, "read", "a"), (2, 1, 5, "write", "a"), (2, 1, 6, "read", "a"), (3, 1, 5, "write", "a"), (3, 1, 6, "write", "b"), (3, 2, 7, "read", "b")]
    found = lineage.store_write_read(spark.createDataFrame(data, "key int, process int, at int, kind string, value string"))
    assert rows(found.select("key", "joined")) == [(1, True), (2, False), (3, False)]
    assert found.where(F.col("writes") + F.col("reads") == 3).count() == 1
