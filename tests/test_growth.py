"""Work that stays bounded as tables grow: few keys with many rows, texts made once, elements parsed once."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import graph, policy, resolution, scan
from evidentia.sources import documents


def tasks(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_hypotheses_of_one_source_are_made_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(scan.paired, "__defaults__", (500,))
    candidates = spark.createDataFrame([(i, "a" if i else None, "sink") for i in range(101)], "candidate_id long, source string, sink string")
    seeds = spark.createDataFrame([(i, "a", "v") for i in range(50)] + [(50, "a", ""), (51, None, "v"), (52, "b", "v")], "seed_id long, source string, value string")
    made = policy.build_hypotheses(candidates, seeds)
    assert tasks(made) > 3
    assert made.select("candidate_id", "seed_id").distinct().count() == made.count() == 100 * 50


def test_origins_of_one_address_are_found_by_many_tasks_and_once(spark, monkeypatch):
    monkeypatch.setattr(scan.paired, "__defaults__", (100,))
    findings = spark.createDataFrame([(i, "http://x.org/q/a") for i in range(60)] + [(7, "http://x.org/q/a"), (3, "http://x.org/q/b")], "finding_id long, url string")
    jobs = spark.createDataFrame([(i, "http://x.org/q/KEY", "KEY", "ab"[i % 2]) for i in range(60)], "job_id long, template string, keyword string, value string")
    found = policy.job_origin(findings, jobs)
    assert tasks(found) > 3
    want = sorted([(i, j) for i in range(60) for j in range(0, 60, 2)] + [(3, j) for j in range(1, 60, 2)])
    assert sorted(map(tuple, found.collect())) == want


def test_texts_of_regions_are_made_for_lines(spark):
    points = spark.createDataFrame([("f", i, i % 3) for i in range(12)] + [("g", 12, 1)], "file string, point_id long, at long")
    spans = spark.createDataFrame([("f", 1, 0, 1, "if"), ("f", 2, 1, 1, "case")], "file string, scope_id long, first long, last long, kind string")
    made = resolution.control_regions(points, spans, lambda c: F.array_join(F.transform(c, lambda r: r["kind"]), ";"))
    texts = {0: "if", 1: "if;case", 2: ""}
    assert sorted(map(tuple, made.collect())) == sorted([(i, texts[i % 3]) for i in range(12)] + [(12, "")])


def test_host_elements_are_parsed_once(spark):
    rows = [("a", f'<host><status state="up"/><address addr="10.0.0.{i}" addrtype="ipv4"/></host>') for i in range(40)] + [("b", "<host><status></host>"), ("b", "<host/>")]
    hosts = documents.hosts_from_xml(spark.createDataFrame(rows, "document string, value string").coalesce(1))
    assert "from_xml" not in hosts._jdf.queryExecution().optimizedPlan().toString().lower() and "xmltostructs" not in hosts._jdf.queryExecution().optimizedPlan().toString().lower()
    assert sorted(r["ip"] for r in hosts.collect()) == sorted(f"10.0.0.{i}" for i in range(40))


def test_sinks_are_searched_from_the_fewer_side(spark, monkeypatch):
    ways, plain = [], graph.graph_slice
    monkeypatch.setattr(graph, "graph_slice", lambda edges, roots, depth=3, direction="out", ends=None: (ways.append(direction), plain(edges, roots, depth, direction, ends))[1])
    edges = spark.createDataFrame([(f"c{i}", "m") for i in range(9)] + [("m", "s"), ("c0", "s"), ("s", "c1"), ("c8", None)], "from string, to string")
    roots = spark.createDataFrame([(f"c{i}",) for i in range(9)] + [("c0",), ("s",)], "root string")
    sinks = spark.createDataFrame([("s",), ("s",)], "node string")
    got = graph.sink_reach(edges, roots, sinks, 3)
    assert sorted(map(tuple, got.select("root", "node", "depth").collect())) == sorted([("c0", "s", 1), ("s", "s", 0)] + [(f"c{i}", "s", 2) for i in range(1, 9)])
    other = graph.sink_reach(edges, sinks.select(F.col("node").alias("root")), roots.select(F.col("root").alias("node")), 3)
    assert sorted(map(tuple, other.select("root", "node", "depth").collect())) == [("s", "c1", 1), ("s", "s", 0)]
    assert ways == ["in", "out"]


def test_levels_of_slices_hold_what_was_taken(spark, monkeypatch):
    sizes, plain = {}, graph.staged
    def kept(df, name):
        out = plain(df, name)
        sizes.setdefault(name, []).append(out.count())
        return out
    monkeypatch.setattr(graph, "staged", kept)
    # a hub whose edges lead to nodes beyond the bound: all are looked at, and neither written nor lost from the counts
    edges = spark.createDataFrame([("hub", f"n{i:03d}") for i in range(200)] + [("r", "hub")], "from string, to string")
    parts, told = graph.bounded_slice(edges, spark.createDataFrame([("r",)], "root string"), 2, 5, 90, 150)
    assert parts.count() == 4 and [tuple(x) for x in told.select("nodes", "edges", "work", "reasons").collect()] == [(5, 4, 150, ["max_nodes", "max_work"])]
    assert max(sizes["level"]) <= 6
