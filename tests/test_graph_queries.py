from collections import defaultdict

import pytest

import __spark_entry__ as entry
from evidentia.operators import graph

SF = "/root/testdata/sf0.001"


def keys(spark, table, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{table}.parquet").select(*columns).collect()]


def edges(spark):
    """Every edge of the five tables."""
    parts = (("orders", "c", "o_custkey", "o", "o_orderkey"), ("lineitem", "o", "l_orderkey", "s", "l_suppkey"), ("supplier", "s", "s_suppkey", "n", "s_nationkey"), ("nation", "n", "n_nationkey", "r", "n_regionkey"), ("region", "r", "r_regionkey", "n", "r_regionkey"))
    return {(f"{a}{x}", f"{b}{y}") for table, a, k, b, v in parts for x, y in keys(spark, table, k, v)}


def reached(pairs, roots, depth):
    step = defaultdict(set)
    for a, b in pairs:
        step[a].add(b)
    out = set()
    for root in roots:
        level, seen = {root}, {root}
        for d in range(depth + 1):
            out |= {(root, n, d) for n in level}
            level = {b for a in level for b in step[a]} - seen
            seen |= level
    return out


def got(spark, name):
    return sorted((r.root, r.node, r.depth) for r in entry.queries()[name](spark, SF).collect())


def test_slices_reach_over_every_order_and_line(spark):
    pairs, roots = edges(spark), [f"c{k}" for (k,) in keys(spark, "customer", "c_custkey")]
    assert got(spark, "graph_slice") == sorted(reached(pairs, roots, 3))
    assert got(spark, "sink_reach") == sorted(x for x in reached(pairs, roots, 4) if x[1].startswith("r"))
    back = {(b, a) for a, b in pairs}
    assert got(spark, "callers") == sorted(reached(back, {b for _, b in pairs if b.startswith("n")}, 2))


@pytest.mark.parametrize("few", [0, 12, 1000])
def test_the_last_level_is_not_written_and_few_nodes_bring_their_edges_alone(spark, monkeypatch, few):
    sizes, plain = {}, graph.staged

    def kept(df, name):
        out = plain(df, name)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(graph, "staged", kept)
    monkeypatch.setattr(graph, "FEW", few)
    roots = [f"c{i}" for i in range(20)]
    pairs = [(r, f"m{i % 5 + j}") for i, r in enumerate(roots) for j in range(3)] + [(f"m{i}", f"h{i % 2}") for i in range(7)]
    pairs += [("h0", "e"), ("h1", "h1"), ("h1", "c3"), ("c3", "c3"), ("m2", "c1"), ("c1", "c2")] + [(f"z{i}", f"z{i + 1}") for i in range(50)]
    frame = spark.createDataFrame([*pairs, *pairs, (None, "c1")], '"from" string, "to" string'.replace('"', "`"))
    for depth in (0, 1, 2, 3, 6):
        sizes.clear()
        got = graph.graph_slice(frame, spark.createDataFrame([(r,) for r in [*roots, "c1"]], "root string"), depth)
        assert sorted(map(tuple, got.collect())) == sorted(reached(set(pairs), roots, depth))
        assert len(sizes.get("frontier", [])) == max(depth - 1, 0)
        # nodes that many roots reach bring their edges to the frontier, and no others
        assert all(n <= 12 for n in sizes.get("near", [])) and ("near" in sizes) == (few == 12 and depth > 1)
    ends = spark.createDataFrame([("h0",), ("c1",), ("h0",)], "node string")
    for depth in (1, 3):
        got = graph.graph_slice(frame, spark.createDataFrame([(r,) for r in roots], "root string"), depth, ends=ends)
        assert sorted(map(tuple, got.collect())) == sorted(x for x in reached(set(pairs), roots, depth) if x[1] in ("h0", "c1"))
