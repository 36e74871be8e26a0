"""Bounded slices against a plain walk, and what a hub shows to its roots."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import graph


def size(**x):
    return len(json.dumps(x, separators=(",", ":")))


def walk(rows, root, depth, nodes, edges, work, most_bytes, direction, relations):
    """One root's slice, edge by edge."""
    near = {}
    for edge, a, b, relation in sorted(set(rows)):
        for node, other in [(a, b)] * (direction != "in") + [(b, a)] * (direction == "in" or direction == "both" and a != b):
            near.setdefault(node, []).append((edge, other, a, b, relation))
    seen, frontier, held, kept, why, looked, total = [root], [root], set(), [], set(), 0, size(n=root) - 6 + 1
    for d in range(1, depth + 2):
        reached, stop = [], None
        for edge, other, a, b, relation in (e for node in frontier for e in near.get(node, [])):
            if looked == work:
                stop = "max_work"
                break
            looked += 1
            if relation not in relations or edge in held:
                continue
            if d > depth:
                why.add("max_depth")
                continue
            if len(held) >= edges:
                stop = "max_edges"
                break
            if other not in seen and len(seen) >= nodes:
                why.add("max_nodes")
                continue
            more = size(edge=edge, **{"from": a, "to": b}, relation=relation) + 1 + (0 if other in seen else size(n=other) - 6 + 1)
            if total + more > most_bytes:
                stop = "max_bytes"
                break
            total += more
            held.add(edge)
            kept.append((root, edge, a, b, relation, d))
            if other not in seen:
                seen.append(other)
                reached.append(other)
        frontier = reached
        if stop:
            why.add(stop)
            break
    return kept, (root, len(seen), len(held), looked, total, sorted(why))


@pytest.mark.parametrize(
    ("direction", "bounds"),
    [("both", (9, 14, 60, 5_000)), ("both", (7, 500, 90, 5_000)), ("both", (5, 9, 1_000, 5_000)), ("both", (40, 60, 70, 1_500)), ("out", (6, 12, 80, 5_000)), ("in", (6, 8, 45, 5_000))],
)
def test_slices_are_those_of_a_plain_walk(spark, direction, bounds):
    rng = random.Random(f"{direction}{bounds}")
    ends = [("hub", f"a{rng.randrange(60)}") for _ in range(90)] + [(f"b{rng.randrange(40)}", "hub") for _ in range(60)] + [("rim", rng.choice(["hub", f"a{rng.randrange(60)}", f"b{rng.randrange(8)}"])) for _ in range(50)]
    ends += [(f"b{rng.randrange(12)}", f"a{rng.randrange(12)}") for _ in range(60)] + [("hub", "hub"), ("a1", "a1"), ("a2", "rim")]
    relations = ("calls", "uses")
    rows = [(f"e{rng.randrange(10_000):05d}{i:03d}", a, b, rng.choice(["calls", "uses", "mentions"])) for i, (a, b) in enumerate(ends)]
    roots = sorted({x for e in ends for x in e} | {"lone"})
    df = spark.createDataFrame(rows + rows[:20], "edge string, from string, to string, relation string")
    parts, told = graph.bounded_slice(df, spark.createDataFrame([(r,) for r in [*roots, roots[0], None]], "root string"), 3, *bounds, direction, relations)
    want = [walk(rows, r, 3, *bounds, direction, relations) for r in roots]
    assert sorted(tuple(r) for r in parts.select("root", "edge", "from", "to", "relation", "depth").collect()) == sorted(x for kept, _ in want for x in kept)
    assert sorted(tuple(r) for r in told.select("root", "nodes", "edges", "work", "bytes", "reasons").collect()) == sorted(w for _, w in want)


def test_a_hub_shows_no_more_than_may_be_reached(spark, monkeypatch):
    shown, plain = [], graph._looked
    def counted(*given):
        out = plain(*given)
        shown.append(out.select(F.sum(F.size("entries"))).first()[0])
        return out
    monkeypatch.setattr(graph, "_looked", counted)
    edges = spark.createDataFrame([("hub", f"n{i:03d}") for i in range(300)] + [(f"r{i}", "hub") for i in range(20)], "from string, to string")
    parts, told = graph.bounded_slice(edges, spark.createDataFrame([(f"r{i}",) for i in range(20)], "root string"), 2, 5, 90, 250)
    assert parts.count() == 20 * 4 and {(r.nodes, r.edges, r.work, *r.reasons) for r in told.collect()} == {(5, 4, 250, "max_nodes", "max_work")}
    # of 249 edges that each root looks at, the three new nodes and the first that is too many
    assert shown == [20, 20 * 4]
