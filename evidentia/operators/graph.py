"""Bounded breadth-first slices of a fact graph, for all roots at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import bucketed, staged


def graph_edges(facts: DataFrame) -> DataFrame:
    """facts (subject, kind, object) as edges; packages and behaviours are nodes of their own kind."""
    to = F.when(F.col("kind").isin("package_use", "dependency"), F.concat(F.lit("package:"), "object")).when(F.col("kind") == "behavior", F.concat(F.lit("behavior:"), "object")).otherwise(F.col("object"))
    return facts.select(F.col("subject").alias("from"), to.alias("to"), F.col("kind").alias("relation"))


#: Rows of a frontier, or edges of its nodes, that each task may hold: the other side is not shuffled for them.
FEW = 400_000


def _led(frontier: DataFrame, step: DataFrame) -> tuple[DataFrame, DataFrame]:
    """frontier and step for their join: a side that is counted and small is broadcast, and only edges of a frontier's nodes are kept where these are few."""
    # the estimate only says whether nodes are worth a count
    n, nodes = frontier.agg(F.count("*"), F.approx_count_distinct("node")).first()
    if n <= FEW:
        return F.broadcast(frontier), step
    if nodes <= FEW:
        at = staged(frontier.select("node").distinct(), "nodes")
        if at.count() <= FEW:
            step = staged(step.join(F.broadcast(at), "node", "left_semi"), "near")
            if step.count() <= FEW:
                return frontier, F.broadcast(step)
    return frontier, step


def graph_slice(edges: DataFrame, roots: DataFrame, depth: int = 3, direction: str = "out", ends: DataFrame | None = None) -> DataFrame:
    """(root, node, depth): the nodes within `depth` steps of each root, at their least depth; if given, only those of ends (node).

    Each level joins the frontier with the edges on its node, a key that adaptive execution
    splits where a node is a hub, and drops what the root has seen. The first level has nothing
    to drop but the root, as its edges are distinct. A level is one shuffle of the pairs that it
    finds, and one of frontier and edges unless one of them is counted and small: many roots
    that meet in few nodes are not sent to those nodes. Edges are made distinct once. The last
    level takes the edges to ends alone and is not written.
    """
    step = edges.select(F.col("from").alias("node"), F.col("to").alias("next")) if direction == "out" else edges.select(F.col("to").alias("node"), F.col("from").alias("next"))
    step = staged(step.where("node IS NOT NULL").distinct(), "steps")
    seen = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct()
    frontier = seen
    for d in range(1, depth + 1):
        last = step if ends is None or d < depth else step.join(ends.select(F.col("node").alias("next")).distinct(), "next", "left_semi")
        near, last = (frontier, last) if d == 1 else _led(frontier.select("root", "node"), last)
        found = near.join(last, "node").select("root", F.col("next").alias("node"))
        if d == 1:
            found = found.where(~F.col("node").eqNullSafe(F.col("root")))
        else:
            found = found.distinct().join(seen, ["root", "node"], "left_anti")
        frontier = found.withColumn("depth", F.lit(d))
        if d < depth:
            frontier = staged(frontier, "frontier")
        seen = seen.union(frontier)
        if d < depth and frontier.isEmpty():
            break
    return seen if ends is None else seen.join(ends.select("node").distinct(), "node", "left_semi").select("root", "node", "depth")


@dataclass(frozen=True)
class Bounds:
    """What one root's slice may hold: nodes with the root, edges, edges looked at, and bytes of edges and nodes as JSON."""

    nodes: int = 200
    edges: int = 500
    work: int = 10_000
    bytes: int = 256_000


def _text_size(column: str) -> Column:
    return F.octet_length(F.to_json(F.struct(F.col(column).alias("n")))).cast("long") - 6


#: Edges of the nodes of one bucket, and edges that the roots of one bucket may look at, about.
BUCKET, LOOKS = 1_000_000, 4_000_000


def _adjacent(edges: DataFrame, direction: str, relations: tuple[str, ...] | None, most: int, buckets: int) -> DataFrame:
    """(node, degree, entries) in buckets of nodes: how many edges a node has, `most` at most and the first by their ids, and those of the relations asked for with their place among them. A loop is one edge.

    A hub is cut within each part of the edges before these are dealt by their nodes.
    """
    named = edges if "relation" in edges.columns else edges.withColumn("relation", F.lit(None).cast("string"))
    if "edge" not in edges.columns:
        named = named.withColumn("edge", F.to_json(F.struct("from", "to", "relation")))
    salt = F.pmod(F.xxhash64("edge"), F.lit(4 * buckets))
    dealt = named.select("edge", "from", "to", "relation").repartition(buckets, salt).select("edge", F.struct("from", "to", "relation").alias("e"), salt.alias("salt"))
    once = dealt.groupBy("salt", "edge").agg(F.min("e").alias("e")).select("salt", "edge", "e.*").where(F.col("from").isNotNull() & F.col("to").isNotNull())
    side = lambda node, next_: F.struct(F.col(node).alias("node"), F.col(next_).alias("next"), F.lit(node == "from").alias("forward"))
    sides = {"out": F.array(side("from", "to")), "in": F.array(side("to", "from")), "both": F.when(F.col("from") == F.col("to"), F.array(side("from", "to"))).otherwise(F.array(side("from", "to"), side("to", "from")))}[direction]
    # of an edge that is not asked for, only its place counts
    wanted = F.lit(True) if relations is None else F.coalesce(F.col("relation").isin(*relations), F.lit(False))
    rows = once.select("salt", "edge", "relation", wanted.alias("wanted"), F.inline(sides)).select("salt", "node", "edge", *(F.when(F.col("wanted"), F.col(c)).alias(c) for c in ("next", "relation", "forward")))

    def first(of: DataFrame, *key: str) -> DataFrame:
        return of.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("edge"))).where(F.col("place") <= most)

    placed = first(first(rows, "salt", "node").drop("salt", "place").repartition(buckets, "node"), "node")
    entry = F.struct("place", "edge", "next", "relation", "forward")
    listed = placed.groupBy("node").agg(F.count("*").cast("int").alias("degree"), F.sort_array(F.collect_list(F.when(F.col("next").isNotNull(), entry))).alias("entries"))
    return bucketed(listed, "steps", "node", buckets, dealt=True)


def _looked(opened: DataFrame, near: DataFrame, buckets: int, both: bool) -> DataFrame:
    """(root, own, before, total, entries): what opened nodes show to their roots, up to the last edge that a root may look at.

    New nodes beyond `room` are never reached. So where a level's first node comes with the nodes
    that its root holds, its list ends at the first node that is too many, unless an edge behind it
    leads to one of those that the root holds then. The edges behind it change nothing: if no more
    are taken, that one tells it, and what is looked at is known from the degrees.
    """
    rows = opened.repartition(buckets, "node").join(near, "node")
    rows = rows.withColumn("entries", F.slice("entries", F.lit(1), F.size(F.filter("entries.place", lambda p: p <= F.col("left"))))).withColumn("nexts", F.col("entries.next"))
    rows = rows.withColumn("fresh", F.array_except("nexts", "seen")).withColumn("cut", F.array_position("nexts", F.get("fresh", "room")).cast("int"))
    rows = rows.withColumn("rest", F.slice("nexts", F.col("cut") + 1, F.size("nexts")))
    # an edge to a node that was opened before is held already
    later = F.slice("seen", F.col("own"), F.size("seen")) if both else F.col("seen")
    rows = rows.withColumn("trim", F.coalesce(~F.arrays_overlap("rest", F.concat(later, F.slice("fresh", F.lit(1), F.col("room")))), F.lit(False)))
    return rows.select("root", "own", "before", "total", F.when(F.col("trim"), F.slice("entries", F.lit(1), F.col("cut"))).otherwise(F.col("entries")).alias("entries"))


def bounded_slice(edges: DataFrame, roots: DataFrame, depth: int = 3, most_nodes: int = 200, most_edges: int = 500, most_work: int = 10_000, most_bytes: int = 256_000, direction: str = "out", relations: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """(root, edge, from, to, relation, depth) of each root's edges within the bounds, and (root, nodes, edges, work, bytes, reasons): what a root's slice holds, and which bounds cut it.

    edges (from, to) may have a relation and an id (edge); without an id, equal edges are one. A
    root's nodes are opened in the order they were reached, and each one's edges taken by id.
    Work counts every edge that is looked at; one that is held already, or of a relation not
    asked for, counts for nothing else. Edges, work and bytes end a slice where they are met;
    past most_nodes, edges to new nodes are left out and others are still taken. Nodes at the
    last depth are looked at, and max_depth is a reason if one has an edge that is not held. A hub
    is cut at most_work edges before any join. Edges without an end are left out.

    A root's state is one row, as the bounds keep it small: its sums and the nodes that it holds, in
    the order they are opened. Of a root that goes on, each node that was opened showed all its edges:
    an edge is held if its other end was opened before, so the edges need not be kept with the state.
    A node's edges are one row, in buckets of nodes. A level asks the nodes for their degrees, then
    those that the root may look at for their edges: what is shuffled are nodes and short lists,
    and a hub's list that leads beyond most_nodes ends there.
    """
    bounds, both = Bounds(most_nodes, most_edges, most_work, most_bytes), direction == "both"
    wanted = roots.where(F.col("root").isNotNull()).select("root").distinct()
    buckets = int(min(max(2 * edges.count() / BUCKET, roots.count() * (bounds.work + 1) / LOOKS, edges.sparkSession.sparkContext.defaultParallelism), 2_048))
    near = _adjacent(edges, direction, relations, bounds.work + 1, buckets)
    zero, none = F.lit(0).cast("long"), F.array().cast("array<string>")
    state = staged(wanted.select("root", (zero + 1).alias("nodes"), zero.alias("edges"), zero.alias("work"), (_text_size("root") + 1).alias("bytes"), none.alias("reasons"), F.array("root").alias("seen"), F.lit(1).alias("opens")), "state")
    sums = ["nodes", "edges", "work", "bytes", "reasons"]
    ended, levels = [], []
    line = Window.partitionBy("root").orderBy("step")
    upto, above = line.rowsBetween(Window.unboundedPreceding, Window.currentRow), line.rowsBetween(Window.unboundedPreceding, -1)
    left, room = F.lit(bounds.work + 1) - F.col("work"), F.greatest(F.lit(bounds.nodes) - F.col("nodes"), F.lit(0)).cast("int")
    for d in range(1, depth + 2):
        live = state.where("opens IS NOT NULL")
        ahead = live.select("root", "opens", F.posexplode(F.slice("seen", F.col("opens"), F.size("seen"))).alias("at", "node")).select("root", (F.col("opens") + F.col("at")).alias("own"), "node")
        known = ahead.repartition(buckets, "node").join(near.select("node", "degree"), "node").select("root", "own", "degree").repartition(buckets, "root")
        known = known.withColumns({"before": F.sum("degree").over(Window.partitionBy("root").orderBy("own")) - F.col("degree"), "total": F.sum("degree").over(Window.partitionBy("root"))})
        # nodes whose edges stand behind the last that a root may look at are not opened at all
        opened = known.join(live.select("root", "nodes", "work", "seen"), "root").withColumns({"left": left - F.col("before"), "room": room}).where("left > 0")
        home = live.select("root", *sums, "seen")
        if d > depth:
            # a node that leads to more nodes than the root holds leads to a new one
            looked = opened.select("root", "own", "total", "nodes", (F.col("left") - 1).alias("left"), F.get("seen", F.col("own") - 1).alias("node")).repartition(buckets, "node").join(near, "node")
            looked = looked.withColumn("nexts", F.array_distinct(F.slice("entries.next", F.lit(1), F.size(F.filter("entries.place", lambda p: p <= F.col("left"))))))
            looked = looked.withColumn("more", F.size("nexts") > F.col("nodes")).select("root", "own", "total", "more", F.when(~F.col("more"), F.col("nexts")).alias("nexts"))
            looked = looked.repartition(buckets, "root").groupBy("root").agg(F.max("total").alias("total"), F.max("more").alias("more"), F.collect_list(F.when(~F.col("more"), F.struct("own", "nexts"))).alias("lists"))
            asks = F.exists("lists", lambda x: F.size(F.array_except(x["nexts"], F.slice("seen", F.lit(1), x["own"] - 1) if both else none) if both else x["nexts"]) > 0)
            cut = F.coalesce(F.col("total") >= left, F.lit(False))
            state = home.join(looked, "root", "left").withColumn("hit", F.coalesce(F.col("more") | asks, F.lit(False)))
            state = staged(state.select("root", "nodes", "edges", F.when(cut, F.lit(bounds.work)).otherwise(F.col("work") + F.coalesce("total", zero)).cast("long").alias("work"), "bytes", F.concat("reasons", F.when(cut, F.array(F.lit("max_work"))).otherwise(none), F.when(F.col("hit"), F.array(F.lit("max_depth"))).otherwise(none)).alias("reasons")), "state")
            ended.append(state)
            break
        # of the level's first node alone, new nodes are counted before any other's
        asks = (F.col("before") == 0) & (F.least(F.col("degree").cast("long"), F.col("left")) > F.col("room") + 1 + F.col("nodes"))
        shown = _looked(opened.select("root", "own", "before", F.when(F.col("before") == 0, F.col("total")).alias("total"), "left", F.get("seen", F.col("own") - 1).alias("node"), *(F.when(asks, F.col(c)).alias(c) for c in ("room", "seen"))), near, buckets, both)
        shown = shown.repartition(buckets, "root").groupBy("root").agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("own", "before", "entries"))).alias("lists"))
        each = home.join(shown, "root", "left").withColumn("gained", F.slice(F.array_except(F.flatten(F.transform("lists", lambda x: x["entries"]["next"])), F.col("seen")), F.lit(1), room))
        each = each.select("root", *sums, "total", "seen", "gained", F.posexplode_outer("lists").alias("nth", "x")).select("*", "x.own", "x.before", F.posexplode_outer("x.entries").alias("at", "e"))
        node, forward = F.get("seen", F.col("own") - 1), F.col("e.forward")
        # what stays as it is goes with the root's first row alone
        once = (F.coalesce("nth", F.lit(0)) == 0) & (F.coalesce("at", F.lit(0)) == 0)
        each = each.select("root", "nodes", "edges", "work", "bytes", *(F.when(once, F.col(c)).alias(c) for c in ("total", "reasons", "seen")), (F.col("before") + F.col("e.place")).alias("step"), "e.edge", F.when(forward, node).otherwise(F.col("e.next")).alias("from"), F.when(forward, F.col("e.next")).otherwise(node).alias("to"), "e.relation", "e.next", "own", F.array_position("seen", F.col("e.next")).alias("held"), F.array_position("gained", F.col("e.next")).alias("new"))
        asked = F.col("edge").isNotNull() & (F.lit(not both) | (F.col("held") == 0) | (F.col("held") >= F.col("own")))
        each = each.withColumn("asked", F.coalesce(asked, F.lit(False))).withColumn("taken", (F.col("asked") & ((F.col("held") > 0) | (F.col("new") > 0))).cast("int"))
        each = each.withColumn("first", F.coalesce(F.col("new") > F.coalesce(F.max("new").over(above), zero), F.lit(False)))
        weight = F.octet_length(F.to_json(F.struct("edge", "from", "to", "relation"))).cast("long") + 1
        gain = F.when(F.col("taken") == 1, weight + F.when(F.col("first"), _text_size("next") + 1).otherwise(0)).otherwise(0)
        each = each.withColumns({"n_nodes": F.col("nodes") + F.coalesce(F.max("new").over(upto), zero), "n_edges": F.col("edges") + F.sum("taken").over(upto), "n_bytes": F.col("bytes") + F.sum(gain).over(upto)})
        # a slice that holds all its edges ends at the next one that it asks for, whether its node is new or not
        full = F.col("asked") & (F.col("n_edges") - F.col("taken") >= bounds.edges)
        met = F.when(F.col("step") >= left, "max_work").when(full, "max_edges").when(F.col("n_bytes") > bounds.bytes, "max_bytes")
        each = each.withColumn("stop", F.first(F.when(met.isNotNull(), F.struct("step", met.alias("reason"))), ignorenulls=True).over(upto))
        good = F.coalesce(F.col("step") < F.col("stop.step"), F.lit(True))
        took = each.groupBy("root").agg(
            *(F.first(c, ignorenulls=True).alias(c) for c in (*sums, "total", "seen")),
            *(F.max(F.when(good, F.col(f"n_{c}"))).alias(f"m_{c}") for c in ("nodes", "edges", "bytes")),
            F.collect_list(F.when(good & (F.col("taken") == 1), F.struct("edge", "from", "to", "relation"))).alias("parts"),
            F.sort_array(F.collect_list(F.when(good & F.col("first"), F.struct("step", "next")))).alias("reached"),
            F.max(good & F.col("asked") & (F.col("taken") == 0)).alias("shut"), F.max("stop").alias("stop"),
        )
        took = took.withColumn("why", F.coalesce(F.col("stop.reason"), F.when(F.col("total") >= left, F.lit("max_work"))))
        # the edge at which the work ends was not looked at, one at which another bound was met was
        work = F.when(F.col("why") == "max_work", F.lit(bounds.work)).otherwise(F.col("work") + F.coalesce(F.col("stop.step"), F.col("total"), zero)).cast("long")
        goes = F.col("why").isNull() & (F.size("reached") > 0)
        reasons = F.concat("reasons", F.when(F.col("shut"), F.array(F.lit("max_nodes"))).otherwise(none), F.when(F.col("why").isNotNull(), F.array("why")).otherwise(none))
        state = staged(took.select("root", *(F.coalesce(f"m_{c}", c).alias(c) for c in ("nodes", "edges")), work.alias("work"), F.coalesce("m_bytes", "bytes").alias("bytes"), reasons.alias("reasons"), F.when(goes, F.concat("seen", F.col("reached.next"))).alias("seen"), F.when(goes, F.size("seen") + 1).alias("opens"), "parts"), "level")
        levels.append(state.select("root", F.inline("parts"), F.lit(d).alias("depth")))
        ended.append(state.where("opens IS NULL"))
        if state.where("opens IS NOT NULL").isEmpty():
            break
    kept = reduce(DataFrame.union, levels) if levels else edges.select(F.lit("").alias("root"), F.lit("").alias("edge"), F.col("from").cast("string"), F.col("to").cast("string"), F.lit("").alias("relation"), F.lit(0).alias("depth")).where("false")
    report = reduce(DataFrame.union, (e.select("root", *sums) for e in ended))
    return kept, report.withColumn("reasons", F.array_sort(F.array_distinct("reasons")))


def sink_reach(edges: DataFrame, roots: DataFrame, sinks: DataFrame, depth: int = 3) -> DataFrame:
    """(root, node, depth) of the sinks (node) that a root reaches.

    Searched from the side that has fewer ends: a node is then held once for each of them, and not
    once for each root whose way leads over it.
    """
    roots, sinks = staged(roots.select("root").distinct(), "roots"), staged(sinks.select("node").distinct(), "sinks")
    if sinks.count() >= roots.count():
        return graph_slice(edges, roots, depth, ends=sinks)
    back = graph_slice(edges, sinks.select(F.col("node").alias("root")), depth, "in", roots.select(F.col("root").alias("node")))
    return back.select(F.col("node").alias("root"), F.col("root").alias("node"), "depth")
