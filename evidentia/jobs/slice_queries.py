"""Queries of bounded slices, each with DuckDB SQL that takes the levels one after the other."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dataflow, graph
from .queries import _query
from .views import VIEWS

VIEWS |= {
    "v_links": "SELECT concat(relation, ':', \"from\", '>', \"to\") AS edge, \"from\", \"to\", relation FROM (SELECT concat('c', CAST(o_custkey AS STRING)) AS \"from\", concat('o', CAST(o_orderkey AS STRING)) AS \"to\", 'calls' AS relation FROM {orders} UNION ALL SELECT concat('o', CAST(l_orderkey AS STRING)), concat('s', CAST(l_suppkey AS STRING)), CASE WHEN l_linenumber % 4 = 0 THEN 'mentions' ELSE 'invokes' END FROM {lineitem} UNION ALL SELECT concat('s', CAST(s_suppkey AS STRING)), concat('n', CAST(s_nationkey AS STRING)), 'uses_package' FROM {supplier} UNION ALL SELECT concat('n', CAST(n_nationkey AS STRING)), concat('n', CAST(n_regionkey AS STRING)), 'implements' FROM {nation}) t",
    "v_dataflow": "SELECT concat('x', CAST(event_id AS STRING)) AS fact_id, CASE event_type WHEN 'view' THEN 'binding' WHEN 'click' THEN 'call_argument' WHEN 'purchase' THEN 'return' WHEN 'signup' THEN 'parameter' ELSE 'guard' END AS kind, concat('f', CAST(user_id AS STRING)) AS subject, CASE event_type WHEN 'view' THEN concat('v', CAST(event_id % 6 AS STRING)) WHEN 'signup' THEN concat('v', CAST(event_id % 6 AS STRING)) WHEN 'click' THEN concat('f', CAST(event_id * 7 % 997 AS STRING), '#argument/', CAST(event_id % 3 AS STRING)) ELSE 'r' END AS object, concat('m', CAST(user_id % 7 AS STRING)) AS file, CAST(event_id * 31 % 500 + 1 AS INTEGER) AS line, CASE WHEN event_id % 10 > 0 THEN CAST(event_id % 40 AS INTEGER) END AS col, CASE event_type WHEN 'signup' THEN CAST(event_id % 4 AS INTEGER) END AS position, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN array(concat('v', CAST(event_id % 7 AS STRING)), 'v2') WHEN 2 THEN array('v2', 'v2') ELSE array(concat('v', CAST(event_id % 8 AS STRING))) END AS variables, CASE WHEN event_type IN ('view', 'purchase') AND event_id % 3 = 0 THEN concat('f', CAST(event_id * 13 % 1499 AS STRING)) WHEN event_id % 11 = 0 THEN '' END AS target FROM {events}",
}

BOUNDS = graph.Bounds(60, 90, 400, 7_000)
FLOW = dataflow.Bounds(depth=8, nodes=40, edges=70, work=70, bytes=16_000, definitions=4)


def _link_levels(depth: int, b: graph.Bounds) -> str:
    """The levels of bounded_slice over v_links, both ways, as common table expressions ending in `kept` and `told`."""
    text = [f"""s AS MATERIALIZED (SELECT edge, "from", "to", relation, relation <> 'mentions' AS wanted, strlen('{{"edge":"' || edge || '","from":"' || "from" || '","to":"' || "to" || '","relation":"' || relation || '"}}') + 1 AS weight FROM (SELECT DISTINCT * FROM v_links)),
a AS MATERIALIZED (SELECT "from" AS node, "to" AS next, * FROM s UNION ALL SELECT "to", "from", * FROM s WHERE "from" <> "to"),
n AS MATERIALIZED (SELECT node, count(*) AS degree FROM a GROUP BY 1),
q1 AS MATERIALIZED (SELECT root, 1 AS nodes, 0 AS edges, 0 AS work, strlen(root) + 3 AS bytes FROM (SELECT DISTINCT root FROM v_roots)),
f1 AS MATERIALIZED (SELECT root, root AS node, 0 AS turn FROM q1), seen1 AS (SELECT root, node FROM f1), held1 AS (SELECT root, '' AS edge FROM q1 WHERE false)"""]
    for d in range(1, depth + 2):
        rows = f"""e{d} AS MATERIALIZED (SELECT f.root, f.turn, a.*, q.nodes, q.edges, q.work, q.bytes, k.node IS NOT NULL AS known, a.wanted AND h.edge IS NULL AS asked0, row_number() OVER (PARTITION BY f.root ORDER BY f.turn, a.edge) AS step
 FROM (SELECT f.*, sum(degree) OVER (PARTITION BY root ORDER BY turn) - degree AS before FROM f{d} f JOIN n ON n.node = f.node) f JOIN a ON a.node = f.node AND f.before <= {b.work} JOIN q{d} q ON q.root = f.root LEFT JOIN seen{d} k ON k.root = f.root AND k.node = a.next LEFT JOIN held{d} h ON h.root = f.root AND h.edge = a.edge)"""
        text.append(rows)
        if d > depth:
            text.append(f"""why{d} AS (SELECT root, CASE WHEN work + step > {b.work} THEN 'max_work' ELSE 'max_depth' END AS reason FROM e{d} WHERE work + step > {b.work} OR asked0),
q{d + 1} AS (SELECT q.root, q.nodes, q.edges, q.work + coalesce(n, 0) AS work, q.bytes FROM q{d} q LEFT JOIN (SELECT root, count(*) AS n FROM e{d} WHERE work + step <= {b.work} GROUP BY 1) g ON g.root = q.root)""")
            break
        text.append(f"""g{d} AS (SELECT *, asked0 AND row_number() OVER (PARTITION BY root, edge ORDER BY step) = 1 AS asked FROM e{d}),
h{d} AS (SELECT *, CAST(asked AND NOT known AND row_number() OVER (PARTITION BY root, next, asked ORDER BY step) = 1 AS INTEGER) AS fresh FROM g{d}),
i{d} AS (SELECT *, nodes + sum(fresh) OVER (PARTITION BY root ORDER BY step) AS place FROM h{d}),
j{d} AS (SELECT *, asked AND NOT known AND min(CASE WHEN fresh = 1 THEN place END) OVER (PARTITION BY root, next) > {b.nodes} AS shut FROM i{d}),
k{d} AS (SELECT *, CAST(asked AND NOT coalesce(shut, false) AS INTEGER) AS taken, CASE WHEN coalesce(shut, false) THEN 0 ELSE fresh END AS gained FROM j{d}),
l{d} AS (SELECT *, edges + sum(taken) OVER w AS n_edges, nodes + sum(gained) OVER w AS n_nodes, bytes + sum(CASE WHEN taken = 1 THEN weight + CASE WHEN gained = 1 THEN strlen(next) + 3 ELSE 0 END ELSE 0 END) OVER w AS n_bytes FROM k{d} WINDOW w AS (PARTITION BY root ORDER BY step)),
m{d} AS (SELECT *, CASE WHEN work + step > {b.work} THEN 'max_work' WHEN asked AND n_edges - taken >= {b.edges} THEN 'max_edges' WHEN n_bytes > {b.bytes} THEN 'max_bytes' END AS met FROM l{d}),
z{d} AS MATERIALIZED (SELECT root, min(step) AS z, arg_min(met, step) AS met FROM m{d} WHERE met IS NOT NULL GROUP BY 1),
o{d} AS MATERIALIZED (SELECT m.* FROM m{d} m LEFT JOIN z{d} z ON z.root = m.root WHERE z.z IS NULL OR m.step < z.z),
why{d} AS (SELECT root, met AS reason FROM z{d} UNION ALL SELECT root, 'max_nodes' FROM o{d} WHERE shut),
q{d + 1} AS MATERIALIZED (SELECT q.root, coalesce(x.nodes, q.nodes) AS nodes, coalesce(x.edges, q.edges) AS edges, q.work + coalesce(x.n, 0) + CASE WHEN z.met <> 'max_work' THEN 1 ELSE 0 END AS work, coalesce(x.bytes, q.bytes) AS bytes FROM q{d} q LEFT JOIN (SELECT root, max(n_nodes) AS nodes, max(n_edges) AS edges, max(n_bytes) AS bytes, count(*) AS n FROM o{d} GROUP BY 1) x ON x.root = q.root LEFT JOIN z{d} z ON z.root = q.root),
f{d + 1} AS MATERIALIZED (SELECT root, next AS node, step AS turn FROM o{d} WHERE gained = 1 AND root NOT IN (SELECT root FROM z{d})),
seen{d + 1} AS (SELECT * FROM seen{d} UNION ALL SELECT root, next FROM o{d} WHERE gained = 1), held{d + 1} AS (SELECT * FROM held{d} UNION ALL SELECT root, edge FROM o{d} WHERE taken = 1)""")
    kept = " UNION ALL ".join(f'SELECT root, edge, {d} AS depth FROM o{d} WHERE taken = 1' for d in range(1, depth + 1))
    whys = " UNION ALL ".join(f"SELECT * FROM why{d}" for d in range(1, depth + 2))
    text.append(f"""kept AS ({kept}), told AS (SELECT q.root, nodes::BIGINT AS nodes, edges::BIGINT AS edges, work::BIGINT AS work, bytes::BIGINT AS bytes, coalesce(reasons, '') AS reasons FROM q{depth + 2} q LEFT JOIN (SELECT root, array_to_string(list_sort(list_distinct(list(reason))), ',') AS reasons FROM ({whys}) GROUP BY 1) w ON w.root = q.root)""")
    return "WITH " + ",\n".join(text)


def _links(edges, roots):  # noqa: ANN001, ANN202
    return graph.bounded_slice(edges, roots, 3, BOUNDS.nodes, BOUNDS.edges, BOUNDS.work, BOUNDS.bytes, "both", ("calls", "invokes", "uses_package", "implements"))


@_query("bounded_slice", _link_levels(3, BOUNDS) + " SELECT * FROM kept", "v_links", "v_roots")
def _(edges, roots):  # noqa: ANN001, ANN202
    return _links(edges, roots)[0].select("root", "edge", "depth")


@_query("bounded_slice_report", _link_levels(3, BOUNDS) + " SELECT * FROM told", "v_links", "v_roots")
def _(edges, roots):  # noqa: ANN001, ANN202
    return _links(edges, roots)[1].withColumn("reasons", F.array_join("reasons", ","))


def _json(*columns: str) -> str:
    """The size of a JSON object without nulls, of plain ASCII values."""
    members = ", ".join(f"""'"{name}":' || {value}""" for name, value in (c.split(" = ") for c in columns))
    return f"strlen('{{' || concat_ws(',', {members}) || '}}')"


def _flow_levels(b: dataflow.Bounds) -> str:
    """The slices of backward_slice from every guard and argument of v_dataflow, level by level, as common table expressions ending in `parts` and `told`."""
    quoted = lambda c: f"""'"' || {c} || '"'"""
    fact = _json(*(f"{c} = {quoted(c)}" for c in ("fact_id", "kind", "subject", "object", "file")), "line = line", "col = col", "position = position", """variables = '["' || array_to_string(variables, '","') || '"]'""", f"target = {quoted('target')}")
    edge = _json(*(f"{n} = {quoted(c)}" for n, c in (("from", "source"), ("to", "node"), ("relation", "relation"), ("variable", "variable"), ("basis", "coalesce(reason, basis)"))))
    text = [f"""x AS MATERIALIZED (SELECT *, coalesce(col, 2147483647) AS c, {fact} AS size FROM v_dataflow),
u AS (SELECT DISTINCT ON (fact_id, variable) * FROM (SELECT fact_id, file, subject, line, c, unnest(variables) AS variable, generate_subscripts(variables, 1) AS ordinal FROM x) ORDER BY fact_id, variable, ordinal),
near AS (SELECT u.fact_id, u.variable, b.fact_id AS source, row_number() OVER (PARTITION BY u.fact_id, u.variable ORDER BY b.line DESC, b.c DESC, b.fact_id) AS place, count(*) OVER (PARTITION BY u.fact_id, u.variable) AS n
 FROM u JOIN x b ON b.kind = 'binding' AND b.file = u.file AND b.subject = u.subject AND b.object = u.variable AND b.fact_id <> u.fact_id AND (b.line < u.line OR b.line = u.line AND b.c <= u.c)),
given AS (SELECT subject, object, fact_id AS source, row_number() OVER (PARTITION BY subject, object ORDER BY fact_id) AS place FROM x WHERE kind = 'parameter'),
gives AS (SELECT subject, fact_id AS source, row_number() OVER (PARTITION BY subject ORDER BY fact_id) AS place, count(*) OVER (PARTITION BY subject) AS n FROM x WHERE kind = 'return'),
args AS (SELECT object, fact_id AS source, row_number() OVER (PARTITION BY object ORDER BY fact_id) AS place, count(*) OVER (PARTITION BY object) AS n FROM x WHERE kind = 'call_argument'),
asked AS MATERIALIZED (
 SELECT fact_id AS node, 0 AS phase, u.ordinal, place, source, 'may_flow_into' AS relation, variable, 'lexical_assignment' AS basis, NULL AS reason, CASE WHEN n > {b.definitions} THEN 'reaching_definitions_truncated' WHEN n > 1 THEN 'multiple_reaching_definitions' END AS note FROM near JOIN u USING (fact_id, variable) WHERE place <= {b.definitions}
 UNION ALL SELECT u.fact_id, 0, ordinal, place, source, 'may_flow_into', variable, 'function_parameter', CASE WHEN source IS NULL THEN 'unresolved_variable' END, NULL FROM u LEFT JOIN given g ON g.subject = u.subject AND g.object = u.variable WHERE NOT EXISTS (SELECT 1 FROM near WHERE near.fact_id = u.fact_id AND near.variable = u.variable)
 UNION ALL SELECT x.fact_id, 1, 0, place, source, 'may_return_into', NULL, 'resolved_call_target', CASE WHEN source IS NULL THEN 'external_or_dynamic_return' END, CASE WHEN n > 1 THEN 'multiple_return_sites' END FROM x LEFT JOIN gives g ON g.subject = x.target WHERE x.kind IN ('binding', 'return') AND x.target <> ''
 UNION ALL SELECT x.fact_id, 2, 0, place, source, 'may_supply_parameter', x.object, 'resolved_call_target', CASE WHEN source IS NULL THEN 'external_or_dynamic_caller' END, CASE WHEN n > 1 THEN 'multiple_callers' END FROM x LEFT JOIN args g ON g.object = x.subject || '#argument/' || x.position WHERE x.kind = 'parameter' AND x.position IS NOT NULL),
q0 AS MATERIALIZED (SELECT fact_id AS root, 1 AS nodes, 0 AS edges, size AS bytes FROM x WHERE kind IN ('guard', 'call_argument')),
f0 AS MATERIALIZED (SELECT root, root AS node, 0 AS turn FROM q0), seen0 AS (SELECT root, node FROM f0)"""]
    for d in range(b.depth):
        text.append(f"""e{d} AS (SELECT f.root, f.turn, a.*, q.nodes, q.edges, q.bytes, w.size, k.node IS NOT NULL AS known, row_number() OVER (PARTITION BY f.root ORDER BY f.turn, a.phase, a.ordinal, a.place) AS step
 FROM f{d} f JOIN asked a ON a.node = f.node JOIN q{d} q ON q.root = f.root LEFT JOIN seen{d} k ON k.root = f.root AND k.node = a.source LEFT JOIN x w ON w.fact_id = a.source),
g{d} AS (SELECT *, CAST(source IS NOT NULL AND NOT known AND row_number() OVER (PARTITION BY root, source ORDER BY step) = 1 AS INTEGER) AS fresh FROM e{d}),
h{d} AS (SELECT *, edges + count(source) OVER w AS n_edges, nodes + sum(fresh) OVER w AS n_nodes, bytes + sum({edge} + CASE WHEN fresh = 1 THEN size ELSE 0 END) OVER w AS n_bytes FROM g{d} WINDOW w AS (PARTITION BY root ORDER BY step)),
m{d} AS MATERIALIZED (SELECT *, CASE WHEN n_edges > {b.work} THEN 'max_work' WHEN n_edges > {b.edges} THEN 'max_edges' WHEN n_nodes > {b.nodes} THEN 'max_nodes' WHEN n_bytes > {b.bytes} THEN 'max_bytes' END AS met FROM h{d}),
z{d} AS MATERIALIZED (SELECT root, min(step) AS z, arg_min(met, step) AS met FROM m{d} WHERE met IS NOT NULL GROUP BY 1),
o{d} AS MATERIALIZED (SELECT m.* FROM m{d} m LEFT JOIN z{d} z ON z.root = m.root WHERE z.z IS NULL OR m.step < z.z),
notes{d} AS (SELECT m.root, m.note FROM m{d} m LEFT JOIN z{d} z ON z.root = m.root WHERE m.note IS NOT NULL AND (z.z IS NULL OR m.step <= z.z)),
q{d + 1} AS MATERIALIZED (SELECT q.root, coalesce(y.nodes, q.nodes) AS nodes, coalesce(y.edges, q.edges) AS edges, coalesce(y.bytes, q.bytes) AS bytes FROM q{d} q LEFT JOIN (SELECT root, max(n_nodes) AS nodes, max(n_edges) AS edges, max(n_bytes) AS bytes FROM o{d} GROUP BY 1) y ON y.root = q.root),
f{d + 1} AS MATERIALIZED (SELECT root, source AS node, step AS turn FROM o{d} WHERE fresh = 1 AND root NOT IN (SELECT root FROM z{d})),
seen{d + 1} AS MATERIALIZED (SELECT * FROM seen{d} UNION ALL SELECT root, source FROM o{d} WHERE fresh = 1)""")
    last, levels = b.depth, range(b.depth)
    rows = " UNION ALL ".join(f"""SELECT root, CASE WHEN source IS NULL THEN 'unresolved' ELSE 'edge' END AS part, {d + 1} AS depth, source AS "from", node AS "to", relation, variable, coalesce(reason, basis) AS basis FROM o{d}""" for d in levels)
    reasons = " UNION ALL ".join([f"SELECT root, met AS reason FROM z{d}" for d in levels] + [f"SELECT root, 'max_depth' FROM f{last}", "SELECT root, met FROM guarded WHERE met IS NOT NULL"])
    notes = " UNION ALL ".join([f"SELECT * FROM notes{d}" for d in levels] + ["SELECT root, unnest(['branch_feasibility_unknown', 'runtime_reachability_unknown', 'sanitizer_effects_unknown', 'syntax_only']) FROM q0"])
    text.append(f"""touched AS (SELECT DISTINCT s.root, x.subject FROM seen{last} s JOIN x ON x.fact_id = s.node),
ranked AS (SELECT t.root, g.fact_id AS guard, q.nodes, row_number() OVER w AS place, q.bytes + sum(g.size) OVER w AS total FROM touched t JOIN x g ON g.kind = 'guard' AND g.subject = t.subject JOIN q{last} q ON q.root = t.root WINDOW w AS (PARTITION BY t.root ORDER BY g.fact_id)),
guarded AS MATERIALIZED (SELECT *, CASE WHEN place > greatest({b.nodes} - nodes, 0) THEN 'max_nodes' WHEN total > {b.bytes} THEN 'max_bytes' END AS met FROM ranked),
parts AS ({rows} UNION ALL SELECT root, 'guard', 0, guard, NULL, NULL, NULL, NULL FROM guarded WHERE met IS NULL),
told AS (SELECT q.root, q.nodes::BIGINT AS nodes, q.edges::BIGINT AS edges, q.edges::BIGINT AS work, coalesce(g.total, q.bytes)::BIGINT AS bytes, n.notes AS uncertainties, coalesce(r.reasons, '') AS reasons FROM q{last} q LEFT JOIN (SELECT root, max(total) AS total FROM guarded WHERE met IS NULL GROUP BY 1) g ON g.root = q.root
 JOIN (SELECT root, array_to_string(list_sort(list_distinct(list(note))), ',') AS notes FROM ({notes}) t(root, note) GROUP BY 1) n ON n.root = q.root LEFT JOIN (SELECT root, array_to_string(list_sort(list_distinct(list(reason))), ',') AS reasons FROM ({reasons}) GROUP BY 1) r ON r.root = q.root)""")
    return "WITH " + ",\n".join(text)


def _flows(facts):  # noqa: ANN001, ANN202
    return dataflow.backward_slice(facts, facts.where("kind IN ('guard', 'call_argument')").select(F.col("fact_id").alias("root")), FLOW)


@_query("backward_slice", _flow_levels(FLOW) + " SELECT * FROM parts", "v_dataflow")
def _(facts):  # noqa: ANN001, ANN202
    return _flows(facts)[0].na.fill(0, ["depth"])


@_query("backward_slice_report", _flow_levels(FLOW) + " SELECT * FROM told", "v_dataflow")
def _(facts):  # noqa: ANN001, ANN202
    return _flows(facts)[1].withColumns({c: F.array_join(c, ",") for c in ("uncertainties", "reasons")})
