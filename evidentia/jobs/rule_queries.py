"""Queries of rules in full: each clause has rows on both sides of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import oracles, scalars
from ..operators import contracts, correlate, facts, findings, policy, report, resolution, windows
from ..sources import documents, readers
from .queries import _query, predicates
from .views import VIEWS

VIEWS |= {
    "v_import_calls": "SELECT event_id AS call_id, user_id AS file, concat('n', CAST(event_id % 9 AS STRING)) AS name, CAST(event_id * 7 % 60 AS INTEGER) AS line FROM {events}",
    "v_definitions": "SELECT DISTINCT c_custkey % 150 AS file, concat('n', CAST(c_custkey % 9 AS STRING)) AS name FROM {customer} WHERE c_custkey % 11 = 0",
    "v_imports": "SELECT s_suppkey * 7 % 150 + k AS file, concat('M', CAST((s_suppkey + k) % 5 AS STRING)) AS module, CAST(s_suppkey * 13 % 60 AS INTEGER) AS line, CASE s_suppkey % 3 WHEN 1 THEN array(concat('n', CAST(s_suppkey % 9 AS STRING)), 'n3') END AS only_names, CASE s_suppkey % 4 WHEN 2 THEN array(concat('n', CAST(s_suppkey % 7 AS STRING)), 'n1') WHEN 3 THEN array('n3') END AS except_names FROM {supplier}, (SELECT n_nationkey AS k FROM {nation} WHERE n_nationkey < 4) n",
    "v_alias_calls": "SELECT event_id AS call_id, user_id % 40 AS file, concat('App.M', CAST(event_id % 3 AS STRING)) AS module, CAST(event_id * 11 % 90 AS INTEGER) AS line, CASE event_id % 5 WHEN 0 THEN '__MODULE__.run' WHEN 1 THEN 'Repo' WHEN 2 THEN concat('A', CAST(event_id % 4 AS STRING), '.B.run') ELSE concat('A', CAST(event_id % 4 AS STRING), '.run') END AS name FROM {events}",
    "v_aliases": "SELECT c_custkey % 40 AS file, concat('App.M', CAST(c_custkey % 3 AS STRING)) AS module, CASE WHEN c_custkey % 7 = 0 THEN 'Repo' ELSE concat('A', CAST(c_custkey % 4 AS STRING)) END AS short, CAST(c_custkey * 5 % 90 AS INTEGER) AS line, concat('Lib.T', CAST(c_custkey % 23 AS STRING)) AS target FROM {customer}",
    "v_control_spans": "SELECT CAST(o_custkey % 40 AS STRING) AS file, o_orderkey AS scope_id, o_orderkey % 900 AS first, o_orderkey % 900 + CAST(floor(o_totalprice / 20000) AS BIGINT) AS last, CASE o_orderkey % 3 WHEN 0 THEN 'case' WHEN 1 THEN 'if' ELSE 'try' END AS kind FROM {orders}",
    "v_five_stages": "SELECT CAST(floor(event_id / 5) AS BIGINT) AS reference, CASE event_id % 5 WHEN 0 THEN 'spawn' WHEN 1 THEN 'handoff_send' WHEN 2 THEN 'handoff_receive' WHEN 3 THEN 'result_send' ELSE CASE WHEN event_id % 35 = 4 THEN 'result_send' ELSE 'result_receive' END END AS stage, event_id * 10 - CASE WHEN event_id % 31 = 0 THEN 25 ELSE 0 END AS at, CASE WHEN event_id % 53 = 0 THEN 9 ELSE CAST(floor(event_id / 5) AS BIGINT) % 7 END AS owner, CASE WHEN event_id % 59 = 0 THEN NULL ELSE CAST(floor(event_id / 5) AS BIGINT) % 11 END AS child FROM {events}",
    "v_timed_reads": "SELECT event_id AS read_id, user_id AS key, event_id AS at, CASE event_id % 3 WHEN 0 THEN event_id - event_id % 300 + user_id % 7 WHEN 1 THEN NULL ELSE event_id - 2 END AS version FROM {events} WHERE event_type IN ('view', 'click')",
    "v_few_writes": "SELECT user_id AS key, event_id AS version, event_id AS at, CASE event_id % 3 WHEN 0 THEN 'delete' ELSE 'write' END AS kind FROM {events} WHERE event_type = 'error' AND (user_id % 3 = 0 OR event_id % 10 = 0)",
    "v_work": "SELECT CAST(floor(event_id / 8) AS BIGINT) AS stream, event_id % 8 AS place, CAST(floor(value) AS BIGINT) AS bytes, CASE WHEN event_id % 13 > 0 THEN event_id % 17 END AS retained, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 8 * 5 - CASE WHEN event_id % 23 = 0 THEN 9 ELSE 0 END END AS work, CASE WHEN event_id % 37 = 0 THEN 'accepted' WHEN event_id % 41 = 0 THEN 'rejected' ELSE 'incomplete' END AS status, CASE WHEN event_id % 47 = 0 THEN 'calls' ELSE 'steps' END AS unit FROM {events}",
    "v_verdict_findings": "SELECT doc_id AS validation_id FROM {labels} WHERE quality = 1 UNION ALL SELECT doc_id FROM {labels} WHERE quality = 1 AND doc_id % 3 = 0",
    "v_declared_effects": "SELECT DISTINCT source AS tool, lang AS action, CASE WHEN doc_id % 90 = 0 AND lang = 'en' THEN 'write' WHEN lang = 'de' THEN NULL ELSE 'none' END AS effect FROM {documents}",
    "v_keyword_seeds": "SELECT p_partkey AS seed_id, p_size AS seq, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS place, CASE WHEN p_partkey % 2 = 0 THEN 'FUZZ' ELSE 'EXTRA' END AS keyword, concat(CASE WHEN p_partkey % 2 = 0 THEN 'v' ELSE 'e' END, CAST(p_partkey % 5 AS STRING)) AS value FROM {part}",
    "v_mutable": "SELECT event_id AS call_id, CASE event_id % 5 WHEN 0 THEN 'Plug.Conn' WHEN 1 THEN NULL ELSE 'Html' END AS module, CASE event_id % 7 WHEN 0 THEN 'put_resp_header' WHEN 1 THEN 'sanitize_html' WHEN 2 THEN 'redact' WHEN 3 THEN 'render' ELSE 'put_resp_header' END AS function, CASE WHEN event_id % 13 = 0 THEN 0 ELSE 3 END AS arity, CASE event_id % 4 WHEN 0 THEN 'X-Frame-Options' WHEN 1 THEN 'content-security-policy' WHEN 2 THEN 'x-other' END AS header, CASE event_id % 6 WHEN 0 THEN 'verify_peer' WHEN 1 THEN 'verify_none' END AS verify, CASE event_id % 9 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END AS hostname FROM {events}",
    "v_contexts": "SELECT concat('f', CAST(l_suppkey AS STRING)) AS file, CASE l_linenumber % 5 WHEN 0 THEN 'module' WHEN 1 THEN 'import' WHEN 2 THEN 'use' WHEN 3 THEN 'role' ELSE 'alias' END AS kind, CASE WHEN l_linenumber % 5 = 3 THEN concat('role', CAST(l_partkey % 3 AS STRING)) ELSE concat('M', CAST(l_partkey % 30 AS STRING)) END AS target, CASE WHEN l_linenumber % 5 = 4 AND l_partkey % 7 > 0 THEN concat('A', CAST(l_partkey % 4 AS STRING)) END AS name, l_orderkey * 8 + l_linenumber AS line FROM {lineitem}",
    "v_runs": "SELECT o_orderkey AS id, CAST(o_custkey AS STRING) AS case_id, CASE o_orderkey % 3 WHEN 0 THEN 'vulnerable' WHEN 1 THEN 'fixed' ELSE 'failure' END AS role, CASE WHEN o_orderkey % 29 = 0 THEN 'confirmed' WHEN o_orderkey % 3 = 0 THEN 'confirmed' WHEN o_orderkey % 3 = 1 THEN 'refuted' ELSE 'inconclusive' END AS verdict, concat('s', CAST(o_custkey % 5 AS STRING)) AS seed_id, CASE WHEN o_orderkey % 2 = 0 THEN array('b', 'a') ELSE array('a', 'b') END AS findings FROM {orders}",
    "v_match_lines": "SELECT page_id, replace(concat('{~input~:{~FUZZ~:~', CASE page_id % 7 WHEN 3 THEN 'no base64!' ELSE 'dg==' END, '~},~position~:', CAST(page_id AS STRING), ',~status~:', CASE page_id % 5 WHEN 2 THEN '-1' WHEN 4 THEN '~200~' ELSE '200' END, ',~length~:4,~words~:1,~lines~:1,~duration~:1,~content-type~:~~,~redirectlocation~:~~,~url~:~http://a.test/~,~resultfile~:~~,~host~:~~', CASE page_id % 11 WHEN 0 THEN ',~scraper~:[]' WHEN 1 THEN ',~scraper~:{~a~:1}' ELSE '' END, CASE page_id % 13 WHEN 5 THEN '' ELSE '}' END), '~', chr(34)) AS value FROM {pages}".replace("{~", "OPEN~").replace("~}", "~CLOSE").replace(":1}", ":1CLOSE").replace("'}'", "'CLOSE'").replace("OPEN", "' || chr(123) || '").replace("CLOSE", "' || chr(125) || '"),
    "v_calls_text": "SELECT event_id, concat(CASE event_id % 4 WHEN 0 THEN 'Elixir.A.B' WHEN 1 THEN 'os' WHEN 2 THEN '' ELSE 'A' END, CASE event_id % 3 WHEN 0 THEN '.run?' ELSE '.f' END, CASE event_id % 5 WHEN 0 THEN '' ELSE concat('/', CAST(event_id % 12 AS STRING)) END) AS text, CASE event_id % 3 WHEN 0 THEN 'confirmed' ELSE 'refuted' END AS verdict, event_id % 3 AS n FROM {events}",
    "v_addresses": "SELECT CASE c_custkey % 3 WHEN 0 THEN concat('2001:DB8:0:0::', CAST(c_custkey % 40 AS STRING)) WHEN 1 THEN concat('Host', CAST(c_custkey % 40 AS STRING), '.') ELSE concat('10.0.0.', CAST(c_custkey % 40 AS STRING)) END AS ip, CASE c_custkey % 3 WHEN 0 THEN '6' WHEN 1 THEN 'h' ELSE '4' END AS kind, c_custkey % 40 AS n, c_custkey % 9 AS batch FROM {customer}",
    "v_addresses_found": "SELECT CASE s_suppkey % 3 WHEN 0 THEN concat('2001:db8::', CAST(s_suppkey % 40 AS STRING)) WHEN 1 THEN concat('host', CAST(s_suppkey % 40 AS STRING)) ELSE concat('10.0.0.', CAST(s_suppkey % 40 AS STRING)) END AS ip, CASE s_suppkey % 3 WHEN 0 THEN '6' WHEN 1 THEN 'h' ELSE '4' END AS kind, s_suppkey % 40 AS n, CASE WHEN s_suppkey % 4 = 0 THEN 'down' ELSE 'up' END AS status FROM {supplier}",
    "v_boundaries": "SELECT o_custkey AS matrix, o_orderkey AS scenario, o_orderkey % 9 + 1 AS events, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 9 ELSE o_orderkey % 9 + 1 END AS joined, CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS false_joins, o_orderkey % 30 AS candidates, o_orderkey % 5 <> 0 OR o_custkey % 7 = 0 AS supported FROM {orders}",
    "v_timed_trials": "SELECT event_type AS mode, value > 90 AS found, user_id % 12 AS coverage, event_id % 31 AS depth, CAST(floor(value * 1000) AS BIGINT) AS time FROM {events}",
    "v_graphemes": "SELECT doc_id, concat(left(text, 12), repeat('e\u0301', CAST(doc_id % 8 AS INTEGER))) AS value FROM {documents}",
}


@_query(
    "resolve_imports_by_line",
    "WITH c AS (SELECT DISTINCT k.call_id, i.module FROM v_import_calls k JOIN v_imports i ON i.file = k.file AND i.line <= k.line AND (i.only_names IS NULL OR list_contains(i.only_names, k.name)) AND NOT coalesce(list_contains(i.except_names, k.name), false)), n AS (SELECT call_id, count(*) AS n, min(module) AS module FROM c GROUP BY 1)"
    " SELECT k.call_id, CASE WHEN d.file IS NOT NULL THEN 'local' WHEN n.n = 1 THEN 'imported' WHEN n.n > 1 THEN 'ambiguous_import' ELSE 'local_or_imported' END AS resolution, CASE WHEN d.file IS NULL AND n.n = 1 THEN n.module END AS module, coalesce(n.n, 0) AS candidates FROM v_import_calls k LEFT JOIN n ON n.call_id = k.call_id LEFT JOIN v_definitions d ON d.file = k.file AND d.name = k.name",
    "v_import_calls",
    "v_definitions",
    "v_imports",
)
def _(calls, definitions, imports):  # noqa: ANN001, ANN202
    return resolution.resolve_imports(calls, definitions, imports.withColumnsRenamed({"only_names": "only", "except_names": "except"}))


@_query(
    "resolve_alias_names",
    "WITH a AS (SELECT file, module, short, line, max(target) AS target FROM v_aliases GROUP BY ALL), h AS (SELECT *, split_part(name, '.', 1) AS head, substring(name, length(split_part(name, '.', 1)) + 1) AS rest FROM v_alias_calls)"
    " SELECT h.call_id, CASE WHEN head = '__MODULE__' THEN h.module ELSE coalesce(a.target, head) END || rest AS resolved FROM h ASOF LEFT JOIN a ON a.file = h.file AND a.module = h.module AND a.short = h.head AND h.line >= a.line",
    "v_alias_calls",
    "v_aliases",
)
def _(calls, aliases):  # noqa: ANN001, ANN202
    return resolution.resolve_aliases(calls, aliases)


@_query(
    "control_regions",
    "SELECT p.point_id, coalesce(string_agg(s.first || '-' || s.last || ' ' || s.kind || ' ' || s.scope_id, ';' ORDER BY s.first, s.last, s.kind, s.scope_id), '') AS regions FROM v_points_in p LEFT JOIN v_control_spans s ON p.file = s.file AND p.at BETWEEN s.first AND s.last GROUP BY 1",
    "v_points_in",
    "v_control_spans",
)
def _(points, spans):  # noqa: ANN001, ANN202
    text = lambda r: F.concat(r["first"].cast("string"), F.lit("-"), r["last"].cast("string"), F.lit(" "), r["kind"], F.lit(" "), r["scope_id"].cast("string"))
    return resolution.control_regions(points, spans, lambda c: F.array_join(F.transform(c, text), ";"))


STAGES = ("spawn", "handoff_send", "handoff_receive", "result_send", "result_receive")
_PIVOT = ", ".join(f"count(*) FILTER (stage = '{s}') AS n_{s}, min(at) FILTER (stage = '{s}') AS t{i}" for i, s in enumerate(("spawn", "handoff_send", "handoff_receive", "result_send", "result_receive")))


@_query(
    "task_lineage_stages",
    f"SELECT reference, {', '.join('n_' + s for s in STAGES)}, coalesce({' AND '.join(f'n_{s} = 1' for s in STAGES)} AND t0 <= t1 AND t1 <= t2 AND t2 <= t3 AND t3 <= t4 AND owners = 1 AND children = 1 AND named = 5, false) AS joined FROM (SELECT reference, {_PIVOT}, count(DISTINCT owner) AS owners, count(DISTINCT child) AS children, count(child) AS named FROM v_five_stages GROUP BY 1)",
    "v_five_stages",
)
def _(events):  # noqa: ANN001, ANN202
    return correlate.task_lineage(events, ["spawn", "handoff_send", "handoff_receive", "result_send", "result_receive"], ("owner", "child"))


@_query(
    "store_versions_timed",
    """WITH w AS (SELECT w.key, w.version, w.at, (SELECT min(d.at) FROM v_few_writes d WHERE d.key = w.key AND d.kind = 'delete' AND d.at >= w.at) AS ended FROM v_few_writes w WHERE w.kind = 'write'),
x AS (SELECT r.read_id, count(*) FILTER (s.kind = 'write') AS n, max(s.at) FILTER (s.kind = 'write') AS wrote, max(s.at) FILTER (s.kind = 'delete') AS gone FROM v_timed_reads r JOIN v_few_writes s ON s.key = r.key AND s.at <= r.at GROUP BY 1)
SELECT r.read_id, CASE WHEN r.version IS NOT NULL THEN CASE WHEN w.version IS NULL OR w.at > r.at THEN 'missing' WHEN w.ended IS NULL OR w.ended > r.at THEN 'joined' ELSE 'deleted' END
 WHEN coalesce(x.n, 0) = 0 THEN 'missing' WHEN x.gone >= x.wrote THEN 'deleted' WHEN x.n = 1 THEN 'joined' ELSE 'ambiguous' END AS state FROM v_timed_reads r LEFT JOIN w ON w.key = r.key AND w.version = r.version LEFT JOIN x ON x.read_id = r.read_id""",
    "v_few_writes",
    "v_timed_reads",
)
def _(store, reads):  # noqa: ANN001, ANN202
    return correlate.store_versions(store, reads)


@_query(
    "incremental_observations",
    """WITH l AS (SELECT *, last_value(work IGNORE NULLS) OVER (PARTITION BY stream ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, sum(CASE WHEN place > 0 THEN bytes ELSE 0 END) OVER (PARTITION BY stream ORDER BY place) AS received FROM v_work),
s AS (SELECT *, CASE WHEN work < before THEN 'work_decreased' ELSE status END AS told FROM l), z AS (SELECT stream, min(place) AS stop FROM s WHERE told <> 'incomplete' GROUP BY 1)
SELECT s.stream, s.place, told AS status, received::BIGINT AS received, retained, s.work - b.work AS done FROM s LEFT JOIN z ON z.stream = s.stream LEFT JOIN (SELECT stream, work FROM v_work WHERE place = 0) b ON b.stream = s.stream WHERE stop IS NULL OR place <= stop""",
    "v_work",
)
def _(work):  # noqa: ANN001, ANN202
    return windows.incremental_observations(work)


@_query(
    "oracle_work_budget",
    "SELECT o.stream, CASE WHEN coalesce(odd, true) THEN 'skip' WHEN first IS NOT NULL THEN 'violation' WHEN missing THEN 'skip' ELSE 'pass' END AS result, CASE WHEN NOT odd THEN first END AS place FROM (SELECT DISTINCT stream FROM v_work) o LEFT JOIN (SELECT stream, min(place) FILTER (work > 29) AS first, bool_or(work IS NULL OR work < 0) AS missing, bool_or(unit <> 'steps') AS odd FROM v_work WHERE stream % 6 > 0 GROUP BY 1) s ON s.stream = o.stream",
    "v_work",
)
def _(work):  # noqa: ANN001, ANN202
    return windows.oracle_incremental_budget(work.where("stream % 6 > 0"), 29, "work", "steps", work)


@_query(
    "verdict_rollup_full",
    "WITH f AS (SELECT validation_id, count(*) AS n FROM v_verdict_findings GROUP BY 1), e AS (SELECT tool, action, CASE WHEN count(DISTINCT effect) = 1 AND count(effect) = count(*) THEN min(effect) END AS effect FROM v_declared_effects GROUP BY 1, 2)"
    " SELECT v.tool, v.action, count(*) FILTER (verdict = 'confirmed') AS confirmed, count(*) FILTER (verdict = 'refuted') AS refuted, count(*) FILTER (verdict = 'inconclusive') AS inconclusive, coalesce(sum(f.n), 0)::BIGINT AS findings, any_value(e.effect) AS effect FROM v_verdicts v LEFT JOIN f ON f.validation_id = v.id LEFT JOIN e ON e.tool = v.tool AND e.action = v.action GROUP BY 1, 2",
    "v_verdicts",
    "v_verdict_findings",
    "v_declared_effects",
)
def _(verdicts, found, effects):  # noqa: ANN001, ANN202
    return findings.verdict_rollup(verdicts, found, effects)


@_query(
    "match_seeds",
    "WITH s AS (SELECT keyword, value, min((place, seq, seed_id)) AS k FROM v_keyword_seeds GROUP BY 1, 2), i AS (SELECT match_id, keyword, value FROM v_http UNION ALL SELECT match_id, keyword2, value2 FROM v_http WHERE keyword2 IS NOT NULL), b AS (SELECT match_id, arg_min((i.keyword, i.value, k[3]), (k[1], i.keyword)) AS x FROM i JOIN s ON s.keyword = i.keyword AND s.value = i.value GROUP BY 1)"
    " SELECT h.match_id, x[1] AS keyword, x[2] AS value, x[3] AS seed_id FROM v_http h LEFT JOIN b ON b.match_id = h.match_id",
    "v_http",
    "v_keyword_seeds",
)
def _(http, seeds):  # noqa: ANN001, ANN202
    more = F.map_from_arrays(F.array("keyword2"), F.array("value2"))
    given = F.when(F.col("keyword2").isNull(), F.map_from_arrays(F.array("keyword"), F.array("value"))).otherwise(F.map_concat(F.map_from_arrays(F.array("keyword"), F.array("value")), more))
    return findings.match_seeds(http.select("match_id", given.alias("input")), seeds)


@_query("expand_sniper", "SELECT value AS a, NULL::VARCHAR AS b FROM v_lists WHERE list = 1 UNION ALL SELECT NULL, value FROM v_lists WHERE list = 2", "v_lists")
def _(lists):  # noqa: ANN001, ANN202
    named = lists.withColumn("list", F.when(F.col("list") == 1, "a").otherwise("b"))
    return findings.expand_wordlists(named, "sniper", ["a", "b"])


@_query("longest_prefix", "SELECT call_id, target, module, package FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY strlen(module) DESC, module, package) AS n FROM v_calls JOIN v_owners ON starts_with(target, module)) WHERE n = 1", "v_calls", "v_owners")
def _(calls, owners):  # noqa: ANN001, ANN202
    prefixes = calls.select("call_id", "target", F.explode(F.transform(F.sequence(F.lit(1), F.length("target")), lambda n: F.substring("target", F.lit(1), n))).alias("module"))
    return facts.longest_prefix(prefixes.join(owners.select("module", "package"), "module"), ["call_id", "target"]).select("call_id", "target", "module", "package")


_SIZES = {"bytes": "strlen(value) > 22", "codepoints": "length(value) > 18", "graphemes": "length_grapheme(value) > 15"}


@_query("oracle_bounded_length", "SELECT doc_id, " + ", ".join(f"CASE WHEN value IS NULL THEN 'skip' WHEN {test} THEN 'violation' ELSE 'pass' END AS {name}" for name, test in _SIZES.items()) + " FROM v_graphemes", "v_graphemes")
def _(values):  # noqa: ANN001, ANN202
    value = F.col("value")
    return values.select("doc_id", oracles.bounded_length(value, 22, "bytes").alias("bytes"), oracles.bounded_length(value, 18, "codepoints").alias("codepoints"), oracles.bounded_length(value, 15, "graphemes").alias("graphemes"))


#: Names and headers are written out here as what the rule says, not taken from the operator.
@_query(
    "mutation_candidates_full",
    """SELECT call_id, 'SanitizerBypass' AS mutator, 'bypass ' || function AS change FROM v_mutable WHERE module IS NOT NULL AND function IN ('sanitize_html', 'redact') AND arity > 0
UNION ALL SELECT call_id, 'SecurityHeader', 'remove ' || lower(header) FROM v_mutable WHERE module = 'Plug.Conn' AND function = 'put_resp_header' AND arity = 3 AND lower(header) IN ('x-frame-options', 'content-security-policy')
UNION ALL SELECT call_id, 'TransportSecurity', 'verify_peer to verify_none' FROM v_mutable WHERE verify = 'verify_peer'
UNION ALL SELECT call_id, 'TransportSecurity', 'disable hostname verification' FROM v_mutable WHERE hostname = 'true'""",
    "v_mutable",
)
def _(calls):  # noqa: ANN001, ANN202
    options = F.map_from_arrays(F.array(F.lit("verify"), F.lit("check_hostname")), F.array("verify", "hostname"))
    return policy.mutation_candidates(calls.withColumn("options", options))


@_query(
    "context_maps",
    "WITH s AS (SELECT file, " + ", ".join(f"array_to_string(list_sort(list_distinct(list(target) FILTER (kind = '{k}'))), ',') AS {k}s" for k in ("module", "import", "use", "role")) + " FROM v_contexts GROUP BY 1), a AS (SELECT file, name, arg_max(target, (line, target)) AS target FROM v_contexts WHERE kind = 'alias' AND name IS NOT NULL GROUP BY 1, 2), m AS (SELECT file, string_agg(name || '=' || target, ',' ORDER BY name) AS aliases FROM a GROUP BY 1) SELECT s.file, coalesce(modules, '') AS modules, coalesce(imports, '') AS imports, coalesce(uses, '') AS uses, coalesce(roles, '') AS roles, coalesce(aliases, '') AS aliases FROM s LEFT JOIN m ON m.file = s.file",
    "v_contexts",
)
def _(directives):  # noqa: ANN001, ANN202
    told = policy.context_maps(directives)
    entries = F.transform(F.array_sort(F.map_entries("aliases")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return told.select("file", *(F.array_join(c, ",").alias(c) for c in ("modules", "imports", "uses", "roles")), F.array_join(entries, ",").alias("aliases"))


@_query(
    "project_roles",
    "WITH r AS (SELECT DISTINCT file, target AS role FROM v_contexts WHERE kind = 'role'), m AS (SELECT DISTINCT file, target AS module FROM v_contexts WHERE kind = 'module') SELECT role, coalesce(array_to_string(list_sort(list_distinct(list(module) FILTER (module IS NOT NULL))), ','), '') AS modules, array_to_string(list_sort(list_distinct(list(r.file))), ',') AS files FROM r LEFT JOIN m ON m.file = r.file GROUP BY 1",
    "v_contexts",
)
def _(directives):  # noqa: ANN001, ANN202
    return policy.project_roles(directives).select("role", *(F.array_join(c, ",").alias(c) for c in ("modules", "files")))


@_query(
    "oracle_report_names",
    "WITH r AS (SELECT page_id AS input, CASE WHEN status BETWEEN 500 AND 599 THEN 'violation' ELSE 'pass' END AS a, CASE page_id % 4 WHEN 0 THEN 'violation' WHEN 1 THEN 'skip' ELSE 'pass' END AS b FROM (SELECT match_id AS page_id, status FROM v_http)), t AS (SELECT input, 0 AS place, 'no_500' AS name, a AS result FROM r UNION ALL SELECT input, 1, 'custom', b FROM r)"
    " SELECT input, " + ", ".join(f"coalesce(string_agg(name, ',' ORDER BY place) FILTER (result = '{r}'), '') AS {n}" for r, n in (("pass", "passed"), ("skip", "skipped"), ("violation", "violations"))) + ", CASE WHEN bool_or(result = 'violation') THEN 'confirmed' WHEN bool_or(result = 'skip') THEN 'inconclusive' ELSE 'refuted' END AS verdict FROM t GROUP BY 1",
    "v_http",
)
def _(http):  # noqa: ANN001, ANN202
    page = F.col("match_id") % 4
    custom = http.select(F.col("match_id").alias("input"), F.lit(1).alias("place"), F.lit("custom").alias("name"), F.when(page == 0, "violation").when(page == 1, "skip").otherwise("pass").alias("result"))
    known = predicates(http).select(F.col("match_id").alias("input"), F.lit(0).alias("place"), F.lit("no_500").alias("name"), F.col("no_500").alias("result"))
    told = contracts.oracle_report(custom.unionByName(known))
    return told.select("input", *(F.array_join(c, ",").alias(c) for c in ("passed", "skipped", "violations")), "verdict")


_MATRIX = """WITH c AS (SELECT case_id, coalesce(bool_and(verdict = 'confirmed') FILTER (role = 'vulnerable'), false) AS vulnerable, coalesce(bool_and(verdict = 'refuted') FILTER (role = 'fixed'), false) AS fixed, coalesce(bool_and(verdict = 'inconclusive') FILTER (role = 'failure'), false) AS failure, count(*) FILTER (role <> 'vulnerable' AND verdict = 'confirmed') AS false_confirmations FROM v_runs WHERE id % 4 > 0 GROUP BY 1),
t AS (SELECT case_id, role, min(verdict) AS least, max(verdict) AS most FROM v_runs WHERE id % 4 > 0 GROUP BY 1, 2),
r AS (SELECT r.case_id, count(*) AS replays, count(*) FILTER (r.verdict = t.least AND r.verdict = t.most AND r.id % 3 <> 2) AS replays_equal FROM v_runs r LEFT JOIN t ON t.case_id = r.case_id AND t.role = r.role WHERE r.id % 4 = 0 GROUP BY 1),
m AS (SELECT c.*, coalesce(replays, 0) AS replays, coalesce(replays_equal, 0) AS replays_equal FROM c LEFT JOIN r ON r.case_id = c.case_id)"""


def _replayed(runs):  # noqa: ANN001, ANN202
    # a failure's replay comes from another seed
    replays = runs.where("id % 4 = 0").withColumn("seed_id", F.when(F.col("role") == "failure", "other").otherwise(F.col("seed_id")))
    return contracts.replay_matrix(runs.where("id % 4 > 0"), replays)


@_query("replay_matrix", _MATRIX + " SELECT * FROM m", "v_runs")
def _(runs):  # noqa: ANN001, ANN202
    return _replayed(runs)


@_query(
    "suite_summary",
    _MATRIX + ", k AS (SELECT report_id AS case_id, count(*) AS n, count(*) FILTER (passed) AS ok FROM v_checks GROUP BY 1), s AS (SELECT count(*) AS cases, sum(ok)::BIGINT AS passed, sum(n)::BIGINT AS checks, count(*) FILTER (ok = n) AS cases_passed FROM k), f AS (SELECT sum(false_confirmations)::BIGINT AS false_confirmations, sum(replays)::BIGINT AS replays, sum(replays_equal)::BIGINT AS replays_equal FROM m) SELECT s.*, f.*, CASE WHEN passed = checks AND false_confirmations = 0 AND replays = replays_equal THEN 'passed' ELSE 'failed' END AS status FROM s, f",
    "v_checks",
    "v_runs",
)
def _(checks, runs):  # noqa: ANN001, ANN202
    return report.suite_summary(checks.select(F.col("report_id").alias("case_id"), "passed"), _replayed(runs))


@_query(
    "compare_measured",
    "WITH b AS (SELECT case_id AS name, max(sample) AS value, min(sample % 3) AS fixture FROM v_latency WHERE mode = 'baseline' GROUP BY 1), a AS (SELECT case_id AS name, min(sample) AS value, CASE WHEN case_id = 'A' THEN 9 ELSE min(sample % 3) END AS fixture FROM v_latency WHERE mode = 'targeted' GROUP BY 1) SELECT coalesce(a.name, b.name) AS name, b.value AS before, a.value AS after, coalesce(a.fixture = b.fixture, false) AS comparable, CASE WHEN a.fixture = b.fixture THEN round(b.value / nullif(a.value, 0), 6) END AS speedup FROM b FULL JOIN a ON a.name = b.name",
    "v_latency",
)
def _(samples):  # noqa: ANN001, ANN202
    of = lambda mode, value: samples.where(F.col("mode") == mode).groupBy(F.col("case_id").alias("name")).agg(value("sample").alias("value"), F.min(F.col("sample") % 3).cast("string").alias("fixture"), F.lit("one").alias("runtime"))
    after = of("targeted", F.min).withColumn("fixture", F.when(F.col("name") == "A", "9").otherwise(F.col("fixture")))
    return report.compare_measured(of("baseline", F.max), after)


@_query(
    "module_owners_given",
    "WITH d AS (SELECT module, min(package) AS package FROM v_modules GROUP BY 1 HAVING count(DISTINCT package) = 1) SELECT * FROM d WHERE module NOT IN (SELECT module FROM v_owners UNION ALL SELECT 'Brand#3') UNION ALL SELECT module, package FROM v_owners UNION ALL SELECT 'Brand#3', 'mine'",
    "v_modules",
    "v_owners",
)
def _(modules, owners):  # noqa: ANN001, ANN202
    given = owners.select("module", "package").unionByName(modules.where("module = 'Brand#3'").select("module", F.lit("mine").alias("package")).distinct())
    return facts.derive_module_owners(modules, given)


@_query(
    "inventory_totals",
    "SELECT (SELECT count(*) FROM v_facts) AS facts, (SELECT count(DISTINCT subject) FROM v_facts) AS subjects, (SELECT count(DISTINCT package) FROM v_owners) AS packages, (SELECT count(DISTINCT path) FROM v_sources) AS sources, (SELECT count(*) FROM v_diagnostics) AS diagnostics, (SELECT count(*) FROM v_diagnostics WHERE level = 'error') AS errors, (SELECT count(*) FROM v_diagnostics WHERE level = 'warning') AS warnings",
    "v_facts",
    "v_diagnostics",
    "v_owners",
    "v_sources",
)
def _(rows, diagnostics, owners, sources):  # noqa: ANN001, ANN202
    return facts.inventory_totals(rows, diagnostics, owners, sources)


@_query("fact_page_after", "SELECT file, line, subject, object FROM v_facts WHERE (file, line, subject, object) > ('order/500', 2, 'part/0', '') ORDER BY file, line, subject, object LIMIT 40", "v_facts")
def _(rows):  # noqa: ANN001, ANN202
    return facts.fact_page_after(rows.select("file", "line", "subject", "object"), ["file", "line", "subject", "object"], ("order/500", 2, "part/0", ""), 40)


@_query("read_eval_metrics", "SELECT report_id, CASE WHEN report_id % 2 = 0 THEN 'one' END AS runtime, case_id, 'checks' AS metric, count(*)::DOUBLE AS value FROM v_checks GROUP BY 1, 2, 3", "v_checks")
def _(checks):  # noqa: ANN001, ANN202
    cases = checks.groupBy("report_id", "case_id").agg(F.count("*").cast("double").alias("checks"))
    case = F.struct("case_id", F.map_from_arrays(F.array(F.lit("checks")), F.array("checks")).alias("metrics"))
    docs = cases.groupBy("report_id").agg(F.collect_list(case).alias("cases"))
    return documents.read_eval_metrics(docs.select(F.to_json(F.struct("report_id", F.when(F.col("report_id") % 2 == 0, "one").alias("runtime"), "cases")).alias("value")))


_BAD_LINE = "page_id % 13 = 5 OR page_id % 7 = 3 OR page_id % 5 IN (2, 4) OR page_id % 11 = 0"


@_query("read_http_matches", f"SELECT page_id AS position, 200 AS status, 'v' AS fuzz, NULL AS reason, NULL AS value FROM v_match_lines WHERE NOT ({_BAD_LINE}) UNION ALL SELECT NULL, NULL, NULL, CASE WHEN page_id % 13 = 5 THEN 'malformed JSON' ELSE 'invalid field' END, value FROM v_match_lines WHERE {_BAD_LINE}", "v_match_lines")
def _(lines):  # noqa: ANN001, ANN202
    good, bad = readers.http_matches(lines.select("value"))
    return good.select("position", "status", F.decode(F.col("input")["FUZZ"], "UTF-8").alias("fuzz"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("value")).unionByName(bad, allowMissingColumns=True)


@_query("split_mfa", "SELECT event_id, CASE WHEN ok THEN CASE event_id % 4 WHEN 0 THEN 'Elixir.A.B' WHEN 1 THEN 'os' ELSE 'A' END END AS module, CASE WHEN ok THEN CASE event_id % 3 WHEN 0 THEN 'run?' ELSE 'f' END END AS function, CASE WHEN ok THEN event_id % 12 END AS arity FROM (SELECT *, event_id % 4 <> 2 AND event_id % 5 <> 0 AS ok FROM v_calls_text)", "v_calls_text")
def _(calls):  # noqa: ANN001, ANN202
    return calls.select("event_id", scalars.split_mfa(F.col("text")).alias("p")).select("event_id", "p.*")


@_query("verdict_text", "SELECT event_id, 'tool: ' || verdict || ' (' || n || CASE WHEN n = 1 THEN ' finding)' ELSE ' findings)' END AS text FROM v_calls_text", "v_calls_text")
def _(calls):  # noqa: ANN001, ANN202
    return calls.select("event_id", scalars.verdict_text(F.lit("tool"), F.col("verdict"), F.col("n")).alias("text"))


@_query(
    "align_canonical",
    "SELECT d.ip, d.batch, CASE WHEN d.batch = 5 THEN 'error' ELSE coalesce(h.found, 'down') END AS status, CASE WHEN d.batch = 5 THEN 'engine' WHEN h.found IS NULL THEN 'not_reported' END AS reason FROM v_addresses d LEFT JOIN (SELECT kind, n, max(status) AS found FROM v_addresses_found GROUP BY 1, 2) h ON h.kind = d.kind AND h.n = d.n",
    "v_addresses",
    "v_addresses_found",
)
def _(asked, found):  # noqa: ANN001, ANN202
    failed = asked.where("batch = 5").select("batch", F.lit("engine").alias("error"))
    return policy.align_enrichment(asked.select("ip", "batch"), found.select("ip", "status"), failed)


@_query("boundary_scenarios", "SELECT matrix, scenario, events, joined, false_joins, candidates, CASE WHEN supported AND joined = events AND false_joins = 0 THEN 'holds' WHEN NOT supported AND joined < events THEN 'gap' ELSE 'failed' END AS status FROM v_boundaries", "v_boundaries")
def _(scenarios):  # noqa: ANN001, ANN202
    return policy.boundary_scenarios(scenarios)


@_query("search_times", "SELECT mode, count(*) FILTER (found) AS found, count(*) AS trials, " + ", ".join(f"list_sort(list({c}))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS {c}" for c in ("coverage", "depth", "time")) + " FROM v_timed_trials GROUP BY 1", "v_timed_trials")
def _(trials):  # noqa: ANN001, ANN202
    return policy.search_comparison(trials, report.upper_median)
