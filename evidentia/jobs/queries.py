"""The registered queries of the security-evidence operators, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import oracles as o
from ..functions import scalars as s
from ..operators import contracts, lineage, rules
from ..operators import correlate as c
from ..operators import facts as f
from ..operators import findings as g
from ..operators import graph, report
from ..operators import windows as w
from ..sources import readers
from .views import view, with_views

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str]] = {}


def _query(name: str, sql: str, *views: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Registers a function of views as a query."""

    def add(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _FOUND[name] = (lambda spark, sf_dir: fn(*(view(spark, sf_dir, v) for v in views)), with_views(sql))
        return fn

    return add


def _part(*values: str) -> str:
    return " || ".join(f"coalesce(CAST(length(CAST({v} AS STRING)) AS STRING) || ':' || CAST({v} AS STRING) || ';', '-;')" for v in values)


def digest_sql(lines: str) -> str:
    """The digest trees of (key, line) with leaves of about 1024 lines, as common table expressions ending in `roots` (key, digest, n)."""
    text = [f"l AS (SELECT key, line || '*' || count(*) AS line, count(*) AS times FROM ({lines}) GROUP BY key, line), g AS (SELECT key, count(*) AS lines, sum(times)::BIGINT AS n FROM l GROUP BY key)"]
    text.append("d AS (SELECT l.key, l.line, sha256(l.line) AS hash, (g.lines > 1024)::INT + (g.lines > 16384)::INT + (g.lines > 262144)::INT + (g.lines > 4194304)::INT AS depth FROM l JOIN g ON g.key = l.key)")
    text.append("t4 AS (SELECT key, left(hash, 4) AS node, line FROM d WHERE depth = 4)")
    for depth in (3, 2, 1, 0):
        text.append(f"t{depth} AS (SELECT key, left(hash, {depth}) AS node, line FROM d WHERE depth = {depth} UNION ALL SELECT key, left(node, {depth}), node || ':' || sha256(string_agg(line, chr(10) ORDER BY line)) FROM t{depth + 1} GROUP BY key, node)")
    return "WITH " + ", ".join(text) + ", roots AS (SELECT t0.key, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest, any_value(g.n) AS n FROM t0 JOIN g ON g.key = t0.key GROUP BY t0.key)"


def _sid(source: str, *values: str) -> str:
    return f"'{source}:' || sha256('v1|{source}|' || {_part(*values)})"


CATEGORY = "CASE WHEN p.location = 'header' AND lower(p.name) = 'host' THEN 'vhost' WHEN p.location IN ('query','body','cookie') THEN 'param_injection' WHEN p.location = 'url' THEN 'exposed_path' ELSE 'matched_response' END"
MATCHES = f"""c AS (SELECT h.match_id, p.*, p.keyword IN (h.keyword, coalesce(h.keyword2, h.keyword)) AS has, CASE WHEN p.location = 'header' AND lower(p.name) = 'host' THEN 0 WHEN p.location IN ('query','body','cookie') THEN 1 ELSE 2 END AS rank FROM v_http h JOIN v_points p ON h.job_id = p.job_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY has DESC, CASE WHEN has THEN rank ELSE 0 END, place) AS n FROM c) WHERE n = 1),
m AS (SELECT h.*, j.method, {CATEGORY} AS category, coalesce(p.name, p.location) AS point, coalesce(p.keyword, CASE WHEN h.keyword2 < h.keyword THEN h.keyword2 ELSE h.keyword END) AS shown,
 concat_ws(';', CASE WHEN list_contains(j.keywords, h.keyword2) THEN h.keyword2 || '=' || length(h.value2) || ':' || h.value2 END, CASE WHEN list_contains(j.keywords, h.keyword) THEN h.keyword || '=' || length(h.value) || ':' || h.value END) AS own FROM v_http h LEFT JOIN p ON h.match_id = p.match_id LEFT JOIN v_jobs j ON h.job_id = j.job_id),
m2 AS (SELECT *, CASE WHEN method IS NULL THEN NULL ELSE own END AS signature FROM m),
hf AS (SELECT {_sid('http', "'http_match'", 'method', 'url', 'category', 'point', 'signature')} AS id, 'http' AS source, category, CAST(NULL AS VARCHAR) AS severity, 'medium' AS confidence, 'matched HTTP ' || status || ', length=' || length || ', ' || shown || '=' || CASE shown WHEN keyword THEN '"' || value || '"' WHEN keyword2 THEN '"' || value2 || '"' ELSE 'nil' END AS evidence, url AS locus FROM m2)"""
PORTS = f"""pf AS (SELECT {_sid('ports', 'ip', 'port', "coalesce(protocol, 'tcp')")} AS id, 'ports' AS source, CASE WHEN service IS NULL THEN 'open_port' ELSE 'exposed_service' END AS category, 'info' AS severity, 'high' AS confidence, port || '/' || coalesce(protocol, 'tcp') || ' open' || CASE WHEN service IS NULL THEN '' ELSE ' (' || service || ')' END AS evidence, ip || ':' || port AS locus FROM v_hosts h JOIN v_ports p USING (c_custkey) WHERE h.status = 'up' AND p.state = 'open')"""


def _hosts(hosts: DataFrame, ports: DataFrame) -> DataFrame:
    listed = ports.groupBy("c_custkey").agg(F.collect_list(F.struct("port", "protocol", "state", "service")).alias("ports"))
    return hosts.join(listed, "c_custkey").select("ip", "status", "ports")


@_query("findings_from_hosts", f"WITH {PORTS} SELECT * FROM pf", "v_hosts", "v_ports")
def _(hosts, ports):  # noqa: ANN001, ANN202
    return g.findings_from_hosts(_hosts(hosts, ports))


def _inputs(http: DataFrame) -> DataFrame:
    both = F.map_from_arrays(F.array("keyword", "keyword2"), F.array("value", "value2"))
    return http.select("job_id", "url", "status", "length", F.when(F.col("keyword2").isNull(), F.create_map("keyword", "value")).otherwise(both).alias("input"))


@_query("findings_from_matches", f"WITH {MATCHES} SELECT * FROM hf", "v_http", "v_jobs", "v_points")
def _(http, jobs, points):  # noqa: ANN001, ANN202
    return g.findings_from_matches(_inputs(http), jobs, points)


BUS = f"WITH {MATCHES}, {PORTS}, every AS (SELECT * FROM hf UNION ALL SELECT * FROM pf), bus AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY source, category, severity, confidence, evidence, locus) AS n FROM every) WHERE n = 1)"


@_query("finding_bus", f"{BUS} SELECT id, source, category, severity, confidence, evidence, locus FROM bus", "v_http", "v_jobs", "v_points", "v_hosts", "v_ports")
def bus(http, jobs, points, hosts, ports):  # noqa: ANN001, ANN202
    return g.finding_bus(g.findings_from_matches(_inputs(http), jobs, points), g.findings_from_hosts(_hosts(hosts, ports)))


@_query("finding_rollup", f"{BUS} SELECT source, category, severity, confidence, count(*) AS n, grouping(source, category, severity, confidence) AS level FROM bus GROUP BY CUBE (source, category, severity, confidence)", "v_http", "v_jobs", "v_points", "v_hosts", "v_ports")
def _(*tables):  # noqa: ANN002, ANN202
    return g.finding_rollup(bus(*tables))


@_query("seed_provenance", "SELECT h.match_id, h.keyword, h.value, x.seed_id FROM v_http h LEFT JOIN (SELECT keyword, value, min(seed_id) AS seed_id FROM v_seeds GROUP BY 1, 2) x ON h.keyword = x.keyword AND h.value = x.value", "v_http", "v_seeds")
def _(http, seeds):  # noqa: ANN001, ANN202
    return g.seed_provenance(http.select("match_id", "keyword", "value"), seeds.select("keyword", "value", "seed_id"))


@_query("first_wins", "SELECT id, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS n FROM v_seeds) WHERE n = 1", "v_seeds")
def _(seeds):  # noqa: ANN001, ANN202
    return g.first_wins(seeds.select("id", "seq", "value"), ["id"], ["seq"])


@_query("last_wins", "SELECT id, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS n FROM v_seeds) WHERE n = 1", "v_seeds")
def _(seeds):  # noqa: ANN001, ANN202
    return g.last_wins(seeds.select("id", "seq", "value"), ["id"], ["seq"])


@_query("merge_corpus", "SELECT id, value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY (seq % 3 = 0)::INT DESC, seq DESC) AS n FROM v_seeds) WHERE n = 1", "v_seeds")
def _(seeds):  # noqa: ANN001, ANN202
    rows = seeds.select("id", "seq", "value")
    return readers.merge_corpus(rows.where("seq % 3 <> 0"), rows.where("seq % 3 = 0"))


@_query("replay_values", "SELECT property, value, min(seed_id) AS seed_id FROM v_seeds GROUP BY 1, 2", "v_seeds")
def _(seeds):  # noqa: ANN001, ANN202
    return report.replay_values(seeds)


@_query("verdict_rollup", "SELECT tool, action, count(*) FILTER (verdict = 'confirmed') AS confirmed, count(*) FILTER (verdict = 'refuted') AS refuted, count(*) FILTER (verdict = 'inconclusive') AS inconclusive FROM v_verdicts GROUP BY 1, 2", "v_verdicts")
def _(v):  # noqa: ANN001, ANN202
    return g.verdict_rollup(v)


@_query(
    "validation_contract",
    """WITH f AS (SELECT id, CASE WHEN id % 50 = 0 THEN 'other' ELSE tool END AS source, tool, CASE id % 7 WHEN 0 THEN 'huge' WHEN 1 THEN NULL ELSE 'low' END AS severity, CASE WHEN id % 9 = 0 THEN NULL ELSE 'high' END AS confidence, CASE WHEN id % 6 = 0 THEN ' ' ELSE action END AS evidence FROM v_verdicts WHERE toxic = 1),
x AS (SELECT id, count(*) AS n, count(*) FILTER (source <> tool) AS f, count(*) FILTER (severity NOT IN ('info', 'low', 'medium', 'high', 'critical')) AS s, count(*) FILTER (coalesce(confidence NOT IN ('low', 'medium', 'high'), true)) AS c, count(*) FILTER (coalesce(trim(evidence), '') = '') AS e FROM f GROUP BY 1)
SELECT v.id, concat_ws(',', CASE WHEN v.id % 31 = 0 THEN 'no seed' END, CASE WHEN verdict = 'confirmed' AND coalesce(n, 0) = 0 THEN 'confirmed without finding' END, CASE WHEN verdict <> 'confirmed' AND coalesce(n, 0) > 0 THEN 'finding without confirmation' END, CASE WHEN f > 0 THEN 'foreign finding' END, CASE WHEN s > 0 THEN 'bad severity' END, CASE WHEN c > 0 THEN 'bad confidence' END, CASE WHEN e > 0 THEN 'bad evidence' END) AS reasons FROM v_verdicts v LEFT JOIN x ON v.id = x.id""",
    "v_verdicts",
)
def _(v):  # noqa: ANN001, ANN202
    i = F.col("id")
    found = v.where("toxic = 1").select(
        i.alias("validation_id"),
        "tool",
        F.when(i % 50 == 0, "other").otherwise(F.col("tool")).alias("source"),
        F.when(i % 7 == 0, "huge").when(i % 7 != 1, "low").alias("severity"),
        F.when(i % 9 != 0, "high").alias("confidence"),
        F.when(i % 6 == 0, " ").otherwise(F.col("action")).alias("evidence"),
    )
    return g.validation_contract(v.select("id", "tool", "verdict", F.when(i % 31 != 0, i).alias("seed_id")), found)


@_query("revalidate", "SELECT id, id % 4 <> 0 AS complete, CASE WHEN id % 3 = 0 THEN 'confirmed' WHEN id % 4 <> 0 THEN 'refuted' ELSE 'inconclusive' END AS verdict FROM v_verdicts", "v_verdicts")
def _(v):  # noqa: ANN001, ANN202
    return g.revalidate(v.select("id", (F.col("id") % 4 != 0).alias("complete")), v.where("id % 3 = 0"), ["id"])


@_query("receipt_gate", "SELECT id, id % 3 = 0 AS reproduced, CASE WHEN id % 3 = 0 THEN 'confirmed' WHEN id % 4 <> 0 THEN 'refuted' ELSE 'inconclusive' END AS verdict FROM v_verdicts", "v_verdicts")
def _(v):  # noqa: ANN001, ANN202
    return g.receipt_gate(v.select("id", (F.col("id") % 3 == 0).alias("reproduced")), v.where("id % 4 <> 0"), ["id"])


@_query("active_and_suppressed", "SELECT m.rule_id, m.file, m.line, m.message, m.cents, x.reason, CASE WHEN x.reason IS NULL THEN 'active' ELSE 'suppressed' END AS state FROM v_matches m LEFT JOIN (SELECT rule_id, file, line, min(anchor) AS reason FROM v_matches WHERE message % 40 = 0 GROUP BY 1, 2, 3) x ON m.rule_id = x.rule_id AND m.file = x.file AND m.line = x.line", "v_matches")
def _(m):  # noqa: ANN001, ANN202
    sup = m.where("message % 40 = 0").select("rule_id", "file", F.col("line").alias("target_line"), F.col("anchor").alias("reason"))
    return g.active_and_suppressed(m.select("rule_id", "file", "line", "message", "cents"), sup)


@_query("expand_clusterbomb", "SELECT a.value AS value1, b.value AS value2 FROM v_lists a, v_lists b WHERE a.list = 1 AND b.list = 2", "v_lists")
def _(lists):  # noqa: ANN001, ANN202
    return g.expand_inputs(lists, "clusterbomb")


@_query("expand_pitchfork", "SELECT a.value AS value1, b.value AS value2 FROM v_lists a JOIN v_lists b ON a.place = b.place WHERE a.list = 1 AND b.list = 2", "v_lists")
def _(lists):  # noqa: ANN001, ANN202
    return g.expand_inputs(lists, "pitchfork")


ORACLES = """SELECT match_id, CASE WHEN status BETWEEN 500 AND 599 THEN 'violation' ELSE 'pass' END AS no_500,
 CASE WHEN content_type IS NULL OR body IS NULL THEN 'skip' WHEN lower(split_part(content_type, ';', 1)) = 'text/html' AND contains(body, value) THEN 'violation' ELSE 'pass' END AS no_reflection,
 CASE WHEN body IS NULL THEN 'skip' WHEN regexp_matches(body, '(?i)you have an error in your SQL syntax') OR regexp_matches(body, '\\bORA-\\d{5}\\b') OR regexp_matches(body, '(?i)SQLSTATE\\[[A-Z0-9]+\\]') OR regexp_matches(body, '(?i)syntax error at or near [\\"'']') OR regexp_matches(body, '(?i)unclosed quotation mark after the character string') OR regexp_matches(body, '(?i)(?:SQL Native Client|ODBC SQL Server Driver|OLE DB Provider)') THEN 'violation' ELSE 'pass' END AS injection_signal,
 CASE WHEN body IS NULL THEN 'skip' WHEN regexp_matches(body, '(?i)traceback \\(most recent call last\\)') OR regexp_matches(body, '(?i)stack[\\s_-]*trace') OR regexp_matches(body, '(?i)uncaught\\s+\\w*exception') OR regexp_matches(body, '\\.exs?:\\d+(?::\\d+)?') OR regexp_matches(body, '(?:ArgumentError|FunctionClauseError|CaseClauseError|KeyError):') THEN 'violation' ELSE 'pass' END AS sensitive_leak,
 CASE WHEN body IS NULL THEN 'skip' WHEN regexp_matches(regexp_replace(body, '\\x1b\\[[0-9;]*m', '', 'g'), '[\\x00-\\x08\\x0b-\\x1f\\x7f\\x{80}-\\x{9f}]') THEN 'violation' ELSE 'pass' END AS terminal_safety,
 CASE WHEN body IS NULL THEN 'skip' WHEN strlen(body) > 3000 THEN 'violation' ELSE 'pass' END AS bounded_bytes,
 CASE WHEN body IS NULL OR strlen(body) > 1048576 THEN 'skip' WHEN length(body) > 3000 THEN 'violation' ELSE 'pass' END AS bounded_codepoints FROM v_http"""


@_query("oracle_predicates", ORACLES, "v_http")
def predicates(h):  # noqa: ANN001, ANN202
    body = F.col("body")
    return h.select(
        "match_id",
        o.no_500(F.col("status")).alias("no_500"),
        o.no_reflection(body, F.col("content_type"), F.col("value")).alias("no_reflection"),
        o.injection_signal(body).alias("injection_signal"),
        o.sensitive_leak(body).alias("sensitive_leak"),
        o.terminal_safety(body).alias("terminal_safety"),
        o.bounded_length(body, 3000, "bytes").alias("bounded_bytes"),
        o.bounded_length(body, 3000, "codepoints").alias("bounded_codepoints"),
    )


_NAMES = ("no_500", "no_reflection", "injection_signal", "sensitive_leak", "terminal_safety", "bounded_bytes", "bounded_codepoints")


@_query("oracle_report", f"WITH r AS ({ORACLES}), t AS (UNPIVOT r ON {', '.join(_NAMES)} INTO NAME name VALUE result), u AS (SELECT match_id, count(*) FILTER (result = 'violation') AS violations, count(*) FILTER (result = 'skip') AS skips FROM t GROUP BY 1) SELECT *, CASE WHEN violations > 0 THEN 'confirmed' WHEN skips > 0 THEN 'inconclusive' ELSE 'refuted' END AS verdict FROM u", "v_http")
def _(h):  # noqa: ANN001, ANN202
    long = predicates(h).unpivot(["match_id"], list(_NAMES), "name", "result")
    counts = long.groupBy("match_id").agg(F.count_if(F.col("result") == o.VIOLATION).alias("violations"), F.count_if(F.col("result") == o.SKIP).alias("skips"))
    return counts.withColumn("verdict", o.replay_verdict(F.col("violations"), F.col("skips")))


@_query("oracle_state_growth", "SELECT event_id, CASE WHEN b IS NULL OR a IS NULL THEN 'skip' WHEN a - b > 50 THEN 'violation' WHEN z IS NULL THEN 'skip' WHEN z - b > 10 THEN 'violation' ELSE 'pass' END AS result FROM (SELECT event_id, event_id % 97 AS b, CASE WHEN event_id % 10 <> 0 THEN event_id % 131 END AS a, CASE WHEN event_id % 7 <> 0 THEN event_id % 101 END AS z FROM v_trace)", "v_trace")
def _(t):  # noqa: ANN001, ANN202
    i = F.col("event_id")
    return t.select("event_id", o.state_growth(i % 97, F.when(i % 10 != 0, i % 131), F.when(i % 7 != 0, i % 101), F.lit(50), F.lit(10)).alias("result"))


@_query("oracle_canonical_encoding", "SELECT match_id, CASE WHEN match_id % 4 = 0 THEN 'pass' WHEN url = lower(url) AND match_id % 9 <> 0 THEN 'pass' ELSE 'violation' END AS result FROM v_http", "v_http")
def _(h):  # noqa: ANN001, ANN202
    encoded = F.when(F.col("match_id") % 9 != 0, F.lower("url"))
    return h.select("match_id", o.canonical_encoding(F.col("url"), F.col("match_id") % 4 != 0, encoded).alias("result"))


ORIGIN = """u AS (SELECT match_id, trim(url) AS u FROM v_urls),
k AS (SELECT match_id, regexp_matches(u, '^(?i)https?://[^/?#:@]+(:[0-9]+)?(/[^?#]*)?(\\?[^#]*)?$') AS fits, lower(split_part(u, '://', 1)) AS scheme, lower(regexp_extract(u, '//([^/?#:@]+)', 1)) AS host, nullif(regexp_extract(u, '//[^/?#:@]+:([0-9]+)', 1), '') AS port FROM u)"""


@_query("url_origin", f"WITH {ORIGIN}, x AS (SELECT *, fits AND coalesce(CAST(port AS BIGINT) BETWEEN 1 AND 65535, true) AS ok FROM k) SELECT match_id, CASE WHEN ok THEN scheme END AS scheme, CASE WHEN ok THEN host END AS host, CASE WHEN ok THEN coalesce(CAST(port AS INT), CASE scheme WHEN 'https' THEN 443 ELSE 80 END) END AS port FROM x", "v_urls")
def _(urls):  # noqa: ANN001, ANN202
    return urls.select("match_id", s.url_origin(F.col("url")).alias("o")).select("match_id", "o.*")


@_query("ip_to_int", "SELECT ip, CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536 + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT) AS n FROM v_hosts", "v_hosts")
def _(h):  # noqa: ANN001, ANN202
    return h.select("ip", s.ip_to_int(F.col("ip")).alias("n"))


@_query(
    "authorize_ips",
    """WITH t AS (SELECT DISTINCT target, form, n, CASE form WHEN 1 THEN k % 30 WHEN 4 THEN k % 130 END AS own, CASE form WHEN 0 THEN k % 3 END AS third FROM v_scope_targets)
SELECT DISTINCT target, CASE WHEN form IN (0, 1) AND n % 5 <> 0 THEN CASE WHEN n % 3 = 0 THEN coalesce(own >= 16, true) ELSE coalesce(own >= 24, third = 0) END
  WHEN form = 3 THEN n % 5 = 0 WHEN form = 4 THEN n % 5 = 0 AND own BETWEEN 48 AND 128 WHEN form = 2 THEN target IN (SELECT hostname FROM v_scope_names) ELSE false END AS allowed FROM t""",
    "v_scope_targets",
    "v_scope_networks",
    "v_scope_names",
)
def _(targets, networks, names):  # noqa: ANN001, ANN202
    return contracts.authorize_ips(targets, networks, names)


@_query("payload_variants", "SELECT DISTINCT v.value AS base, u.x AS variant FROM v_seeds v, unnest([v.value, ' ' || v.value, v.value || ' ', v.value || v.value, upper(v.value)]) u(x)", "v_seeds")
def _(seeds):  # noqa: ANN001, ANN202
    return seeds.select("value").distinct().select(F.col("value").alias("base"), F.explode(s.payload_variants(F.col("value"))).alias("variant"))


@_query("text_lengths", "SELECT doc_id, strlen(content) AS bytes, length(content) AS codepoints, length_grapheme(content) AS graphemes FROM v_sources", "v_sources")
def _(src):  # noqa: ANN001, ANN202
    return src.select("doc_id", s.text_lengths(F.col("content")).alias("n")).select("doc_id", "n.*")


@_query("fingerprint", "SELECT doc_id, sha256(content) AS digest FROM v_sources", "v_sources")
def _(src):  # noqa: ANN001, ANN202
    return src.select("doc_id", s.fingerprint(F.col("content")).alias("digest"))


@_query(
    "component_checksum",
    digest_sql("SELECT component AS key, path || '=' || sha256(content) AS line FROM v_sources") + " SELECT key AS component, digest AS checksum, n AS files FROM roots",
    "v_sources",
)
def _(src):  # noqa: ANN001, ANN202
    return f.component_checksum(src)


@_query("source_limit_diagnostics", "SELECT 'file_too_large' AS code, path FROM v_sources WHERE bytes > 5000", "v_sources")
def _(src):  # noqa: ANN001, ANN202
    return readers.source_limits(src.select("path", "bytes"), 1 << 40, 5000, 1 << 50)[1]


@_query("parse_suppressions", "SELECT comment_id, comment_id % 5 = 0 AS valid, CASE WHEN comment_id % 5 = 0 THEN 'rule.' || (comment_id % 3) END AS rule_id, CASE WHEN comment_id % 5 = 0 THEN line + 1 END AS target_line, CASE WHEN comment_id % 5 = 0 THEN 'known and safe' END AS reason FROM v_comments WHERE comment_id % 5 < 3", "v_comments")
def _(comments):  # noqa: ANN001, ANN202
    return f.parse_suppressions(comments)


@_query("query_facts", "SELECT * FROM v_facts WHERE kind = 'call' AND starts_with(subject, 'part/1') AND relation = 'calls'", "v_facts")
def _(facts):  # noqa: ANN001, ANN202
    return f.query_facts(facts, {"subject": "part/1"}, kind="call", relation="calls")


@_query("fact_page", "SELECT *, (SELECT count(*) FROM v_facts) AS total, CASE WHEN 300 < (SELECT count(*) FROM v_facts) THEN 300 END AS next_offset FROM v_facts ORDER BY file, line, col, kind, object, subject, relation LIMIT 100 OFFSET 200", "v_facts")
def _(facts):  # noqa: ANN001, ANN202
    return f.fact_page(facts, ["file", "line", "col", "kind", "object", "subject", "relation"], 100, 200)


@_query("inventory_summary", "SELECT kind, relation, count(*) AS n, count(DISTINCT subject) AS subjects FROM v_facts GROUP BY GROUPING SETS ((kind), (relation), ())", "v_facts")
def _(facts):  # noqa: ANN001, ANN202
    return f.inventory_summary(facts)


@_query("occurrence_index", "SELECT *, row_number() OVER (PARTITION BY rule_id, file, anchor ORDER BY line, col, message, o, cents) AS occurrence FROM v_matches", "v_matches")
def _(m):  # noqa: ANN001, ANN202
    return f.occurrence_index(m, ["line", "col", "message", "o", "cents"])


@_query("derive_module_owners", "SELECT module, min(package) AS package FROM v_modules GROUP BY 1 HAVING count(DISTINCT package) = 1", "v_modules")
def _(m):  # noqa: ANN001, ANN202
    return f.derive_module_owners(m)


@_query("package_uses", "SELECT call_id, target, module, package FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY length(module) DESC) AS n FROM v_calls JOIN v_owners ON target = module OR starts_with(target, module || '.')) WHERE n = 1", "v_calls", "v_owners")
def _(calls, owners):  # noqa: ANN001, ANN202
    return f.package_uses(calls, owners)


@_query("enclosing_scope", "SELECT point_id, scope_id FROM (SELECT p.point_id, s.scope_id, row_number() OVER (PARTITION BY p.point_id ORDER BY s.first DESC, s.last, s.scope_id DESC) AS n FROM v_points_in p LEFT JOIN v_spans s ON p.file = s.file AND p.at BETWEEN s.first AND s.last) WHERE n = 1", "v_points_in", "v_spans")
def _(points, spans):  # noqa: ANN001, ANN202
    return f.enclosing_scope(points, spans)


@_query("control_contexts", "SELECT p.point_id, count(*) AS n, arg_min(s.scope_id, (s.first, s.last, s.scope_id)) AS outer, arg_max(s.scope_id, (s.first, s.last, s.scope_id)) AS inner FROM v_points_in p JOIN v_spans s ON p.file = s.file AND p.at BETWEEN s.first AND s.last GROUP BY 1".replace("AS outer", 'AS "outer"').replace("AS inner", 'AS "inner"'), "v_points_in", "v_spans")
def _(points, spans):  # noqa: ANN001, ANN202
    return f.control_contexts(points, spans)


@_query("resolve_aliases", "SELECT a.file, a.point_id, x.value FROM v_asked a ASOF LEFT JOIN (SELECT file, since, max(value) AS value FROM v_changes GROUP BY 1, 2) x ON a.file = x.file AND a.at >= x.since", "v_asked", "v_changes")
def _(asked, changes):  # noqa: ANN001, ANN202
    return f.as_of(asked, changes, ["file"])


@_query(
    "resolve_imports",
    "SELECT h.match_id AS call_id, CASE WHEN h.match_id % 7 = 0 THEN 'local' WHEN n = 1 THEN 'imported' WHEN n > 1 THEN 'ambiguous_import' ELSE 'local_or_imported' END AS resolution, CASE WHEN h.match_id % 7 <> 0 AND n = 1 THEN x.module END AS module FROM v_http h LEFT JOIN (SELECT job_id, keyword, count(DISTINCT location) AS n, min(location) AS module FROM v_points GROUP BY 1, 2) x ON h.job_id = x.job_id AND h.keyword = x.keyword",
    "v_http",
    "v_points",
)
def _(h, p):  # noqa: ANN001, ANN202
    # a call's file names its page where that defines the name itself
    own = F.col("match_id") % 7 == 0
    calls = h.select(F.col("match_id").alias("call_id"), F.when(own, F.concat(F.lit("own"), "match_id")).otherwise(F.col("job_id").cast("string")).alias("file"), F.col("keyword").alias("name"))
    return f.resolve_imports(calls, calls.where(F.startswith("file", F.lit("own"))).select("file", "name"), p.select(F.col("job_id").cast("string").alias("file"), F.col("keyword").alias("name"), F.col("location").alias("module")))


@_query("reaching_definitions", "SELECT use_id, binding_id, rank, n > 8 AS truncated, n > 1 AS multiple FROM (SELECT u.use_id, b.use_id AS binding_id, row_number() OVER (PARTITION BY u.use_id ORDER BY b.at DESC, b.use_id) AS rank, count(*) OVER (PARTITION BY u.use_id) AS n FROM v_uses u JOIN v_uses b ON u.file = b.file AND u.variable = b.variable AND b.at <= u.at AND b.use_id <> u.use_id) WHERE rank <= 8", "v_uses")
def _(uses):  # noqa: ANN001, ANN202
    return f.reaching_definitions(uses, uses.withColumnRenamed("use_id", "binding_id"))


@_query(
    "reaching_parameters",
    "WITH b AS (SELECT * FROM v_uses WHERE at % 5 = 0), r AS (SELECT u.use_id, b.use_id AS binding_id, row_number() OVER (PARTITION BY u.use_id ORDER BY b.at DESC, b.use_id) AS rank, count(*) OVER (PARTITION BY u.use_id) AS n FROM v_uses u JOIN b ON u.file = b.file AND u.variable = b.variable AND b.at <= u.at AND b.use_id <> u.use_id), p AS (SELECT DISTINCT file, variable, file * 10 + use_id % 3 AS parameter_id FROM v_uses)"
    " SELECT use_id, binding_id, rank, n > 2 AS truncated, n > 1 AS multiple, 'binding' AS source FROM r WHERE rank <= 2 UNION ALL SELECT u.use_id, p.parameter_id, row_number() OVER (PARTITION BY u.use_id ORDER BY p.parameter_id), false, false, 'parameter' FROM v_uses u JOIN p ON p.file = u.file AND p.variable = u.variable WHERE u.use_id NOT IN (SELECT use_id FROM r)",
    "v_uses",
)
def _(uses):  # noqa: ANN001, ANN202
    parameters = uses.select("file", "variable", (F.col("file") * 10 + F.col("use_id") % 3).alias("parameter_id")).distinct()
    return f.reaching_definitions(uses, uses.where("at % 5 = 0").withColumnRenamed("use_id", "binding_id"), 2, parameters)


@_query("shared_variables", "SELECT a.call_id, count(*) FILTER (a.call_id <> b.call_id) AS n FROM v_variables a JOIN v_variables b ON a.subject = b.subject AND list_has_any(a.variables, b.variables) GROUP BY 1", "v_variables")
def _(calls):  # noqa: ANN001, ANN202
    return f.shared_variables(calls)


@_query("ambiguity_count", "SELECT CASE status WHEN 500 THEN 'dynamic_dispatch' ELSE 'ambiguous_import' END AS resolution, count(*) AS n FROM v_http WHERE status <> 200 GROUP BY 1", "v_http")
def _(h):  # noqa: ANN001, ANN202
    return report.ambiguity_count(h.withColumn("resolution", F.when(F.col("status") == 500, "dynamic_dispatch").when(F.col("status") == 301, "ambiguous_import").otherwise("local")))


@_query("candidate_reduction", "SELECT count(*) FILTER (status = 500) AS selected, count(*) AS \"all\", round(count(*) FILTER (status = 500) / count(*), 6) AS ratio FROM v_http", "v_http")
def _(h):  # noqa: ANN001, ANN202
    return report.candidate_reduction(h.withColumn("selected", F.col("status") == 500))


PAIRS = """s AS (SELECT id, count(*) AS n, min(marker) AS marker, min(recipient) AS recipient, min(at) AS at FROM v_sends GROUP BY 1), r AS (SELECT id, count(*) AS n, min(marker) AS marker, min(receiver) AS receiver, min(at) AS at FROM v_receives GROUP BY 1),
pairs AS (SELECT e.id, coalesce(s.n, 0) AS sends, coalesce(r.n, 0) AS receives, coalesce(s.n = 1 AND r.n = 1 AND s.marker = r.marker AND s.recipient = r.receiver{0}, false) AS joined FROM (SELECT DISTINCT id FROM v_sends) e LEFT JOIN s ON e.id = s.id LEFT JOIN r ON e.id = r.id)"""
TIMED, FREE = PAIRS.replace("{0}", " AND s.at <= r.at"), PAIRS.replace("{0}", "")


@_query("pair_messages", f"WITH {TIMED} SELECT * FROM pairs", "v_sends", "v_receives")
def _(sends, receives):  # noqa: ANN001, ANN202
    return c.pair_messages(sends, sends, receives)


@_query("pair_unordered", f"WITH {FREE} SELECT * FROM pairs", "v_sends", "v_receives")
def _(sends, receives):  # noqa: ANN001, ANN202
    return c.pair_messages(sends, sends, receives, timed=False)


@_query("pair_summary", f"WITH {TIMED} SELECT count(*) AS expected, count(*) FILTER (joined) AS joined, count(*) - count(*) FILTER (joined) + count(*) FILTER (sends <> 1 OR receives <> 1) AS false_join_count FROM pairs", "v_sends", "v_receives")
def _(sends, receives):  # noqa: ANN001, ANN202
    return c.pair_summary(c.pair_messages(sends, sends, receives))


@_query(
    "pair_calls",
    f"WITH {TIMED} SELECT coalesce(s.id, r.id) AS id, coalesce(s.n, 0) AS sends, coalesce(r.n, 0) AS receives, CASE WHEN p.joined THEN 'joined' WHEN s.n = 1 AND r.n = 1 THEN 'mismatch' WHEN r.n IS NULL THEN 'send_only' WHEN s.n IS NULL THEN 'receive_only' ELSE 'ambiguous' END AS state FROM s FULL JOIN r ON s.id = r.id LEFT JOIN pairs p ON p.id = s.id",
    "v_sends",
    "v_receives",
)
def _(sends, receives):  # noqa: ANN001, ANN202
    return c.pair_calls(sends, receives)


@_query("value_only_candidates", "SELECT s.marker, s.n * r.n AS candidates, s.n = 1 AND r.n = 1 AS \"unique\" FROM (SELECT marker, count(*) AS n FROM v_sends GROUP BY 1) s JOIN (SELECT marker, count(*) AS n FROM v_receives GROUP BY 1) r ON s.marker = r.marker", "v_sends", "v_receives")
def _(sends, receives):  # noqa: ANN001, ANN202
    return c.value_only_candidates(sends, receives)


@_query("supportable_edges", "SELECT id FROM v_sends INTERSECT SELECT id FROM v_receives", "v_sends", "v_receives")
def _(sends, receives):  # noqa: ANN001, ANN202
    return c.supportable_edges(sends, receives)


@_query("task_lineage", "SELECT reference, count(*) FILTER (stage = 'handoff') AS n_handoff, count(*) FILTER (stage = 'result') AS n_result, coalesce(count(*) FILTER (stage = 'handoff') = 1 AND count(*) FILTER (stage = 'result') = 1 AND min(at) FILTER (stage = 'handoff') <= min(at) FILTER (stage = 'result'), false) AS joined FROM v_lineage GROUP BY 1", "v_lineage")
def _(events):  # noqa: ANN001, ANN202
    return c.task_lineage(events, ["handoff", "result"])


@_query("version_intervals", "SELECT key, version, since, until FROM (SELECT key, version, kind, at AS since, lead(at) OVER (PARTITION BY key ORDER BY at, version) AS until FROM v_store) WHERE kind = 'write'", "v_store")
def _(store):  # noqa: ANN001, ANN202
    return c.version_intervals(store)


@_query("store_versions", "SELECT r.read_id, CASE WHEN x.version IS NOT NULL THEN 'joined' WHEN t.n IS NULL OR r.version IS NOT NULL THEN 'missing' WHEN t.n = 1 THEN 'joined' ELSE 'ambiguous' END AS state FROM v_reads r LEFT JOIN (SELECT key, count(*) AS n FROM v_store WHERE kind = 'write' GROUP BY 1) t ON r.key = t.key LEFT JOIN (SELECT DISTINCT key, version FROM v_store WHERE kind = 'write') x ON r.key = x.key AND r.version = x.version", "v_store", "v_reads")
def _(store, reads):  # noqa: ANN001, ANN202
    return c.store_versions(store, reads)


@_query("session_event_limit", "SELECT session_id, event_id, place, n > 60 AS limited FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY at, event_id) AS place, count(*) OVER (PARTITION BY session_id) AS n FROM v_trace) WHERE place <= 60", "v_trace")
def _(trace):  # noqa: ANN001, ANN202
    return c.session_event_limit(trace, 60).select("session_id", "event_id", "place", "limited")


@_query("session_verdict", "SELECT session_id, count(*) AS events, count(*) FILTER (hit AND event_id % 40 = 0) AS hits, CASE WHEN count(*) > 66 THEN 'inconclusive' WHEN count(*) FILTER (hit AND event_id % 40 = 0) > 0 THEN 'confirmed' ELSE 'refuted' END AS verdict FROM v_trace GROUP BY 1", "v_trace")
def _(trace):  # noqa: ANN001, ANN202
    return c.session_verdict(trace.withColumn("hit", F.col("hit") & (F.col("event_id") % 40 == 0)), 66)


@_query("marker_match", "SELECT event_id, CASE WHEN strlen(args[1]) > 8 OR strlen(args[2]) > 8 THEN 'argument_limit' END AS failure, CASE WHEN NOT coalesce(strlen(args[1]) > 8 OR strlen(args[2]) > 8, false) THEN concat_ws(',', CASE WHEN contains(args[1], 'r') THEN '1' END, CASE WHEN contains(args[2], 'r') THEN '2' END) END AS matched FROM v_trace WHERE kind IN ('error', 'click')", "v_trace")
def _(trace):  # noqa: ANN001, ANN202
    sinks = trace.where(F.col("kind").isin("error", "click")).select("kind").distinct().withColumn("positions", F.array(F.lit(1), F.lit(2)))
    return c.marker_match(trace.select("event_id", "kind", "args"), sinks, "r", 8)


@_query("novelty_archive", "SELECT seq, count(*) AS new_items FROM (SELECT item, min(seq) AS seq FROM (SELECT seq, unnest(items) AS item FROM v_samples) GROUP BY 1) GROUP BY 1 ORDER BY 1 LIMIT 32", "v_samples")
def _(samples):  # noqa: ANN001, ANN202
    return w.novelty_archive(samples)


@_query("top_fitness", "SELECT seq, fitness FROM v_samples ORDER BY fitness DESC, seq LIMIT 20", "v_samples")
def _(samples):  # noqa: ANN001, ANN202
    return w.top_fitness(samples.select("seq", "fitness"), 20)


@_query("peak_rate", "SELECT origin, max(n) AS peak, count(*) AS requests, max(at) - min(at) AS span FROM (SELECT origin, at, count(*) OVER (PARTITION BY origin ORDER BY at RANGE BETWEEN CURRENT ROW AND 3599999999 FOLLOWING) AS n FROM v_rate) GROUP BY 1", "v_rate")
def _(requests):  # noqa: ANN001, ANN202
    return w.peak_rate(requests, 3_600_000_000)


@_query("incremental_samples", "SELECT stream, place, bytes, status, CAST(received AS BIGINT) AS received FROM (SELECT *, sum(bytes) OVER (PARTITION BY stream ORDER BY place) AS received, coalesce(sum((status <> 'incomplete')::INT) OVER (PARTITION BY stream ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stops FROM v_chunks) WHERE stops = 0", "v_chunks")
def _(chunks):  # noqa: ANN001, ANN202
    return w.incremental_samples(chunks)


@_query("budget_prefix", "WITH p AS (SELECT stream, place AS turn, row_number() OVER (PARTITION BY stream ORDER BY place) AS place, sum(bytes) OVER (PARTITION BY stream ORDER BY place) AS total FROM v_chunks), x AS (SELECT stream, place, CASE WHEN place > 3 THEN 'max_rows' WHEN total > 900 THEN 'max_bytes' END AS reason FROM p) SELECT stream, CAST(coalesce(min(place) FILTER (reason IS NOT NULL) - 1, count(*)) AS BIGINT) AS kept, arg_min(reason, place) FILTER (reason IS NOT NULL) AS reason FROM x GROUP BY 1", "v_chunks")
def _(chunks):  # noqa: ANN001, ANN202
    return w.budget_prefix(chunks, "stream", ["place"], "bytes", 3, 900)


@_query("oracle_incremental_budget", "SELECT stream, CASE WHEN min(place) FILTER (b > 800) IS NOT NULL THEN 'violation' WHEN bool_or(b IS NULL) THEN 'skip' ELSE 'pass' END AS result, min(place) FILTER (b > 800) AS place FROM (SELECT stream, place, CASE WHEN (stream + place) % 9 <> 0 THEN bytes END AS b FROM v_chunks) GROUP BY 1", "v_chunks")
def _(chunks):  # noqa: ANN001, ANN202
    return w.oracle_incremental_budget(chunks.withColumn("bytes", F.when((F.col("stream") + F.col("place")) % 9 != 0, F.col("bytes"))), 800)


@_query("latency_percentiles", "SELECT case_id, mode, quantile_disc(sample, 0.5) AS p50, quantile_disc(sample, 0.95) AS p95, count(*) AS n FROM v_latency GROUP BY 1, 2", "v_latency")
def _(samples):  # noqa: ANN001, ANN202
    return report.latency_percentiles(samples, ["case_id", "mode"])


MEDIAN = "list_sort(list(sample))[CAST(floor(count(*) / 2) AS BIGINT) + 1]"


@_query("upper_median", f"SELECT case_id, {MEDIAN} AS median FROM v_latency GROUP BY 1", "v_latency")
def _(samples):  # noqa: ANN001, ANN202
    return report.upper_median(samples, ["case_id"])


@_query("overhead_ratio", f"WITH m AS (SELECT case_id, mode, {MEDIAN} AS x FROM v_latency GROUP BY 1, 2), p AS (SELECT case_id, max(x) FILTER (mode = 'baseline') AS baseline, max(x) FILTER (mode = 'targeted') AS targeted FROM m GROUP BY 1) SELECT case_id, baseline, targeted, targeted - baseline AS added, round(targeted / nullif(baseline, 0), 6) AS ratio FROM p", "v_latency")
def _(samples):  # noqa: ANN001, ANN202
    return report.overhead_ratio(samples)


@_query("compare_runs", "SELECT coalesce(b.name, a.name) AS name, b.value AS before, a.value AS after, round(b.value / nullif(a.value, 0), 6) AS speedup FROM (SELECT case_id AS name, max(sample) AS value FROM v_latency WHERE mode = 'baseline' GROUP BY 1) b FULL JOIN (SELECT case_id AS name, min(sample) AS value FROM v_latency WHERE mode = 'targeted' GROUP BY 1) a ON a.name = b.name", "v_latency")
def _(samples):  # noqa: ANN001, ANN202
    before = samples.where("mode = 'baseline'").groupBy(F.col("case_id").alias("name")).agg(F.max("sample").alias("value"))
    return report.compare_runs(before, samples.where("mode = 'targeted'").groupBy(F.col("case_id").alias("name")).agg(F.min("sample").alias("value")))


@_query("suite_report", "WITH k AS (SELECT tool, count(*) AS n, count(*) FILTER (verdict <> 'refuted') AS ok FROM v_verdicts GROUP BY 1) SELECT count(*) AS cases, CAST(sum(ok) AS BIGINT) AS passed, CAST(sum(n) AS BIGINT) AS checks, count(*) FILTER (ok = n) AS cases_passed FROM k", "v_verdicts")
def _(v):  # noqa: ANN001, ANN202
    return report.suite_report(v.select(F.col("tool").alias("case_id"), (F.col("verdict") != "refuted").alias("passed")))


_OTHER = "SELECT tool, CASE WHEN toxic = 1 THEN 'confirmed' ELSE verdict END AS verdict FROM v_verdicts"


@_query("same_semantics", f"(SELECT *, 'first' AS side FROM (SELECT tool, verdict FROM v_verdicts EXCEPT ALL {_OTHER})) UNION ALL (SELECT *, 'second' AS side FROM ({_OTHER} EXCEPT ALL SELECT tool, verdict FROM v_verdicts))", "v_verdicts")
def _(v):  # noqa: ANN001, ANN202
    return report.same_semantics(v.select("tool", "verdict"), v.select("tool", F.when(F.col("toxic") == 1, "confirmed").otherwise(F.col("verdict")).alias("verdict")))


@_query("leak_audit", "SELECT literal_id, count(DISTINCT doc_id) AS documents FROM v_sources JOIN v_literals ON contains(lower(content), lower(literal)) GROUP BY 1", "v_sources", "v_literals")
def _(src, literals):  # noqa: ANN001, ANN202
    return report.leak_audit(src.select("doc_id", F.col("content").alias("text")), literals)


@_query("job_rate_share", "SELECT scan_id, greatest(1, least(most, rate, n)) AS jobs, rate // greatest(1, least(most, rate, n)) AS share FROM v_scans JOIN (SELECT scan_id, count(*) AS n FROM v_targets GROUP BY 1) USING (scan_id)", "v_scans", "v_targets")
def _(scans, targets):  # noqa: ANN001, ANN202
    return report.job_rate_share(scans, targets)


@_query("graph_slice", 'WITH RECURSIVE e AS (SELECT DISTINCT "from", "to" FROM v_edges), t(root, node, depth) AS (SELECT root, root, 0 FROM v_roots UNION SELECT t.root, e."to", t.depth + 1 FROM t JOIN e ON t.node = e."from" WHERE t.depth < 3) SELECT root, node, min(depth) AS depth FROM t GROUP BY 1, 2', "v_edges", "v_roots")
def _(edges, roots):  # noqa: ANN001, ANN202
    return graph.graph_slice(edges, roots, 3)


@_query("callers", 'WITH RECURSIVE e AS (SELECT DISTINCT "from", "to" FROM v_edges), t(root, node, depth) AS (SELECT DISTINCT "to", "to", 0 FROM v_edges WHERE starts_with("to", \'n\') UNION SELECT t.root, e."from", t.depth + 1 FROM t JOIN e ON t.node = e."to" WHERE t.depth < 2) SELECT root, node, min(depth) AS depth FROM t GROUP BY 1, 2', "v_edges")
def _(edges):  # noqa: ANN001, ANN202
    return graph.graph_slice(edges, edges.where("startswith(to, 'n')").select(F.col("to").alias("root")).distinct(), 2, "in")


@_query("sink_reach", 'WITH RECURSIVE e AS (SELECT DISTINCT "from", "to" FROM v_edges), t(root, node, depth) AS (SELECT root, root, 0 FROM v_roots UNION SELECT t.root, e."to", t.depth + 1 FROM t JOIN e ON t.node = e."from" WHERE t.depth < 4) SELECT root, node, min(depth) AS depth FROM t WHERE starts_with(node, \'r\') GROUP BY 1, 2', "v_edges", "v_roots")
def _(edges, roots):  # noqa: ANN001, ANN202
    return graph.sink_reach(edges, roots, edges.where("startswith(to, 'r')").select(F.col("to").alias("node")), 4)


MFA = "(module || '.' || fn || '/' || CAST(arity AS STRING))"


@_query("calls_to", "SELECT * FROM v_api WHERE module = 'os' AND fn = 'cmd'", "v_api")
def _(calls):  # noqa: ANN001, ANN202
    return rules.calls_to(calls, "os", "cmd")


@_query("rule_unsafe_atom", f"SELECT * FROM v_api WHERE shape = 'dynamic' AND {MFA} IN ('String.to_atom/1', 'List.to_atom/1', 'Module.concat/1', 'Module.concat/2', 'erlang.list_to_atom/1', 'erlang.binary_to_atom/2')", "v_api")
def _(calls):  # noqa: ANN001, ANN202
    return rules.unsafe_atom(calls)


@_query("rule_unsafe_exec", f"SELECT *, CASE shape WHEN 'dynamic' THEN 'medium' ELSE 'low' END AS confidence FROM v_api WHERE {MFA} IN ('os.cmd/1', 'os.cmd/2', 'System.shell/1', 'System.shell/2') OR ({MFA} = 'erlang.open_port/2' AND head IN ('spawn', 'spawn_executable'))", "v_api")
def _(calls):  # noqa: ANN001, ANN202
    return rules.unsafe_exec(calls)


@_query("rule_deserialization", "SELECT *, CASE WHEN arity = 2 AND safe THEN 'safe_option' ELSE 'none' END AS qualification FROM v_api WHERE module = 'erlang' AND fn = 'binary_to_term' AND arity IN (1, 2)", "v_api")
def _(calls):  # noqa: ANN001, ANN202
    return rules.deserialization(calls)


@_query("rule_dynamic_code", "SELECT * FROM v_api WHERE (module = 'Code' AND fn IN ('eval_string', 'eval_quoted')) OR (module = 'EEx' AND fn = 'eval_string')", "v_api")
def _(calls):  # noqa: ANN001, ANN202
    return rules.dynamic_code(calls)


@_query("classify_package_api", "SELECT a.call_id, a.module, a.fn, t.behavior FROM v_api a JOIN (SELECT DISTINCT * FROM v_api_table) t ON a.module = t.module AND a.fn = t.fn", "v_api", "v_api_table")
def _(calls, table):  # noqa: ANN001, ANN202
    return rules.classify_api(calls, table).select("call_id", "module", "fn", "behavior")


@_query("build_candidates", "WITH k AS (SELECT subject, count(DISTINCT fn || arity) FILTER (shape = 'dynamic') AS sites FROM v_api GROUP BY 1) SELECT subject, sites, CASE WHEN sites = 0 THEN 'no_site' WHEN sites > 32 THEN 'too_many_sites' WHEN sites = 1 THEN 'unique' ELSE 'ambiguous' END AS state FROM k", "v_api")
def _(calls):  # noqa: ANN001, ANN202
    return contracts.build_candidates(calls, calls.where("shape = 'dynamic'").select("subject", F.concat("fn", "arity").alias("site")))


@_query("action_contract", r"SELECT action_id, concat_ws(',', CASE WHEN NOT regexp_matches(action, '\\.v1$') THEN 'version' END, CASE WHEN coalesce(trim(name), '') = '' THEN 'name' END, CASE WHEN action_id % 4 = 0 THEN 'accepts' END, CASE WHEN effect IS NULL OR effect <> 'none' THEN 'effect' END, CASE WHEN count(*) OVER (PARTITION BY tool, action) > 1 THEN 'duplicate' END) AS reasons FROM v_actions".replace("\\\\", "\\"), "v_actions")
def _(actions):  # noqa: ANN001, ANN202
    return contracts.action_contract(actions)


@_query(
    "fact_contract",
    "SELECT row_id, line, col, concat_ws(',', CASE WHEN trim(kind) = '' THEN 'kind' END, CASE WHEN relation IS NULL THEN 'relation' END, CASE WHEN trim(subject) = '' THEN 'subject' END, CASE WHEN object IS NULL THEN 'object' END, CASE WHEN NOT regexp_matches(source_hash, '^[0-9a-f]{64}$') THEN 'source' END, CASE WHEN NOT (file = 'a/b..c' AND line >= 1 AND coalesce(col >= 1, true) AND (end_line > line OR (end_line = line AND coalesce(end_col >= col, true)))) THEN 'span' END, CASE WHEN NOT has_attributes THEN 'attributes' END) AS reasons FROM v_raw_facts",
    "v_raw_facts",
)
def _(facts):  # noqa: ANN001, ANN202
    full = facts.withColumn("attributes", F.when(F.col("has_attributes"), F.create_map(F.lit("a"), F.lit("b"))))
    return contracts.fact_contract(full).select("row_id", "line", "col", "reasons")


NETWORKS = "SELECT DISTINCT h.ip, EXISTS (SELECT 1 FROM v_networks n WHERE split_part(n.base, '.', 2) = split_part(h.ip, '.', 2) AND (n.prefix = 16 OR split_part(h.ip, '.', 3) = '0')) AS allowed FROM v_hosts h"


@_query("authorize_networks", NETWORKS, "v_hosts", "v_networks")
def _(hosts, networks):  # noqa: ANN001, ANN202
    return contracts.authorize_networks(hosts, networks)


@_query("scope_split", f"WITH a AS ({NETWORKS}) SELECT h.c_custkey % 500 AS plan, count(*) AS targets, count(*) FILTER (NOT a.allowed) AS denied, count(*) FILTER (NOT a.allowed) = 0 AS granted FROM v_hosts h JOIN a ON h.ip = a.ip GROUP BY 1", "v_hosts", "v_networks")
def _(hosts, networks):  # noqa: ANN001, ANN202
    allowed = contracts.authorize_networks(hosts, networks).withColumnRenamed("ip", "target")
    return contracts.scope_split(hosts.select((F.col("c_custkey") % 500).alias("plan"), F.col("ip").alias("target")), allowed)


@_query("authorize_urls", "WITH u AS (SELECT DISTINCT url, regexp_extract(url, '^(https?)://([^/?#:]+)([^?#]*)', 1) AS scheme, regexp_extract(url, '^(https?)://([^/?#:]+)([^?#]*)', 2) AS host, regexp_extract(url, '^(https?)://([^/?#:]+)([^?#]*)', 3) AS path FROM v_http) SELECT url, NOT contains(url, '#') AND EXISTS (SELECT 1 FROM v_url_rules r WHERE r.scheme = u.scheme AND ends_with(u.host, '.' || r.host) AND (r.path = '/' OR u.path = r.path OR starts_with(u.path, r.path || '/'))) AS allowed FROM u", "v_http", "v_url_rules")
def _(h, url_rules):  # noqa: ANN001, ANN202
    return contracts.authorize_urls(h, url_rules)


@_query("control_matrix", "SELECT action AS case_id, coalesce(bool_and(verdict = 'confirmed') FILTER (id % 3 = 0), false) AS vulnerable, coalesce(bool_and(verdict = 'refuted') FILTER (id % 3 = 1), false) AS fixed, coalesce(bool_and(verdict = 'inconclusive') FILTER (id % 3 = 2), false) AS failure, count(*) FILTER (id % 3 <> 0 AND verdict = 'confirmed') AS false_confirmations FROM v_verdicts GROUP BY 1", "v_verdicts")
def _(v):  # noqa: ANN001, ANN202
    role = F.when(F.col("id") % 3 == 0, "vulnerable").when(F.col("id") % 3 == 1, "fixed").otherwise("failure")
    return contracts.control_matrix(v.select(F.col("action").alias("case_id"), role.alias("role"), "verdict"))


@_query("return_sources", "SELECT b.binding_id, coalesce(r.n, 0) AS n, CASE WHEN r.n = 1 THEN 'resolved' WHEN r.n > 1 THEN 'multiple_return_sites' ELSE 'external_or_dynamic_return' END AS state FROM v_bindings b LEFT JOIN (SELECT target, count(*) AS n FROM v_returns GROUP BY 1) r ON b.target = r.target", "v_bindings", "v_returns")
def _(bindings, returns):  # noqa: ANN001, ANN202
    return lineage.return_sources(bindings, returns)


@_query("parameter_callers", "SELECT b.binding_id AS parameter_id, coalesce(r.n, 0) AS n, CASE WHEN r.n = 1 THEN 'resolved' WHEN r.n > 1 THEN 'multiple_callers' ELSE 'no_known_caller' END AS state FROM v_bindings b LEFT JOIN (SELECT object, count(*) AS n FROM v_returns GROUP BY 1) r ON r.object = b.target || '#argument/' || b.position", "v_bindings", "v_returns")
def _(bindings, returns):  # noqa: ANN001, ANN202
    return lineage.parameter_callers(bindings.select(F.col("binding_id").alias("parameter_id"), F.col("target").alias("fn"), "position"), returns)


@_query("store_write_read", "WITH k AS (SELECT key, count(*) FILTER (kind = 'write') AS writes, count(*) FILTER (kind = 'read') AS reads, min(process) FILTER (kind = 'write') AS wp, min(process) FILTER (kind = 'read') AS rp, min(at) FILTER (kind = 'write') AS wa, min(at) FILTER (kind = 'read') AS ra, min(value) FILTER (kind = 'write') AS wv, min(value) FILTER (kind = 'read') AS rv FROM v_cells GROUP BY 1) SELECT key, writes, reads, coalesce(writes = 1 AND reads = 1 AND wp <> rp AND wa < ra AND wv = rv, false) AS joined FROM k", "v_cells")
def _(cells):  # noqa: ANN001, ANN202
    return lineage.store_write_read(cells)


@_query("promote_findings", f"WITH {PORTS} SELECT {_sid('web', 'source', 'id')} AS seed_id, locus AS value, source AS origin_source, id AS origin_id FROM pf", "v_hosts", "v_ports")
def _(hosts, ports):  # noqa: ANN001, ANN202
    return lineage.promote_findings(g.findings_from_hosts(_hosts(hosts, ports)), "web")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the roll-up of all findings."""
    return _FOUND["finding_rollup"][0](spark, sf_dir)


def queries() -> dict[str, Query]:
    from . import policy_queries, rule_queries, slice_queries, source_queries, stream_queries  # noqa: F401, PLC0415 they register theirs

    return {name: fn for name, (fn, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return {name: sql for name, (_, sql) in _FOUND.items() if sql}
