"""Queries of scalar rules, contracts, resolutions and reports, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import policy as p
from ..functions import scalars as s
from ..operators import facts as f
from ..operators import findings, graph, lineage, report
from ..operators import policy as o
from ..operators import windows as w
from .queries import PORTS, _hosts, _query, digest_sql
from .views import VIEWS

VIEWS |= {
    "v_code": "SELECT l_orderkey * 10 + l_linenumber AS fact_id, CASE l_linenumber % 5 WHEN 0 THEN 'definition' WHEN 1 THEN 'unqualified_call' WHEN 2 THEN 'dependency' ELSE 'call' END AS kind, CASE l_suppkey % 12 WHEN 0 THEN 'System' WHEN 1 THEN 'os' WHEN 2 THEN 'erlang' WHEN 3 THEN 'Code' WHEN 4 THEN 'crypto' WHEN 5 THEN 'ets' WHEN 6 THEN 'Enum' WHEN 7 THEN 'GenServer' WHEN 8 THEN 'File' WHEN 9 THEN 'Plug.Crypto' WHEN 10 THEN 'zip' ELSE 'Jason' END AS module, CASE l_partkey % 16 WHEN 0 THEN 'cmd' WHEN 1 THEN 'get_env' WHEN 2 THEN 'send' WHEN 3 THEN 'eval_string' WHEN 4 THEN 'uniform' WHEN 5 THEN 'binary_to_term' WHEN 6 THEN 'map' WHEN 7 THEN 'call' WHEN 8 THEN 'apply' WHEN 9 THEN 'secure_compare' WHEN 10 THEN 'hash_equals' WHEN 11 THEN 'extract' WHEN 12 THEN 'decode' WHEN 13 THEN 'authorized?' WHEN 14 THEN 'revoked?' ELSE 'open_port' END AS function, l_partkey % 3 + 1 AS arity, concat('App.', CASE l_partkey % 6 WHEN 0 THEN 'can_read' WHEN 1 THEN 'login_user' WHEN 2 THEN 'permit' ELSE 'render' END, '/2') AS object, CASE l_suppkey % 9 WHEN 0 THEN 'dynamic_dispatch' ELSE 'static' END AS resolution, CASE l_partkey % 4 WHEN 0 THEN 'git' WHEN 1 THEN 'hex' WHEN 2 THEN 'path' END AS source FROM {lineitem}",
    "v_plan": "SELECT o_custkey AS job_id, CASE o_orderkey % 5 WHEN 0 THEN 'FUZZ' WHEN 1 THEN 'W2' WHEN 2 THEN '2W' ELSE 'WORD' END AS keyword, o_orderpriority AS source, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'a=FUZZ&b=WORD&c=W2&d=2W' ELSE 'a=WORD' END AS body FROM {orders} WHERE o_orderpriority IS NOT NULL",
    "v_plan_seeds": "SELECT l_partkey AS job_id, concat('v', CASE l_suppkey % 6 WHEN 0 THEN chr(10) WHEN 1 THEN chr(13) ELSE 'x' END) AS value, CASE l_linenumber % 3 WHEN 0 THEN 'target' WHEN 1 THEN 'sqli' END AS class, l_suppkey % 4 = 0 AS target FROM {lineitem}",
    "v_messages": "SELECT doc_id, text, source FROM {documents}",
    "v_lookups": "SELECT event_id, concat(CASE event_id % 4 WHEN 0 THEN 'Bearer ' WHEN 1 THEN 'DIGEST ' WHEN 2 THEN 'Basic' ELSE 'Digest ' END, 'realm=', CASE event_id % 5 WHEN 0 THEN 'plain' WHEN 1 THEN concat(chr(34), 'a b', chr(34)) WHEN 2 THEN concat(chr(34), 'open') WHEN 3 THEN concat(chr(34), 'a b', chr(34), ', realm=x') ELSE concat(chr(34), 'a b', chr(34), ', nonce=7') END) AS header FROM {events}",
    "v_cache": "SELECT event_id, concat('a', CAST(event_id % 2 AS STRING)) AS first_value, CASE WHEN event_id % 7 = 0 THEN concat('a', CAST(event_id % 2 AS STRING)) ELSE concat('b', CAST(user_id % 3 AS STRING)) END AS direct_value, CASE event_id % 3 WHEN 0 THEN concat('a', CAST(event_id % 2 AS STRING)) WHEN 1 THEN concat('b', CAST(user_id % 3 AS STRING)) END AS served_value, CASE WHEN event_type = 'error' THEN 'miss' ELSE 'hit' END AS status, user_id % 2 AS first_key, CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id % 2 END AS second_key FROM {events}",
    "v_access": "SELECT o_custkey AS case_id, concat('path', CAST(o_orderkey % 2 AS STRING)) AS path, concat('field', CAST(o_orderkey % 3 AS STRING)) AS field, CASE WHEN o_orderkey % 29 = 0 THEN 'hidden' ELSE 'visible' END AS privileged, CASE WHEN o_orderkey % 31 = 0 THEN 'visible' WHEN o_orderkey % 37 = 0 THEN 'missing' ELSE 'hidden' END AS restricted FROM {orders}",
    "v_discovered": "SELECT CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE concat('10.0.', CAST(c_nationkey AS STRING), '.', CAST(c_custkey % 200 AS STRING)) END AS ip, c_custkey % 64 AS batch, CASE WHEN c_custkey % 3 = 0 THEN 'udp' ELSE 'tcp' END AS protocol, CASE WHEN c_nationkey < 20 THEN array(80, 443) ELSE array(22) END AS ports FROM {customer}",
    "v_enriched": "SELECT concat('10.0.', CAST(s_nationkey AS STRING), '.', CAST(s_suppkey % 200 AS STRING)) AS ip, CASE WHEN s_suppkey % 5 = 0 THEN 'down' ELSE 'up' END AS status FROM {supplier} UNION ALL SELECT CAST(NULL AS STRING), 'up' FROM {region} WHERE r_regionkey = 0",
    "v_failed": "SELECT n_nationkey AS batch, concat('engine ', n_name) AS error FROM {nation} WHERE n_regionkey = 1",
    "v_regions": "SELECT o_orderkey AS call_id, CAST(o_custkey % 90 AS STRING) AS subject, CASE o_orderstatus WHEN 'O' THEN array(o_orderpriority, 'loop') WHEN 'F' THEN array(o_orderpriority) ELSE array('loop', 'try') END AS contexts FROM {orders}",
    "v_handoffs": "SELECT o_orderkey AS reference, o_custkey AS child, MICROS(o_orderdate) AS received_at FROM {orders}",
    "v_exits": "SELECT user_id AS child, CASE event_type WHEN 'error' THEN 'killed' ELSE 'normal' END AS reason, MICROS(ts) - 700000000000000 + user_id * 900000000000 AS at FROM {events}",
    "v_rendered": "SELECT page_id AS job_id, concat('https://', split_part(split_part(url, '//', 2), '/', 1), '/q/KEY?x=1') AS template, 'KEY' AS keyword, concat('a b*', CAST(page_id % 4 AS STRING)) AS value FROM {pages}",
    "v_observed": "SELECT page_id AS finding_id, concat('HTTPS://', split_part(split_part(url, '//', 2), '/', 1), '/q/a', CASE page_id % 4 WHEN 0 THEN ' b*' WHEN 1 THEN '%20b%2A' WHEN 2 THEN '+b*' ELSE '%20b*' END, CAST(page_id % 5 AS STRING), '?x=1') AS url FROM {pages}",
    "v_candidates": "SELECT p_partkey AS candidate_id, p_brand AS source, p_type AS sink, CASE p_size % 4 WHEN 0 THEN 'unique_call' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'instrumented' ELSE 'unique_name' END AS localization, CASE p_partkey % 5 WHEN 0 THEN array('s1', 's2') WHEN 1 THEN NULL ELSE array('s1') END AS sink_sites FROM {part}",
    "v_hypotheses": "SELECT l_orderkey * 10 + l_linenumber AS hypothesis_id, l_partkey * 2 AS candidate_id FROM {lineitem}",
    "v_declared": "SELECT p_brand AS source, p_type AS sink FROM {part} WHERE p_size < 9",
    "v_case_seeds": "SELECT s_suppkey AS seed_id, concat('Brand#', CAST(s_suppkey % 25 AS STRING)) AS source, CASE WHEN s_suppkey % 6 = 0 THEN '' WHEN s_suppkey % 6 = 1 THEN NULL ELSE s_name END AS value FROM {supplier}",
    "v_expected": "SELECT s_suppkey AS expectation_id, concat('part/', CAST(s_suppkey AS STRING)) AS subject, 'call' AS kind, CASE WHEN s_suppkey % 2 = 0 THEN 'urg' ELSE 'low' END AS preview, CASE WHEN s_suppkey % 3 = 0 THEN array('b', 'a') ELSE array('a') END AS variables FROM {supplier}",
    "v_stated": "SELECT concat('part/', CAST(o_orderkey % 400 AS STRING)) AS subject, CASE WHEN o_orderkey % 41 = 0 THEN 'call' ELSE 'binding' END AS kind, lower(o_orderpriority) AS text, CASE WHEN o_custkey % 2 = 0 THEN array('a', 'b') ELSE array('a') END AS variables FROM {orders}",
    "v_submissions": "SELECT o_orderkey AS submission_id, o_custkey % 40 AS case_id, o_orderstatus AS class, concat('lib/', o_orderpriority, ':', CAST(o_orderkey % 4 AS STRING)) AS locus FROM {orders}",
    "v_keys": "SELECT n_nationkey AS case_id, CASE WHEN n_nationkey % 2 = 0 THEN array('O', 'F') ELSE array('P') END AS classes, CASE WHEN n_nationkey % 3 = 0 THEN array('lib/', ':1') ELSE array('lib/') END AS fragments FROM {nation}",
    "v_outcomes": "SELECT l_orderkey AS submission_id, l_linenumber AS variant, CASE l_returnflag WHEN 'A' THEN 'refuted' ELSE 'confirmed' END AS expected, CASE l_linestatus WHEN 'F' THEN 'refuted' ELSE 'confirmed' END AS verdict, l_partkey % 13 <> 0 AS replay_equal FROM {lineitem}",
    "v_results": "SELECT event_id AS input, concat('p', CAST(user_id % 20 AS STRING)) AS property, event_type AS oracle, CASE event_type WHEN 'error' THEN 'crash' WHEN 'purchase' THEN 'violation' ELSE 'pass' END AS result, CASE user_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS no_crash FROM {events}",
    "v_scenarios": "SELECT o_custkey AS matrix, o_orderkey % 9 + 1 AS events, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 9 ELSE o_orderkey % 9 + 1 END AS joined, CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS false_joins, o_orderkey % 5 <> 0 OR o_custkey % 7 = 0 AS supported FROM {orders}",
    "v_provenance": "SELECT p_partkey AS case_id, CASE WHEN p_partkey % 5 = 0 THEN 'main' ELSE repeat(CAST(p_size % 10 AS STRING), 40) END AS vulnerable_revision, repeat(CAST(p_partkey % 10 AS STRING), 40) AS fixed_revision, CASE WHEN p_partkey % 6 = 0 THEN ' ' ELSE p_name END AS advisory, p_brand AS project, p_type AS path, CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE 'MIT' END AS license, p_size % 7 AS vulnerable_hash, p_partkey % 7 AS fixed_hash FROM {part}",
    "v_reports": "SELECT o_custkey AS report_id, count(DISTINCT o_orderstatus) + CASE WHEN o_custkey % 9 = 0 THEN 1 ELSE 0 END AS cases, count(DISTINCT o_orderstatus) AS passed FROM {orders} GROUP BY o_custkey",
    "v_checks": "SELECT o_custkey AS report_id, o_orderstatus AS case_id, o_orderpriority AS name, o_orderkey % 53 <> 0 AS passed FROM {orders}",
    "v_directives": "SELECT concat('f', CAST(l_suppkey AS STRING)) AS file, CASE l_returnflag WHEN 'A' THEN 'module' WHEN 'N' THEN 'import' ELSE 'use' END AS kind, concat('M', CAST(l_partkey % 30 AS STRING)) AS target FROM {lineitem}",
    "v_trials": "SELECT event_type AS mode, value > 90 AS found, user_id % 12 AS coverage, event_id % 31 AS depth FROM {events}",
    "v_paths": "SELECT concat(CASE doc_id % 4 WHEN 0 THEN 'lib/' WHEN 1 THEN 'lib/a/b/' WHEN 2 THEN 'test/' ELSE 'lib/.git/' END, CASE doc_id % 3 WHEN 0 THEN 'm' WHEN 1 THEN '.m' ELSE 'gen_' END, CAST(doc_id % 50 AS STRING), CASE doc_id % 5 WHEN 0 THEN '.exs' ELSE '.ex' END) AS path FROM {documents}",
    "v_diagnostics": "SELECT CASE event_type WHEN 'error' THEN 'error' ELSE 'warning' END AS level, event_id AS diagnostic_id FROM {events}",
    "v_callbacks": "SELECT CASE n_regionkey WHEN 0 THEN 'implements' WHEN 1 THEN 'callback' ELSE 'definition' END AS kind, CASE n_regionkey WHEN 0 THEN concat('M', CAST(n_nationkey AS STRING)) WHEN 1 THEN concat('I', CAST(n_nationkey % 3 AS STRING)) ELSE concat('d', n_name) END AS subject, CASE n_regionkey WHEN 0 THEN concat('I', CAST(n_nationkey % 3 AS STRING)) WHEN 1 THEN 'x' ELSE concat('M', CAST(n_nationkey % 8 * 2 AS STRING), '.f', CAST(n_nationkey % 2 AS STRING), '/1') END AS object, concat('f', CAST(n_nationkey % 2 AS STRING), '/1') AS signature FROM {nation} UNION ALL SELECT 'definition', concat('d', CAST(s_suppkey AS STRING)), concat('M', CAST(s_suppkey % 25 AS STRING), '.f', CAST(s_suppkey % 2 AS STRING), '/1'), NULL FROM {supplier}",
    "v_ips": "SELECT event_id, CASE event_id % 8 WHEN 0 THEN concat('10.0.0.', CAST(event_id % 300 AS STRING)) WHEN 1 THEN concat('Host-', CAST(user_id AS STRING), '.Example.com.') WHEN 2 THEN '01.2.3.4' WHEN 3 THEN concat('a_', CAST(user_id AS STRING)) WHEN 4 THEN '-bad-.org' WHEN 5 THEN 'a..b' WHEN 6 THEN '1.2.3' ELSE 'ok.org' END AS text FROM {events}",
}


def _sid(source: str, *values: str) -> str:
    from .queries import _sid as sid

    return sid(source, *values)


#: The rule as SQL: fixed values, written out here and not taken from the operator.
BEHAVIORS = """SELECT fact_id, 'dynamic_dispatch' AS behavior, 'dynamic_receiver' AS basis FROM v_code WHERE kind = 'call' AND resolution = 'dynamic_dispatch'
UNION ALL SELECT fact_id, 'process_message_send' AS behavior, 'known_api' AS basis FROM v_code WHERE kind = 'call' AND module IN ('Kernel', 'Process', 'erlang') AND function IN ('send')
UNION ALL SELECT fact_id, 'process_message_send' AS behavior, 'known_api' AS basis FROM v_code WHERE kind = 'call' AND module IN ('GenServer', 'gen_server') AND function IN ('cast')
UNION ALL SELECT fact_id, 'otp_request' AS behavior, 'known_api' AS basis FROM v_code WHERE kind = 'call' AND module IN ('GenServer', 'gen_server') AND function IN ('call')
UNION ALL SELECT fact_id, 'otp_request' AS behavior, 'known_api' AS basis FROM v_code WHERE kind = 'call' AND module IN ('Supervisor', 'DynamicSupervisor') AND function IN ('start_child')
UNION ALL SELECT fact_id, 'shared_state_access' AS behavior, 'module_family' AS basis FROM v_code WHERE kind = 'call' AND module IN ('ets', 'dets', 'mnesia', 'persistent_term')
UNION ALL SELECT fact_id, 'process_state_access' AS behavior, 'known_api' AS basis FROM v_code WHERE kind = 'call' AND module IN ('Process', 'erlang') AND function IN ('get', 'put', 'delete', 'get_keys')
UNION ALL SELECT fact_id, 'filesystem_access' AS behavior, 'module_family' AS basis FROM v_code WHERE kind = 'call' AND module IN ('File', 'Path', 'file', 'filelib', 'zip', 'erl_tar')
UNION ALL SELECT fact_id, 'network_access' AS behavior, 'module_family' AS basis FROM v_code WHERE kind = 'call' AND module IN ('gen_tcp', 'gen_udp', 'ssl', 'httpc', 'Req', 'Finch', 'Mint.HTTP', 'HTTPoison', 'Tesla', 'Bandit', 'Plug.Conn')
UNION ALL SELECT fact_id, 'external_process' AS behavior, 'known_api' AS basis FROM v_code WHERE kind = 'call' AND module IN ('System', 'os', 'Port') AND function IN ('cmd', 'shell', 'open', 'spawn', 'spawn_executable')
UNION ALL SELECT fact_id, 'native_code_boundary' AS behavior, 'known_api' AS basis FROM v_code WHERE kind = 'call' AND module IN ('erlang', 'Rustler') AND function IN ('load_nif')
UNION ALL SELECT fact_id, 'native_code_boundary' AS behavior, 'known_api' AS basis FROM v_code WHERE kind = 'call' AND module IN ('Code') AND function IN ('prepend_path')
UNION ALL SELECT fact_id, 'native_code_boundary' AS behavior, 'known_api' AS basis FROM v_code WHERE kind = 'call' AND module IN ('code') AND function IN ('load_binary')
UNION ALL SELECT fact_id, 'dynamic_code' AS behavior, 'known_api' AS basis FROM v_code WHERE kind = 'call' AND module IN ('Code', 'EEx', 'erl_eval') AND function IN ('eval_file', 'eval_quoted', 'eval_string', 'expr', 'exprs')
UNION ALL SELECT fact_id, 'configuration_read' AS behavior, 'known_api' AS basis FROM v_code WHERE kind = 'call' AND module IN ('Application', 'application') AND function IN ('get_env', 'fetch_env', 'fetch_env!', 'get_all_env')
UNION ALL SELECT fact_id, 'environment_read' AS behavior, 'known_api' AS basis FROM v_code WHERE kind = 'call' AND module IN ('System', 'os') AND function IN ('get_env', 'getenv')
UNION ALL SELECT fact_id, 'deserialization' AS behavior, 'known_api' AS basis FROM v_code WHERE kind = 'call' AND module IN ('erlang') AND function IN ('binary_to_term')
UNION ALL SELECT fact_id, 'deserialization' AS behavior, 'known_api' AS basis FROM v_code WHERE kind = 'call' AND module IN ('Jason') AND function IN ('decode', 'decode!')
UNION ALL SELECT fact_id, 'deserialization' AS behavior, 'known_api' AS basis FROM v_code WHERE kind = 'call' AND module IN ('jiffy', 'jsx') AND function IN ('decode')
UNION ALL SELECT fact_id, 'deserialization' AS behavior, 'known_api' AS basis FROM v_code WHERE kind = 'call' AND module IN ('yaml_elixir', 'YamlElixir') AND function IN ('read_from_string')
UNION ALL SELECT fact_id, 'cryptography' AS behavior, 'module_family' AS basis FROM v_code WHERE kind = 'call' AND module IN ('crypto', 'public_key', 'Plug.Crypto', 'Pbkdf2', 'Argon2', 'Bcrypt')
UNION ALL SELECT fact_id, 'randomness' AS behavior, 'known_api' AS basis FROM v_code WHERE kind = 'call' AND module IN ('rand', 'crypto') AND function IN ('uniform', 'bytes', 'strong_rand_bytes', 'rand_seed')
UNION ALL SELECT fact_id, 'resource_amplification' AS behavior, 'known_api' AS basis FROM v_code WHERE kind = 'call' AND module IN ('Enum') AND function IN ('to_list', 'map', 'flat_map')
UNION ALL SELECT fact_id, 'resource_amplification' AS behavior, 'known_api' AS basis FROM v_code WHERE kind = 'call' AND module IN ('String', 'List') AND function IN ('duplicate')
UNION ALL SELECT fact_id, 'resource_amplification' AS behavior, 'known_api' AS basis FROM v_code WHERE kind = 'call' AND module IN ('binary') AND function IN ('copy')
UNION ALL SELECT fact_id, 'resource_amplification' AS behavior, 'known_api' AS basis FROM v_code WHERE kind = 'call' AND module IN ('zlib') AND function IN ('uncompress')
UNION ALL SELECT fact_id, 'resource_amplification' AS behavior, 'known_api' AS basis FROM v_code WHERE kind = 'call' AND module IN ('zip', 'erl_tar') AND function IN ('extract')
UNION ALL SELECT fact_id, 'process_message_send' AS behavior, 'unqualified_name' AS basis FROM v_code WHERE kind = 'unqualified_call' AND function IN ('send')
UNION ALL SELECT fact_id, 'external_process' AS behavior, 'unqualified_name' AS basis FROM v_code WHERE kind = 'unqualified_call' AND function IN ('open_port')
UNION ALL SELECT fact_id, 'dynamic_dispatch' AS behavior, 'unqualified_name' AS basis FROM v_code WHERE kind = 'unqualified_call' AND function IN ('apply', 'spawn', 'spawn_link', 'spawn_monitor')
UNION ALL SELECT fact_id, 'authorization_boundary' AS behavior, 'function_name' AS basis FROM v_code WHERE kind = 'definition' AND regexp_matches(split_part(split_part(object, '.', -1), '/', 1), 'authoriz|permit|allowed|can_')
UNION ALL SELECT fact_id, 'authentication_boundary' AS behavior, 'function_name' AS basis FROM v_code WHERE kind = 'definition' AND regexp_matches(split_part(split_part(object, '.', -1), '/', 1), 'authenticat|login|sign_in|verify_credential')
UNION ALL SELECT fact_id, 'non_registry_dependency' AS behavior, 'dependency_source' AS basis FROM v_code WHERE kind = 'dependency' AND source IN ('git', 'github', 'path')"""


@_query("classify_behaviors", BEHAVIORS, "v_code")
def _(code):  # noqa: ANN001, ANN202
    return o.classify_behaviors(code)


@_query("package_usage", "SELECT * FROM v_facts WHERE kind = 'package_use' AND object = 'supp/1'", "v_facts")
def _(facts):  # noqa: ANN001, ANN202
    return o.package_usage(facts, "supp/1")


@_query(
    "mutation_candidates",
    f"SELECT fact_id AS call_id, 'SecurityDecision' AS mutator, 'force ' || function || ' to allow' AS change FROM v_code WHERE function IN ('authenticated?', 'authorized?', 'allowed?', 'permitted?', 'has_permission?', 'can_access?', 'trusted?', 'verified?', 'valid_signature?', 'csrf_valid?') UNION ALL SELECT fact_id, 'SecurityDecision', 'force ' || function || ' to return false' FROM v_code WHERE function IN ('blocked?', 'denied?', 'forbidden?', 'revoked?', 'expired?', 'rate_limited?', 'throttled?') UNION ALL SELECT fact_id, 'SecureCompare', 'downgrade ' || module || '.' || function || '/2' FROM v_code WHERE arity = 2 AND (module, function) IN (('Plug.Crypto', 'secure_compare'), ('crypto', 'hash_equals'))",
    "v_code",
)
def _(code):  # noqa: ANN001, ANN202
    return o.mutation_candidates(code.withColumnRenamed("fact_id", "call_id"))


@_query(
    "response_filter",
    "SELECT match_id FROM v_http WHERE (status BETWEEN 200 AND 299 OR status = 500 OR words BETWEEN 5 AND 9 OR coalesce(regexp_matches(body, 'KeyError'), false)) AND NOT (lines = 7 AND millis > 400)",
    "v_http",
)
def _(h):  # noqa: ANN001, ANN202
    return h.where(p.response_filter({"codes": [(200, 299), 500], "words": (5, 9) and [(5, 9)], "regex": "KeyError"}, {"lines": 7, "time": ("gt", 400)}, "or", "and")).select("match_id")


@_query(
    "plan_contract",
    """WITH k AS (SELECT job_id, keyword, count(DISTINCT source) > 1 AS a, NOT regexp_matches(keyword, '^[A-Za-z][A-Za-z0-9_]*$') AS b, bool_or(coalesce(NOT contains(body, keyword), false)) AS c FROM v_plan GROUP BY 1, 2),
j AS (SELECT job_id, bool_or(a) AS a, bool_or(b) AS b, bool_or(c) AS c FROM k GROUP BY 1),
s AS (SELECT job_id, bool_or(contains(value, chr(10)) OR contains(value, chr(13))) AS d, bool_or(target AND coalesce(class, '') <> 'target') AS e FROM v_plan_seeds GROUP BY 1)
SELECT coalesce(j.job_id, s.job_id) AS job_id, concat_ws(',', CASE WHEN a THEN 'several sources of a keyword' END, CASE WHEN b THEN 'invalid keyword' END, CASE WHEN c THEN 'body without its keyword' END, CASE WHEN d THEN 'line break in a seed' END, CASE WHEN e THEN 'target seed of another class' END) AS reasons FROM j FULL JOIN s ON j.job_id = s.job_id""",
    "v_plan",
    "v_plan_seeds",
)
def _(plan, seeds):  # noqa: ANN001, ANN202
    return o.plan_contract(plan, seeds)


@_query(
    "plan_syntax",
    f"""SELECT fact_id, regexp_matches(function, '^[A-Za-z][A-Za-z0-9_]*$') AS keyword_ok, regexp_matches(upper(function), '^[A-Z][A-Z0-9!#$%&''*+.^_`|~-]*$') AS method_ok, regexp_matches(object, '^[!#$%&''*+.^_`|~0-9A-Za-z-]+$') AS header_ok, regexp_matches(CAST(arity AS VARCHAR) || CASE arity WHEN 2 THEN '-3.5' WHEN 3 THEN '.' ELSE '' END, '{p.DELAY}') AS delay_ok FROM v_code""",
    "v_code",
)
def _(code):  # noqa: ANN001, ANN202
    delay = F.concat(F.col("arity").cast("string"), F.when(F.col("arity") == 2, "-3.5").when(F.col("arity") == 3, ".").otherwise(""))
    return code.select("fact_id", p.valid_keyword(F.col("function")).alias("keyword_ok"), p.valid_method(F.col("function")).alias("method_ok"), p.valid_header(F.col("object")).alias("header_ok"), p.valid_delay(delay).alias("delay_ok"))


@_query(
    "span_ok",
    "SELECT row_id, line, col, coalesce(file <> '' AND NOT starts_with(file, '/') AND NOT list_contains(string_split(file, '/'), '..') AND line > 0 AND coalesce(col > 0, true) AND line + 1 - row_id % 3 >= line AND (line + 1 - row_id % 3 > line OR coalesce(3 >= col, true)), false) AS ok FROM v_raw_facts",
    "v_raw_facts",
)
def _(facts):  # noqa: ANN001, ANN202
    end = F.col("line") + 1 - F.col("row_id") % 3
    return facts.select("row_id", "line", "col", p.span_ok(F.col("file"), F.col("line"), end, F.col("col"), F.lit(3)).alias("ok"))


@_query("candidate_contract", "SELECT candidate_id, CASE WHEN coalesce(len(sink_sites), 0) NOT BETWEEN 1 AND 32 THEN 'sink sites out of bounds' WHEN starts_with(localization, 'unique') AND len(sink_sites) <> 1 THEN 'unique with several sites' WHEN localization = 'ambiguous' AND len(sink_sites) < 2 THEN 'ambiguous with one site' END AS reason FROM v_candidates", "v_candidates")
def _(c):  # noqa: ANN001, ANN202
    return o.candidate_contract(c).select("candidate_id", "reason")


@_query("localized_sink_span", "SELECT candidate_id, CASE WHEN starts_with(localization, 'unique') OR localization = 'instrumented' THEN sink_sites[1] END AS sink_span FROM v_candidates", "v_candidates")
def _(c):  # noqa: ANN001, ANN202
    return o.localized_sink_span(c).select("candidate_id", "sink_span")


_AUTH = r"""a AS (SELECT event_id, regexp_matches(header, '^\s*[A-Za-z]+\s+[a-z]+=([a-z0-9]+|"[^"]*")(\s*,\s*[a-z]+=([a-z0-9]+|"[^"]*"))*\s*$') AS whole, lower(split_part(header, ' ', 1)) AS scheme, regexp_extract_all(header, 'realm=([a-z0-9]+|"[^"]*")', 1) AS realms FROM v_lookups)"""


@_query("oracle_quoted_parameter", f"WITH {_AUTH} SELECT event_id, CASE WHEN whole AND scheme = 'digest' AND len(realms) = 1 AND realms[1] = '\"a b\"' THEN 'pass' ELSE 'violation' END AS result FROM a", "v_lookups")
def _(h):  # noqa: ANN001, ANN202
    return h.select("event_id", p.quoted_parameter(F.col("header"), "Digest", "realm", F.lit("a b")).alias("result"))


@_query("auth_params", f"WITH {_AUTH} SELECT event_id, CASE WHEN whole THEN 'parsed' ELSE 'malformed' END AS status, CASE WHEN whole THEN scheme END AS scheme, CASE WHEN whole THEN len(regexp_extract_all(header, '[a-z]+=')) END AS n FROM a JOIN v_lookups USING (event_id)", "v_lookups")
def _(h):  # noqa: ANN001, ANN202
    a = p.auth_params(F.col("header"))
    return h.select("event_id", a["status"].alias("status"), a["scheme"].alias("scheme"), F.when(a["params"].isNotNull(), F.size(a["params"])).cast("long").alias("n"))


@_query("oracle_cache_partition", "SELECT event_id, CASE WHEN first_value IS NOT DISTINCT FROM direct_value THEN 'skip' WHEN served_value IS NOT DISTINCT FROM direct_value THEN 'pass' WHEN status = 'hit' AND first_key IS NOT DISTINCT FROM second_key AND served_value IS NOT DISTINCT FROM first_value THEN 'violation' ELSE 'skip' END AS result FROM v_cache", "v_cache")
def _(c):  # noqa: ANN001, ANN202
    return c.select("event_id", p.cache_partition(*map(F.col, ("first_value", "direct_value", "served_value", "status", "first_key", "second_key"))).alias("result"))


@_query(
    "oracle_field_policy",
    "WITH s AS (SELECT case_id, path, field, max(privileged) AS privileged, max(restricted) AS restricted FROM v_access GROUP BY 1, 2, 3), m AS (SELECT a.case_id, a.path, b.field FROM (SELECT DISTINCT case_id, path FROM v_access) a JOIN (SELECT DISTINCT case_id, field FROM v_access) b USING (case_id)), c AS (SELECT m.case_id, coalesce(privileged, 'missing') = 'visible' AND coalesce(restricted, 'missing') <> 'missing' AS ok, coalesce(restricted = 'visible', false) AS leak FROM m LEFT JOIN s USING (case_id, path, field)) SELECT case_id, count(*) FILTER (leak) AS leaks, CASE WHEN NOT bool_and(ok) THEN 'skip' WHEN bool_or(leak) THEN 'violation' ELSE 'pass' END AS result FROM c GROUP BY 1",
    "v_access",
)
def _(a):  # noqa: ANN001, ANN202
    return o.field_policy(a, a.select("case_id", "path"), a.select("case_id", "field"))


@_query("oracle_predicate_results", "SELECT event_id, CASE WHEN served_value IS NULL THEN 'skip' WHEN served_value = direct_value THEN 'pass' ELSE 'violation' END AS differential, CASE WHEN second_key IS NULL THEN 'skip' WHEN second_key = 0 OR status = 'miss' THEN 'pass' ELSE 'violation' END AS authz, CASE WHEN length(first_value) = 2 THEN 'pass' ELSE 'violation' END AS custom FROM v_cache", "v_cache")
def _(c):  # noqa: ANN001, ANN202
    return c.select("event_id", p.judged(F.col("served_value") == F.col("direct_value")).alias("differential"), p.judged(F.when(F.col("second_key").isNotNull(), (F.col("second_key") == 0) | (F.col("status") == "miss"))).alias("authz"), p.judged(F.length("first_value") == 2).alias("custom"))


@_query("align_enrichment", "WITH h AS (SELECT ip, max(status) AS found FROM v_enriched GROUP BY 1), e AS (SELECT batch, min(error) AS error FROM v_failed GROUP BY 1) SELECT d.ip, d.batch, CASE WHEN error IS NOT NULL THEN 'error' ELSE coalesce(found, 'down') END AS status, CASE WHEN error IS NOT NULL THEN error WHEN found IS NULL THEN 'not_reported' END AS reason FROM v_discovered d LEFT JOIN e ON d.batch = e.batch LEFT JOIN h ON d.ip IS NOT DISTINCT FROM h.ip", "v_discovered", "v_enriched", "v_failed")
def _(d, h, e):  # noqa: ANN001, ANN202
    return o.align_enrichment(d.select("ip", "batch"), h, e)


@_query("host_batches", "SELECT ip, protocol, ports[1] AS port, (row_number() OVER (PARTITION BY protocol, ports ORDER BY ip) - 1) // 16 AS batch FROM (SELECT DISTINCT ip, protocol, ports FROM v_discovered WHERE ip IS NOT NULL)", "v_discovered")
def batches(d):  # noqa: ANN001, ANN202
    some = d.where("ip IS NOT NULL").select("ip", "protocol", "ports").distinct()
    return w.host_batches(some, 16).select("ip", "protocol", F.get("ports", F.lit(0)).alias("port"), "batch")


@_query("plan_batch_stats", "SELECT protocol, port, batch, count(*) AS hosts, sum(n) AS n_ports FROM (SELECT protocol, ports[1] AS port, len(ports) AS n, (row_number() OVER (PARTITION BY protocol, ports ORDER BY ip) - 1) // 16 AS batch FROM (SELECT DISTINCT ip, protocol, ports FROM v_discovered WHERE ip IS NOT NULL)) GROUP BY 1, 2, 3", "v_discovered")
def _(d):  # noqa: ANN001, ANN202
    some = d.where("ip IS NOT NULL").select("ip", "protocol", "ports").distinct()
    return w.plan_batch_stats(w.host_batches(some, 16)).select("protocol", F.get("ports", F.lit(0)).alias("port"), "batch", "hosts", "n_ports")


@_query("shared_control", "WITH e AS (SELECT call_id, subject, unnest(contexts) AS c FROM v_regions), p AS (SELECT DISTINCT a.call_id, b.call_id AS other FROM e a JOIN e b ON a.subject = b.subject AND a.c = b.c) SELECT call_id, count(*) - 1 AS n FROM p GROUP BY 1", "v_regions")
def _(r):  # noqa: ANN001, ANN202
    return o.shared_control(r)


@_query("task_failures", "SELECT h.reference, h.child, min(e.at) AS failed_at FROM v_handoffs h JOIN v_exits e ON h.child = e.child AND e.reason = 'killed' AND e.at >= h.received_at GROUP BY 1, 2", "v_handoffs", "v_exits")
def _(h, e):  # noqa: ANN001, ANN202
    return o.task_failures(h, e, "killed")


_URL = "CASE WHEN regexp_matches(u, '^(?i)https?://[^/?#:@ ]+/') THEN lower(regexp_extract(u, '^([A-Za-z]+://[^/]+)', 1)) || regexp_replace(u, '^[A-Za-z]+://[^/]+', '') ELSE u END"


@_query(
    "job_origin",
    f"WITH r AS (SELECT job_id, unnest([replace(template, keyword, value), replace(template, keyword, replace(replace(value, ' ', '%20'), '*', '%2A')), replace(template, keyword, replace(value, ' ', '+'))]) AS u FROM v_rendered), j AS (SELECT DISTINCT job_id, {_URL} AS u FROM r), f AS (SELECT finding_id, url AS u FROM v_observed) SELECT DISTINCT f.finding_id, j.job_id FROM (SELECT finding_id, {_URL} AS u FROM f) f JOIN j ON f.u = j.u",
    "v_observed",
    "v_rendered",
)
def _(observed, rendered):  # noqa: ANN001, ANN202
    return o.job_origin(observed, rendered)


@_query("resolve_candidates", "SELECT h.hypothesis_id, h.candidate_id, CASE WHEN c.source IS NULL THEN 'candidate_missing' WHEN c.source NOT IN (SELECT source FROM v_declared) THEN 'source_mismatch' WHEN c.sink NOT IN (SELECT sink FROM v_declared) THEN 'sink_mismatch' ELSE 'resolved' END AS state FROM v_hypotheses h LEFT JOIN v_candidates c ON h.candidate_id = c.candidate_id", "v_hypotheses", "v_candidates", "v_declared")
def _(h, c, d):  # noqa: ANN001, ANN202
    return o.resolve_candidates(h, c, d.select("source"), d.select("sink"))


@_query("build_hypotheses", f"SELECT {_sid('hypothesis', 'c.candidate_id', 's.seed_id')} AS id, c.candidate_id, s.seed_id, 'value from ' || c.source || ' reaches ' || c.sink AS claim FROM v_candidates c JOIN v_case_seeds s ON c.source = s.source WHERE strlen(s.value) > 0", "v_candidates", "v_case_seeds")
def _(c, seeds):  # noqa: ANN001, ANN202
    return o.build_hypotheses(c, seeds)


@_query(
    "expected_facts",
    "WITH j AS (SELECT e.expectation_id, count(f.text) AS n, bool_and(coalesce(contains(f.text, e.preview), false)) AS a, bool_and(coalesce(list_sort(e.variables) = list_sort(f.variables), false)) AS b FROM v_expected e LEFT JOIN v_stated f ON e.subject = f.subject AND e.kind = f.kind GROUP BY 1) SELECT expectation_id, CASE WHEN n = 0 THEN 'missing' WHEN n > 1 THEN 'ambiguous' WHEN NOT a THEN 'preview_differs' WHEN NOT b THEN 'variables_differ' ELSE 'matched' END AS state FROM j",
    "v_expected",
    "v_stated",
)
def _(e, facts):  # noqa: ANN001, ANN202
    return o.expected_facts(e, facts)


@_query(
    "score_submissions",
    "WITH r AS (SELECT submission_id, bool_and(verdict = expected) AS v, bool_and(replay_equal) AS r FROM v_outcomes GROUP BY 1), x AS (SELECT s.submission_id, coalesce(list_contains(k.classes, s.class), false) AS class_ok, coalesce(len(list_filter(k.fragments, lambda z: NOT contains(s.locus, z))) = 0, false) AS locus_ok, coalesce(v, false) AS verdicts_ok, coalesce(r, false) AS replay_ok FROM v_submissions s LEFT JOIN v_keys k ON s.case_id = k.case_id LEFT JOIN r ON s.submission_id = r.submission_id) SELECT *, class_ok AND locus_ok AND verdicts_ok AND replay_ok AS accepted FROM x",
    "v_submissions",
    "v_keys",
    "v_outcomes",
)
def _(submissions, keys, outcomes):  # noqa: ANN001, ANN202
    return o.score_submissions(submissions, keys, outcomes)


@_query(
    "inventory_id",
    digest_sql("SELECT 1 AS key, 'f:' || fact_id AS line FROM v_code UNION ALL SELECT 1, 'o:' || module || '=' || package FROM v_modules") + " SELECT digest AS inventory_id, (SELECT count(*) FROM v_code) AS facts FROM roots",
    "v_code",
    "v_modules",
)
def _(code, modules):  # noqa: ANN001, ANN202
    return o.inventory_id(code.select(F.col("fact_id").cast("string").alias("id")), modules)


@_query(
    "scan_metrics",
    "SELECT (SELECT count(*) FROM v_sources) AS sources, (SELECT CAST(sum(bytes) AS BIGINT) FROM v_sources) AS bytes, (SELECT count(*) FROM v_code) AS facts, (SELECT count(DISTINCT rule_id) FROM v_matches) AS rules, (SELECT count(*) FROM v_matches) AS observations, (SELECT count(*) FROM v_matches WHERE message % 40 = 0) AS suppressed, (SELECT count(*) FROM v_diagnostics) AS diagnostics, CASE WHEN (SELECT bool_or(level = 'error') FROM v_diagnostics) THEN 'incomplete' ELSE 'complete' END AS status",
    "v_sources",
    "v_code",
    "v_matches",
    "v_diagnostics",
)
def _(sources, code, matches, diagnostics):  # noqa: ANN001, ANN202
    return o.scan_metrics(sources, code, matches.withColumn("suppressed", F.col("message") % 40 == 0), diagnostics)


@_query(
    "violation_findings",
    f"WITH r AS (SELECT DISTINCT property, CASE WHEN result = 'crash' THEN 'no_crash' ELSE oracle END AS oracle, input FROM v_results WHERE result = 'violation' OR (result = 'crash' AND coalesce(no_crash, false))) SELECT {_sid('property', 'property', 'oracle', 'input')} AS id, {_sid('counterexample', 'property', 'input')} AS seed_id, property, oracle, input FROM r",
    "v_results",
)
def _(results):  # noqa: ANN001, ANN202
    return o.violation_findings(results)


@_query("boundary_matrix", "SELECT matrix, CAST(sum(events) AS BIGINT) AS events, CAST(sum(joined) AS BIGINT) AS joined, CAST(sum(false_joins) AS BIGINT) AS false_joins, CASE WHEN NOT bool_and(CASE WHEN supported THEN joined = events AND false_joins = 0 ELSE joined < events END) THEN 'failed' WHEN bool_and(supported) THEN 'complete' ELSE 'partial' END AS status FROM v_scenarios GROUP BY 1", "v_scenarios")
def _(scenarios):  # noqa: ANN001, ANN202
    return o.boundary_matrix(scenarios)


@_query(
    "case_provenance_contract",
    "SELECT case_id, concat_ws(',', CASE WHEN NOT (regexp_matches(vulnerable_revision, '^[0-9a-f]{40}$') AND regexp_matches(fixed_revision, '^[0-9a-f]{40}$')) THEN 'revision' END, CASE WHEN vulnerable_revision = fixed_revision THEN 'equal revisions' END, CASE WHEN vulnerable_hash = fixed_hash THEN 'equal sources' END, CASE WHEN trim(coalesce(advisory, '')) = '' THEN 'no advisory' END, CASE WHEN trim(coalesce(project, '')) = '' THEN 'no project' END, CASE WHEN trim(coalesce(path, '')) = '' THEN 'no path' END, CASE WHEN trim(coalesce(license, '')) = '' THEN 'no license' END) AS reasons FROM v_provenance",
    "v_provenance",
)
def _(cases):  # noqa: ANN001, ANN202
    return o.case_provenance_contract(cases)


@_query(
    "report_contract",
    "WITH n AS (SELECT report_id, case_id, name, count(*) AS n, bool_and(passed) AS ok FROM v_checks GROUP BY 1, 2, 3), c AS (SELECT report_id, case_id, max(n) AS most, bool_and(ok) AS ok FROM n GROUP BY 1, 2), t AS (SELECT report_id, count(*) AS n, count(*) FILTER (ok) AS ok, max(most) AS most FROM c GROUP BY 1) SELECT r.report_id, concat_ws(',', CASE WHEN coalesce(t.n, 0) <> r.cases THEN 'cases differ' END, CASE WHEN coalesce(t.ok, 0) <> r.passed THEN 'passed differs' END, CASE WHEN most > 1 THEN 'repeated check' END, CASE WHEN coalesce(t.ok < t.n, true) THEN 'failed case' END) AS reasons FROM v_reports r LEFT JOIN t ON r.report_id = t.report_id",
    "v_reports",
    "v_checks",
)
def _(reports, checks):  # noqa: ANN001, ANN202
    return o.report_contract(reports, checks)


_SET = "coalesce(string_agg(DISTINCT target, ',' ORDER BY target) FILTER (kind = '{0}'), '') AS {0}s"


@_query("context_facts", f"SELECT file, {', '.join(_SET.format(k) for k in ('module', 'import', 'use'))} FROM v_directives GROUP BY 1", "v_directives")
def _(directives):  # noqa: ANN001, ANN202
    return o.context_facts(directives)


@_query("search_comparison", "SELECT mode, count(*) FILTER (found) AS found, count(*) AS trials, list_sort(list(coverage))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS coverage, list_sort(list(depth))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS depth FROM v_trials GROUP BY 1", "v_trials")
def _(trials):  # noqa: ANN001, ANN202
    return o.search_comparison(trials, report.upper_median)


@_query("distinct_values", "SELECT count(*) AS rows, count(DISTINCT source) AS source, count(DISTINCT doc_id) AS doc_id, count(DISTINCT text) AS text FROM v_messages", "v_messages")
def _(m):  # noqa: ANN001, ANN202
    return o.distinct_values(m, ["source", "doc_id", "text"])


@_query("fact_order", "SELECT file, line, col, kind, object, subject AS id FROM v_facts ORDER BY file, line, coalesce(col, 0), kind, object, id", "v_facts")
def _(facts):  # noqa: ANN001, ANN202
    return o.fact_order(facts.select("file", "line", "col", "kind", "object", F.col("subject").alias("id")))


@_query("diagnostic_order", "SELECT level, 'scan' AS phase, CAST(NULL AS VARCHAR) AS file, CASE WHEN diagnostic_id % 3 = 0 THEN 'r' END AS rule, diagnostic_id AS code FROM v_diagnostics ORDER BY level, phase, coalesce(rule, ''), code", "v_diagnostics")
def _(d):  # noqa: ANN001, ANN202
    return o.diagnostic_order(d.select("level", F.lit("scan").alias("phase"), F.lit(None).cast("string").alias("file"), F.when(F.col("diagnostic_id") % 3 == 0, "r").alias("rule"), F.col("diagnostic_id").alias("code")))


@_query("complete_or_fail", "SELECT file, line, col, kind, object, subject, relation FROM v_facts WHERE subject = 'part/1'", "v_facts")
def _(facts):  # noqa: ANN001, ANN202
    order = ["file", "line", "col", "kind", "object", "subject", "relation"]
    return o.complete_or_fail(f.fact_page(facts.where("subject = 'part/1'"), order, 10_000, 0)).select(*order)


@_query("include_minus_exclude", "SELECT DISTINCT path FROM v_paths WHERE (regexp_matches(path, '^lib/([^./][^/]*/)*[^./][^/]*\\.ex$') OR regexp_matches(path, '^lib/\\.git/[^./][^/]*\\.ex$')) AND NOT regexp_matches(path, '^([^./][^/]*/)*gen_[^/]*\\.ex$')", "v_paths")
def _(paths):  # noqa: ANN001, ANN202
    return o.include_minus_exclude(paths, ["lib/**/*.ex", "lib/.git/*.ex"], ["**/gen_*.ex"])


@_query("replay_shape_equal", "SELECT coalesce(a.id, b.id) AS id, coalesce(a.x = b.x, false) AS equal FROM (SELECT event_id AS id, event_type AS x FROM events) a FULL JOIN (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'click' ELSE 'view' END AS x FROM orders) b ON a.id = b.id", "v_trace", "v_sends")
def _(trace, sends):  # noqa: ANN001, ANN202
    first = trace.select(F.col("event_id").alias("id"), F.col("kind").alias("x"), F.col("at").alias("took"))
    second = sends.select("id", F.when(F.col("id") % 2 == 0, "click").otherwise("view").alias("x"), F.lit(0).cast("long").alias("took"))
    return o.replay_shape_equal(first, second, ["took"])


@_query("distinct_targets", "SELECT ip AS id, min(batch) AS batch FROM v_discovered WHERE ip IS NOT NULL GROUP BY 1 ORDER BY 1", "v_discovered")
def _(d):  # noqa: ANN001, ANN202
    return o.distinct_targets(d.where("ip IS NOT NULL").select(F.col("ip").alias("id"), "batch"))


#: All of the table, written out again as the SQL form of it; chr stands for bytes that no text shows, and no text for those that are not UTF-8.
PROBES = """(VALUES ('sqli', 0, '1'' AND ''1''=''2'), ('sqli', 1, '0 UNION SELECT NULL,NULL'), ('sqli', 2, '1) OR (SELECT 7)=(7'), ('sqli', 3, 'mk7'' OR ''a''<''b'),
 ('xss', 0, '<svg id=mk7 onload=void(0)>'), ('xss', 1, '<img alt=mk7 src=x:>'), ('xss', 2, 'javascript:void(''mk7'')'),
 ('path_traversal', 0, '....//....//mk7.txt'), ('path_traversal', 1, '/..;/mk7.txt'), ('path_traversal', 2, '%252e%252e%252fmk7.txt'),
 ('ssrf', 0, 'http://mk7.example/'), ('ssrf', 1, 'http://[::1]:9/mk7'), ('ssrf', 2, 'gopher://mk7.example:9/_x'),
 ('command_injection', 0, 'a' || chr(10) || 'echo mk7'), ('command_injection', 1, '%0Aecho mk7'), ('command_injection', 2, 'a&echo mk7&'),
 ('template_injection', 0, chr(123) || chr(123) || ' ''mk'' ~ 7 ' || chr(125) || chr(125)), ('template_injection', 1, '*' || chr(123) || '3*3' || chr(125) || 'mk7'), ('template_injection', 2, '@(3*3)mk7'),
 ('http_parameter_injection', 0, 'a=1&a=mk7'), ('http_parameter_injection', 1, 'a;b=mk7'), ('http_parameter_injection', 2, 'mk7%0d%0aX-Mk7: 1'),
 ('ldap_injection', 0, '*)(uid=mk7'), ('ldap_injection', 1, 'mk7)(|(cn=*'), ('xml_entity', 0, '<!DOCTYPE m [<!ENTITY e "mk7">]><m>&e;</m>'),
 ('null_byte', 0, 'mk7%00.png'), ('null_byte', 1, 'mk7' || chr(0) || '.png'), ('malformed_utf8', 0, NULL), ('malformed_utf8', 1, NULL), ('malformed_utf8', 2, NULL),
 ('format_string', 0, '%08x.%08x.mk7'), ('format_string', 1, chr(123) || '0.__class__' || chr(125) || 'mk7')) b(class, place, value)"""


@_query("builtin_payloads", f"SELECT class, place, value, sum(CASE WHEN doc_id % 50 < 40 AND doc_id % 50 = n THEN 1 ELSE 0 END)::BIGINT AS documents FROM (SELECT *, row_number() OVER (ORDER BY class, place) AS n FROM {PROBES}), v_messages WHERE doc_id IS NOT NULL GROUP BY ALL", "v_messages")
def _(m):  # noqa: ANN001, ANN202
    # every fiftieth text or so has one of the probes put in, in the order of classes and places
    known = o.builtin_payloads(m.sparkSession).withColumn("value", F.when(F.expr("is_valid_utf8(value)"), F.decode("value", "UTF-8")))
    known = known.withColumn("n", F.row_number().over(Window.orderBy("class", "place")))
    probed = m.where("doc_id IS NOT NULL").withColumn("n", F.col("doc_id") % 50).join(F.broadcast(known), "n", "left").select("doc_id", F.concat(F.lit("x "), F.coalesce("value", F.lit("")), F.lit(" y")).alias("text"))
    found = report.leak_audit(probed, known.select("n", F.concat_ws("/", "class", "place").alias("literal_id"), F.col("value").alias("literal")))
    whole = known.join(found, F.col("literal_id") == F.concat_ws("/", "class", "place"), "left")
    # those that are no text are only counted where they were put
    put = m.groupBy((F.col("doc_id") % 50).alias("n")).agg(F.count("*").alias("put"))
    return whole.join(put, "n", "left").select("class", "place", "value", F.coalesce(F.when(F.col("value").isNull(), F.col("put")).otherwise(F.col("documents")), F.lit(0)).alias("documents"))


@_query(
    "distinct_sketches",
    "SELECT source, count(*) AS rows, true AS doc_id, true AS text FROM v_messages GROUP BY 1",
    "v_messages",
)
def _(m):  # noqa: ANN001, ANN202
    # sketches of parts, united, against the exact counts: three standard errors
    dealt = o.distinct_sketches(m.withColumn("part", F.col("doc_id") % 7), ["source", "part"], ["doc_id", "text"])
    told = o.sketch_estimates(o.merge_sketches(dealt, ["source"], ["doc_id", "text"]), ["doc_id", "text"])
    exact = m.groupBy("source").agg(F.count_distinct("doc_id").alias("ids"), F.count_distinct("text").alias("texts"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 1 + F.col(b) * 0.025
    return told.join(exact, told["source"].eqNullSafe(exact["source"])).select(told["source"], "rows", near("doc_id", "ids").alias("doc_id"), near("text", "texts").alias("text"))


@_query(
    "externalize_results",
    "WITH j AS (SELECT doc_id AS id, to_json({'id': doc_id, 'text': text}) AS json FROM v_messages WHERE text IS NOT NULL), r AS (SELECT id, json, strlen(json) AS size, strlen(json) > 400 AS large FROM j) SELECT id, CASE WHEN NOT large THEN json END AS json, CASE WHEN large THEN sha256(json) END AS sha256, size, CASE WHEN large THEN json END AS artifact FROM r",
    "v_messages",
)
def _(m):  # noqa: ANN001, ANN202
    rows, artifacts = o.externalize_results(m.where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text"), 400)
    return rows.join(artifacts.withColumnRenamed("json", "artifact"), "sha256", "left").select("id", "json", "sha256", "size", "artifact")


@_query("wire_projection", "SELECT doc_id AS id, source AS evidence, strlen(text) AS raw_size, sha256(text) AS raw_sha256 FROM v_messages", "v_messages")
def _(m):  # noqa: ANN001, ANN202
    return o.wire_projection(m.select(F.col("doc_id").alias("id"), F.col("source").alias("evidence"), F.encode("text", "UTF-8").alias("raw"), F.lit("x").alias("seed")))


@_query("seal", "WITH x AS (SELECT l_orderkey AS id, '{\"a\":' || l_partkey || ',\"b\":\"' || l_returnflag || '\"}' AS json FROM lineitem) SELECT id, sha256(json) AS digest, CASE id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'digest_mismatch' ELSE 'missing_digest' END AS state FROM x", "v_line")
def _(line):  # noqa: ANN001, ANN202
    sealed = line.select("id", p.seal(F.struct("a", "b")).alias("s"))
    given = F.when(F.col("id") % 3 == 0, F.col("s.digest")).when(F.col("id") % 3 == 1, F.sha2(F.col("s.digest"), 256))
    return sealed.select("id", F.col("s.digest").alias("digest"), p.verify_seal(F.col("s.json"), given).alias("state"))


VIEWS["v_line"] = "SELECT l_orderkey AS id, l_partkey AS a, l_returnflag AS b FROM {lineitem}"


def _cut_sql(column: str, most: int) -> str:
    """The longest beginning in characters that fits the bytes, by its own arithmetic: whole characters are added up."""
    return f"(SELECT coalesce(string_agg(c, '' ORDER BY i), '') FROM (SELECT c, i, sum(strlen(c)) OVER (ORDER BY i) AS upto FROM (SELECT unnest(regexp_extract_all(left({column}, {most}), '(?s).')) AS c, generate_subscripts(regexp_extract_all(left({column}, {most}), '(?s).'), 1) AS i)) WHERE upto <= {most})"


@_query("preview", f"SELECT doc_id, CASE WHEN strlen(text) <= 240 THEN text ELSE {_cut_sql('text', 240)} END AS preview, strlen(text) > 240 AS truncated FROM v_messages", "v_messages")
def _(m):  # noqa: ANN001, ANN202
    return m.select("doc_id", p.preview(F.col("text")).alias("p")).select("doc_id", "p.*")


@_query("bounded_message", "SELECT doc_id, strlen(text) <= 4096 AS whole, CASE WHEN strlen(text) <= 4096 THEN strlen(text) END AS bytes FROM v_messages", "v_messages")
def _(m):  # noqa: ANN001, ANN202
    b = p.bounded_message(F.col("text"))
    whole = b == F.col("text")
    fits = (F.octet_length(b) <= 4096) & (F.octet_length(b) > 4089) & b.endswith("...") & F.startswith("text", F.substr(b, F.lit(1), F.length(b) - 3))
    return m.select("doc_id", F.when(whole | fits, whole).alias("whole"), F.when(whole, F.octet_length(b)).cast("long").alias("bytes"))


@_query("request_id", f"WITH r AS (SELECT l_orderkey AS id, {_sid('request', 'l_returnflag', 'l_linestatus', 'l_partkey')} AS request FROM lineitem) SELECT id, request, {_sid('replay', 'request')} AS replay FROM r", "v_requests")
def _(line):  # noqa: ANN001, ANN202
    r = p.request_id(F.col("action"), F.col("kind"), F.col("subject"))
    return line.select("id", r.alias("request"), p.replay_seed_id(r).alias("replay"))


VIEWS["v_requests"] = "SELECT l_orderkey AS id, l_returnflag AS action, l_linestatus AS kind, l_partkey AS subject FROM {lineitem}"


@_query(
    "render_template",
    "SELECT job_id, replace(template, 'KEY', value) AS raw, replace(template, 'KEY', replace(replace(value, ' ', '%20'), '*', '%2A')) AS percent, replace(template, 'KEY', replace(value, ' ', '+')) AS form, rtrim(template, '/') || '/' || keyword AS with_path, template || '&q=' || keyword AS with_query FROM v_rendered",
    "v_rendered",
)
def _(r):  # noqa: ANN001, ANN202
    out = r.select("job_id", p.render_template(F.col("template"), {"KEY": F.col("value")}).alias("r"), p.put_path(F.col("template"), F.col("keyword")).alias("with_path"), p.put_query(F.col("template"), F.lit("q"), F.col("keyword")).alias("with_query"))
    return out.select("job_id", "r.*", "with_path", "with_query")


@_query("route_path", "SELECT job_id, CASE job_id % 3 WHEN 0 THEN '/u/' || replace(replace(value, ' ', '%20'), '*', '%2A') || '/:other' WHEN 1 THEN '/f/' || replace(replace(value, ' ', '%20'), '*', '%2A') ELSE '/plain' END AS path, CASE job_id % 3 WHEN 0 THEN 'id,other' WHEN 1 THEN 'rest' ELSE '' END AS params FROM v_rendered", "v_rendered")
def _(r):  # noqa: ANN001, ANN202
    route = F.when(F.col("job_id") % 3 == 0, "/u/:id/:other").when(F.col("job_id") % 3 == 1, "/f/*rest").otherwise("/plain")
    return r.select("job_id", p.route_path(route, F.col("value")).alias("path"), F.array_join(F.transform(s.route_params(route), lambda t: t["name"]), ",").alias("params"))


@_query("lock_directness", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'direct' ELSE 'transitive' END AS directness, CASE p_size % 5 WHEN 0 THEN 'github' WHEN 1 THEN 'git' WHEN 2 THEN 'path' ELSE 'hex' END AS source FROM part", "v_deps")
def _(d):  # noqa: ANN001, ANN202
    return d.select("p_partkey", p.lock_directness(F.col("level")).alias("directness"), p.dependency_source(F.from_json("options", "map<string,string>")).alias("source"))


VIEWS["v_deps"] = "SELECT p_partkey, p_size % 4 AS level, concat('{', chr(34), CASE p_size % 5 WHEN 0 THEN 'github' WHEN 1 THEN 'git' WHEN 2 THEN 'path' ELSE 'only' END, chr(34), ':', chr(34), 'x', chr(34), '}') AS options FROM {part}".replace("'{'", "chr(123)").replace("'}'", "chr(125)")


@_query("response_fields", "SELECT match_id, status, CASE WHEN match_id % 2 = 0 THEN body END AS body, content_type FROM (SELECT match_id, CASE WHEN match_id % 3 = 0 THEN NULL ELSE status END AS status, body, content_type FROM v_http)", "v_http")
def _(h):  # noqa: ANN001, ANN202
    key = F.when(F.col("match_id") % 3 == 1, "status").when(F.col("match_id") % 3 == 2, "status_code").otherwise("other")
    where = F.when(F.col("match_id") % 2 == 0, F.when(F.col("match_id") % 4 == 0, "body").otherwise("resp_body")).otherwise("x")
    given = F.map_from_arrays(F.array(key, where, F.lit("Content-TYPE")), F.array(F.col("status").cast("string"), "body", "content_type"))
    return h.select("match_id", p.response_fields(given).alias("r")).select("match_id", "r.*")


@_query("terminal_sequences", "SELECT match_id, CASE match_id % 17 WHEN 1 THEN 'csi' WHEN 2 THEN 'control' WHEN 3 THEN 'c1' ELSE '' END AS labels FROM v_http WHERE body IS NOT NULL AND NOT regexp_matches(left(body, length(body) - 12), '[\\x00-\\x08\\x0b-\\x1f\\x7f\\x{80}-\\x{9f}]')", "v_http")
def _(h):  # noqa: ANN001, ANN202
    some = h.where(F.col("body").isNotNull() & ~F.col("body").substr(F.lit(1), F.greatest(F.length("body") - 12, F.lit(0))).rlike("[\\x00-\\x08\\x0b-\\x1f\\x7f\\x{80}-\\x{9f}]"))
    return some.select("match_id", F.array_join(p.terminal_sequences(F.col("body")), ",").alias("labels"))


_HOST = "^[a-z0-9_]([a-z0-9_-]{0,61}[a-z0-9_])?([.][a-z0-9_]([a-z0-9_-]{0,61}[a-z0-9_])?)*$"


@_query("canonical_ip", f"WITH x AS (SELECT event_id, text, regexp_matches(text, '^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])([.]|$)){{4}}$') AND NOT ends_with(text, '.') AS four, lower(rtrim(text, '.')) AS name FROM v_ips) SELECT event_id, CASE WHEN four THEN 'ipv4' WHEN regexp_matches(name, '{_HOST}') AND NOT regexp_matches(name, '^[0-9.]+$') THEN 'host' END AS kind, CASE WHEN four THEN text WHEN regexp_matches(name, '{_HOST}') AND NOT regexp_matches(name, '^[0-9.]+$') THEN name END AS value FROM x", "v_ips")
def _(ips):  # noqa: ANN001, ANN202
    return ips.select("event_id", p.canonical_ip(F.col("text")).alias("c")).select("event_id", "c.*")


@_query("callback_implementations", "SELECT i.object AS interface, i.subject AS module, c.signature, d.subject AS definition FROM (SELECT DISTINCT subject, object FROM v_callbacks WHERE kind = 'implements') i JOIN (SELECT DISTINCT subject, signature FROM v_callbacks WHERE kind = 'callback') c ON i.object = c.subject JOIN (SELECT DISTINCT subject, object FROM v_callbacks WHERE kind = 'definition') d ON d.object = i.subject || '.' || c.signature", "v_callbacks")
def _(facts):  # noqa: ANN001, ANN202
    return f.callback_implementations(facts)


@_query("graph_edges", "SELECT subject AS \"from\", CASE WHEN kind IN ('package_use', 'dependency') THEN 'package:' || object WHEN kind = 'behavior' THEN 'behavior:' || object ELSE object END AS \"to\", kind AS relation FROM v_facts", "v_facts")
def _(facts):  # noqa: ANN001, ANN202
    return graph.graph_edges(facts)


@_query(
    "finding_lineage",
    f"WITH {PORTS.replace('pf AS (SELECT', 'pf AS (SELECT DISTINCT')}, s AS (SELECT {_sid('web', 'source', 'id')} AS seed_id, id FROM pf), v AS (SELECT 'v' || seed_id AS validation_id, CASE WHEN right(seed_id, 1) < '8' THEN seed_id ELSE 'gone' END AS seed_id FROM s) SELECT v.validation_id, v.seed_id, s.id AS finding_id, pf.category, pf.locus FROM v LEFT JOIN s ON v.seed_id = s.seed_id LEFT JOIN pf ON s.id = pf.id",
    "v_hosts",
    "v_ports",
)
def _(hosts, ports):  # noqa: ANN001, ANN202
    found = findings.findings_from_hosts(_hosts(hosts, ports)).dropDuplicates(["id"])
    seeds = lineage.promote_findings(found, "web")
    validations = seeds.select(F.concat(F.lit("v"), "seed_id").alias("validation_id"), F.when(F.right("seed_id", F.lit(1)) < "8", F.col("seed_id")).otherwise("gone").alias("seed_id"))
    return lineage.finding_lineage(seeds, found, validations)
