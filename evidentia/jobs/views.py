"""Evidence views over the star and text tables, as SQL that Spark and DuckDB both run.

A view names its tables in braces. MICROS(x) is the engine's count of microseconds.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_http": "SELECT page_id AS match_id, page_id % 5 AS job_id, url, concat(html, CASE page_id % 23 WHEN 0 THEN ' ORA-00933: x' WHEN 1 THEN ' XORA-00933' WHEN 2 THEN ' You have an error in your sql syntax' WHEN 3 THEN ' SQLSTATE[42]' WHEN 4 THEN concat(' syntax error at or near ', chr(34), 'x') WHEN 5 THEN ' syntax error at or near x' WHEN 6 THEN ' Unclosed quotation mark after the character string' WHEN 7 THEN ' OLE DB provider' WHEN 8 THEN ' Traceback (most recent call last)' WHEN 9 THEN ' stack_trace' WHEN 10 THEN ' uncaught FooException' WHEN 11 THEN ' lib/a.ex:12' WHEN 12 THEN ' lib/a.exe:12' WHEN 13 THEN ' KeyError: x' WHEN 14 THEN ' KeyError x' ELSE '' END, CASE page_id % 17 WHEN 0 THEN concat(chr(27), '[31mred', chr(27), '[0m') WHEN 1 THEN concat(chr(27), '[2J') WHEN 2 THEN chr(7) WHEN 3 THEN chr(155) ELSE '' END) AS body, length(html) AS length, CASE page_id % 7 WHEN 0 THEN 500 WHEN 1 THEN 301 ELSE 200 END AS status, CASE page_id % 5 WHEN 0 THEN 'application/json' WHEN 1 THEN NULL ELSE 'text/html; charset=utf-8' END AS content_type, CASE WHEN page_id % 2 = 0 THEN 'FUZZ' ELSE 'WORD' END AS keyword, concat('v', CAST(page_id % 9 AS STRING)) AS value, CASE WHEN page_id % 4 = 0 THEN 'EXTRA' END AS keyword2, concat('e', CAST(page_id % 6 AS STRING)) AS value2, page_id % 40 AS lines, page_id % 250 AS words, page_id % 900 AS millis FROM {pages}",
    "v_jobs": "SELECT r_regionkey AS job_id, CASE r_regionkey WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END AS method, CASE WHEN r_regionkey = 1 THEN array('FUZZ', 'WORD') ELSE array('EXTRA', 'FUZZ', 'WORD') END AS keywords FROM {region} WHERE r_regionkey < 4",
    "v_points": "SELECT n_nationkey % 4 AS job_id, n_nationkey AS place, CASE WHEN n_nationkey % 4 = 2 THEN 'OTHER' WHEN n_nationkey % 3 = 0 THEN 'FUZZ' WHEN n_nationkey % 3 = 1 THEN 'WORD' ELSE 'EXTRA' END AS keyword, CASE n_nationkey % 5 WHEN 0 THEN 'query' WHEN 1 THEN 'url' WHEN 2 THEN 'header' WHEN 3 THEN 'body' ELSE 'cookie' END AS location, CASE n_nationkey % 5 WHEN 0 THEN 'q' WHEN 2 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'HOST' ELSE 'X-Id' END WHEN 4 THEN 'sid' END AS name FROM {nation}",
    "v_seeds": "SELECT p_partkey AS seed_id, p_partkey AS seq, CASE WHEN p_partkey % 2 = 0 THEN 'FUZZ' ELSE 'WORD' END AS keyword, concat('v', CAST(p_partkey % 12 AS STRING)) AS value, p_name AS id, p_brand AS property FROM {part}",
    "v_facts": "SELECT DISTINCT concat('part/', CAST(l_partkey AS STRING)) AS subject, concat('supp/', CAST(l_suppkey AS STRING)) AS object, CASE l_returnflag WHEN 'N' THEN 'call' WHEN 'A' THEN 'unqualified_call' ELSE 'package_use' END AS kind, CASE l_linestatus WHEN 'O' THEN 'calls' ELSE 'uses' END AS relation, concat('order/', CAST(l_orderkey AS STRING)) AS file, l_linenumber AS line, CAST(l_quantity AS INTEGER) AS col FROM {lineitem}",
    "v_matches": "SELECT CAST(l_suppkey % 7 AS STRING) AS rule_id, concat('order/', CAST(l_orderkey % 50 AS STRING)) AS file, l_returnflag AS anchor, l_linenumber AS line, CAST(l_quantity AS INTEGER) AS col, l_partkey AS message, l_orderkey AS o, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM {lineitem}",
    "v_edges": "SELECT concat('c', CAST(o_custkey AS STRING)) AS \"from\", concat('o', CAST(o_orderkey AS STRING)) AS \"to\" FROM {orders} UNION ALL SELECT concat('o', CAST(l_orderkey AS STRING)), concat('s', CAST(l_suppkey AS STRING)) FROM {lineitem} UNION ALL SELECT concat('s', CAST(s_suppkey AS STRING)), concat('n', CAST(s_nationkey AS STRING)) FROM {supplier} UNION ALL SELECT concat('n', CAST(n_nationkey AS STRING)), concat('r', CAST(n_regionkey AS STRING)) FROM {nation} UNION ALL SELECT concat('r', CAST(r_regionkey AS STRING)), concat('n', CAST(r_regionkey AS STRING)) FROM {region}",
    "v_roots": "SELECT concat('c', CAST(c_custkey AS STRING)) AS root FROM {customer}",
    "v_spans": "SELECT CAST(o_custkey % 40 AS STRING) AS file, o_orderkey AS scope_id, o_orderkey % 900 AS first, o_orderkey % 900 + CAST(floor(o_totalprice / 2000) AS BIGINT) AS last FROM {orders}",
    "v_points_in": "SELECT CAST(event_id % 40 AS STRING) AS file, event_id AS point_id, (event_id * 7) % 1100 AS at FROM {events}",
    "v_changes": "SELECT CAST(o_custkey AS STRING) AS file, MICROS(o_orderdate) AS since, o_orderkey AS value FROM {orders}",
    "v_asked": "SELECT CAST(user_id AS STRING) AS file, MICROS(ts) - 800000000000000 + event_id * 10000000000 AS at, event_id AS point_id FROM {events}",
    "v_modules": "SELECT p_brand AS module, CASE WHEN p_brand IN ('Brand#1', 'Brand#3') THEN 'one' ELSE p_type END AS package FROM {part}",
    "v_calls": "SELECT page_id AS call_id, concat('com.example.', CASE page_id % 4 WHEN 0 THEN 'mail' WHEN 1 THEN 'mail.smtp' WHEN 2 THEN 'mailer' ELSE 'web.view' END, '.f', CAST(page_id % 3 AS STRING)) AS target FROM {pages}",
    "v_owners": "SELECT CASE r_regionkey WHEN 0 THEN 'com' WHEN 1 THEN 'com.example.mail' WHEN 2 THEN 'com.example.mail.smtp' WHEN 3 THEN 'com.example.web' ELSE 'org' END AS module, r_name AS package FROM {region}",
    "v_uses": "SELECT user_id AS file, event_type AS variable, event_id AS at, event_id AS use_id FROM {events}",
    "v_variables": "SELECT o_orderkey AS call_id, CAST(o_custkey % 60 AS STRING) AS subject, CASE o_orderstatus WHEN 'O' THEN array(o_orderpriority, 'x') WHEN 'F' THEN array(o_orderpriority) ELSE array('x', 'y') END AS variables FROM {orders}",
    "v_sources": "SELECT source AS component, concat('src/', source, '/', CAST(doc_id AS STRING), '.txt') AS path, text AS content, doc_id, n_chars AS bytes FROM {documents}",
    "v_comments": "SELECT doc_id AS comment_id, n_chars AS line, CASE doc_id % 5 WHEN 0 THEN concat('# evidence-ignore: rule.', CAST(doc_id % 3 AS STRING), ' -- known and safe') WHEN 1 THEN '# evidence-ignore later' WHEN 2 THEN '# evidence-ignore: Rule -- x' ELSE text END AS text FROM {documents}",
    "v_sends": "SELECT o_orderkey AS id, o_orderpriority AS marker, MICROS(o_orderdate) AS at, o_orderkey % 3 AS recipient FROM {orders}",
    "v_receives": "SELECT l_orderkey AS id, CASE WHEN l_linenumber % 2 = 0 THEN '1-URGENT' ELSE '5-LOW' END AS marker, MICROS(l_shipdate) AS at, l_partkey % 3 AS receiver FROM {lineitem}",
    "v_lineage": "SELECT concat(CAST(conv_id AS STRING), '/', CAST(CAST(floor(turn / 2) AS BIGINT) AS STRING)) AS reference, CASE role WHEN 'user' THEN 'handoff' WHEN 'assistant' THEN 'result' ELSE 'other' END AS stage, turn AS at FROM {conversations}",
    "v_store": "SELECT user_id AS key, event_id AS version, event_id AS at, CASE event_type WHEN 'error' THEN 'delete' ELSE 'write' END AS kind FROM {events} WHERE event_type IN ('purchase', 'signup', 'error')",
    "v_reads": "SELECT event_id AS read_id, user_id AS key, CASE WHEN event_id % 3 = 0 THEN event_id - 1 END AS version FROM {events} WHERE event_type IN ('view', 'click')",
    "v_trace": "SELECT user_id AS session_id, event_id, MICROS(ts) AS at, event_type AS kind, event_type = 'error' AS hit, array(event_type, props) AS args FROM {events}",
    "v_rate": "SELECT event_type AS origin, MICROS(ts) AS at FROM {events}",
    "v_samples": "SELECT event_id AS seq, array(event_type, concat('v', CAST(CAST(floor(value / 50) AS BIGINT) AS STRING)), concat('u', CAST(user_id % 10 AS STRING))) AS items, CAST(round(value * 100) AS BIGINT) AS fitness FROM {events}",
    "v_chunks": "SELECT conv_id AS stream, turn AS place, CAST(length(text) AS BIGINT) AS bytes, CASE WHEN role = 'system' AND turn > 0 OR turn % 5 = 4 THEN 'rejected' ELSE 'incomplete' END AS status FROM {conversations}",
    "v_verdicts": "SELECT d.doc_id AS id, d.source AS tool, d.lang AS action, CASE l.quality WHEN 1 THEN 'confirmed' WHEN 0 THEN 'refuted' ELSE 'inconclusive' END AS verdict, l.toxic FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id",
    "v_latency": "SELECT l_returnflag AS case_id, CASE l_linestatus WHEN 'O' THEN 'targeted' ELSE 'baseline' END AS mode, CAST(round(l_extendedprice * 100) AS BIGINT) AS sample FROM {lineitem}",
    "v_literals": "SELECT item_id AS literal_id, text AS literal FROM {benchmark}",
    "v_lists": "SELECT 1 AS list, n_nationkey AS place, n_name AS value FROM {nation} UNION ALL SELECT 2, r_regionkey, r_name FROM {region}",
    "v_scans": "SELECT n_nationkey AS scan_id, CAST(n_nationkey % 7 + 1 AS BIGINT) AS rate, CAST(4 AS BIGINT) AS most FROM {nation}",
    "v_targets": "SELECT s_nationkey AS scan_id, s_suppkey AS target FROM {supplier}",
    "v_urls": "SELECT page_id AS match_id, CASE page_id % 6 WHEN 0 THEN concat(' HTTPS://', upper(split_part(split_part(url, '//', 2), '/', 1)), ':8443?q=1 ') WHEN 1 THEN concat('http://u@', split_part(url, '//', 2)) WHEN 2 THEN concat('HTTP://', split_part(split_part(url, '//', 2), '/', 1), ':70000/') WHEN 3 THEN concat('ftp://', split_part(url, '//', 2)) ELSE url END AS url FROM {pages}",
    "v_hosts": "SELECT concat('10.', CAST(c_nationkey AS STRING), '.', CAST(CAST(floor(c_custkey / 250) AS BIGINT) % 250 AS STRING), '.', CAST(c_custkey % 250 AS STRING)) AS ip, c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'down' ELSE 'up' END AS status FROM {customer}",
    "v_ports": "SELECT o_custkey AS c_custkey, CAST(o_orderkey % 1024 + 1 AS INTEGER) AS port, CASE o_orderkey % 3 WHEN 0 THEN 'udp' WHEN 1 THEN 'tcp' END AS protocol, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'filtered' END AS state, CASE WHEN o_orderkey % 2 = 0 THEN 'https' END AS service FROM {orders}",
    "v_api": "SELECT l_orderkey AS call_id, concat('part/', CAST(l_partkey AS STRING)) AS subject, CASE l_suppkey % 7 WHEN 0 THEN 'String' WHEN 1 THEN 'os' WHEN 2 THEN 'erlang' WHEN 3 THEN 'Code' WHEN 4 THEN 'System' WHEN 5 THEN 'Module' ELSE 'EEx' END AS module, CASE l_orderkey % 8 WHEN 0 THEN 'to_atom' WHEN 1 THEN 'cmd' WHEN 2 THEN 'binary_to_term' WHEN 3 THEN 'eval_string' WHEN 4 THEN 'shell' WHEN 5 THEN 'eval_quoted' WHEN 6 THEN 'open_port' ELSE 'concat' END AS fn, l_linenumber % 3 AS arity, CASE l_returnflag WHEN 'N' THEN 'dynamic' ELSE 'literal' END AS shape, CASE WHEN l_partkey % 2 = 0 THEN 'spawn' ELSE 'fd' END AS head, l_linestatus = 'O' AS safe FROM {lineitem}",
    "v_api_table": "SELECT CASE r_regionkey WHEN 0 THEN 'String' WHEN 1 THEN 'os' WHEN 2 THEN 'Code' ELSE 'System' END AS module, CASE r_regionkey WHEN 0 THEN 'to_atom' WHEN 1 THEN 'cmd' WHEN 2 THEN 'eval_string' ELSE 'shell' END AS fn, CASE WHEN r_regionkey % 2 = 0 THEN 'dynamic_data' ELSE 'command' END AS behavior FROM {region}",
    "v_actions": "SELECT p_partkey AS action_id, concat('tool', CAST(p_partkey % 400 AS STRING)) AS tool, concat('check-', CAST(p_size AS STRING), CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '.v1' END) AS action, CASE p_partkey % 4 WHEN 0 THEN array('url', 'url') WHEN 1 THEN array('url') ELSE array('ip', 'url') END AS accepts, CASE p_partkey % 6 WHEN 0 THEN 'maybe' WHEN 1 THEN NULL ELSE 'none' END AS effect, CASE p_size % 9 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE p_name END AS name FROM {part}",
    "v_raw_facts": "SELECT l_orderkey AS row_id, CASE WHEN l_partkey % 11 = 0 THEN ' ' ELSE 'part' END AS subject, CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE 'supplier' END AS object, CASE WHEN l_partkey % 7 = 0 THEN 'a/../b' WHEN l_partkey % 7 = 1 THEN '/a' ELSE 'a/b..c' END AS file, l_linenumber - 1 AS line, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_suppkey % 5 END AS col, l_linenumber - 1 + l_partkey % 3 - 1 AS end_line, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE 3 END AS end_col, CASE WHEN l_partkey % 17 = 0 THEN '' ELSE 'call' END AS kind, CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE 'calls' END AS relation, CASE l_partkey % 23 WHEN 0 THEN 'abc' WHEN 1 THEN repeat('G', 64) ELSE repeat('0a', 32) END AS source_hash, l_partkey % 29 <> 0 AS has_attributes FROM {lineitem}",
    "v_networks": "SELECT concat('10.', CAST(n_nationkey AS STRING), '.0.0') AS base, CASE WHEN n_nationkey % 3 = 0 THEN 16 ELSE 24 END AS prefix FROM {nation}",
    "v_scope_targets": "SELECT CASE c_custkey % 6 WHEN 0 THEN concat('10.', CAST(c_nationkey AS STRING), '.', CAST(c_custkey % 3 AS STRING), '.7') WHEN 1 THEN concat('10.', CAST(c_nationkey AS STRING), '.0.0/', CAST(c_custkey % 30 AS STRING)) WHEN 2 THEN concat('host', CAST(c_custkey % 50 AS STRING), '.corp') WHEN 3 THEN concat('2001:db8:', CAST(c_nationkey AS STRING), '::', CAST(c_custkey % 9 AS STRING)) WHEN 4 THEN concat('2001:db8:', CAST(c_nationkey AS STRING), '::/', CAST(c_custkey % 130 AS STRING)) ELSE '10.1.2' END AS target, c_custkey % 6 AS form, c_nationkey AS n, c_custkey AS k FROM {customer}",
    "v_scope_networks": "SELECT CASE WHEN n_nationkey % 5 = 0 THEN concat('2001:db8:', CAST(n_nationkey AS STRING), '::') ELSE concat('10.', CAST(n_nationkey AS STRING), '.0.0') END AS base, CASE WHEN n_nationkey % 5 = 0 THEN 48 WHEN n_nationkey % 3 = 0 THEN 16 ELSE 24 END AS prefix FROM {nation}",
    "v_scope_names": "SELECT concat('host', CAST(s_suppkey % 20 AS STRING), '.corp') AS hostname FROM {supplier}",
    "v_url_rules": "SELECT CASE WHEN r_regionkey % 2 = 0 THEN 'http' ELSE 'https' END AS scheme, CASE WHEN r_regionkey % 2 = 0 THEN 80 ELSE 443 END AS port, CASE r_regionkey WHEN 0 THEN 'example.com' WHEN 1 THEN 'example.net' WHEN 2 THEN 'example.org' WHEN 3 THEN 'example.org' ELSE 'example.net' END AS host, true AS subdomains, CASE WHEN r_regionkey < 3 THEN '/' ELSE '/en' END AS path FROM {region}",
    "v_bindings": "SELECT event_id AS binding_id, concat('f', CAST(user_id AS STRING)) AS target, user_id % 3 AS position FROM {events}",
    "v_returns": "SELECT c_custkey AS return_id, concat('f', CAST(c_custkey * c_custkey % 211 AS STRING)) AS target, concat('f', CAST(c_custkey * c_custkey % 211 AS STRING), '#argument/', CAST(c_custkey % 4 AS STRING)) AS object FROM {customer}",
    "v_cells": "SELECT o_custkey * 7 + o_orderkey % 7 AS key, o_orderkey % 5 AS process, o_orderkey AS at, CASE o_orderstatus WHEN 'F' THEN 'write' ELSE 'read' END AS kind, substring(o_orderpriority, 1, 1) AS value FROM {orders}",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the Parquet tables of a folder."""
    text = re.sub(r"MICROS\(([^()]*)\)", r"unix_micros(CAST(\1 AS TIMESTAMP))", VIEWS[name]).replace('"', "`")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{%s}" % t in text}
    return spark.sql(text, **used)


def _quoted(sql: str) -> str:
    """DuckDB reads AT as a word of its own."""
    return re.sub(r"""'(?:[^']|'')*'|(?<![\w"])at(?![\w"])""", lambda m: '"at"' if m[0] == "at" else m[0], sql)


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names as common table expressions."""
    names = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    sql = _quoted(sql)
    if not names:
        return sql
    texts = [_quoted(re.sub(r"\barray\(", "list_value(", re.sub(r"MICROS\(", "epoch_us(", re.sub(r"\{(\w+)\}", r"\1", VIEWS[n])))) for n in names]
    head = ", ".join(f"{n} AS ({t})" for n, t in zip(names, texts, strict=True))
    body = sql.strip()
    for word in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(word):
            return f"{word}{head}, {body[len(word):]}"
    return f"WITH {head} {body}"
