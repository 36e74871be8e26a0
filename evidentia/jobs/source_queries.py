"""Queries of document readers, over documents made from the tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import policy as p
from ..sources import documents as d
from ..sources import readers
from ..staging import staged
from .queries import _query
from .views import VIEWS



def _json(sql: str) -> str:
    """SQL of a text in which ~ stands for a double quote and < and > for braces."""
    return f"replace(replace(replace({sql}, '~', chr(34)), '<', chr(123)), '>', chr(125))"


_HOST_DOCUMENT = _json("concat('<~schema_version~:', CASE c_custkey % 7 WHEN 0 THEN 'null' WHEN 1 THEN '2' ELSE '1' END, ',~hosts~:[<~ip~:~10.0.0.', CAST(c_nationkey AS STRING), '~,~status~:~', CASE WHEN c_custkey % 13 = 0 THEN 'gone' ELSE 'up' END, '~,~hostname~:~h', CAST(c_custkey AS STRING), '~>]>')")
_FINDING_DOCUMENT = _json("concat('<~schema_version~:1,~findings~:[<~id~:~f', CAST(s_suppkey AS STRING), '~,~severity~:~', CASE WHEN s_suppkey % 5 = 0 THEN 'huge' ELSE 'low' END, '~,~confidence~:~', CASE WHEN s_suppkey % 7 = 0 THEN 'none' ELSE 'high' END, '~,~locus~:<~', CASE WHEN s_suppkey % 9 = 0 THEN 'colour' ELSE 'url' END, '~:~x~>>]>')")
_RECEIPT = _json("concat('<~type~:~', CASE event_type WHEN 'view' THEN 'request' ELSE 'response' END, '~,~cancelled~:', CASE WHEN event_id % 5 = 0 THEN 'true' ELSE 'false' END, ',~status~:', CAST(event_id % 700 AS STRING), ',~error~:~', CASE WHEN event_id % 6 = 0 THEN 'reset' ELSE '' END, '~,~method~:~GET~,~input~:<~FUZZ~:~', CASE WHEN event_id % 8 = 0 THEN '***' ELSE 'YWJj' END, '~>>')")
VIEWS |= {
    "v_host_documents": f"SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN 'no json' ELSE {_HOST_DOCUMENT} END AS value FROM {{customer}}",
    "v_finding_documents": f"SELECT s_suppkey AS id, {_FINDING_DOCUMENT} AS value FROM {{supplier}}",
    "v_receipt_lines": f"SELECT event_id AS id, {_RECEIPT} AS value FROM {{events}}",
    "v_xml": f"SELECT c_custkey AS id, c_nationkey AS document, c_custkey % 4 AS n_ports, replace(concat('<host><status state=~', CASE c_custkey % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' ELSE 'odd' END, '~ reason=~r~/><address addr=~aa:bb~ addrtype=~mac~/><address addr=~10.1.0.', CAST(c_custkey % 250 AS STRING), '~ addrtype=~ipv4~/><hostnames><hostname name=~h', CAST(c_custkey AS STRING), '~/><hostname name=~z~/></hostnames><ports>', repeat('<port portid=~443~ protocol=~tcp~><state state=~open~/><service name=~https~/><script id=~s~/></port>', CAST(c_custkey % 4 AS INTEGER)), '</ports></host>'), '~', chr(34)) AS value FROM {{customer}}",
    "v_xml_pieces": "SELECT document, replace(concat(CASE WHEN id = least_id THEN '<?xml version=~1.0~?><!-- scan --><nmaprun args=~x~>' ELSE '' END, CASE WHEN id % 9 = 0 THEN '<taskprogress/>' ELSE '' END, '<host starttime=~', CAST(id AS STRING), '~ endtime=~', CASE WHEN id % 6 = 0 THEN 'late' ELSE CAST(id + 9 AS STRING) END, '~><status state=~up~', CASE WHEN id % 401 = 0 THEN '' ELSE '/' END, '><address addr=~10.1.0.', CAST(id % 250 AS STRING), '~ addrtype=~ipv4~/><ports><port portid=~80~ protocol=~tcp~><state state=~open~/><service name=~http~>', CASE WHEN id % 4 = 0 THEN '' ELSE concat('<cpe> cpe:', CAST(id % 13 AS STRING), ' </cpe><cpe/>') END, '</service></port></ports><hostscript><script id=~a~ output=~1 > 0~/></hostscript>'), '~', chr(34)) AS value FROM (SELECT c_custkey AS id, c_nationkey AS document, min(c_custkey) OVER (PARTITION BY c_nationkey) AS least_id FROM {customer}) c UNION ALL SELECT document, CASE document % 5 WHEN 3 THEN '<host><status' WHEN 4 THEN '</nmaprun> more' ELSE '<runstats><hosts/></runstats></nmaprun>' END FROM (SELECT DISTINCT c_nationkey AS document FROM {customer}) n",
    "v_scan_lines": "SELECT c_custkey AS id, concat('10.2.', CAST(c_nationkey AS STRING), '.', CAST(c_custkey % 250 AS STRING), CASE c_custkey % 6 WHEN 0 THEN ' is up' WHEN 1 THEN ' -> [443, 80, 443]' WHEN 2 THEN ' -> []' WHEN 3 THEN ' -> [x]' ELSE concat(' -> [', CAST(c_custkey % 1000 + 1 AS STRING), ']') END) AS value FROM {customer}",
    "v_six": "SELECT event_id, concat('2001:db8:', CASE event_id % 4 WHEN 0 THEN concat(':', CAST(event_id % 10 AS STRING)) WHEN 1 THEN concat('0:0:1:0:0:', CAST(event_id % 10 AS STRING)) WHEN 2 THEN concat('00', CAST(event_id % 10 AS STRING), '::A') ELSE '1:2:3:4:5:6:7' END) AS ip FROM {events}",
}


@_query("read_hosts_json", "SELECT '10.0.0.' || c_nationkey AS ip, 'h' || c_custkey AS hostname, 'up' AS status FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 7 > 1 AND c_custkey % 13 <> 0", "v_host_documents")
def _(docs):  # noqa: ANN001, ANN202
    return d.read_hosts_json(docs)[0].select("ip", "hostname", "status")


@_query("read_hosts_json_rejects", "SELECT CASE WHEN c_custkey % 11 = 0 THEN 'malformed' WHEN c_custkey % 7 = 0 THEN 'missing version' WHEN c_custkey % 7 = 1 THEN 'unknown version' ELSE 'bad status' END AS reason, count(*) AS n FROM customer WHERE c_custkey % 11 = 0 OR c_custkey % 7 < 2 OR c_custkey % 13 = 0 GROUP BY 1", "v_host_documents")
def _(docs):  # noqa: ANN001, ANN202
    return d.read_hosts_json(docs)[1].groupBy("reason").agg(F.count("*").alias("n"))


@_query("write_hosts_json", "SELECT document, count(*) AS hosts, CAST(sum(id % 4) AS BIGINT) AS n_ports, CAST(ceil(count(*) / 7.0) AS BIGINT) AS pieces FROM v_xml GROUP BY 1", "v_xml")
def _(xml):  # noqa: ANN001, ANN202
    ports = F.transform("ports", lambda p: F.struct(*(p[c].alias(c) for c in ("port", "protocol", "state", "service"))))
    hosts = d.hosts_from_xml(xml).select("document", "ip", "hostname", "status", "reason", ports.alias("ports"))
    text = staged(d.write_hosts_json(hosts, ["document"], 7), "documents")
    back, _rejects = d.read_hosts_json(text.select("value"))
    named = back.join(hosts.select("hostname", "document").distinct(), "hostname")
    told = named.groupBy("document").agg(F.count("*").alias("hosts"), F.sum(F.size("ports")).alias("n_ports"))
    return told.join(text.groupBy("document").agg(F.count("*").alias("pieces")), "document")


@_query("read_findings_json", "SELECT 'f' || s_suppkey AS id, 'low' AS severity, 'x' AS url FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 AND s_suppkey % 9 <> 0", "v_finding_documents")
def _(docs):  # noqa: ANN001, ANN202
    return d.read_findings_json(docs)[0].select("id", "severity", F.col("locus")["url"].alias("url"))


@_query("read_findings_json_rejects", "SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'bad severity' WHEN s_suppkey % 7 = 0 THEN 'bad confidence' ELSE 'unknown locus key' END AS reason, count(*) AS n FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 7 = 0 OR s_suppkey % 9 = 0 GROUP BY 1", "v_finding_documents")
def _(docs):  # noqa: ANN001, ANN202
    return d.read_findings_json(docs)[1].groupBy("reason").agg(F.count("*").alias("n"))


@_query("write_findings_json", "SELECT 'f' || s_suppkey AS id, 'low' AS severity, (row_number() OVER (PARTITION BY s_suppkey % 3 ORDER BY 'f' || s_suppkey) - 1) // 5 AS piece FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 AND s_suppkey % 9 <> 0", "v_finding_documents")
def _(docs):  # noqa: ANN001, ANN202
    # each document is read again on its own, with the piece it was written in
    found = d.read_findings_json(docs)[0].withColumn("batch", F.substring("id", 2, 20).cast("long") % 3)
    text = d.write_findings_json(found, ["batch"], 5)
    marked = text.select("piece", F.from_json("value", "schema_version int, findings array<struct<id:string,severity:string>>")["findings"].alias("f"))
    checked = d.read_findings_json(text.select("value"))[0]
    return marked.select("piece", F.inline("f")).join(checked.select("id"), "id", "left_semi").select("id", "severity", "piece")


@_query("read_corpus", "SELECT 's' || p_partkey AS id, p_brand AS property, p_name AS value FROM part WHERE p_partkey % 10 <> 0 AND p_brand = 'Brand#3' ORDER BY 1", "v_corpus")
def _(parts):  # noqa: ANN001, ANN202
    seed = F.struct(F.concat(F.lit("s"), "p_partkey").alias("id"), F.col("p_brand").alias("property"), F.base64(F.encode("p_name", "UTF-8")).alias("value"), F.when(F.col("p_partkey") % 10 == 0, F.lit("0")).otherwise(F.sha2("p_name", 256)).alias("sha256"))
    docs = parts.select(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.array(seed).alias("seeds"))).alias("value"))
    return d.read_corpus(docs, "Brand#3")[0].select("id", "property", F.decode("value", "UTF-8").alias("value"))


VIEWS["v_corpus"] = "SELECT p_partkey, p_brand, p_name FROM {part}"


@_query("read_receipts", "SELECT 'GET' AS method, CAST(event_id % 700 AS INT) AS status, 'abc' AS fuzz FROM events WHERE event_type <> 'view' AND event_id % 5 <> 0 AND event_id % 700 BETWEEN 100 AND 599 AND event_id % 6 <> 0 AND event_id % 8 <> 0", "v_receipt_lines")
def _(lines):  # noqa: ANN001, ANN202
    return d.read_receipts(lines)[0].select("method", "status", F.decode(F.col("input")["FUZZ"], "UTF-8").alias("fuzz"))


@_query("read_eval_reports", "SELECT report_id, case_id, name, passed FROM v_checks", "v_checks")
def _(checks):  # noqa: ANN001, ANN202
    cases = checks.groupBy("report_id", "case_id").agg(F.collect_list(F.struct("name", "passed")).alias("checks"))
    docs = cases.groupBy("report_id").agg(F.collect_list(F.struct("case_id", "checks")).alias("cases"))
    return d.read_eval_reports(docs.select(F.to_json(F.struct("report_id", "cases")).alias("value")))


@_query("read_hosts_xml", "SELECT document, '10.1.0.' || (id % 250) AS ip, 'h' || id AS hostname, CASE id % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' ELSE 'unknown' END AS status, 'r' AS reason, n_ports, n_ports AS scripts, CASE WHEN n_ports > 0 THEN 'https' END AS service FROM v_xml", "v_xml")
def _(xml):  # noqa: ANN001, ANN202
    hosts = d.hosts_from_xml(xml)
    return hosts.select("document", "ip", "hostname", "status", "reason", F.size("ports").cast("long").alias("n_ports"), F.col("scripts").cast("long").alias("scripts"), F.get("ports", F.lit(0))["service"].alias("service"))


@_query("xml_document_budgets", "SELECT document, CASE WHEN count(*) > 62 THEN 'too many hosts' WHEN sum(n_ports) > 85 THEN 'too many ports' END AS reason FROM v_xml GROUP BY 1 HAVING count(*) > 62 OR sum(n_ports) > 85", "v_xml")
def _(xml):  # noqa: ANN001, ANN202
    return d.xml_document_budgets(d.hosts_from_xml(xml), {"hosts": 62, "ports": 85})[1]


@_query("xml_documents", "SELECT c_nationkey AS document, CASE WHEN c_nationkey % 5 = 3 THEN 'truncated' ELSE 'malformed' END AS reason FROM customer GROUP BY 1 HAVING c_nationkey % 5 >= 3 OR bool_or(c_custkey % 401 = 0)", "v_xml_pieces")
def _(pieces):  # noqa: ANN001, ANN202
    return d.xml_documents(pieces)[1]


@_query("xml_hosts", "SELECT c_nationkey AS document, '10.1.0.' || (c_custkey % 250) AS ip, c_custkey AS started_at, CASE WHEN c_custkey % 6 > 0 THEN c_custkey + 9 END AS ended_at, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'cpe:' || (c_custkey % 13) END AS cpes, '1 > 0' AS output FROM customer WHERE c_nationkey NOT IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING c_nationkey % 5 >= 3 OR bool_or(c_custkey % 401 = 0))", "v_xml_pieces")
def _(pieces):  # noqa: ANN001, ANN202
    hosts = d.xml_documents(pieces)[0]
    return hosts.select("document", "ip", "started_at", "ended_at", F.array_join(F.get("ports", F.lit(0))["cpes"], ",").alias("cpes"), F.get("host_scripts", F.lit(0))["output"].alias("output"))


@_query("read_scan_lines", "SELECT split_part(value, ' ', 1) AS ip, CASE id % 6 WHEN 1 THEN '80,443' ELSE CAST(id % 1000 + 1 AS VARCHAR) END AS ports FROM v_scan_lines WHERE id % 6 IN (1, 4, 5)", "v_scan_lines")
def _(lines):  # noqa: ANN001, ANN202
    return readers.read_scan_lines(lines)[0].select("ip", F.array_join(F.transform("ports", lambda x: x.cast("string")), ",").alias("ports"))


@_query("ipv6_scope", "SELECT event_id, event_id % 4 < 2 OR (event_id % 4 = 2 AND event_id % 10 = 0) AS allowed, CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id % 10 = 0 THEN '2001:db8::' ELSE '2001:db8::' || (event_id % 10) END WHEN 1 THEN CASE WHEN event_id % 10 = 0 THEN '2001:db8:0:0:1::' ELSE '2001:db8::1:0:0:' || (event_id % 10) END WHEN 2 THEN CASE WHEN event_id % 10 = 0 THEN '2001:db8::a' ELSE '2001:db8:' || (event_id % 10) || '::a' END END AS value FROM v_six", "v_six")
def _(six):  # noqa: ANN001, ANN202
    groups = p.ipv6_groups(F.col("ip"))
    inside = p.in_network(groups, p.ipv6_groups(F.lit("2001:db8::")), F.lit(48))
    return six.select("event_id", F.coalesce(inside, F.lit(False)).alias("allowed"), p.canonical_ip(F.col("ip"))["value"].alias("value"))
