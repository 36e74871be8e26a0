"""Versioned documents of hosts, findings, seeds, receipts and reports: rows of what is valid, and rejects with a reason.

Each reader takes a table with one document a row in `value`; spark.read.text(path,
wholetext=True) or a stream of lines gives one. A document is valid as a whole or rejected as
a whole. Documents are parsed by built-in functions with fixed schemas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.findings import CONFIDENCES, SEVERITIES
from ..operators.policy import include_minus_exclude, inventory_id
from ..operators.scan import numbered
from ..staging import staged

VERSION = 1
STATUSES = ("up", "down", "unknown")
LOCUS = ("url", "method", "host", "param", "keyword", "input", "status", "length", "words", "lines", "content_type", "identity_version", "ip", "port", "file", "line")
HOST = "ip string, hostname string, status string, reason string, ports array<struct<port int, protocol string, state string, service string>>"
FINDING = "id string, source string, category string, severity string, confidence string, evidence string, locus map<string,string>"


def _judged(documents: DataFrame, schema: str, reason) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """Parsed documents with d, and rejects (value, reason): malformed ones, those of another version, and what `reason` names."""
    parsed = documents.withColumn("d", F.from_json("value", f"schema_version int, {schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.when(F.col("d").isNull() | F.col("d._corrupt").isNotNull(), "malformed").when(F.col("d.schema_version").isNull(), "missing version").when(F.col("d.schema_version") != VERSION, "unknown version").otherwise(reason(F.col("d")))
    marked = parsed.withColumn("why", bad)
    return marked.where("why IS NULL"), marked.where("why IS NOT NULL").select("value", F.col("why").alias("reason"))


def read_hosts_json(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hosts, rejects) of {schema_version, hosts}: hosts are (ip, hostname, status, reason, ports)."""
    bad = lambda d: F.when(d["hosts"].isNull(), "no hosts").when(F.exists(d["hosts"], lambda h: ~F.coalesce(h["status"].isin(*STATUSES), F.lit(False))), "bad status")
    good, rejects = _judged(documents, f"hosts array<struct<{HOST.replace(' array', ':array').replace(' string', ':string').replace('port int', 'port:int')}>>", bad)
    return good.select(F.inline("d.hosts")), rejects


#: Rows of one document, at most.
ROWS = 10_000


def _cut(rows: DataFrame, by: list[str], order: str, most: int) -> DataFrame:
    """rows with piece: a group's rows in their order, `most` to a piece. Rows are numbered by a scan, so no task holds a group."""
    return numbered(rows, by, [order], "_place").withColumn("piece", F.floor((F.col("_place") - 1) / most)).drop("_place")


def write_hosts_json(hosts: DataFrame, by: list[str], most: int = ROWS) -> DataFrame:
    """(by, piece, value): documents of the hosts of each group, `most` in one; hosts are sorted, so equal hosts make equal documents."""
    row = F.struct("ip", "hostname", "status", "reason", "ports")
    cut = _cut(hosts.withColumn("_host", row), by, "_host", most)
    listed = cut.groupBy(*by, "piece").agg(F.array_sort(F.collect_list("_host")).alias("hosts"))
    return listed.select(*by, "piece", F.to_json(F.struct(F.lit(VERSION).alias("schema_version"), "hosts")).alias("value"))


def read_findings_json(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, rejects) of {schema_version, findings}: severities (or none), confidences and the keys of loci are checked."""

    def bad(d: Column) -> Column:
        severity = F.exists(d["findings"], lambda f: f["severity"].isNotNull() & ~f["severity"].isin(*SEVERITIES))
        confidence = F.exists(d["findings"], lambda f: ~F.coalesce(f["confidence"].isin(*CONFIDENCES), F.lit(False)))
        locus = F.exists(d["findings"], lambda f: F.size(F.array_except(F.map_keys(F.coalesce(f["locus"], F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))), F.array(*map(F.lit, LOCUS)))) > 0)
        return F.when(d["findings"].isNull(), "no findings").when(severity, "bad severity").when(confidence, "bad confidence").when(locus, "unknown locus key")

    good, rejects = _judged(documents, "findings array<struct<id:string,source:string,category:string,severity:string,confidence:string,evidence:string,locus:map<string,string>>>", bad)
    return good.select(F.inline("d.findings")), rejects


def write_findings_json(findings: DataFrame, by: list[str], most: int = ROWS) -> DataFrame:
    """(by, piece, value): documents of the findings of each group, sorted by id, `most` in one."""
    row = F.struct("id", "source", "category", "severity", "confidence", "evidence", "locus")
    # maps have no order: the rows are sorted by their id
    cut = _cut(findings, by, "id", most)
    listed = cut.groupBy(*by, "piece").agg(F.array_sort(F.collect_list(row), lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)).alias("findings"))
    return listed.select(*by, "piece", F.to_json(F.struct(F.lit(VERSION).alias("schema_version"), "findings")).alias("value"))


def read_corpus(documents: DataFrame, property_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(seeds, rejects) of {schema_version, seeds}: values are base64 and must have the digest that is noted; seeds are sorted by id, of one property if it is given."""
    value = lambda s: F.try_to_binary(s["value"], F.lit("base64"))
    bad = lambda d: F.when(d["seeds"].isNull(), "no seeds").when(F.exists(d["seeds"], lambda s: value(s).isNull()), "bad value").when(F.exists(d["seeds"], lambda s: ~F.coalesce(F.sha2(value(s), 256) == s["sha256"], F.lit(False))), "digest mismatch")
    good, rejects = _judged(documents, "seeds array<struct<id:string,property:string,value:string,sha256:string>>", bad)
    seeds = good.select(F.inline("d.seeds")).withColumn("value", F.unbase64("value"))
    if property_id is not None:
        seeds = seeds.where(F.col("property") == property_id)
    return seeds.orderBy("id"), rejects


def read_receipts(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(receipts, others) of audit lines: answers that were completed, not cancelled, with a status of 100 to 599, no error, and inputs that decode."""
    d = F.from_json("value", "type string, cancelled boolean, status int, error string, method string, input map<string,string>")
    parsed = lines.withColumn("d", d)
    decoded = F.transform_values(F.col("d.input"), lambda _, x: F.try_to_binary(x, F.lit("base64")))
    ok = (F.col("d.type") == "response") & ~F.coalesce("d.cancelled", F.lit(False)) & F.col("d.status").between(100, 599) & (F.coalesce("d.error", F.lit("")) == "") & F.col("d.method").isNotNull()
    ok = F.coalesce(ok & F.forall(F.map_values(decoded), lambda x: x.isNotNull()), F.lit(False))
    return parsed.where(ok).select("d.method", "d.status", decoded.alias("input")), parsed.where(~ok).select("value")


def read_eval_reports(documents: DataFrame) -> DataFrame:
    """(report_id, case_id, name, passed): a row for each check of each case of {report_id, cases}."""
    d = F.from_json("value", "report_id long, cases array<struct<case_id:string,checks:array<struct<name:string,passed:boolean>>>>")
    cases = documents.select(d.alias("d")).select("d.report_id", F.explode("d.cases").alias("c"))
    return cases.select("report_id", F.col("c.case_id").alias("case_id"), F.explode("c.checks").alias("k")).select("report_id", "case_id", "k.*")


def read_eval_metrics(documents: DataFrame) -> DataFrame:
    """(report_id, runtime, case_id, metric, value): a row for each metric of each case of {report_id, runtime, cases}; a case without metrics has none."""
    d = F.from_json("value", "report_id long, runtime string, cases array<struct<case_id:string,metrics:map<string,double>>>")
    cases = documents.select(d.alias("d")).select("d.report_id", "d.runtime", F.explode("d.cases").alias("c"))
    return cases.select("report_id", "runtime", F.col("c.case_id").alias("case_id"), F.explode("c.metrics").alias("metric", "value"))


#: A scanner's host element. Fixed names.
_SCRIPT = "script array<struct<_id string, _output string>>"
_PORT = f"struct<_portid string, _protocol string, state struct<_state string>, service struct<_name string, _product string, _version string, cpe array<string>>, {_SCRIPT}>"
_OS = "array<struct<_name string, _accuracy string, osclass array<struct<cpe array<string>>>>>"
XML = f"_starttime string, _endtime string, status struct<_state string, _reason string>, address array<struct<_addr string, _addrtype string>>, hostnames struct<hostname array<struct<_name string>>>, ports struct<port array<{_PORT}>>, hostscript struct<{_SCRIPT}>, os struct<osmatch {_OS}>, _bad string"
#: What one document may hold.
LIMITS = {"hosts": 1_024, "ports": 65_536, "scripts": 16_384, "bytes": 16_777_216, "elements": 100_000, "script_nodes": 65_536, "text_bytes": 8_388_608, "depth": 64, "scalar_bytes": 65_536}
_SUMS, _PEAKS = ("ports", "scripts", "bytes", "elements", "script_nodes", "text_bytes"), ("depth", "scalar_bytes")
#: A tag, whatever its attributes hold, and an attribute's value.
_TAG = r"""<(?:/|[A-Za-z_])(?:[^>"']|"[^"]*"|'[^']*')*>"""
_VALUE = r"""=\s*(?:"([^"]*)"|'([^']*)')"""


def _or_none(column: Column, kind: str) -> Column:
    return F.coalesce(column, F.array().cast(kind))


def _depth(value: Column) -> Column:
    """The deepest nesting of a fragment's tags."""
    step = lambda tag: F.when(F.startswith(tag, F.lit("</")), -1).when(F.endswith(tag, F.lit("/>")), 0).otherwise(1)
    top = lambda d, tag: F.when(F.startswith(tag, F.lit("</")), d).otherwise(d + 1)
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))
    return F.aggregate(F.regexp_extract_all(value, F.lit(_TAG), F.lit(0)), start, lambda s, tag: F.struct((s["d"] + step(tag)).alias("d"), F.greatest(s["m"], top(s["d"], tag)).alias("m")), lambda s: s["m"])


def hosts_from_xml(elements: DataFrame) -> DataFrame:
    """Hosts of host elements (document, value), none of a document with an element that is not well-formed.

    (document, ip, hostname, hostnames, status, reason, started_at, ended_at, ports, scripts, os,
    os_matches, host_scripts, and what budgets count: bytes, elements, script_nodes, text_bytes,
    depth, scalar_bytes). ip is the last address of IP kind, hostname the first name, statuses
    other than up and down are unknown, numbers that are none are null, CPEs are trimmed.
    """
    # parsing is most of the work: it is done once, by all tasks, however few files the elements come from
    tasks = int(elements.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = _host_rows(staged(_parsed(elements.repartition(tasks, F.xxhash64("document", "value"))), "elements"))
    broken = told.where("malformed").select("document").distinct()
    return told.join(broken, told["document"].eqNullSafe(broken["document"]), "left_anti").drop("malformed")


def _parsed(elements: DataFrame) -> DataFrame:
    return elements.select("document", "value", F.from_xml("value", XML, {"columnNameOfCorruptRecord": "_bad"}).alias("h"))


def _host_rows(parsed: DataFrame) -> DataFrame:
    values = F.regexp_extract_all("value", F.lit(_VALUE), F.lit(1))
    sizes = F.transform(values, F.octet_length)
    x = parsed.select(
        "document", "h", F.octet_length("value").cast("long").alias("bytes"),
        F.regexp_count("value", F.lit("<[A-Za-z_]")).cast("long").alias("elements"), F.regexp_count("value", F.lit(r"<(?:table|elem)[\s>/]")).cast("long").alias("script_nodes"),
        F.aggregate(sizes, F.lit(0).cast("long"), lambda n, k: n + k).alias("text_bytes"), _depth(F.col("value")).cast("long").alias("depth"), F.coalesce(F.array_max(sizes), F.lit(0)).cast("long").alias("scalar_bytes"),
    )
    address = F.filter("h.address", lambda a: a["_addrtype"].isin("ipv4", "ipv6"))
    script = "array<struct<_id:string,_output:string>>"
    scripts = lambda c: F.transform(_or_none(c, script), lambda k: F.struct(k["_id"].alias("id"), k["_output"].alias("output")))
    cpes = lambda c: F.filter(F.transform(_or_none(c, "array<string>"), lambda t: F.trim(t)), lambda t: t != "")
    ports = _or_none(F.col("h.ports.port"), f"array<{_PORT}>")
    matches = _or_none(F.col("h.os.osmatch"), _OS)
    names = F.transform(_or_none(F.col("h.hostnames.hostname"), "array<struct<_name:string>>"), lambda n: n["_name"])
    port = lambda p: F.struct(
        p["_portid"].try_cast("int").alias("port"), p["_protocol"].alias("protocol"), p["state"]["_state"].alias("state"), p["service"]["_name"].alias("service"),
        p["service"]["_product"].alias("product"), p["service"]["_version"].alias("version"), cpes(p["service"]["cpe"]).alias("cpes"), scripts(p["script"]).alias("scripts"),
    )
    return x.select(
        "document",
        F.try_element_at(address, F.lit(-1))["_addr"].alias("ip"),
        F.get(names, F.lit(0)).alias("hostname"),
        names.alias("hostnames"),
        F.when(F.col("h.status._state").isin("up", "down"), F.col("h.status._state")).otherwise("unknown").alias("status"),
        F.col("h.status._reason").alias("reason"),
        F.col("h._starttime").try_cast("long").alias("started_at"),
        F.col("h._endtime").try_cast("long").alias("ended_at"),
        F.transform(ports, port).alias("ports"),
        (F.aggregate(ports, F.lit(0), lambda n, p: n + F.greatest(F.size(p["script"]), F.lit(0))) + F.greatest(F.size(F.col("h.hostscript.script")), F.lit(0))).alias("scripts"),
        F.transform(matches, lambda o: o["_name"]).alias("os"),
        F.transform(matches, lambda o: F.struct(o["_name"].alias("name"), o["_accuracy"].try_cast("int").alias("accuracy"), F.flatten(F.transform(_or_none(o["osclass"], "array<struct<cpe:array<string>>>"), lambda k: cpes(k["cpe"]))).alias("cpes"))).alias("os_matches"),
        scripts(F.col("h.hostscript.script")).alias("host_scripts"),
        "bytes", "elements", "script_nodes", "text_bytes", "depth", "scalar_bytes",
        (F.col("h").isNull() | F.col("h._bad").isNotNull()).alias("malformed"),
    )


def xml_documents(pieces: DataFrame, root: str = "nmaprun") -> tuple[DataFrame, DataFrame]:
    """(hosts, (document, reason) of the documents that are rejected) of pieces (document, value): the texts of documents cut at, and without, each `</host>`, in any order.

    A document is taken as a whole or not at all. One of its pieces opens the root element and
    one, which begins no host, closes it; that is the last, as a document that was cut off has none. Each
    host, and what stands between hosts, is well-formed. So a document is `truncated` without
    the end of its root, `malformed` otherwise. `</host>` within a comment or CDATA makes it malformed too.
    A document that has no host at all is one piece, and gives no row of either table if it is well-formed.
    """
    begins, close = rf"(?s)^(.*?)<{root}(?:\s[^>]*)?>", rf"(?s)^(.*?)</{root}\s*>\s*(?:<!--.*?-->\s*)*$"
    opens = F.col("value").rlike(begins) & ~F.regexp_extract("value", begins, 1).rlike("<host[\\s>]")
    # what opens the root may stand behind a declaration, instructions and comments only
    head = F.regexp_extract("value", begins, 1).rlike(r"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE\s+[A-Za-z_]+(?:\s+[^>\[]*)?>\s*)*$")
    inner = F.when(opens, F.regexp_replace("value", begins, "")).otherwise(F.col("value"))
    ends = F.col("inner").rlike(rf"</{root}\s*>")
    p = pieces.select("document", "value", opens.alias("opens"), (opens & ~head).alias("bad_head"), inner.alias("inner")).withColumn("ends", ends)
    p = p.withColumn("bad_end", F.col("ends") & ~F.col("inner").rlike(close)).withColumn("inner", F.when(F.col("ends"), F.regexp_extract("inner", close, 1)).otherwise(F.col("inner")))
    host = F.regexp_extract("inner", r"(?s)(<host[\s>].*)$", 1)
    p = p.withColumn("host", host).withColumn("between", F.expr("left(inner, length(inner) - length(host))"))
    # what stands between hosts is checked as an element of its own
    text = F.from_xml(F.concat(F.lit("<between>"), "between", F.lit("</between>")), "_bad string", {"columnNameOfCorruptRecord": "_bad"})
    p = p.withColumn("text", text).withColumn("bad_text", (F.trim("between") != "") & (F.col("text").isNull() | F.col("text._bad").isNotNull()))
    p = p.withColumn("begins", F.col("host") != "")
    elements = p.where("begins").select("document", F.concat("host", F.lit("</host>")).alias("value"))
    told = staged(_host_rows(_parsed(elements)), "hosts")
    forms = p.groupBy("document").agg(F.count_if("opens").alias("opens"), F.count_if("ends").alias("ends"), F.count_if((F.col("ends") == F.col("begins")) | F.col("bad_head") | F.col("bad_end") | F.col("bad_text")).alias("bad"))
    broken = told.where("malformed").select("document", F.lit(True).alias("broken")).distinct()
    reason = F.when(F.col("ends") == 0, "truncated").when((F.col("opens") != 1) | (F.col("ends") != 1) | (F.col("bad") > 0) | F.col("broken"), "malformed")
    failed = staged(forms.join(broken, "document", "left").select("document", reason.alias("reason")).where("reason IS NOT NULL"), "failed")
    return told.join(failed, "document", "left_anti").drop("malformed"), failed


def read_hosts_xml(spark: SparkSession, path: str) -> DataFrame:
    """Host rows of scanner files, a file being a document. Files are split at host elements, so one file feeds many tasks; a file that is not well-formed as a whole gives no row."""
    return xml_documents(xml_pieces(spark, path))[0]


def xml_pieces(spark: SparkSession, path: str) -> DataFrame:
    """(document, value): the files below a path, each cut at the ends of its hosts."""
    return spark.read.option("lineSep", "</host>").text(path).select(F.col("_metadata.file_path").alias("document"), "value")


def xml_document_budgets(hosts: DataFrame, limits: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(hosts of documents within all limits, (document, reason) of the others): one excess fails the whole document. What stands outside hosts is not counted."""
    limits = LIMITS | (limits or {})
    size = lambda c: F.sum(F.size(c) if c == "ports" else F.col(c))
    sums = hosts.groupBy("document").agg(F.count("*").alias("hosts"), *(size(c).alias(c) for c in _SUMS), *(F.max(c).alias(c) for c in _PEAKS))
    names = {c: f"too many {c}" for c in ("hosts", *_SUMS)} | {"depth": "too deep", "scalar_bytes": "too long a value"}
    reason = F.coalesce(*(F.when(F.col(c) > limits[c], text) for c, text in names.items()))
    failed = sums.select("document", reason.alias("reason")).where("reason IS NOT NULL")
    return hosts.join(failed, hosts["document"].eqNullSafe(failed["document"]), "left_anti"), failed


def discover_sources(spark: SparkSession, root: str, include: list[str], exclude: list[str]) -> DataFrame:
    """(path, bytes) of the files below a folder whose path from it matches; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("full"), F.col("length").alias("bytes"))
    # the folder's name ends where its own last part ends
    name = root.rstrip("/").rsplit("/", 1)[-1]
    rows = found.select(F.substring_index("full", f"/{name}/", -1).alias("path"), "bytes")
    return rows.join(include_minus_exclude(rows, include, exclude), "path", "left_semi")


def write_inventory_artifact(facts: DataFrame, owners: DataFrame, path: str, most: int) -> DataFrame:
    """Writes facts (with id) under the digest of their ids, and gives the manifest (inventory_id, facts, bytes); above `most` bytes of JSON nothing is written. The digest and the size are computed once."""
    size = facts.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*facts.columns)))), F.lit(0)).alias("bytes"))
    manifest = staged(inventory_id(facts, owners).join(F.broadcast(size)), "manifest")
    row = manifest.first()
    if row["bytes"] > most:
        raise ValueError(f"an inventory of {row['bytes']} bytes is above {most}")
    facts.write.mode("overwrite").parquet(f"{path}/{row['inventory_id']}/facts")
    manifest.write.mode("overwrite").json(f"{path}/{row['inventory_id']}/manifest")
    return manifest
