"""Row contracts and scope: each row gets the names of the rules that it breaks, so nothing is dropped unseen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.oracles import PASS, SKIP, VIOLATION, replay_verdict

from ..functions.policy import ipv6_groups, masked, span_ok
from ..functions.scalars import canonical_path, cidr_mask, ip_to_int, normalize_url, url_origin, versioned_id_ok

#: Side effects that an action may have. Fixed values.
SIDE_EFFECTS = ("none", "test_execution", "authorized_probe")
#: Sink sites of a candidate at most. Fixed value.
SITES = 32


def reasons(**rules: Column) -> Column:
    """The names of the rules that do not hold, in order, joined by commas; a rule that is null does not hold."""
    return F.array_join(F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()))), ",")


def action_contract(actions: DataFrame) -> DataFrame:
    """actions (action_id, tool, action, name, accepts, effect): a versioned id, once per tool, a name that is not blank, distinct inputs and a known side effect."""
    uses = actions.groupBy("tool", "action").agg(F.count("*").alias("uses"))
    distinct = (F.size("accepts") > 0) & (F.size(F.array_distinct("accepts")) == F.size("accepts"))
    rules = {"version": versioned_id_ok(F.col("action")), "name": F.trim("name") != "", "accepts": distinct, "effect": F.col("effect").isin(*SIDE_EFFECTS), "duplicate": F.col("uses") == 1}
    return actions.join(uses, ["tool", "action"], "left").select("action_id", reasons(**rules).alias("reasons"))


def fact_contract(facts: DataFrame) -> DataFrame:
    """facts (kind, relation, subject, object, source_hash, file, line, col, end_line, end_col, attributes) with their reasons: names are not blank, the source has a digest, the span is one below the root, attributes are a map."""
    named = lambda c: F.trim(c) != ""
    span = span_ok(F.col("file"), F.col("line"), F.col("end_line"), F.col("col"), F.col("end_col"))
    rules = {c: named(c) for c in ("kind", "relation", "subject", "object")} | {"source": F.col("source_hash").rlike("^[0-9a-f]{64}$"), "span": span, "attributes": F.col("attributes").isNotNull()}
    return facts.withColumn("reasons", reasons(**rules))


def authorize_networks(targets: DataFrame, networks: DataFrame) -> DataFrame:
    """The distinct targets (ip) and whether a network (base, prefix) holds them; no network allows nothing, nor does text that is no address.

    A target is masked once for each prefix length in use, 33 at most, and equi-joined with the networks of that length.
    """
    nets = networks.select(ip_to_int(F.col("base")).bitwiseAND(cidr_mask(F.col("prefix"))).alias("net"), F.col("prefix").cast("int").alias("prefix")).where("prefix BETWEEN 0 AND 32").distinct()
    lengths = [r[0] for r in nets.select("prefix").distinct().collect()]
    asked = targets.select("ip").distinct()
    if not lengths:
        return asked.withColumn("allowed", F.lit(False))
    each = asked.withColumn("prefix", F.explode(F.array(*map(F.lit, sorted(lengths))))).withColumn("net", ip_to_int(F.col("ip")).bitwiseAND(cidr_mask(F.col("prefix"))))
    held = each.join(nets.withColumn("hit", F.lit(True)), ["net", "prefix"], "left")
    return held.groupBy("ip").agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("allowed"))


def authorize_ips(targets: DataFrame, networks: DataFrame, hostnames: DataFrame) -> DataFrame:
    """The distinct targets (target) and whether they are in scope: an address or network (base/prefix) within an allowed network (base, prefix) of its family, or a host name (hostname) that is allowed by itself. Without rules nothing is.

    Addresses are masked once for each prefix length in use that is no longer than their own,
    33 and 129 at most, and equi-joined with the networks of that length.
    """
    base, own = F.split_part("target", F.lit("/"), F.lit(1)), F.split_part("target", F.lit("/"), F.lit(2))
    four, six = ip_to_int(F.col("base")), ipv6_groups(F.col("base"))
    most = F.when(four.isNotNull(), 32).when(six.isNotNull(), 128)
    family = F.when(four.isNotNull(), 4).when(six.isNotNull(), 6)
    key = lambda prefix: F.when(F.col("family") == 4, four.bitwiseAND(cidr_mask(prefix)).cast("string")).otherwise(F.array_join(masked(six, prefix), ":"))
    nets = networks.select("base", F.col("prefix").cast("int").alias("prefix")).withColumn("family", family).where(F.col("prefix").between(0, most))
    nets = nets.select("family", "prefix", key(F.col("prefix")).alias("net")).distinct()
    lengths = sorted(tuple(r) for r in nets.select("family", "prefix").distinct().collect())
    asked = targets.select("target").distinct()
    parsed = asked.withColumn("base", base).withColumn("family", family).withColumn("own", F.when(own == "", most).otherwise(F.when(own.try_cast("int").between(0, most), own.try_cast("int"))))
    rules = F.array(*(F.struct(F.lit(f).alias("f"), F.lit(n).alias("n")) for f, n in lengths)) if lengths else F.array().cast("array<struct<f:int,n:int>>")
    each = parsed.withColumn("rule", F.explode(rules)).where("rule.f = family AND rule.n <= own")
    held = each.select("target", "family", F.col("rule.n").alias("prefix"), key(F.col("rule.n")).alias("net")).join(nets, ["family", "prefix", "net"], "left_semi").select("target")
    named = asked.join(hostnames.select(F.col("hostname").alias("target")), "target", "left_semi")
    return asked.join(held.union(named).distinct().withColumn("hit", F.lit(True)), "target", "left").select("target", F.coalesce("hit", F.lit(False)).alias("allowed"))


def authorize_urls(targets: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct targets (url) and whether a rule (scheme, host, port, path, subdomains) holds them.

    Scheme and port are equal; the host is the rule's, or strictly below it where the rule is
    for subdomains; the path is the rule's or below it on a segment's border. A target is
    joined by its host's endings and its path's beginnings, so no rule is compared with all
    targets. Addresses that are not normal, and null, are denied.
    """
    asked = targets.select("url").distinct()
    origin, u = url_origin(F.col("url")), normalize_url(F.col("url"))
    parts = asked.select("url", origin["scheme"].alias("scheme"), origin["port"].alias("port"), F.split(origin["host"], r"\.").alias("labels"), canonical_path(F.regexp_extract(u, r"^https?://[^/?]+([^?]*)", 1)).alias("p"))
    parts = parts.where("scheme IS NOT NULL AND p IS NOT NULL").withColumn("segments", F.filter(F.split("p", "/"), lambda x: x != ""))
    hosts = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.struct((i > 1).alias("subdomains"), F.array_join(F.slice("labels", i, F.size("labels")), ".").alias("host")))
    paths = F.transform(F.sequence(F.lit(0), F.size("segments")), lambda i: F.concat(F.lit("/"), F.array_join(F.slice("segments", F.lit(1), i), "/")))
    keys = parts.withColumn("h", F.explode(hosts)).select("url", "scheme", "port", F.col("h.host").alias("host"), F.col("h.subdomains").alias("subdomains"), F.explode(paths).alias("path"))
    on = ["scheme", "port", "host", "subdomains", "path"]
    hit = keys.join(rules.select(*on).distinct(), on, "left_semi").select("url").distinct().withColumn("hit", F.lit(True))
    return asked.join(hit, "url", "left").select("url", F.coalesce("hit", F.lit(False)).alias("allowed"))


def scope_split(plans: DataFrame, allowed: DataFrame) -> DataFrame:
    """plans (plan, target) with allowed (target, allowed): targets, those denied, and whether the plan may run; one denied target denies it."""
    judged = plans.join(allowed, "target", "left")
    return judged.groupBy("plan").agg(F.count("*").alias("targets"), F.count_if(~F.coalesce("allowed", F.lit(False))).alias("denied")).withColumn("granted", F.col("denied") == 0)


def build_candidates(definitions: DataFrame, sink_calls: DataFrame) -> DataFrame:
    """Per definition (subject) its distinct sink sites (subject, site): unique with one, ambiguous with more; none and over SITES are rejected with a reason."""
    n = sink_calls.groupBy("subject").agg(F.count_distinct("site").alias("sites"))
    state = F.when(F.col("sites") == 0, "no_site").when(F.col("sites") > SITES, "too_many_sites").when(F.col("sites") == 1, "unique").otherwise("ambiguous")
    return definitions.select("subject").distinct().join(n, "subject", "left").na.fill(0, ["sites"]).withColumn("state", state)


def control_matrix(validations: DataFrame) -> DataFrame:
    """validations (case_id, role, verdict): whether all vulnerable runs are confirmed, fixed ones refuted and failing ones inconclusive, and the confirmations that are false."""
    holds = lambda role, verdict: F.coalesce(F.bool_and(F.when(F.col("role") == role, F.col("verdict") == verdict)), F.lit(False))
    false = F.count_if((F.col("role") != "vulnerable") & (F.col("verdict") == "confirmed"))
    return validations.groupBy("case_id").agg(holds("vulnerable", "confirmed").alias("vulnerable"), holds("fixed", "refuted").alias("fixed"), holds("failure", "inconclusive").alias("failure"), false.alias("false_confirmations"))


def oracle_report(results: DataFrame) -> DataFrame:
    """(input, passed, skipped, violations, verdict) of results (input, place, name, result): the names of each result in the order in which they were declared, and what they decide."""
    named = F.array_sort(F.collect_list(F.struct("place", "name", "result")))
    of = lambda result: F.transform(F.filter("all", lambda r: r["result"] == result), lambda r: r["name"])
    out = results.groupBy("input").agg(named.alias("all")).select("input", of(PASS).alias("passed"), of(SKIP).alias("skipped"), of(VIOLATION).alias("violations"))
    return out.withColumn("verdict", replay_verdict(F.size("violations"), F.size("skipped")))


def replay_matrix(validations: DataFrame, replays: DataFrame) -> DataFrame:
    """`control_matrix` of validations (case_id, role, verdict, seed_id, findings), with the replays of each case and how many of them repeat verdict, seed and findings (in any order) of every validation of their role."""
    key = F.struct("verdict", "seed_id", F.array_sort(F.coalesce("findings", F.array().cast("array<string>"))).alias("findings"))
    told = validations.groupBy("case_id", "role").agg(F.min(key).alias("least"), F.max(key).alias("most"))
    again = replays.withColumn("mine", key).join(told, ["case_id", "role"], "left")
    equal = F.coalesce((F.col("mine") == F.col("least")) & (F.col("mine") == F.col("most")), F.lit(False))
    counts = again.groupBy("case_id").agg(F.count("*").alias("replays"), F.count_if(equal).alias("replays_equal"))
    return control_matrix(validations).join(counts, "case_id", "left").na.fill(0, ["replays", "replays_equal"])
