"""Findings of all tools: projection, provenance, one bus, suppression and roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import input_signature, normalize_url, stable_id

#: Severities and confidences. Fixed values.
SEVERITIES, CONFIDENCES = ("info", "low", "medium", "high", "critical"), ("low", "medium", "high")
COLUMNS = ("id", "source", "category", "severity", "confidence", "evidence", "locus")


def findings_from_hosts(hosts: DataFrame) -> DataFrame:
    """One finding per open port of a host that is up; hosts (ip, status, ports array<struct<port, protocol, state, service>>)."""
    port = hosts.where("status = 'up'").select("ip", F.explode("ports").alias("p")).where("p.state = 'open'")
    protocol = F.coalesce("p.protocol", F.lit("tcp"))
    where = F.concat(F.col("p.port").cast("string"), F.lit("/"), protocol)
    served = F.col("p.service").isNotNull()
    return port.select(
        stable_id("ports", F.col("ip"), F.col("p.port"), protocol).alias("id"),
        F.lit("ports").alias("source"),
        F.when(served, "exposed_service").otherwise("open_port").alias("category"),
        F.lit("info").alias("severity"),
        F.lit("high").alias("confidence"),
        F.concat(where, F.lit(" open"), F.when(served, F.concat(F.lit(" ("), F.col("p.service"), F.lit(")"))).otherwise("")).alias("evidence"),
        F.concat("ip", F.lit(":"), F.col("p.port").cast("string")).alias("locus"),
    )


def match_category(point: F.Column) -> F.Column:
    """The category of a match by its primary fuzz point (location, name)."""
    host = (point["location"] == "header") & (F.lower(point["name"]) == "host")
    return F.when(host, "vhost").when(point["location"].isin("query", "body", "cookie"), "param_injection").when(point["location"] == "url", "exposed_path").otherwise("matched_response")


def primary_fuzz_point(points: F.Column, given: F.Column) -> F.Column:
    """Of points (array of place, keyword, location, name): among those whose keyword the input has the Host header's, then one in query, body or cookie, then the first; without any the first of all."""
    host = lambda p: (p["location"] == "header") & (F.lower(p["name"]) == "host")
    rank = lambda p: F.when(host(p), 0).when(p["location"].isin("query", "body", "cookie"), 1).otherwise(2)
    as_ranked = lambda r: lambda p: F.struct(r(p).alias("rank"), *(p[c].alias(c) for c in ("place", "keyword", "location", "name")))
    able = F.filter(points, lambda p: F.map_contains_key(given, p["keyword"]))
    return F.coalesce(F.array_min(F.transform(able, as_ranked(rank))), F.array_min(F.transform(points, as_ranked(lambda _: F.lit(0)))))


def findings_from_matches(matches: DataFrame, jobs: DataFrame, points: DataFrame) -> DataFrame:
    """One finding per HTTP match (job_id, url, status, length, input) with its job (job_id, method, keywords) and the job's fuzz points (job_id, place, keyword, location, name).

    A finding is known by its job's method, its address, category and point, and the values of
    all declared keywords. A match has no severity of its own.
    """
    listed = points.groupBy("job_id").agg(F.collect_list(F.struct("place", "keyword", "location", "name")).alias("points"))
    joined = matches.join(jobs, "job_id", "left").join(listed, "job_id", "left").withColumn("point", primary_fuzz_point(F.col("points"), F.col("input")))
    signature = F.when(F.col("keywords").isNotNull(), F.array_join(F.transform(input_signature(F.col("input"), F.col("keywords")), lambda e: F.concat(e["key"], F.lit("="), F.length(e["value"]).cast("string"), F.lit(":"), e["value"])), ";"))
    category = match_category(F.col("point"))
    keyword = F.coalesce("point.keyword", F.array_min(F.map_keys("input")))
    value = F.coalesce(F.concat(F.lit('"'), F.try_element_at("input", keyword), F.lit('"')), F.lit("nil"))
    what = F.concat(F.lit("matched HTTP "), F.col("status").cast("string"), F.lit(", length="), F.col("length").cast("string"))
    url = F.coalesce(normalize_url(F.col("url")), F.col("url"))
    return joined.select(
        stable_id("http", F.lit("http_match"), F.col("method"), url, category, F.coalesce("point.name", "point.location"), signature).alias("id"),
        F.lit("http").alias("source"),
        category.alias("category"),
        F.lit(None).cast("string").alias("severity"),
        F.lit("medium").alias("confidence"),
        F.when(keyword.isNull(), what).otherwise(F.concat(what, F.lit(", "), keyword, F.lit("="), value)).alias("evidence"),
        url.alias("locus"),
    )


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first in an order that must be total within it."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return first_wins(df, keys, [F.desc(c) for c in order])


def seed_provenance(matches: DataFrame, seeds: DataFrame) -> DataFrame:
    """matches (match_id, keyword, value) with the first seed (keyword, value, seed_id) of their value, or null."""
    return matches.join(first_wins(seeds, ["keyword", "value"], ["seed_id"]), ["keyword", "value"], "left")


def match_seeds(matches: DataFrame, seeds: DataFrame) -> DataFrame:
    """(match_id, keyword, value, seed_id): the one seed of each match (match_id, input: a map of keywords and values).

    Seeds (keyword, place: the keyword's in the wordlists, seq, value, seed_id): the first of a
    keyword and value counts, and of a match's keywords the first in the order of the
    wordlists that has one. Null where none has.
    """
    first = first_wins(seeds, ["keyword", "value"], ["place", "seq", "seed_id"])
    asked = matches.select("match_id", F.explode_outer("input").alias("keyword", "value"))
    found = asked.join(first, ["keyword", "value"]).groupBy("match_id").agg(F.min(F.struct("place", "keyword", "value", "seed_id")).alias("s"))
    return matches.select("match_id").join(found, "match_id", "left").select("match_id", "s.keyword", "s.value", "s.seed_id")


def finding_bus(*tables: DataFrame) -> DataFrame:
    """All tools' findings, one row per id: the row that is least in its columns stays."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return every.groupBy("id").agg(F.min(F.struct(*(c for c in every.columns if c != "id"))).alias("row")).select("id", "row.*")


def finding_rollup(findings: DataFrame) -> DataFrame:
    """Counts by source, category, severity and confidence with all subtotals; level tells which."""
    return findings.cube("source", "category", "severity", "confidence").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def verdict_rollup(validations: DataFrame, findings: DataFrame | None = None, actions: DataFrame | None = None) -> DataFrame:
    """Counts of each verdict by tool and action; with findings (validation_id) of validations (id) the number of theirs, with actions (tool, action, effect) the class of side effects, null where it is not declared once."""
    rows = validations
    if findings is not None:
        mine = findings.groupBy(F.col("validation_id").alias("id")).agg(F.count("*").alias("_mine"))
        rows = rows.join(mine, "id", "left")
    more = [F.coalesce(F.sum("_mine"), F.lit(0)).alias("findings")] if findings is not None else []
    verdicts = [F.count_if(F.col("verdict") == v).alias(v) for v in ("confirmed", "refuted", "inconclusive")]
    out = rows.groupBy("tool", "action").agg(*verdicts, *more)
    if actions is None:
        return out
    effects = actions.groupBy("tool", "action").agg(F.min("effect").alias("least"), F.max("effect").alias("most"), F.count("effect").alias("n"), F.count("*").alias("rows"))
    one = F.when((F.col("least") == F.col("most")) & (F.col("n") == F.col("rows")), F.col("least"))
    return out.join(effects.select("tool", "action", one.alias("effect")), ["tool", "action"], "left")


def active_and_suppressed(observations: DataFrame, suppressions: DataFrame) -> DataFrame:
    """observations with the least reason of a suppression of their rule, file and line; null where active."""
    reasons = suppressions.groupBy("rule_id", "file", F.col("target_line").alias("line")).agg(F.min("reason").alias("reason"))
    return observations.join(reasons, ["rule_id", "file", "line"], "left").withColumn("state", F.when(F.col("reason").isNull(), "active").otherwise("suppressed"))


def revalidate(candidates: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Verdict of each candidate (keys, complete): seen again, absent from a complete observation, or unknown."""
    seen = current.select(*keys).distinct().withColumn("seen", F.lit(True))
    return candidates.join(seen, keys, "left").withColumn("verdict", F.when(F.col("seen"), "confirmed").when(F.col("complete"), "refuted").otherwise("inconclusive")).drop("seen")


def receipt_gate(candidates: DataFrame, receipts: DataFrame, keys: list[str]) -> DataFrame:
    """A candidate that was not reproduced is refuted only with a receipt of its keys."""
    got = receipts.select(*keys).distinct().withColumn("got", F.lit(True))
    return candidates.join(got, keys, "left").withColumn("verdict", F.when(F.col("reproduced"), "confirmed").when(F.col("got"), "refuted").otherwise("inconclusive")).drop("got")


def validation_contract(validations: DataFrame, findings: DataFrame) -> DataFrame:
    """Reasons against each validation (id, tool, verdict, seed_id) with its findings (validation_id, source, severity, confidence, evidence): an unknown verdict, no seed, or findings that don't fit it or their own rules; empty for a valid one."""
    bad = lambda ok: F.count_if(~F.coalesce(ok, F.lit(False)))
    counts = findings.groupBy(F.col("validation_id").alias("id")).agg(
        F.count("*").alias("n"),
        F.count_if(~F.col("source").eqNullSafe(F.col("tool"))).alias("foreign"),
        bad(F.col("severity").isNull() | F.col("severity").isin(*SEVERITIES)).alias("severity"),
        bad(F.col("confidence").isin(*CONFIDENCES)).alias("confidence"),
        bad(F.trim("evidence") != "").alias("evidence"),
    )
    n, some = F.coalesce("n", F.lit(0)), lambda c: F.coalesce(c, F.lit(0)) > 0
    reasons = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("verdict").isin("confirmed", "refuted", "inconclusive"), F.lit(False)), "verdict"),
            F.when(F.col("seed_id").isNull(), "no seed"),
            F.when((F.col("verdict") == "confirmed") & (n == 0), "confirmed without finding"),
            F.when((F.col("verdict") != "confirmed") & (n > 0), "finding without confirmation"),
            F.when(some("foreign"), "foreign finding"),
            *(F.when(some(c), f"bad {c}") for c in ("severity", "confidence", "evidence")),
        )
    )
    return validations.join(counts, "id", "left").select("id", F.array_join(reasons, ",").alias("reasons"))


def expand_inputs(lists: DataFrame, mode: str) -> DataFrame:
    """Value pairs of two wordlists (list, place, value): clusterbomb takes all pairs, pitchfork equal places.

    All pairs are what clusterbomb asks for; their number is the product of the lists' sizes.
    """
    a, b = (lists.where(F.col("list") == k).select("place", F.col("value").alias(f"value{k}")) for k in (1, 2))
    if mode == "pitchfork":
        return a.join(b, "place").select("value1", "value2")
    return a.drop("place").join(b.drop("place"), F.lit(True)).select("value1", "value2")


def expand_wordlists(lists: DataFrame, mode: str, names: list[str]) -> DataFrame:
    """Inputs, a column for each name, of any number of wordlists (list: its name, place, value).

    clusterbomb takes every combination, their number being the product of the lists' sizes, as is
    asked for. pitchfork takes equal places, as far as the shortest list goes. sniper puts each
    value in one place at a time and leaves the others null.
    """
    each = [lists.where(F.col("list") == n).select("place", F.col("value").alias(n)) for n in names]
    if mode == "sniper":
        return reduce(DataFrame.unionByName, (e.drop("place").select(*(F.col(n) if n == own else F.lit(None).cast("string").alias(n) for n in names)) for own, e in zip(names, each, strict=True)))
    if mode == "pitchfork":
        return reduce(lambda a, b: a.join(b, "place"), each).select(*names)
    return reduce(lambda a, b: a.join(b, F.lit(True)), (e.drop("place") for e in each)).select(*names)
