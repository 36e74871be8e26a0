"""Readers that part what is valid from what is not, with a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a line beyond which it is rejected unread.
LINE = 1_048_576
NUMBERS = ("position", "status", "length", "words", "lines", "duration")
TEXTS = ("content-type", "redirectlocation", "url", "resultfile", "host")


def read_http_matches(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """NDJSON files of fuzz results as (matches, rejects)."""
    return http_matches(spark.read.text(path))


def http_matches(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines (value), of a table or a stream, as (matches, rejects): numbers are whole and not negative, texts texts, input an object of base64, scraper an object if it is there; blank lines are no lines."""
    lines = lines.where(F.trim("value") != "")
    v = F.when(F.octet_length("value") <= LINE, F.try_parse_json("value"))
    parsed = lines.withColumn("v", v)
    ok = F.lit(True)
    for name in NUMBERS:
        kind = F.schema_of_variant(F.try_variant_get("v", f"$['{name}']", "variant"))
        ok = ok & F.coalesce(kind == "BIGINT", F.lit(False)) & F.coalesce(F.try_variant_get("v", f"$['{name}']", "long") >= 0, F.lit(False))
    for name in TEXTS:
        ok = ok & F.coalesce(F.schema_of_variant(F.try_variant_get("v", f"$['{name}']", "variant")) == "STRING", F.lit(False))
    given = F.try_variant_get("v", "$.input", "map<string,string>")
    decoded = F.transform_values(given, lambda _, x: F.try_to_binary(x, F.lit("base64")))
    ok = ok & F.coalesce(given.isNotNull() & F.forall(F.map_values(decoded), lambda x: x.isNotNull()), F.lit(False))
    # results of a scraper, where they are given, are an object
    scraper = F.schema_of_variant(F.try_variant_get("v", "$.scraper", "variant"))
    ok = ok & F.coalesce(F.startswith(scraper, F.lit("OBJECT")) | (scraper == "VOID"), F.lit(True))
    reason = F.when(F.octet_length("value") > LINE, "line too long").when(F.col("v").isNull(), "malformed JSON").when(~ok, "invalid field")
    judged = parsed.withColumn("reason", reason)
    good = judged.where("reason IS NULL").select(decoded.alias("input"), *(F.try_variant_get("v", f"$['{n}']", "long").alias(n) for n in NUMBERS), *(F.try_variant_get("v", f"$['{n}']", "string").alias(n.replace("-", "_")) for n in TEXTS))
    return good, judged.where("reason IS NOT NULL").select("value", "reason")


def read_scan_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`ip -> [p1, p2]` lines as (ip, sorted distinct ports) and rejects; lines without an arrow and empty lists are ignored."""
    arrow = lines.where(F.contains("value", F.lit("->")))
    form = r"^\s*([0-9A-Fa-f.:]+)\s*->\s*\[([0-9, ]*)\]\s*$"
    ports = F.array_sort(F.array_distinct(F.transform(F.filter(F.split(F.regexp_extract("value", form, 2), ","), lambda p: F.trim(p) != ""), lambda p: F.trim(p).cast("int"))))
    good = F.col("value").rlike(form)
    rows = arrow.where(good).select(F.regexp_extract("value", form, 1).alias("ip"), ports.alias("ports")).where(F.size("ports") > 0)
    return rows, arrow.where(~good)


def merge_corpus(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """One seed (id, seq, value) per id: incoming over existing, and the last of a batch."""
    both = existing.withColumn("side", F.lit(0)).unionByName(incoming.withColumn("side", F.lit(1)))
    return both.groupBy("id").agg(F.max_by("value", F.struct("side", "seq")).alias("value"))


def source_limits(sources: DataFrame, most_files: int, most_file: int, most_total: int) -> tuple[DataFrame, DataFrame]:
    """(kept, diagnostics) of sources (path, bytes): too many files or bytes in all keep nothing; a file too large goes alone."""
    total = sources.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total"))
    code = F.when(F.col("files") > most_files, "too_many_files").when(F.col("total") > most_total, "too_many_bytes")
    judged = sources.join(F.broadcast(total.select(code.alias("code"))))
    whole = total.select(code.alias("code"), F.lit(None).cast("string").alias("path")).where("code IS NOT NULL")
    single = judged.where(F.col("code").isNull() & (F.col("bytes") > most_file)).select(F.lit("file_too_large").alias("code"), "path")
    return judged.where(F.col("code").isNull() & (F.col("bytes") <= most_file)).drop("code"), whole.union(single)
