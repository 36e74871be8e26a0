"""Where values, seeds and findings come from: equi-joins with their counts stated, never a guess among several."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import stable_id


def _counted(asked: DataFrame, found: DataFrame, key: str, many: str, none: str) -> DataFrame:
    n = found.groupBy(key).agg(F.count("*").alias("n"))
    state = F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, many).otherwise(none)
    return asked.join(n, key, "left").na.fill(0, ["n"]).withColumn("state", state)


def return_sources(bindings: DataFrame, returns: DataFrame) -> DataFrame:
    """bindings (binding_id, target) by how many returns (target) their function has: one, several, or none that is known."""
    return _counted(bindings, returns, "target", "multiple_return_sites", "external_or_dynamic_return").select("binding_id", "n", "state")


def parameter_callers(parameters: DataFrame, arguments: DataFrame) -> DataFrame:
    """parameters (parameter_id, fn, position) by the call arguments (object) `fn#argument/position` that may supply them."""
    asked = parameters.withColumn("object", F.concat("fn", F.lit("#argument/"), F.col("position").cast("string")))
    return _counted(asked, arguments, "object", "multiple_callers", "no_known_caller").select("parameter_id", "n", "state")


def promote_findings(findings: DataFrame, tool: str) -> DataFrame:
    """findings (id, source, locus) as seeds of another tool: a stable id, the value and the origin."""
    return findings.select(stable_id(tool, F.col("source"), F.col("id")).alias("seed_id"), F.col("locus").alias("value"), F.col("source").alias("origin_source"), F.col("id").alias("origin_id"))


def finding_lineage(seeds: DataFrame, findings: DataFrame, validations: DataFrame) -> DataFrame:
    """Each validation (validation_id, seed_id) traced to its seed's finding; nulls where the trail ends."""
    trail = validations.join(seeds.select("seed_id", F.col("origin_id").alias("id")), "seed_id", "left")
    return trail.join(findings.select("id", "category", "locus"), "id", "left").select("validation_id", "seed_id", F.col("id").alias("finding_id"), "category", "locus")


def store_write_read(cells: DataFrame) -> DataFrame:
    """Per key of cells (key, process, at, kind, value): joined if it was written once, then read once by another process, with one value. One shuffle, no pairs."""
    one = lambda kind, column: F.min(F.when(F.col("kind") == kind, F.col(column))).alias(f"{kind}_{column}")
    sides = [one(kind, column) for kind in ("write", "read") for column in ("process", "at", "value")]
    found = cells.groupBy("key").agg(F.count_if(F.col("kind") == "write").alias("writes"), F.count_if(F.col("kind") == "read").alias("reads"), *sides)
    fits = (F.col("writes") == 1) & (F.col("reads") == 1) & (F.col("write_process") != F.col("read_process")) & (F.col("write_at") < F.col("read_at")) & F.col("write_value").eqNullSafe(F.col("read_value"))
    return found.select("key", "writes", "reads", F.coalesce(fits, F.lit(False)).alias("joined"))
