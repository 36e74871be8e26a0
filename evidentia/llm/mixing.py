"""Mixing sources to target weights by repetition rates and hash-seeded Bernoulli copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 20_240_601
#: Sources whose targets may be sent to each executor; beyond it they are joined by a shuffle, with the documents' side salted.
BROADCAST = 10_000
SALTS = 64


def size_of(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target, rate) from (source, source_size), one row per source.

    Sources by code point, null last, weigh WEIGHTS in turn. Targets share the sum of all sizes
    by weight; one above MOST times its source's size stops there and what is over is shared
    by weight among the rest, until none is above. With targets in proportion to weight, those
    that stop are the sources of the smallest size over weight, so a running sum over that
    order finds them. The windows run over the table of sources alone.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8")))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(rank - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight.cast("double")).withColumn("most", (MOST * F.col("source_size")).cast("double")).withColumn("level", F.col("most") / F.col("weight"))
    order = Window.orderBy("level", F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = (
        rows.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("share", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("fair", F.col("left") / F.col("share"))
        .withColumn("open", F.col("level") > F.col("fair"))
    )
    # the first source in this order that does not stop sets the level of all that follow
    water = F.first(F.when(F.col("open"), F.col("fair")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    target = F.coalesce(F.least("most", water * F.col("weight")), F.col("most"))
    return rows.withColumn("target", target).select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST)))).otherwise(0.0).alias("rate"))


def with_targets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """rows with source_size, target and rate of their source."""
    named = targets.withColumnsRenamed({"source": "_source"})
    if targets.count() <= BROADCAST:
        return rows.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    salted = named.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, F.col("source").eqNullSafe(F.col("_source")) & (dealt["_salt"] == salted["_salt"])).drop("_source", "_salt")


def copies(id_col: str = "doc_id", seed: int = SEED) -> F.Column:
    """floor(rate) and one more with the probability of the fraction, drawn from the id's hash, of rows without an id the text's."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.md5("text"), F.lit("")))
    draw = F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    whole = F.floor("rate")
    return (whole + (draw < F.col("rate") - whole).cast("long")).cast("long")


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs with size, source_size, target and copies: how often the mix takes each row.

    A null text has size 0. Null sources are one source, the last. A source without words has
    target 0 and takes nothing. Repeated ids draw alike, rows without an id by their text. An
    empty table gives an empty table. Columns of these names are replaced.
    """
    clean = docs.drop("size", "source_size", "target", "rate", "copies")
    sized = clean.withColumn("size", size_of())
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # the table of sources is small; it is computed once and not with each use
    targets = source_targets(sums)
    return with_targets(sized, staged(targets, "targets")).withColumn("copies", copies(seed=seed)).drop("rate")


def repeat_rows(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: each row as often as it is taken, in its own columns."""
    held = docs.select("doc_id", "source", "text", F.struct("*").alias("_row"))
    taken = mix(held, seed).where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return taken.select("_row.*")
