"""Order-dependent operators as windows that never hold the whole table in one partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scan import numbered, scanned


def novelty_archive(samples: DataFrame, most: int = 32) -> DataFrame:
    """The first `most` samples (seq, items) that show an item no earlier sample had, in order.

    An item's first sample is the least seq that holds it, so what was seen before needs no
    pass in order.
    """
    first = samples.select("seq", F.explode("items").alias("item")).groupBy("item").agg(F.min("seq").alias("seq"))
    return first.groupBy("seq").agg(F.count("*").alias("new_items")).orderBy("seq").limit(most)


def peak_rate(requests: DataFrame, window: int) -> DataFrame:
    """Per origin: the most requests in a half-open window that starts at a request, the number of all, and the time from the first to the last.

    Time is cut into bins of the window's length; a request is counted for those of its own
    bin and of the one before, so a window function holds two bins and not an origin.
    """
    bin_ = F.floor(F.col("at") / window)
    dealt = requests.select("origin", "at", bin_.alias("own"), F.explode(F.array(bin_, bin_ - 1)).alias("bin"))
    w = Window.partitionBy("origin", "bin").orderBy("at").rangeBetween(0, window - 1)
    counted = dealt.withColumn("n", F.count("*").over(w)).where("own = bin")
    return counted.groupBy("origin").agg(F.max("n").alias("peak"), F.count("*").alias("requests"), (F.max("at") - F.min("at")).alias("span"))


def incremental_samples(chunks: DataFrame) -> DataFrame:
    """chunks (stream, place, bytes, status) up to the first that is not incomplete, with the bytes so far."""
    w = Window.partitionBy("stream").orderBy("place")
    stops = F.sum((F.col("status") != "incomplete").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    sized = chunks.withColumn("received", F.sum("bytes").over(w)).withColumn("stops", F.coalesce(stops, F.lit(0)))
    return sized.where("stops = 0").drop("stops")


def incremental_observations(chunks: DataFrame) -> DataFrame:
    """(stream, place, status, received, retained, done) of chunks (stream, place, bytes, retained, work, status); place 0 is the state before the first.

    received are the bytes so far, done the work since place 0 (null where either is). Delivery
    ends with the first status that is not incomplete. Work below the last that was known is an
    error: that row has the status work_decreased, and none follows it. One scan in two steps, so
    a stream with most rows is no one task.
    """
    known = chunks.where(F.col("stream").isNotNull())
    first = known.where("place = 0").groupBy("stream").agg(F.max("work").alias("baseline"))
    ran = scanned(known, ["stream"], ["place"], received=("sum", F.when(F.col("place") > 0, F.coalesce("bytes", F.lit(0))).otherwise(0)), known_work=("last", F.col("work")))
    # the row before in its stream is the next one of the falling order
    ran = scanned(ran, ["stream"], [F.desc("place")], before=("next", F.col("known_work")))
    fell = F.coalesce(F.col("work") < F.col("before"), F.lit(False))
    told = ran.withColumn("status", F.when(fell, "work_decreased").otherwise(F.col("status")))
    stop = told.where(F.coalesce(F.col("status") != "incomplete", F.lit(True))).groupBy("stream").agg(F.min("place").alias("stop"))
    out = told.join(stop, "stream", "left").where("stop IS NULL OR place <= stop").join(first, "stream", "left")
    return out.select("stream", "place", "status", "received", "retained", (F.col("work") - F.col("baseline")).alias("done"))


def budget_prefix(rows: DataFrame, key: str, order: list[str], size: str, most_rows: int, most_size: int) -> DataFrame:
    """Each key's longest ordered prefix within both budgets, and the reason that stopped it (null if nothing did)."""
    w = Window.partitionBy(key).orderBy(*order)
    placed = rows.withColumn("place", F.row_number().over(w)).withColumn("total", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    reason = F.when(F.col("place") > most_rows, "max_rows").when(F.col("total") > most_size, "max_bytes")
    stop = placed.where(reason.isNotNull()).groupBy(key).agg(F.min(F.struct("place", reason.alias("reason"))).alias("stop"))
    kept = F.coalesce(F.col("stop.place") - 1, F.col("n"))
    return placed.groupBy(key).agg(F.count("*").alias("n")).join(stop, key, "left").select(key, kept.alias("kept"), F.col("stop.reason").alias("reason"))


def oracle_incremental_budget(samples: DataFrame, most: int, metric: str = "bytes", unit: str | None = None, streams: DataFrame | None = None) -> DataFrame:
    """Per stream of samples (stream, place, and the metric's column): a violation at the first over the budget, else skipped if one is missing or negative, else passed.

    If a unit is asked for, a stream with a sample of another unit (column unit) is skipped, and
    so is one of streams (stream) that has no sample.
    """
    value, first = F.col(metric), F.min(F.when(F.col(metric) > most, F.col("place")))
    odd = F.lit(False) if unit is None else ~F.coalesce(F.col("unit") == unit, F.lit(False))
    told = samples.groupBy("stream").agg(first.alias("first"), F.max(value.isNull() | (value < 0)).alias("missing"), F.max(odd).alias("odd"))
    if streams is not None:
        told = streams.select("stream").distinct().join(told, "stream", "left")
    result = F.when(F.coalesce("odd", F.lit(True)), "skip").when(F.col("first").isNotNull(), "violation").when(F.col("missing"), "skip").otherwise("pass")
    return told.withColumn("result", result).select("stream", "result", F.when(F.col("result") == "violation", F.col("first")).alias("place"))


def host_batches(discoveries: DataFrame, size: int) -> DataFrame:
    """Batches of at most `size` hosts (ip, protocol, ports) with equal protocol and ports, numbered by the address.

    Almost all hosts share one set of ports: they are numbered by a scan, so that no task holds
    a group, and all batches but a group's last are full.
    """
    placed = numbered(discoveries, ["protocol", "ports"], ["ip"], "_place")
    return placed.withColumn("batch", F.floor((F.col("_place") - 1) / size)).drop("_place")


def plan_batch_stats(batches: DataFrame) -> DataFrame:
    """Hosts and ports of each batch (protocol, ports, batch)."""
    return batches.groupBy("protocol", "ports", "batch").agg(F.count("*").alias("hosts"), F.sum(F.size("ports")).alias("n_ports"))


def top_fitness(samples: DataFrame, k: int) -> DataFrame:
    """The k samples (seq, fitness) of the highest fitness, the earlier first among equals."""
    return samples.orderBy(F.desc("fitness"), "seq").limit(k)
