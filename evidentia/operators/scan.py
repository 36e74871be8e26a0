"""Running sums, last values and next values along long keys, in two passes.

Rows are dealt by ranges of (keys, order), so a key with a third of all rows is spread over as
many tasks as its rows ask for. A window within each part makes the local answers, one row for
each key and part is carried over the borders, and is added to the local answers. As parts are
ranges, at most the first and the last key of a part go on in another: the carried rows are
twice as many as parts, and so may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged


def scanned(rows: DataFrame, keys: list[str], order: list[str | Column], **wanted: tuple[str, Column]) -> DataFrame:
    """rows with one column for each wanted (kind, expression), along the order within equal keys.

    "sum": the sum up to this row (null before the first value); "last": the last value up to this row that is not
    null; "next": the value of the following row. Rows of equal keys and order stay in one part
    and follow each other in any order, as in a window. Null keys are a key.
    """
    given = rows.columns
    dealt = rows.withColumns({f"_x_{name}": x for name, (_, x) in wanted.items()}).repartitionByRange(*(F.col(k) for k in keys), *order).withColumn("_part", F.spark_partition_id())
    local = Window.partitionBy("_part", *keys).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = {"sum": lambda x: F.sum(x).over(upto), "last": lambda x: F.last(x, ignorenulls=True).over(upto), "next": lambda x: F.lead(x).over(local)}
    table = staged(dealt.withColumn("_place", F.row_number().over(local)).withColumns({f"_y_{name}": here[kind](f"_x_{name}") for name, (kind, _) in wanted.items()}), "scan")

    ends = [F.min_by(f"_x_{name}", "_place").alias(f"_c_{name}") if kind == "next" else F.max_by(f"_y_{name}", "_place").alias(f"_c_{name}") for name, (kind, _) in wanted.items()]
    parts = table.groupBy("_part", *keys).agg(F.max("_place").alias("_size"), *ends)
    of = Window.partitionBy(*keys)
    before = of.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    over = {"sum": lambda x: F.sum(x).over(before), "last": lambda x: F.last(x, ignorenulls=True).over(before), "next": lambda x: F.lead(x).over(of.orderBy("_part"))}
    carried = parts.withColumn("_parts", F.count("*").over(of)).withColumns({f"_d_{name}": over[kind](f"_c_{name}") for name, (kind, _) in wanted.items()}).where("_parts > 1")
    carried = carried.select(F.col("_part").alias("_p"), *(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_size").alias("_last"), *(f"_d_{name}" for name in wanted))

    on = F.col("_part") == F.col("_p")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    both = table.join(F.broadcast(carried), on, "left")
    whole = {
        "sum": lambda n: F.when(F.col(f"_y_{n}").isNull(), F.col(f"_d_{n}")).otherwise(F.col(f"_y_{n}") + F.coalesce(F.col(f"_d_{n}"), F.lit(0))),
        "last": lambda n: F.coalesce(f"_y_{n}", f"_d_{n}"),
        "next": lambda n: F.when(F.col("_place") == F.col("_last"), F.col(f"_d_{n}")).otherwise(F.col(f"_y_{n}")),
    }
    return both.select(*given, *(whole[kind](name).alias(name) for name, (kind, _) in wanted.items()))


def numbered(rows: DataFrame, keys: list[str], order: list[str | Column], out: str = "place") -> DataFrame:
    """rows with their place, from one, along the order within equal keys."""
    return scanned(rows, keys, order, **{out: ("sum", F.lit(1).cast("long"))})


#: Pairs of one slice of a key, about.
PAIRS = 4_000_000


def paired(left: DataFrame, right: DataFrame, key: str, most: int = PAIRS) -> DataFrame:
    """left joined with right on a key whose values may be few and have many rows on both sides.

    A value's left rows are dealt to slices of about `most` pairs, and each slice meets all right
    rows of the value: tasks are as many as the pairs ask for, and a task buffers no more than the
    right rows of a value, on disk where they are many. Both sides are read twice.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("_l")).join(right.groupBy(key).agg(F.count("*").alias("_r")), key)
    slices = staged(counts.withColumn("_slices", F.least(F.col("_l"), F.ceil(F.col("_l") * F.col("_r") / most))), "slices")
    pairs = slices.agg(F.sum(F.col("_l").cast("double") * F.col("_r"))).first()[0] or 0
    tasks = int(min(max(pairs / most, left.sparkSession.sparkContext.defaultParallelism), 4_096))
    slices = slices.select(key, "_slices")
    dealt = left.join(slices, key).withColumn("_slice", F.pmod(F.xxhash64(*left.columns), "_slices")).drop("_slices")
    copied = right.join(slices, key).withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slices") - 1))).drop("_slices")
    return dealt.repartition(tasks, key, "_slice").join(copied.repartition(tasks, key, "_slice"), [key, "_slice"]).drop("_slice")
