"""Connected components by alternating large and small stars.

Every round is two joins and two minimum aggregations whose partial sums run before the
shuffle. A hub with many neighbours is a skewed key of a join, which adaptive execution
splits; no neighbourhood is gathered anywhere. The rounds grow with the logarithm of the
longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import drop_path, new_path

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour above a node goes to the smallest of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    over = down.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return over.union(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is its smallest reachable node.

    Nodes are non-null longs. Loops and repeated edges are allowed; an edge to itself gives no
    row unless another edge holds that node. An empty table gives an empty table.
    """
    spark = edges.sparkSession
    path = new_path(spark, "edges")
    edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct().write.parquet(path)
    now = spark.read.schema("a long, b long").parquet(path)
    before = None
    for _ in range(MAX_ROUNDS):
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before or state[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        before, old = state, path
        path = new_path(spark, "edges")
        _small_star(_large_star(now).distinct()).distinct().write.parquet(path)
        now = spark.read.schema("a long, b long").parquet(path)
        drop_path(spark, old)
    raise RuntimeError("components did not settle")
