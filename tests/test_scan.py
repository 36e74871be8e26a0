import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from evidentia.operators.scan import numbered, scanned


def test_scan_equals_windows_whatever_the_parts(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), i % 40, i, rng.choice([None, rng.randrange(9)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t int, i int, x int")
    w = Window.partitionBy("k").orderBy("t", F.desc("i"))
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = df.select("k", "t", "i", "x", F.sum("x").over(upto).alias("s"), F.last("x", True).over(upto).alias("l"), F.lead("x").over(w).alias("n"), F.row_number().over(w).alias("r"))
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("1", "7", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = scanned(df, ["k"], ["t", F.desc("i")], s=("sum", F.col("x")), l=("last", F.col("x")), n=("next", F.col("x")), r=("sum", F.lit(1)))
            assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", kept)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_key_with_all_rows_uses_many_tasks(spark):
    df = spark.range(20_000).select(F.lit("k").alias("k"), F.col("id").alias("t"))
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = [r.n for r in df.repartitionByRange("k", "t").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert len(parts) == 16 and max(parts) < 4000
        got = numbered(df, ["k"], ["t"])
        assert got.where("place <> t + 1").count() == 0 and got.count() == 20_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert numbered(df.limit(0), ["k"], ["t"]).count() == 0
