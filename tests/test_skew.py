"""Hot keys: one key holding a third of all rows must neither break results nor land
in a single task."""

from pyspark.sql import functions as F

from wordrate.operators import responses as R
from wordrate.operators.numbering import prefix_sum, with_row_number


def test_hot_task_results_all_kept(spark):
    n = 3000
    # a third of the results answer task 0; requests have 2 versions per task
    res = spark.range(n).select(F.lit("").alias("run"),
                                F.when(F.col("id") % 3 == 0, F.lit("t0"))
                                 .otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("task_id"),
                                F.col("id").alias("line_no"))
    req = (spark.range(n).select(F.lit("").alias("run"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("task_id"),
                                 F.lit("old").alias("prompt"), F.lit(0).cast("long").alias("line_no"))
           .unionByName(spark.range(n).select(F.lit("").alias("run"),
                                              F.concat(F.lit("t"), F.col("id").cast("string")).alias("task_id"),
                                              F.lit("new").alias("prompt"), F.lit(1).cast("long").alias("line_no"))))
    j = R.join_results(res, req)
    assert j.count() == n
    assert j.where(F.col("prompt") != "new").count() == 0
    assert j.where(F.col("task_id") == "t0").count() == n // 3


def test_row_numbers_spread_a_hot_value(spark):
    n = 3000
    df = spark.range(n).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("v"))
    numbered = with_row_number(df, ["v", "id"], "pos", num_partitions=6)
    rows = sorted((r["v"], r["id"], r["pos"]) for r in numbered.collect())
    assert [p for _, _, p in rows] == list(range(1, n + 1))
    sizes = [r["count"] for r in df.repartitionByRange(6, "v", "id").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < n / 3          # the hot value is split across partitions


def test_prefix_sum_single_hot_group(spark):
    n = 2000
    df = spark.range(n).select(F.lit("g").alias("g"), F.col("id").alias("o"), F.lit(2).cast("long").alias("c"))
    got = {r["o"]: r["before"] for r in prefix_sum(df, ["g"], ["o"], "c", "before", num_partitions=8).collect()}
    assert all(got[o] == 2 * o for o in range(n))
