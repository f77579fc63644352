"""Numbers, splits and offsets on tables large enough for several range partitions, with a
payload column in use and with exchange reuse off: they must not rest on plan shapes."""

import pytest
from pyspark.sql import functions as F

from wordrate.operators import chat, numbering, sampling

N = 120_000


@pytest.fixture(params=["true", "false"])
def reuse(spark, request):
    spark.conf.set("spark.sql.exchange.reuse", request.param)
    yield request.param
    spark.conf.unset("spark.sql.exchange.reuse")


def table(spark, n=N):
    return spark.range(n).select(F.col("id").alias("key"), F.md5(F.col("id").cast("string")).alias("payload"), (F.col("id") % 3).cast("string").alias("s"))


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_numbers_are_dense(spark, reuse, parts):
    got = numbering.with_row_number(table(spark), ["payload"], num_partitions=parts, total="n")
    got = got.join(table(spark).select("payload", F.col("key").alias("k2")), "payload")  # payload in use
    r = got.agg(F.countDistinct("row_no"), F.min("row_no"), F.max("row_no"), F.count(F.lit(1)), F.min("n"), F.max("n"), F.count_if(F.col("key") != F.col("k2"))).first()
    assert tuple(r) == (N, 1, N, N, N, N, 0)


def test_split_sizes_are_exact(spark, reuse):
    split = sampling.split_exact(table(spark), "key", 0.5).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("payload").alias("d"))
    assert sorted(tuple(r) for r in split.collect()) == [("test", N // 2, N // 2), ("train", N // 2, N // 2)]
    strat = sampling.split_stratified(table(spark), "key", F.col("s"), {"0": 0.1, "1": 0.434383, "2": 0.9})
    got = {(r.stratum, r.split): r.n for r in strat.groupBy("stratum", "split").agg(F.countDistinct("payload").alias("n")).collect()}
    assert got == {("0", "test"): 4000, ("0", "train"): 36000, ("1", "test"): 17376, ("1", "train"): 22624, ("2", "test"): 36000, ("2", "train"): 4000}


def test_transcript_lines_keep_every_turn(spark, reuse):
    # one conversation holds a third of all turns
    turns = spark.range(N).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 5000).alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")).alias("text"))
    got = chat.transcript_lines(turns)
    from pyspark.sql import Window
    want = got.withColumn("w", F.coalesce(F.sum("line_chars").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    assert tuple(want.agg(F.count(F.lit(1)), F.count_if(F.col("w") != F.col("offset"))).first()) == (N, 0)


def test_prefix_sum_over_null_groups(spark):
    df = spark.createDataFrame([(None, i, 1) for i in range(50)] + [("a", i, 2) for i in range(50)], "g string, o int, v int")
    got = numbering.prefix_sum(df, ["g"], ["o"], "v", num_partitions=5)
    assert all(r.cum_before == r.o * (2 if r.g else 1) for r in got.collect()) and got.count() == 100
