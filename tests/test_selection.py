"""Splits by distributed selection against the numbered order."""


import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from wordrate.operators import sampling as SP
from wordrate.operators import selection as SEL

ROWS = 60_000


def table(spark, n=ROWS):
    return spark.range(n).select(F.col("id").alias("key"), F.md5(F.col("id").cast("string")).alias("payload"),
                                 F.when(F.col("id") % 10 < 3, "a").when(F.col("id") % 10 < 9, "b").alias("s"))


def numbered(df, seed, by=()):
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(SP.seeded_key("key", seed), "key")))


@pytest.mark.parametrize("fraction,rule,small", [(0.5, "round", 10_000), (0.41060, "ceil", 40), (0.0, "round", 40), (1.0, "ceil", 40), (1e-5, "ceil", 1)])
def test_same_rows_as_the_numbered_order(spark, monkeypatch, fraction, rule, small):
    monkeypatch.setattr(SEL, "SMALL", small)
    got = SP.split_exact(table(spark), "key", fraction, 7, rule)
    n = SP.sample_size(ROWS, fraction, rule)
    want = numbered(table(spark), 7).withColumn("want", F.when(F.col("pos") <= n, "train").otherwise("test"))
    r = got.join(want.select("key", "want", F.col("payload").alias("p2")), "key").agg(
        F.count(F.lit(1)), F.count_if(F.col("split") != F.col("want")), F.count_if(F.col("payload") != F.col("p2")), F.count_if(F.col("split") == "train")).first()
    assert tuple(r) == (ROWS, 0, 0, n)


def test_strata_are_selected_together(spark, monkeypatch):
    monkeypatch.setattr(SEL, "SMALL", 30)
    share = {"a": 0.2, "b": 0.434383}
    got = SP.split_stratified(table(spark), "key", F.col("s"), share, 42)
    want = numbered(table(spark).where("s is not null"), 42, ["s"]).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("s")))
    limit = F.ceil(F.when(F.col("s") == "a", share["a"]).otherwise(share["b"]) * F.col("n"))
    want = want.select("key", F.when(F.col("pos") <= limit, "test").otherwise("train").alias("want"))
    r = got.join(want, "key").agg(F.count(F.lit(1)), F.count_if(F.col("split") != F.col("want"))).first()
    assert tuple(r) == (ROWS * 9 // 10, 0) and got.count() == ROWS * 9 // 10


def test_no_row_is_moved(spark):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    t = table(spark)
    assert "Exchange" not in plan(SP.split_exact(t, "key", 0.3))
    assert "Exchange" not in plan(SP.split_stratified(t, "key", F.col("s"), {"a": 0.2, "b": 0.5}))


def test_a_key_with_a_third_of_the_rows(spark, monkeypatch):
    """The place falls among rows of one key: exactly as many of them are drawn as it takes."""
    monkeypatch.setattr(SEL, "SMALL", 20)
    n = 9000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("key"), F.col("id").alias("payload"))
    before = df.where(SP.seeded_key("key", 42) < SP.seeded_key(F.lit(-1), 42)).where("key <> -1").count()
    for extra in (0, 1, 1234, 3000, 3001):
        got = SP.split_exact(df, "key", (before + extra) / n, 42)
        r = got.agg(F.count(F.lit(1)), F.count_if(F.col("split") == "train"), F.countDistinct("payload"),
                    F.count_if((F.col("key") == -1) & (F.col("split") == "train"))).first()
        assert tuple(r) == (n, before + extra, n, min(extra, 3000))


def test_null_keys_and_empty_tables(spark):
    df = spark.createDataFrame([(None, i) for i in range(5)] + [(i, i) for i in range(20)], "key long, payload long")
    got = SP.split_exact(df, "key", 0.4, 1).collect()
    assert sum(r.split == "train" for r in got) == 10 and all(r.split == "train" for r in got if r.key is None)
    got = SP.split_exact(df, "key", 0.08, 1).collect()
    assert sum(r.split == "train" for r in got) == 2 and all(r.key is None for r in got if r.split == "train")
    assert SP.split_exact(df.limit(0), "key", 0.4).count() == 0
    assert SP.split_stratified(df.limit(0), "key", F.lit("a"), {"a": 0.5}).count() == 0


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=60), st.integers(1, 60), st.integers(1, 8))
def test_place_is_the_nth_row(spark, keys, at, small):
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    was, SEL.SMALL = SEL.SMALL, small
    try:
        place = SEL.places(df, SP.seeded_key("key", 3), F.col("key"), lambda _, n: min(at, n))[0]
    finally:
        SEL.SMALL = was
    order = sorted(keys, key=lambda k: hashlib.md5(f"{k}#3".encode()).hexdigest())
    if at < len(keys):
        assert place.key == order[at - 1] and place.equal == keys.count(place.key)
        assert place.needed == at - order.index(place.key)
    else:
        assert place.hash is None and place.take == len(keys)
