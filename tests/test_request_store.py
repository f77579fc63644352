"""A bucketed request table: last request wins, and only results are shuffled."""

import uuid

import pytest
from pyspark.sql import functions as F

from wordrate.operators import responses as R
from wordrate.operators.request_store import RequestStore
from wordrate.sinks import files as K


@pytest.fixture
def store(spark):
    s = RequestStore(spark, f"store_{uuid.uuid4().hex}", K.scratch_dir(spark, "test-store"), 6)
    yield s
    s.drop()


def requests(spark, n, tag, run="r"):
    return spark.range(n).select(F.lit(run).alias("run"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("task_id"),
                                 F.concat(F.lit(tag), F.col("id").cast("string")).alias("prompt"), F.col("id").alias("line_no"))


def results(spark, n, run="r"):
    # the run comes with the rows, as from a file's name: a literal would drop out of the join's keys
    return spark.range(n).select(F.when(F.col("id") >= 0, run).alias("run"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("task_id"), F.col("id").alias("answer"))


def plan_lines(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def test_last_request_wins_and_runs_stay_apart(spark, store):
    store.add(requests(spark, 50, "old"), 0)
    store.add(requests(spark, 30, "new"), 1)
    store.add(requests(spark, 20, "other", "r_2"), 1)
    store.add(requests(spark, 3, "x").unionByName(requests(spark, 3, "y").withColumn("line_no", F.col("line_no") + 10)), 2)
    want = {f"t{i}": ("y" if i < 3 else "new" if i < 30 else "old") + str(i) for i in range(50)}
    assert {r.task_id: r.prompt for r in store.requests().where("run = 'r'").collect()} == want
    got = store.join(results(spark, 60).unionByName(results(spark, 5)))  # repeated results are kept
    assert got.count() == 55 and {r.task_id: r.prompt for r in got.collect()} == want
    assert sorted(r.prompt for r in store.join(results(spark, 2, "r_2")).collect()) == ["other0", "other1"]


def test_requests_are_not_shuffled(spark, store):
    store.add(requests(spark, 2000, "p"), 0)
    store.add(requests(spark, 1000, "q"), 1)
    for parts in ("2", "6", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            lines = plan_lines(store.join(results(spark, 3000)))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        scan = next(i for i, x in enumerate(lines) if "FileScan parquet" in x)
        depth = [len(x) - len(x.lstrip(" :+-*(0123456789)")) for x in lines]
        above, d = [], depth[scan]
        for i in range(scan, -1, -1):  # the operators between the scan and the join
            if depth[i] < d:
                above.append(lines[i])
                d = depth[i]
            if "SortMergeJoin" in lines[i]:
                break
        assert any("SortMergeJoin" in x for x in above) and not any("Exchange" in x for x in above), "\n".join(above)


def test_a_second_session_opens_the_table(spark):
    path = K.scratch_dir(spark, "test-store")
    one = RequestStore(spark, f"store_{uuid.uuid4().hex}", path, 4)
    one.add(requests(spark, 10, "p"), 0)
    one.drop()
    two = RequestStore(spark, f"store_{uuid.uuid4().hex}", path, 4)
    assert two.requests().count() == 10 and two.join(results(spark, 4)).count() == 4
    two.drop()


def test_equal_to_the_unstored_join(spark, store):
    req = requests(spark, 40, "a").unionByName(requests(spark, 40, "b").withColumn("line_no", F.col("line_no") + 100))
    store.add(req, 0)
    res = results(spark, 60)
    got = sorted((r.task_id, r.prompt) for r in store.join(res).collect())
    assert got == sorted((r.task_id, r.prompt) for r in R.join_results(res, req).collect())


def test_empty_store(spark, store):
    assert store.requests().count() == 0 and store.join(results(spark, 3)).count() == 0
