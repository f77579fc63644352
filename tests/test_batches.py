"""Batch files and their manifest; numbering of a scan as it lies."""

import os
import re

import pytest
from pyspark.sql import functions as F

from wordrate.operators import numbering as NB
from wordrate.operators import requests as Q
from wordrate.sinks import batches as B
from wordrate.sinks import files as K
from wordrate.sources import files as S


def requests(spark, run, n=25, word="w"):
    return spark.range(1, n + 1).select(F.lit(run).alias("run"), F.col("id").alias("task_no"),
                                        F.to_json(F.struct(F.concat(F.lit(f"{word}_task_"), "id").alias("custom_id"))).alias("json"))


def ids(spark, path, run):
    return sorted(r.custom_id for r in S.read_batches_of_run(spark, path, run).select("custom_id").collect())


def want(n=25, word="w"):
    return sorted(f"{word}_task_{i}" for i in range(1, n + 1))


def test_names_manifest_and_modes(spark, tmp_path):
    out = str(tmp_path / "out")
    K.write_request_batches(requests(spark, "r"), out, 10, stamp="s")
    K.write_request_batches(requests(spark, "r_2", 5), out, 10, stamp="s")
    assert sorted(f for f in os.listdir(out) if not f.startswith(("_", "."))) == ["r_2_batch_0_s.jsonl", "r_batch_0_s.jsonl", "r_batch_1_s.jsonl", "r_batch_2_s.jsonl"]
    assert [(f["run"], f["batch"], f["tasks"]) for f in B.committed(out)] == [("r", 0, 10), ("r", 1, 10), ("r", 2, 5), ("r_2", 0, 5)]
    with open(os.path.join(out, "r_batch_1_s.jsonl")) as f:
        assert [int(re.search(r"_task_(\d+)", x).group(1)) for x in f] == list(range(11, 21))
    with pytest.raises(FileExistsError):
        K.write_request_batches(requests(spark, "r"), out, 10, stamp="t")
    assert ids(spark, out, "r") == want() and ids(spark, out, "r_2") == want(5)
    K.write_request_batches(requests(spark, "r", 7, "v"), out, 10, mode="overwrite", stamp="s")  # the same stamp
    assert ids(spark, out, "r") == want(7, "v") and ids(spark, out, "r_2") == want(5)
    assert len([f for f in os.listdir(out) if f.startswith("r_batch")]) == 1
    K.write_request_batches(requests(spark, "r", 7, "v"), out, 10, mode="append", stamp="s")
    assert ids(spark, out, "r") == sorted(want(7, "v") * 2)
    assert ids(spark, out, "absent") == []


@pytest.mark.parametrize("run", ["a/b", "50% + x", "ünï", "a_batch_1_b", "..", "say \"hi\""])
def test_any_run_name(spark, tmp_path, run):
    out = str(tmp_path / "out")
    K.write_request_batches(requests(spark, run, 3), out, 10)
    assert ids(spark, out, run) == want(3)
    assert not [f for f in os.listdir(out) if os.path.isdir(os.path.join(out, f)) and f != B.MANIFEST]
    told = S.read_requests(spark, out + "/*.jsonl").select("run").distinct().collect()
    assert [r.run for r in told] == [run]


def test_a_crash_leaves_the_old_set(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    K.write_request_batches(requests(spark, "r"), out, 10, stamp="s")
    bad = requests(spark, "r", 40, "v").withColumn("json", F.when(F.col("task_no") == 38, F.raise_error(F.lit("stop"))).otherwise(F.col("json")))
    with pytest.raises(Exception):
        K.write_request_batches(bad, out, 10, mode="overwrite", stamp="s")
    assert ids(spark, out, "r") == want()
    # files written, no commit: what a lost driver leaves
    for name in ("r_batch_0_z.jsonl", "r_batch_7_s.jsonl"):
        (tmp_path / "out" / name).write_text('{"custom_id": "lost"}\n')
    assert ids(spark, out, "r") == want()


def test_a_second_attempt_of_a_task_adds_nothing(spark, tmp_path):
    import pyarrow as pa
    out = str(tmp_path / "out")
    w = B.BatchWriter({"path": out, "stamp": "s"}, False)
    rows = [pa.RecordBatch.from_pydict({"run": ["r"] * 4, "batch_index": [0, 0, 1, 1], "value": list("abcd")})]
    first, second = w.write(iter(rows)), w.write(iter(rows))
    assert first.files == second.files
    w.commit([second, None])
    assert [f["tasks"] for f in B.committed(out)] == [2, 2]


def test_empty_requests(spark, tmp_path):
    out = str(tmp_path / "out")
    K.write_request_batches(requests(spark, "r", 0), out, 10)
    assert B.committed(out) == [] and ids(spark, out, "r") == []


def test_numbers_in_file_order(spark, tmp_path):
    """Many files and splits, several splits to a task; no row is moved."""
    folder = str(tmp_path / "words.csv")
    spark.range(5000).select(F.col("id").alias("Word"), F.repeat(F.lit("x"), 30).alias("pad")).repartitionByRange(7, "Word").sortWithinPartitions("Word") \
        .write.option("header", True).csv(folder)
    for size in ("4k", "64m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            words = S.read_word_table(spark, folder)
            got = NB.number_in_file_order(words, "no")
            assert got.where(F.col("no") != F.col("Word").cast("long") + 1).count() == 0 and got.count() == 5000
            reqs = Q.build_requests(Q.number_words_in_file_order(words, "Word"), Q.Experiment("r", "e", 'Rate "{Word}"'))
            plan = reqs._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
            assert "Exchange hashpartitioning" not in plan and "rangepartitioning" not in plan
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    rows = spark.range(100).select(F.col("id").alias("v"))
    assert sorted(r.no for r in NB.number_in_file_order(rows, "no").collect()) == list(range(1, 101))


def test_relative_paths_and_uris(spark, tmp_path, monkeypatch):
    from wordrate.session import storage_uri
    assert storage_uri(spark, f"file://{tmp_path}/a b") == f"{tmp_path}/a b" == storage_uri(spark, f"{tmp_path}/a b")
    assert os.path.isabs(storage_uri(spark, "rel/x")) and storage_uri(spark, "rel/x").endswith("/rel/x")
    K.write_request_batches(requests(spark, "r", 3), f"file://{tmp_path}/u", 10)
    assert ids(spark, f"{tmp_path}/u", "r") == want(3) == ids(spark, f"file://{tmp_path}/u", "r")
