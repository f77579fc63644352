"""R1 + R2: result files arriving in two drops, processed by two runs of the same
streaming query (one checkpoint): repeats of a task are dropped across runs, and the
restarted query does not emit anything twice."""

import json
import math
import os

from measured_values import V02_TOP
from pyspark.sql import functions as F

from wordrate.sinks import files as K
from wordrate.streaming import ingest as ST

TOP = V02_TOP[:3]


def _result(key, minute):
    return json.dumps({"key": key, "processed_time": f"2025-08-18T04:{minute:02d}:00Z", "response": {"candidates": [{
        "content": {"parts": [{"text": "4"}]},
        "logprobsResult": {"chosenCandidates": [{"token": "4", "logProbability": TOP[0][1]}],
                           "topCandidates": [{"candidates": [{"token": t, "logProbability": lp} for t, lp in TOP]}]}}]}})


def test_two_drops_two_runs_exactly_once(spark):
    base = K.scratch_dir(spark, "test-stream")
    inbox = os.path.join(base, "in")
    os.makedirs(os.path.join(inbox, "drop1"))
    os.makedirs(os.path.join(inbox, "drop2"))
    reqs = spark.createDataFrame([("", f"k{i}", f'Rate "w{i}"', i) for i in range(6)],
                                 "run string, task_id string, prompt string, line_no long")
    with open(os.path.join(inbox, "drop1", "a.jsonl"), "w") as fh:
        fh.write("\n".join(_result(f"k{i}", i) for i in range(4)) + "\n")
    out, ckpt = os.path.join(base, "out"), os.path.join(base, "ckpt")
    ST.run_available(ST.scored_stream(spark, inbox, reqs, feature_label="Familiarity", watermark="1 hour"), out, ckpt)
    assert spark.read.parquet(out).count() == 4
    with open(os.path.join(inbox, "drop2", "b.jsonl"), "w") as fh:   # k2, k3 repeated; k4, k5 new
        fh.write("\n".join(_result(f"k{i}", i + 10) for i in range(2, 6)) + "\n")
    ST.run_available(ST.scored_stream(spark, inbox, reqs, feature_label="Familiarity", watermark="1 hour"), out, ckpt)
    got = spark.read.parquet(out)
    assert sorted(r["task_id"] for r in got.collect()) == [f"k{i}" for i in range(6)]
    w = [math.exp(lp) for _, lp in TOP]
    expected = sum(int(t) * x for (t, _), x in zip(TOP, w)) / sum(w)
    assert got.where(F.abs(F.col("weighted_sum") - F.lit(expected)) > 1e-12).count() == 0


def test_late_first_answers_and_runs(spark):
    """An answer stamped hours before the others is kept, a repeat is not, and two runs with
    the same task ids stay apart."""
    base = K.scratch_dir(spark, "test-stream-late")
    inbox = os.path.join(base, "in")
    os.makedirs(inbox)
    reqs = spark.createDataFrame([(r, f"k{i}", f'Rate "{r}{i}"', i) for r in ("a", "a_2") for i in range(4)],
                                 "run string, task_id string, prompt string, line_no long")
    out, ckpt = os.path.join(base, "out"), os.path.join(base, "ckpt")
    drops = [("a_batch_0_x.jsonl", [("k0", 50), ("k1", 51)]), ("a_batch_1_x.jsonl", [("k2", 1), ("k0", 2)]),
             ("a_2_batch_0_x.jsonl", [("k0", 0), ("k3", 59)])]
    for name, answers in drops:
        with open(os.path.join(inbox, name), "w") as fh:
            fh.write("".join(_result(k, m) + "\n" for k, m in answers))
        ST.run_available(ST.scored_stream(spark, inbox, reqs, feature_label="Familiarity", watermark="1 minute"), out, ckpt)
    got = sorted((r.run, r.task_id, r.word) for r in spark.read.parquet(out).collect())
    assert got == [("a", "k0", "a0"), ("a", "k1", "a1"), ("a", "k2", "a2"), ("a_2", "k0", "a_20"), ("a_2", "k3", "a_23")]
