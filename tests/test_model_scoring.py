"""Groups across Arrow batches; a ledger that lets a stopped run go on."""

import json
import os

import pytest
from pyspark.sql import functions as F

from wordrate.operators import model_scoring as MS


def prompts(spark, n, parts=2):
    return spark.range(n).repartition(parts).select(F.col("id").alias("task"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"))


@pytest.mark.parametrize("arrow", ["1", "3", "7", "10000"])
def test_groups_do_not_depend_on_arrow_batches(spark, arrow):
    def factory():
        return lambda group: [float(len(group))] * len(group)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", arrow)
    try:
        got = MS.score_prompts(prompts(spark, 23, 1), "prompt", factory).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r.score for r in got) == [3.0] * 3 + [5.0] * 20 and len({r.task for r in got}) == 23


def logging_factory(log, stop_at=None):
    """A model that notes what it is sent, and fails at one prompt."""
    def factory():
        def model(group):
            if stop_at in group:
                raise RuntimeError("stopped")
            with open(log, "a") as f:
                f.write("".join(p + "\n" for p in group))
            return [float(p[1:]) for p in group]
        return model
    return factory


def test_a_stopped_run_sends_nothing_twice(spark, tmp_path):
    log, folder = str(tmp_path / "log"), str(tmp_path / "ledger")
    df = prompts(spark, 60, 3)
    for stop in ("p17", "p17", "p41", None):
        if stop:
            with pytest.raises(Exception, match="stopped"):
                MS.score_resumable(df, ["task"], "prompt", logging_factory(log, stop), folder)
        else:
            got = MS.score_resumable(df, ["task"], "prompt", logging_factory(log, None), folder)
    sent = open(log).read().split()
    assert len(sent) == len(set(sent)) == 60
    assert sorted((r.task, r.score) for r in got.collect()) == [(i, float(i)) for i in range(60)]
    again = MS.score_resumable(df, ["task"], "prompt", logging_factory(log, "p1"), folder)  # nothing left to send
    assert again.count() == 60 and len(open(log).read().split()) == 60


def test_torn_lines_and_repeated_keys(spark, tmp_path):
    folder = tmp_path / "ledger"
    os.makedirs(folder)
    (folder / "x-0-a.jsonl").write_text(json.dumps({"task": 1, "score": 7.0}) + "\n" + '{"task": 2, "sco')
    df = prompts(spark, 4).unionByName(prompts(spark, 2))
    got = MS.score_resumable(df, ["task"], "prompt", logging_factory(str(tmp_path / "log")), str(folder))
    assert sorted((r.task, r.score) for r in got.collect()) == [(0, 0.0), (0, 0.0), (1, 7.0), (1, 7.0), (2, 2.0), (3, 3.0)]
    assert sorted(open(tmp_path / "log").read().split()) == ["p0", "p2", "p3"]


def test_no_prompts(spark, tmp_path):
    df = prompts(spark, 3).limit(0)
    assert MS.score_prompts(df, "prompt", MS.length_scorer_factory).count() == 0
    assert MS.score_resumable(df, ["task"], "prompt", MS.length_scorer_factory, str(tmp_path / "l")).count() == 0


def test_an_attempt_goes_on_after_an_earlier_one(tmp_path, monkeypatch):
    """A task that Spark starts again leaves out what its earlier attempt wrote down."""
    import pyarrow as pa
    from pyspark import TaskContext

    class Ctx:
        def partitionId(self):
            return 4
    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: Ctx()))
    log, folder = str(tmp_path / "log"), str(tmp_path / "ledger")
    rows = pa.RecordBatch.from_pydict({"task": list(range(12)), "prompt": [f"p{i}" for i in range(12)]})

    def attempt(stop):
        run = MS._sending(["task"], [0], 1, logging_factory(log, stop), folder, "job", "score", 5)
        return [b.to_pydict()["sent"] for b in run(iter([rows.slice(0, 7), rows.slice(7)]))]
    with pytest.raises(RuntimeError):
        attempt("p8")
    assert attempt(None) == [[7]]
    assert len(open(log).read().split()) == len(set(open(log).read().split())) == 12
