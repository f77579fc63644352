"""Streaming monitor: files in several triggers against the batch report and the first answers."""

import json
import os
import random

from pyspark.sql import functions as F

from wordrate.operators import requeue as RQ
from wordrate.operators import responses as R
from wordrate.sinks import files as K
from wordrate.sources import files as S
from wordrate.streaming import monitor as M


def _request(key, word):
    return json.dumps({"custom_id": key, "body": {"messages": [{"role": "user", "content": f'Rate "{word}"'}]}})


def _result(key, answer, error=None):
    step = {"token": answer, "logprob": -0.5, "top_logprobs": [{"token": answer, "logprob": -0.5}, {"token": "1", "logprob": -2.0}]}
    body = {"choices": [{"message": {"role": "assistant", "content": answer}, "logprobs": {"content": [step]}}]}
    return json.dumps({"custom_id": key, "error": error, "response": None if error else {"status_code": 200, "body": body}})


class Drops:
    """Folders of request and result files, and the two queries over them."""

    def __init__(self, spark, name, **how):
        self.spark, self.base, self.how = spark, K.scratch_dir(spark, f"test-monitor-{name}"), how
        for folder in ("requests", "results"):
            os.makedirs(os.path.join(self.base, folder))

    def put(self, folder, name, lines):
        with open(os.path.join(self.base, folder, name), "w") as fh:
            fh.write("".join(x + "\n" for x in lines))

    def trigger(self):
        b = self.base
        changes = M.file_changes(self.spark, f"{b}/requests", f"{b}/results")
        M.run_available(M.task_events(changes, **self.how), f"{b}/events", f"{b}/ckpt-events")
        M.run_available(M.run_reports(M.stored_events(self.spark, f"{b}/events")), f"{b}/reports", f"{b}/ckpt-reports")
        return self.spark.read.parquet(f"{b}/events"), self.spark.read.parquet(f"{b}/reports")

    def batch_report(self):
        req = R.canonical_requests(S.read_requests(self.spark, f"{self.base}/requests"))
        raw = S.read_results(self.spark, f"{self.base}/results")
        res = raw.select("run", F.col("custom_id").alias("task_id"), F.col("error").isNotNull().alias("failed"))
        return sorted(map(tuple, RQ.completeness(req.select("run", "task_id"), res).collect()))


def test_triggers_with_late_files_equal_the_batch_report(spark):
    """Two runs with the same task ids; answers before their requests, repeats, failures, extras."""
    r = random.Random(3)
    d = Drops(spark, "late")
    tasks = [f"t_{i}" for i in range(30)]
    order = [(run, t) for run in ("a", "a_2") for t in tasks]
    r.shuffle(order)
    first = {}
    for k in range(3):
        for run in ("a", "a_2"):
            d.put("requests", f"{run}_batch_{k}_x.jsonl", [_request(t, f"{run}{t}") for x, t in order[k::3] if x == run])
            lines = []
            for x, t in order[(k + 1) % 3::3] + order[(k + 2) % 3::5]:  # most come before or after their request, some twice
                if x == run and t not in ("t_1", "t_2"):
                    bad = "timeout" if run == "a_2" and t == "t_7" else None
                    answer = str(r.randint(2, 7))
                    lines.append(_result(t, answer, bad))
            d.put("results", f"{run}_batch_{k}_x.jsonl", lines + [_result(f"extra{k}", "3")])
        events, reports = d.trigger()
        want = d.batch_report()
        assert sorted(map(tuple, M.latest_reports(reports).collect())) == want
    answers = events.where("event = 'answer'").groupBy("run", "task_id").count()
    assert answers.where("count <> 1").count() == 0
    requested = {(run, t) for run, t in order if t not in ("t_1", "t_2") and (run, t) != ("a_2", "t_7")}
    got = {(x.run, x.task_id) for x in answers.collect()}
    answered = {(x.run, x.task_id) for x in S.read_results(spark, f"{d.base}/results").select("run", F.col("custom_id").alias("task_id")).collect()}
    assert got == requested & answered
    words = {(x.run, x.task_id): x.word for x in M.scored(events).collect()}
    assert words == {(run, t): f"{run}{t}" for run, t in got}


def test_first_answers_overdue_tasks_and_finished_runs(spark):
    d = Drops(spark, "timers", overdue_ms=1)
    d.put("requests", "r_batch_0_x.jsonl", [_request(f"k{i}", f"w{i}") for i in range(4)])
    d.put("results", "r_batch_0_x.jsonl", [_result("k0", "4"), _result("k0", "5"), _result("k1", "6")])
    d.trigger()
    d.put("results", "r_batch_1_x.jsonl", [_result("k0", "2"), _result("k2", "3")])
    d.trigger()
    d.put("results", "r_batch_2_x.jsonl", [_result("k3", "7")])
    events, reports = d.trigger()
    said = {x.task_id: json.loads(x.answer)["answer_text"] for x in events.where("event = 'answer'").collect()}
    assert said == {"k0": "4", "k1": "6", "k2": "3", "k3": "7"}
    late = sorted(x.task_id for x in events.where("event = 'overdue'").collect())
    assert late == ["k3"]  # k2's answer came with the next files, k3's after them
    done = reports.where("finished").collect()
    assert len(done) == 1 and done[0].n_answered == 4
    value = {x.task_id: x.value for x in M.scored(events, feature_label="Familiarity").collect()}
    assert value["k3"] == 7.0


def test_state_is_forgotten(spark):
    """With a time to live of a moment, a repeat in a later trigger is an extra result."""
    d = Drops(spark, "ttl", forget_ms=1)
    d.put("requests", "r_batch_0_x.jsonl", [_request("k", "w")])
    d.put("results", "r_batch_0_x.jsonl", [_result("k", "4")])
    d.trigger()
    d.put("results", "r_batch_1_x.jsonl", [_result("k", "4")])
    _, reports = d.trigger()
    assert [x.n_extra for x in M.latest_reports(reports).collect()] == [1]
