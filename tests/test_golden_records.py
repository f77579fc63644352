"""Golden: inline result/request records of the three dialects through the full
canonical -> join -> score path (values from the fixture table)."""

import json

import pytest
from measured_values import (SINGLE, V01_TOP, V01_WEIGHTED, V02_TOP, V02_WEIGHTED, V08_TOP, V08_WEIGHTED, V09_TOP,
                             V09_WEIGHTED)
from pyspark.sql import functions as F

from wordrate.operators import responses as R
from wordrate.sources import schemas as SC


def chat_result(cid, content, steps):
    return {"id": "batch_req_x", "custom_id": cid, "response": {"status_code": 200, "body": {"choices": [{
        "index": 0, "message": {"role": "assistant", "content": content, "refusal": None},
        "logprobs": {"content": [{"token": t, "logprob": lp, "bytes": [],
                                  "top_logprobs": [{"token": a, "logprob": b, "bytes": []} for a, b in top]}
                                 for t, lp, top in steps]}, "finish_reason": "stop"}]}}}


def lines_df(spark, objs, ddl):
    rows = [(json.dumps(o, ensure_ascii=False), i) for i, o in enumerate(objs)]
    df = spark.createDataFrame(rows, "value string, line_no long")
    return df.select(F.from_json("value", ddl).alias("r"), "line_no").select("r.*", "line_no")


def test_chat_dialect_golden(spark):
    reqs = [{"custom_id": "exp_task_1", "method": "POST", "url": "/v1/chat/completions",
             "body": {"model": "m", "messages": [{"role": "user", "content": 'Word: "stale"'}]}},
            {"custom_id": "exp_task_1", "method": "POST", "url": "/v1/chat/completions",
             "body": {"model": "m", "messages": [{"role": "user", "content": 'Rate "abdication" 1-7'}]}},
            {"custom_id": "exp_task_2", "method": "POST", "url": "/v1/chat/completions",
             "body": {"model": "m", "messages": [{"role": "user", "content": 'Rate "abdomen" 1-7'}]}}]
    res = [chat_result("exp_task_1", "4", [(*V02_TOP[0], V02_TOP)]),
           chat_result("exp_task_2", "5.", [("5", -0.05, V02_TOP), (".", -0.1, [(".", -0.1)])]),
           chat_result("exp_task_9", "3", [("3", -0.1, V02_TOP)])]
    joined = R.join_results(R.canonical_results(lines_df(spark, res, SC.RESULT_UNION)),
                            R.canonical_requests(lines_df(spark, reqs, SC.REQUEST_UNION)))
    out = {r["task_id"]: r for r in R.score(joined, "weighted_sum", "Familiarity").collect()}
    assert set(out) == {"exp_task_1", "exp_task_2"}          # unmatched result dropped
    t1 = out["exp_task_1"]
    assert t1["word"] == "abdication"                         # last request wins
    assert t1["weighted_sum"] == pytest.approx(V02_WEIGHTED, rel=1e-15)
    assert t1["logprob"] == V02_TOP[0][1]
    t2 = out["exp_task_2"]
    assert t2["weighted_sum"] is None and t2["logprob"] is None  # two tokens: gate A fails
    assert t2["value"] == 5.0


def test_google_dialect_golden(spark):
    reqs = [{"key": "g_task_1", "request": {"contents": [{"parts": [{"text": 'Rate "abdication"'}]}]}}]
    res = [{"key": "g_task_1", "processed_time": "2025-08-18T04:18:00Z", "response": {"candidates": [{
        "content": {"parts": [{"text": "2.88"}], "role": "model"},
        "logprobsResult": {"chosenCandidates": [{"token": SINGLE[0], "logProbability": SINGLE[1]}],
                           "topCandidates": [{"candidates": [{"token": SINGLE[0], "logProbability": SINGLE[1]}]}]}}]}}]
    joined = R.join_results(R.canonical_results(lines_df(spark, res, SC.RESULT_UNION)),
                            R.canonical_requests(lines_df(spark, reqs, SC.REQUEST_UNION)))
    row = R.score(joined, "weighted_sum", "Familiarity").first()
    assert row["word"] == "abdication" and row["value"] == 2.88
    assert row["logprob"] == SINGLE[1]                     # logprob whenever present
    assert row["weighted_sum"] is None                      # "2.88" is not an integer answer


def test_local_dialect_json_mode(spark):
    reqs = [{"id": "l_task_1", "prompt": 'Return JSON for "abdomen"'}]
    res = [{"id": "l_task_1", "response": {"status_code": -1, "body": {"choices": [{"index": 0, "message": {
        "role": "assistant", "content": '{"Word": "abdomen", "Familiarity": 5}'}}]}}}]
    joined = R.join_results(R.canonical_results(lines_df(spark, res, SC.RESULT_UNION)),
                            R.canonical_requests(lines_df(spark, reqs, SC.REQUEST_UNION)))
    row = R.score(joined, "json", "Familiarity").first()
    assert row["dialect"] == "local"
    assert row["value"] == 5.0 and row["word_mismatch"] is False


def test_google_prompt_skips_contents_without_parts(spark):
    reqs = [{"key": "g", "request": {"contents": [{"role": "user"}, {"parts": [{"text": 'A "x"'}, {"text": "B"}]}]}}]
    got = R.canonical_requests(lines_df(spark, reqs, SC.REQUEST_UNION)).first()["prompt"]
    assert got == 'A "x"\nB'


# (name, prompt, answer, steps, mode, expected: first word, last word, value, weighted_sum, logprob)
GOLDEN_ROWS = [
    ("v01_task1", "Rate the familiarity of abdication from 1 to 7.", "5",
     [(*V01_TOP[0], V01_TOP)], "weighted_sum",
     (None, None, 5.0, V01_WEIGHTED, V01_TOP[0][1])),
    ("v01_task2", "Rate the familiarity of abdomen from 1 to 7.",
     "I would rate the familiarity with the abdomen as a 6.",
     [("I", -0.2, V01_TOP), (" would", -0.1, [(" would", -0.1)])], "json",
     (None, None, 6.0, None, None)),
    ("v08_task1", 'Rate "abdication" from 0 to 100.', "40",
     [(*V08_TOP[0], V08_TOP)], "weighted_sum",
     ("abdication", "abdication", 40.0, V08_WEIGHTED, V08_TOP[0][1])),
    ("v09_task1", 'Example: "imam" gets 3. Now rate "abdication".', "4",
     [(*V09_TOP[0], V09_TOP)], "weighted_sum",
     ("imam", "abdication", 4.0, V09_WEIGHTED, V09_TOP[0][1])),
    ("v04_task1", 'Rate "abdication". Answer as JSON with keys "Word" and "Familiarity".',
     '{"Word": "abdication", "Familiarity": 4}', [("{", -0.01, [("{", -0.01)])], "json",
     ("abdication", "Familiarity", 4.0, None, None)),
]


@pytest.mark.parametrize("row", GOLDEN_ROWS, ids=[r[0] for r in GOLDEN_ROWS])
def test_fixture_golden_rows(spark, row):
    name, prompt, answer, steps, mode, (first, last, value, ws, lp) = row
    req = [{"custom_id": name, "body": {"messages": [{"role": "user", "content": prompt}]}}]
    res = [chat_result(name, answer, steps)]
    joined = R.join_results(R.canonical_results(lines_df(spark, res, SC.RESULT_UNION)),
                            R.canonical_requests(lines_df(spark, req, SC.REQUEST_UNION)))
    out = R.score(joined, mode, "Familiarity").first()
    out_last = R.score(joined, mode, "Familiarity", word_rule="last").first()
    assert (out["word"], out_last["word"]) == (first, last)
    from wordrate import functions as W
    x5 = joined.select(W.number_from_answer("answer_text", "Familiarity")).first()[0]
    assert x5 == value
    if ws is None:
        assert out["weighted_sum"] is None
    else:
        assert out["weighted_sum"] == pytest.approx(ws, rel=1e-15)
    assert out["logprob"] == lp
