"""End-to-end jobs over files (inline fixtures)."""

import json
import os
import re

import pytest
from measured_values import V02_TOP, V02_WEIGHTED
from pyspark.sql import functions as F

from wordrate import jobs

CATALOGUE = """
experiments:
  fam_v02:
    dataset_path: "words.csv"
    dataset_column: "Word"
    prompt_path: "standard.txt"
    model_name: "gpt-4o-mini-2024-07-18"
    company: "OpenAI"
"""


def test_prepare_then_score(spark, tmp_path):
    exp = tmp_path / "familiarity"
    (exp / "data").mkdir(parents=True)
    (exp / "prompts").mkdir()
    (exp / "data" / "words.csv").write_bytes("Word,FAM\nabdication,3.2\nabdomen,4.1\ncaf\xe9,5.0\n".encode("latin-1"))
    (exp / "prompts" / "standard.txt").write_text('How familiar is "{Word}"? Answer 1-7.', encoding="utf-8")
    out = str(tmp_path / "batches")
    reqs = jobs.prepare_requests(spark, str(exp), CATALOGUE, ["fam_v02"], out, chunk_size=2)
    got = sorted((r["task_no"], r["word"]) for r in reqs.collect())
    assert got == [(1, "abdication"), (2, "abdomen"), (3, "café")]
    files = [os.path.join(d, f) for d, _, fs in os.walk(out) for f in fs if f.endswith(".jsonl")]
    assert len(files) == 2                                   # 2 + 1 tasks in chunks of 2
    assert all(re.fullmatch(r"fam_v02_batch_[01]_[-0-9]+\.jsonl", os.path.basename(f)) for f in files)
    results = tmp_path / "results.jsonl"
    lines = []
    for n in (1, 2):
        lines.append(json.dumps({"id": "r", "custom_id": f"{exp}_task_{n}", "response": {"body": {"choices": [{
            "message": {"content": "4"},
            "logprobs": {"content": [{"token": "4", "logprob": V02_TOP[0][1],
                                      "top_logprobs": [{"token": t, "logprob": lp} for t, lp in V02_TOP]}]}}]}}}))
    results.write_text("\n".join(lines) + "\n", encoding="utf-8")
    scored = jobs.score_results(spark, out, str(results), str(tmp_path / "out"), mode="weighted_sum",
                                feature_label="Familiarity", run="fam_v02", fmt="xlsx")
    book = spark.read.format("xlsx").schema("word string, answer_text string, value double, logprob double, "
                                            "weighted_sum double, task_id string, run string").load(str(tmp_path / "out" / "scores"))
    assert sorted(r["word"] for r in book.collect()) == ["abdication", "abdomen"]
    rows = {r["word"]: r for r in scored.collect()}
    assert set(rows) == {"abdication", "abdomen"}
    assert abs(rows["abdomen"]["weighted_sum"] - V02_WEIGHTED) < 1e-12


def test_requeue_merge_finetune_agreement(spark, tmp_path):
    reqs = tmp_path / "batches.jsonl"
    reqs.write_text("\n".join(json.dumps({"custom_id": f"x_task_{i}", "body": {}}) for i in range(1, 6)) + "\n")
    errs = tmp_path / "errors.jsonl"
    errs.write_text('{"custom_id": "x_task_2"}\n\nnot json\n{"custom_id": "x_task_5"}\n')
    again = jobs.requeue_failed(spark, str(reqs), str(errs), str(tmp_path / "requeue"))
    assert sorted(json.loads(r["value"])["custom_id"] for r in again.collect()) == ["x_task_2", "x_task_5"]

    norms = spark.createDataFrame([(f"w{i}", float(i % 7) + 1.0, float((i * 3) % 7) + 1.0) for i in range(40)],
                                  "Word string, FAM double, FAM2 double")
    est = spark.createDataFrame([(f"w{i}", str(float(i % 5))) for i in range(0, 40, 2)], "word string, fam string")
    merged, missing = jobs.merge_norms(norms, est, "Word", "word", out_dir=str(tmp_path / "merge"))
    assert merged.count() == 40 and missing.count() == 20

    recs = jobs.finetune_records(norms, "Word", "FAM", "Rate {word}.", None, 0.5, 42, str(tmp_path / "ft"))
    assert recs.count() == 20
    assert recs.select(F.col("messages")[1]["content"]).first()[0].endswith(".0")

    stats = jobs.agreement(merged, "FAM", "fam_new", ["FAM", "FAM2", "fam_new"])
    assert stats["errors"].first()["n"] == 20
    assert stats["combined"].count() == 9
    assert sum(r["count"] for r in stats["hexbin"].collect()) == 20


def test_two_runs_in_one_folder(spark, tmp_path):
    exp = tmp_path / "fam"
    (exp / "data").mkdir(parents=True)
    (exp / "prompts").mkdir()
    (exp / "data" / "words.csv").write_bytes(b"Word\ncat\ndog\n")
    (exp / "prompts" / "a.txt").write_text('A: "{Word}"', encoding="utf-8")
    (exp / "prompts" / "b.txt").write_text('B: "{Word}"', encoding="utf-8")
    cat = """
experiments:
  run_a: {dataset_path: "words.csv", dataset_column: "Word", prompt_path: "a.txt", company: "OpenAI"}
  run_b: {dataset_path: "words.csv", dataset_column: "Word", prompt_path: "b.txt", company: "OpenAI"}
"""
    out = str(tmp_path / "batches")
    reqs = jobs.prepare_requests(spark, str(exp), cat, ["run_a", "run_b"], out)
    assert reqs.count() == 4
    res = tmp_path / "res.jsonl"
    res.write_text(json.dumps({"custom_id": f"{exp}_task_2", "response": {"body": {"choices": [
        {"message": {"content": "5"}}]}}}) + "\n", encoding="utf-8")
    b = jobs.score_results(spark, out, str(res), run="run_b", mode="number", feature_label="Familiarity")
    rows = b.collect()
    assert len(rows) == 1 and rows[0]["word"] == "dog" and rows[0]["value"] == 5.0
    a = jobs.score_results(spark, out, str(res), run="run_a", mode="number", feature_label="Familiarity")
    assert a.first()["word"] == "dog"
    with pytest.raises(ValueError):  # the file names no run, and there are two
        jobs.score_results(spark, out, str(res), mode="number", feature_label="Familiarity")


def _requests(path, ids_words):
    path.write_text("".join(json.dumps({"custom_id": i, "body": {"messages": [{"role": "user", "content": f'Rate "{w}"'}]}}) + "\n" for i, w in ids_words))


def _answers(path, ids_values):
    path.write_text("".join(json.dumps({"custom_id": i, "response": {"body": {"choices": [{"message": {"content": v}}]}}}) + "\n" for i, v in ids_values))


def test_runs_with_the_same_ids_and_other_words(spark, tmp_path):
    """Each answer belongs to the run in its file's name."""
    req, res, err = tmp_path / "req", tmp_path / "res", tmp_path / "err"
    for d in (req, res, err):
        d.mkdir()
    _requests(req / "original_batch_0_2025-01-01.jsonl", [("t_1", "cat"), ("t_2", "emu")])
    _requests(req / "original_2_batch_0_2025-01-01.jsonl", [("t_1", "dog"), ("t_2", "yak")])
    _answers(res / "original_batch_0_2025-01-01_results.jsonl", [("t_1", "4")])
    _answers(res / "original_2_batch_0_2025-01-01_results.jsonl", [("t_1", "6")])
    scored = jobs.score_results(spark, str(req), str(res), str(tmp_path / "out"), mode="number", feature_label="Familiarity")
    want = [("original", "cat", 4.0), ("original_2", "dog", 6.0)]
    assert sorted((r.run, r.word, r.value) for r in scored.collect()) == want
    back = spark.read.parquet(str(tmp_path / "out" / "scores"))
    assert sorted((r.run, r.word, r.value) for r in back.collect()) == want
    (err / "original_2_batch_0_2025-01-01_error.jsonl").write_text('{"custom_id": "t_2"}\n')
    again = [json.loads(r.value)["body"]["messages"][0]["content"] for r in jobs.requeue_failed(spark, str(req), str(err)).collect()]
    assert again == ['Rate "yak"']


def test_batches_of_a_run_are_the_only_files_read(spark, tmp_path):
    from wordrate.sources import files as S

    for run in ("a", "a_2", "a+b c"):
        _requests(tmp_path / f"{run}_batch_0_x.jsonl", [(f"{run}_1", "w")])
    (tmp_path / "a_batch_bad.txt").write_text("no json")
    for run in ("a", "a_2", "a+b c"):
        got = S.read_batches_of_run(spark, str(tmp_path), run)
        assert [(r.run, r.custom_id) for r in got.select("run", "custom_id").collect()] == [(run, f"{run}_1")]
        if run != "a":
            assert len(got.inputFiles()) == 1


def test_merge_workbook_keeps_other_sheets(spark, tmp_path):
    from wordrate.sources import xlsx
    src = tmp_path / "norms"
    src.mkdir()
    xlsx.write_workbook_sheets(str(src / "norms.xlsx"), [
        ("joint", ["Word", "FAM"], [("cat", 4.5), ("dog", 3.0), ("emu", 2.0)]),
        ("readme", ["Word", "FAM"], [("note", None)])])
    est = tmp_path / "est"
    est.mkdir()
    xlsx.write_workbook(str(est / "est.xlsx"), "Sheet1", ["word", "fam_gpt"], [("cat", 4.1), ("dog", 2.9)])
    path, missing = jobs.merge_workbook(spark, str(src), str(est), "Word", "word", str(tmp_path / "out"))
    assert [r["Word"] for r in missing.collect()] == ["emu"]
    back = {(r["sheet"], r["Word"]): r["fam_gpt_new"] for r in
            spark.read.format("xlsx").option("sheet", "*").load(path).collect()}
    assert back[("joint", "cat")] == "4.1" and back[("joint", "emu")] == "#N/D"
    assert ("readme", "note") in back
