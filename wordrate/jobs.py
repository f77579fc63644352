"""End-to-end jobs over files: what each command of the original workflow does, as one
Spark job each.  Every function reads its inputs with the ``sources`` readers, composes
the operators, and writes through the ``sinks`` (distributed writes, no driver data).

    prepare_requests      word table + catalogue + prompt  -> chunked request files   (§3.1)
    score_results         request files + result files     -> rating table            (§3.3)
    requeue_failed        request files + error file       -> requests to send again  (J6)
    merge_norms           norm table + estimate table      -> merged table + report   (J5)
    merge_workbook        workbook + estimate workbook     -> new workbook version    (J5, K3)
    finetune_records      norm table + templates           -> train/test + chat JSONL (§3.4)
    agreement             merged table                     -> statistics tables       (A1-A12)
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import numeric as N
from .operators import agreement as AG
from .operators import chat as CH
from .operators import norms as NM
from .operators import requests as Q
from .operators import requeue as RQ
from .operators import responses as R
from .operators import sampling as SP
from .sinks import files as K
from .sources import catalogue as C
from .sources import files as S


def prepare_requests(spark: SparkSession, experiment_path: str, catalogue_yaml: str, names: Sequence[str],
                     out_dir: str, chunk_size: int = 50000, order_by: str | None = None) -> DataFrame:
    """§3.1 for one or several catalogue experiments sharing a word table: scan ->
    number (P2) -> pair with the experiments (J8) -> fill prompts (P6) -> provider
    records (P8-P12) -> chunked JSONL files per run (K1).  Returns the request table."""
    cat = C.read_catalogue(catalogue_yaml)
    first = C.lookup(cat, "experiments", names[0])
    prompts = {}
    for n in names:
        pp = C.lookup(cat, "experiments", n)["prompt_path"]
        prompts[pp] = S.read_prompt(spark, os.path.join(experiment_path, "prompts", pp)).first()["prompt"]
    exps = C.experiments(cat, experiment_path, prompts, names=list(names))
    column = first.get("dataset_column", "word")
    table_path = os.path.join(experiment_path, "data", first["dataset_path"])
    words = S.read_word_table(spark, table_path)
    if order_by is None:  # input order of the file
        numbered = Q.number_words_in_file_order(words, column=column)
    else:
        numbered = Q.number_words(words, [order_by], column=column)
    reqs = Q.build_requests(numbered, exps)
    K.write_request_batches(reqs, out_dir, chunk_size=chunk_size)
    return reqs


def score_results(spark: SparkSession, request_paths, result_paths, out_dir: str | None = None,
                  mode: str = "weighted_sum", feature_label: str = "AoA", locale: str = "default",
                  word_rule: str = "first", run: str | None = None, fmt: str = "parquet") -> DataFrame:
    """§3.3: both sides read with the union schemas (dialect per row), requests
    deduplicated last-wins per (run, task id), inner join on both, one scoring projection;
    word mismatches are written beside the result as diagnostics (K6).  Task ids carry the
    experiment folder, not the run (P3), so the run comes from the files' names (or their
    ``run=`` folder).  ``run`` picks one run, and is the run of files that tell none; without
    it, such results belong to the requests' only run, and it is an error if there are
    several.  ``fmt="xlsx"`` writes workbooks (K2, one per task) instead of parquet."""
    reqs = R.canonical_requests(S.read_requests(spark, request_paths))
    res = R.canonical_results(S.read_results(spark, result_paths))
    if run is None and res.where(F.col("run") == "").limit(1).count():
        known = [r["run"] for r in reqs.select("run").distinct().limit(2).collect()]
        if len(known) > 1:
            raise ValueError("result files name no run, and the requests are of several; give run=")
        run = known[0] if known else ""
        res = res.withColumn("run", F.when(F.col("run") == "", F.lit(run)).otherwise(F.col("run")))
    elif run is not None:
        mine = F.when(F.col("run") == "", F.lit(run)).otherwise(F.col("run"))
        reqs, res = (d.withColumn("run", mine).where(F.col("run") == run) for d in (reqs, res))
    scored = R.score(R.join_results(res, reqs), mode=mode, feature_label=feature_label,
                     locale=locale, word_rule=word_rule)
    if out_dir:
        table = scored.select("word", "answer_text", "value", "logprob", "weighted_sum", "task_id", "run")
        if fmt == "xlsx":
            from .sources import xlsx
            xlsx.register(spark)
            table.write.format("xlsx").mode("append").option("sheet", "scores").save(os.path.join(out_dir, "scores"))
        else:
            table.write.mode("error").format(fmt).save(os.path.join(out_dir, "scores"))
        K.write_diagnostics(R.mismatches(scored), os.path.join(out_dir, "word_mismatch"))
    return scored


def requeue_failed(spark: SparkSession, request_paths, error_paths, out_dir: str | None = None) -> DataFrame:
    """J6 with a tolerant read of the error file (S6); rejects go to diagnostics.  An error
    file whose name tells its run re-queues that run's requests only; one that tells none
    matches by id alone."""
    text = spark.read.text(request_paths).select("value", S.run_of_file(F.col("_metadata.file_path")).alias("run"))
    parsed = S.parse_json_lines(text.where(F.trim("value") != ""), "custom_id string", keep=("value", "run")).where(F.col("_bad").isNull())
    failed, rejects = S.read_jsonl_tolerant(spark, error_paths, "custom_id string")
    failed = failed.select("custom_id", S.run_of_file(F.col("line_no.file")).alias("run"))
    reqs = parsed.select("run", "custom_id", "value")
    hit = RQ.requeue(reqs, failed, run="run")
    again = hit.select("value")
    if out_dir:
        again.write.mode("error").text(os.path.join(out_dir, "requests"))
        K.write_diagnostics(rejects, os.path.join(out_dir, "rejected_lines"))
    return again


def merge_norms(left: DataFrame, right: DataFrame, left_key: str, right_key: str, suffix: str = "_new",
                out_dir: str | None = None) -> tuple[DataFrame, DataFrame]:
    """J5 + X22 report; the written table renders missing cells as '#N/D' (X21)."""
    merged, new_cols = NM.combine_norms(left, right, left_key, right_key, suffix)
    missing = NM.missing_rows(merged, new_cols).select(left_key)
    if out_dir:
        NM.render_missing(merged).write.mode("error").option("header", True).csv(os.path.join(out_dir, "merged"))
        K.write_diagnostics(missing, os.path.join(out_dir, "missing"))
    return merged, missing


def merge_workbook(spark: SparkSession, workbook_path: str, estimates_path: str, left_key: str, right_key: str,
                   out_base: str, suffix: str = "_new") -> tuple[str, DataFrame]:
    """The workbook merge command: left-join the first sheet of a workbook with the
    first sheet of another (J5), render missing cells as '#N/D' (X21), keep every other
    sheet unchanged and write a new version (K3; the previous one stays as ``_old``).
    Returns the new version path and the rows lacking estimates (X22 report)."""
    from .sources import xlsx
    xlsx.register(spark)
    first = xlsx.sheet_names(workbook_path)[0]
    book = spark.read.format("xlsx").option("sheet", "*").load(workbook_path)
    left = book.where(F.col("sheet") == first).drop("sheet")
    right = spark.read.format("xlsx").load(estimates_path)
    merged, missing = merge_norms(left, right, left_key, right_key, suffix)
    path = K.rewrite_first_sheet(book, NM.render_missing(merged), first, out_base)
    return path, missing


def finetune_records(norms: DataFrame, key: str, answer_column: str, user_template: str,
                     assistant_template: str | None, fraction: float, seed: int, out_dir: str) -> DataFrame:
    """§3.4: exact-fraction split (T4/J7, K7), chat records of the training rows
    (P17/P18, K4), and the contents-dialect copy (P19)."""
    split = SP.split_exact(norms, key, fraction, seed, rule="round")
    K.write_splits(split, os.path.join(out_dir, "splits"), fraction, seed)
    train = split.where(F.col("split") == "train").drop("split")
    records = CH.chat_records(train, user_template, answer_column, assistant_template)
    K.write_jsonl(records.select("messages"), os.path.join(out_dir, "chat"))
    K.write_jsonl(records.select(CH.to_contents("messages").alias("contents")), os.path.join(out_dir, "contents"))
    return records


def agreement(table: DataFrame, truth: str, pred: str, columns: Sequence[str],
              by: Sequence[str] = ()) -> dict[str, DataFrame]:
    """A1-A12 over a merged table whose estimate columns may be text (X20 first)."""
    numeric = table.select(*by, *[N.coerce_numeric(c).alias(c) for c in columns])
    return {
        "errors": AG.error_metrics(numeric, truth, pred, by=list(by)),
        "pearson": AG.pearson_matrix(numeric, list(columns)),
        "spearman": AG.spearman_matrix(numeric, list(columns)),
        "combined": AG.combined_correlations(numeric, list(columns)),
        "histogram": AG.histogram(numeric, pred, 100),
        "hexbin": AG.hexbin(numeric, truth, pred, 30),
        "error_density": AG.error_density(numeric.select((F.col(pred) - F.col(truth)).alias("e")), "e"),
    }


__all__ = ["prepare_requests", "score_results", "requeue_failed", "merge_norms", "merge_workbook",
           "finetune_records", "agreement"]
