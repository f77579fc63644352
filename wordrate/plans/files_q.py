"""Queries that go through files: chunked request files and run selection (K1, S7, S8),
newest file (S9), and streaming ingest of result files (R1, R2).  Files are written
under the shared checkpoint folder, derived from the driver tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import requests as Q
from ..operators import responses as R
from ..sinks import files as K
from ..sources import files as S
from ..streaming import ingest as ST
from . import derive as D
from .registry import query
from .scoring_q import _E


def _write_runs(spark: SparkSession, sf_dir: str, folder: str) -> None:
    part = D.read(spark, sf_dir, "part")
    words = Q.number_words(part, ["p_partkey"], column="p_name")
    exps = [D.experiment("OpenAI", run="original"), D.experiment("OpenAI", run="original_2")]
    reqs = Q.build_requests(words, exps)
    K.write_request_batches(reqs, folder, chunk_size=500)


@query("prefix_files", sql="""
WITH n AS (SELECT row_number() OVER (ORDER BY p_partkey) AS task_no FROM part)
SELECT 'original' AS run, CAST(floor((task_no - 1) / 500) AS BIGINT) AS batch_index, count(*) AS n_tasks,
       min(task_no) AS first_task
FROM n GROUP BY 2""")
def prefix_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 write of two runs (``original``, ``original_2``) in 500-task files, then S8:
    only the files of run ``original`` are read back (S7 multi-file scan)."""
    folder = K.scratch_dir(spark, "batches")
    _write_runs(spark, sf_dir, folder)
    reqs = S.read_batches_of_run(spark, folder, "original")
    per_file = reqs.select("run", S.batch_of_file(F.col("line_no.file")).alias("batch_index"),
                           F.regexp_extract("custom_id", r"_task_(\d+)$", 1).cast("long").alias("task_no"))
    return per_file.groupBy("run", "batch_index").agg(F.count(F.lit(1)).alias("n_tasks"),
                                                      F.min("task_no").alias("first_task"))


@query("newest_file", sql="""
SELECT 'later' AS run, count(*) AS n_requests, sum(length(p_name))::BIGINT AS name_chars FROM part""")
def newest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9 + T9: two runs are written in files of 500 requests, the first over the odd parts and
    the other over all; the first file of the later run is given the newest time, the newest file
    directly in the folder is found, and the run it belongs to is read whole and counted."""
    folder = K.scratch_dir(spark, "newest")
    part = D.read(spark, sf_dir, "part")
    for run, rows in (("earlier", part.where(F.col("p_partkey") % 2 == 1)), ("later", part)):
        words = Q.number_words(rows, ["p_partkey"], column="p_name")
        reqs = Q.build_requests(words, D.experiment("OpenAI", run=run))
        K.write_request_batches(reqs, folder, chunk_size=500, stamp="2025-01-01-00-00")
    K.touch(spark, os.path.join(folder, "later_batch_0_2025-01-01-00-00.jsonl"), 4102444800)
    newest = S.newest_file(spark, folder, "*.jsonl").select(S.run_of_file(F.col("path")).alias("run")).first()["run"]  # one name
    reqs = S.read_batches_of_run(spark, folder, newest)
    words = F.regexp_extract(F.col("body.messages")[0]["content"], '"([^"]*)"', 1)
    return reqs.groupBy("run").agg(F.count(F.lit(1)).alias("n_requests"), F.sum(F.length(words)).alias("name_chars"))


@query("prepare_requests", sql="""
WITH n AS (SELECT p_name, row_number() OVER (ORDER BY p_partkey) AS task_no FROM part)
SELECT 'a/b 50%' AS run, CAST(floor((task_no - 1) / 300) AS BIGINT) AS batch_index, count(*) AS n_tasks, min(task_no) AS first_task,
       max(task_no) AS last_task, sum(task_no * length(p_name))::BIGINT AS names_in_order
FROM n GROUP BY 2""")
def prepare_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + P1 + P2 + K1 + S8: a word list in CSV files (ISO-8859-1), numbered in file order where
    its lines lie, requests in files of 300 named after a run with ``/`` and ``%``, written twice
    (the second time over the first), and the run's files read back by the manifest."""
    base = K.scratch_dir(spark, "prepare")
    part = D.read(spark, sf_dir, "part").select("p_partkey", "p_name")
    (part.repartitionByRange(4, "p_partkey").sortWithinPartitions("p_partkey").select(F.col("p_name").alias("Word"))
         .write.option("header", True).option("encoding", "ISO-8859-1").csv(os.path.join(base, "words.csv")))
    words = Q.number_words_in_file_order(S.read_word_table(spark, os.path.join(base, "words.csv")), "Word")
    reqs = Q.build_requests(words, [D.experiment("OpenAI", run="a/b 50%"), D.experiment("OpenAI", run="b")])
    for _ in range(2):
        K.write_request_batches(reqs, os.path.join(base, "out"), chunk_size=300, mode="overwrite")
    back = S.read_batches_of_run(spark, os.path.join(base, "out"), "a/b 50%")
    name = F.regexp_extract(F.col("body.messages")[0]["content"], '"([^"]*)"', 1)
    task = F.regexp_extract("custom_id", r"_task_(\d+)$", 1).cast("long")
    rows = back.select("run", S.batch_of_file(F.col("line_no.file")).alias("batch_index"), task.alias("task"), name.alias("name"),
                       (S.run_of_file(F.col("line_no.file")) == F.col("run")).alias("own"))
    return rows.where("own").groupBy("run", "batch_index").agg(
        F.count(F.lit(1)).alias("n_tasks"), F.min("task").alias("first_task"), F.max("task").alias("last_task"),
        F.sum(F.col("task") * F.length("name")).alias("names_in_order"))


@query("stream_scores", sql=_E + """
SELECT task_id, word,
       CASE WHEN label = 2 THEN 'The rating is 5' ELSE CAST(label + 3 AS VARCHAR) END AS answer_text,
       CASE WHEN label = 2 THEN 5.0 ELSE CAST(label + 3 AS DOUBLE) END AS value,
       round(lp1, 6) AS logprob,
       CASE WHEN label <> 2 THEN round(ws, 6) END AS weighted_sum
FROM w""")
def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 + R2: result files land in two drops (the second repeats the label 0-1
    answers); a streaming query dedupes per task within a watermark, joins the static
    request table and appends scored rows -- equal to the batch ``score_google``."""
    base = K.scratch_dir(spark, "stream")
    tasks = D.embedding_tasks(spark, sf_dir)
    stamp = F.date_format(F.timestamp_seconds(F.lit(1755490680) + F.col("task_no")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    lines = D.result_lines(tasks, "google").join(
        tasks.select(F.col("task_no").alias("line_no"), "label", stamp.alias("ts")), "line_no")
    with_time = lines.select(F.concat(F.expr("substr(value, 1, length(value) - 1)"),
                                      F.lit(',"processed_time":"'), F.col("ts"), F.lit('"}')).alias("value"),
                             "label")
    with_time.select("value").write.text(os.path.join(base, "in", "drop1"))
    with_time.where(F.col("label") <= 1).select("value").write.text(os.path.join(base, "in", "drop2"))
    requests = R.canonical_requests(D.derived_requests(spark, sf_dir, "Google"))
    stream = ST.scored_stream(spark, os.path.join(base, "in"), requests, feature_label="Familiarity",
                              watermark="1 hour")
    ST.run_available(stream, os.path.join(base, "out"), os.path.join(base, "checkpoint"))
    out = spark.read.parquet(os.path.join(base, "out"))
    return out.select("task_id", "word", "answer_text", "value", F.round("logprob", 6).alias("logprob"),
                      F.round("weighted_sum", 6).alias("weighted_sum"))


@query("xlsx_roundtrip", sql="""
SELECT p_partkey, p_name || CASE WHEN p_partkey % 50 = 0 THEN chr(13) || chr(10) || chr(11) || '_x0041_"&<' ELSE '' END AS p_name,
       p_size, p_retailprice, p_brand AS sheet
FROM part""")
def xlsx_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2 + S3/S4: the part table written as workbooks by several tasks, a sheet per brand (names
    with line ends, control characters and markup among the cells), and read back, a task per
    workbook and sheet, with the sheet's name as a column."""
    from ..sources import xlsx
    xlsx.register(spark)
    folder = K.scratch_dir(spark, "xlsx")
    part = D.read(spark, sf_dir, "part").withColumn(
        "p_name", F.when(F.col("p_partkey") % 50 == 0, F.concat("p_name", F.lit('\r\n\x0b_x0041_"&<'))).otherwise(F.col("p_name")))
    rows = part.select("p_partkey", "p_name", "p_type", "p_size", "p_retailprice", "p_brand").repartition(4, "p_brand")
    rows.write.format("xlsx").mode("append").option("sheetColumn", "p_brand").save(folder)
    return (spark.read.format("xlsx").schema("p_partkey long, p_name string, p_size int, p_retailprice double, sheet string")
                 .option("sheet", "*").load(folder))


@query("xlsx_one_sheet", sql="""
SELECT p_partkey, p_size FROM part WHERE p_brand = 'Brand#7' AND p_size >= 20""")
def xlsx_one_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 for some sheets and columns: of the workbooks of all parts, only the sheets of one brand are
    planned, and two columns of their cells are parsed."""
    from ..sources import xlsx
    xlsx.register(spark)
    folder = K.scratch_dir(spark, "xlsx")
    rows = D.read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size", "p_brand").repartition(3)
    rows.write.format("xlsx").mode("append").option("sheetColumn", "p_brand").save(folder)
    back = (spark.read.format("xlsx").schema("p_partkey long, p_size int, sheet string").option("sheet", "*")
                 .option("sheets", '["Brand#7"]').load(folder))
    return back.where("p_size >= 20").select("p_partkey", "p_size")
