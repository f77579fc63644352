"""Queries that write the driver tables in the formats of the sinks and read them back through
the sources (S2, S10, S13, K3-K8, F6)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chat as CH
from ..operators import requests as Q
from ..operators import responses as R
from ..operators import sampling as SP
from ..sinks import files as K
from ..sources import files as S
from . import derive as D
from .chat_q import _REC_SQL, _records
from .registry import query
from .scoring_q import _E, _scored
from .splits_q import _NORMS_SQL, SEED, _norms


@query("csv_utf8", sql="""
SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, md5(text || '"' || chr(10) || ',') AS text_hash FROM conversations""")
def csv_utf8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns as UTF-8 CSV, with quotes, commas and line ends in the cells, read back."""
    folder = os.path.join(K.scratch_dir(spark, "csv"), "turns.csv")
    rows = D.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.concat("text", F.lit('"\n,')).alias("text"))
    (rows.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .csv(folder))
    back = S.read_csv_utf8(spark, folder, multi_line=True)
    return back.select("conv_id", "turn", "role", F.md5("text").alias("text_hash"))


@query("prompt_file", sql="""
WITH p AS (SELECT text || chr(10) || 'Rate "{Word}" (from 1 to 7).' || chr(10) AS p FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark))
SELECT p_partkey, md5(replace(p.p, '{Word}', p_name)) AS prompt_hash FROM part, p""")
def prompt_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S10 + P6: a prompt of several lines in a text file (here made of a benchmark item), read whole
    and filled for every part."""
    folder = K.scratch_dir(spark, "prompt")
    first = D.read(spark, sf_dir, "benchmark").agg(F.min_by("text", "item_id").alias("text"))
    first.select(F.concat("text", F.lit('\nRate "{Word}" (from 1 to 7).')).alias("value")).coalesce(1).write.text(folder)
    prompt = S.read_prompt(spark, folder).first()["prompt"]  # one file
    words = D.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("task_no"), F.col("p_name").alias("word"))
    reqs = Q.build_requests(words, D.experiment("OpenAI", prompt=prompt))
    return reqs.select(F.col("task_no").alias("p_partkey"), F.md5("prompt").alias("prompt_hash"))


@query("chat_jsonl", sql=_REC_SQL + """
SELECT 'records_llama3.1.jsonl' AS file, md5(u) AS user_hash, a AS assistant_content, 2 AS n_messages FROM r""")
def chat_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4/K5 + K8 + S13: training records as JSON lines in a folder named after the data set (only
    the last extension goes), read back as chat records."""
    name = CH.output_stem("/data/records_llama3.1.xlsx")
    path = os.path.join(K.scratch_dir(spark, "chat"), name)
    K.write_jsonl(_records(spark, sf_dir).select("messages"), path)
    back = S.read_chat_records(spark, path)
    m = F.col("messages")
    return back.select(F.element_at(F.split(F.regexp_extract(F.input_file_name(), r"(.*)/[^/]*$", 1), "/"), -1).alias("file"),
                       F.md5(m[0]["content"]).alias("user_hash"), m[1]["content"].alias("assistant_content"), F.size(m).alias("n_messages"))


@query("split_folders", sql=_NORMS_SQL + """,
s AS (SELECT doc_id, rating_a, CASE WHEN row_number() OVER (ORDER BY h, doc_id) <= (SELECT round_even(0.3 * count(*), 0) FROM n)
                    THEN 'train' ELSE 'test' END AS split FROM n)
SELECT CASE split WHEN 'train' THEN 'train_split_30.0_randomstate_42' ELSE 'test_split_70.0_randomstate_42' END AS folder,
       split, count(*) AS n, sum(doc_id)::BIGINT AS ids, round(sum(rating_a), 6) AS ratings
FROM s GROUP BY split""")
def split_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: an exact split with its payload, a folder per part named with share and seed."""
    path = K.scratch_dir(spark, "splits")
    K.write_splits(SP.split_exact(_norms(spark, sf_dir), "doc_id", 0.3, SEED), path, 0.3, SEED)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("split_name").alias("folder"), "split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"), F.round(F.sum("rating_a"), 6).alias("ratings"))


@query("rewrite_sheet", sql="""
SELECT 'current' AS version, p_brand AS sheet, count(*) AS n, sum(p_partkey)::BIGINT AS keys,
       sum(CASE WHEN p_brand = 'Brand#1' THEN p_size + 1000 ELSE p_size END)::BIGINT AS sizes FROM part GROUP BY p_brand
UNION ALL SELECT '_old', p_brand, count(*), sum(p_partkey)::BIGINT,
       sum(CASE WHEN p_brand = 'Brand#1' THEN p_size + 500 ELSE p_size END)::BIGINT FROM part GROUP BY p_brand""")
def rewrite_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: workbooks of all parts, a sheet per brand; one sheet is rewritten twice, the other sheets
    stay, and the version before stays readable."""
    from ..sources import xlsx
    xlsx.register(spark)
    base = K.scratch_dir(spark, "rewrite")
    rows = D.read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand").repartition(3)
    rows.write.format("xlsx").mode("append").option("sheetColumn", "p_brand").save(os.path.join(base, "in"))

    def read(path):
        return spark.read.format("xlsx").schema("p_partkey long, p_size int, sheet string").option("sheet", "*").load(path)

    book = read(os.path.join(base, "in"))
    for step in (500, 1000):
        merged = book.where("sheet = 'Brand#1'").withColumn("p_size", F.col("p_size") + step)
        K.rewrite_first_sheet(book, merged, "Brand#1", os.path.join(base, "out"))
    versions = [read(os.path.join(base, "out", v)).withColumn("version", F.lit(v)) for v in ("current", "_old")]
    return versions[0].unionByName(versions[1]).groupBy("version", "sheet").agg(
        F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("keys"), F.sum("p_size").alias("sizes"))


@query("warnings_file", sql=_E + "SELECT task_id, word, CAST(label + 3 AS DOUBLE) AS value FROM w WHERE label = 1")
def warnings_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6 + X9: answers about another word than the one asked for, written beside the results."""
    path = os.path.join(K.scratch_dir(spark, "warnings"), "mismatches")
    scored = _scored(spark, sf_dir, "openai", mode="json", json_answers=True)
    K.write_diagnostics(R.mismatches(scored).select("task_id", "word", "value"), path)
    return spark.read.schema("task_id string, word string, value double").json(path)


@query("prediction_files", sql="""
SELECT 'tuned' AS run, count(*) AS n_tasks, sum(p_partkey + 1)::BIGINT AS task_sum FROM part""")
def prediction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """of a folder with batch files and prediction files of two runs, the predictions of one."""
    folder = K.scratch_dir(spark, "predictions")
    words = D.read(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("task_no"), F.col("p_name").alias("word"))
    for run, stamp in (("tuned", "2025-01-01"), ("tuned", "predictions"), ("tuned_2", "predictions")):
        reqs = Q.build_requests(words, D.experiment("Google", run=run))
        K.write_request_batches(reqs, folder, chunk_size=400, mode="append", stamp=stamp)
    back = S.read_batches_of_run(spark, folder, "tuned", glob="*predictions.jsonl")
    task = F.regexp_extract("key", r"_task_(\d+)$", 1).cast("long")
    return back.groupBy("run").agg(F.count(F.lit(1)).alias("n_tasks"), F.sum(task).alias("task_sum"))
