"""Queries over files that land in several drops (R1, R2, A16 while streaming)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks import files as K
from ..streaming import monitor as M
from . import derive as D
from .registry import query


def _drop(lines: DataFrame, folder: str) -> None:
    lines.select("run", "value").write.partitionBy("run").text(folder)


@query("stream_completeness", sql="""
WITH d AS (SELECT doc_id, lang AS run, 't_' || (doc_id // 3) AS id FROM documents),
req AS (SELECT DISTINCT run, id FROM d WHERE doc_id % 7 <> 0),
res AS (SELECT run, id, bool_or(l.quality = 0) AS failed, bool_or(l.quality <> 0) AS said
        FROM labels l JOIN d ON d.doc_id = l.doc_id GROUP BY run, id),
j AS (SELECT coalesce(req.run, res.run) AS run, req.id IS NOT NULL AS has_req, res.id IS NOT NULL AS has_res, failed, said
      FROM req FULL OUTER JOIN res ON req.run = res.run AND req.id = res.id)
SELECT run, count(*) FILTER (WHERE has_req) AS n_requests,
       count(*) FILTER (WHERE has_req AND has_res AND NOT failed) AS n_answered,
       count(*) FILTER (WHERE has_req AND coalesce(failed, false)) AS n_failed,
       count(*) FILTER (WHERE has_req AND NOT has_res) AS n_missing,
       count(*) FILTER (WHERE NOT has_req) AS n_extra,
       bool_and(NOT has_req OR (has_res AND NOT failed)) AS all_finished,
       count(*) FILTER (WHERE has_req AND coalesce(said, false)) AS n_first_answers
FROM j GROUP BY run""")
def stream_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 + R2 + A16 over files in two drops: one run per language, task ids that the runs
    share, requests that come after their results, repeated tasks, failed ones (quality 0) and
    extras.  After the last trigger the report equals the batch one, and every task
    with an answer has had one ``answer`` event."""
    base = K.scratch_dir(spark, "monitor")
    docs = D.read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("run"), F.concat(F.lit("t_"), F.expr("doc_id div 3")).alias("id"))
    labels = D.read(spark, sf_dir, "labels").join(docs, "doc_id")
    user = F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit('Rate "'), F.col("run"), F.col("doc_id"), F.lit('"')).alias("content")))
    requests = docs.where("doc_id % 7 <> 0").withColumn("value", F.to_json(F.struct(F.col("id").alias("custom_id"), F.struct(user.alias("messages")).alias("body"))))
    answer = F.struct(F.struct(F.lit("assistant").alias("role"), (F.col("toxic") + 1).cast("string").alias("content")).alias("message"))
    said = F.struct(F.struct(F.array(answer).alias("choices")).alias("body"))
    failed = F.col("quality") == 0
    results = labels.withColumn("value", F.to_json(F.struct(F.col("id").alias("custom_id"), F.when(failed, "server_error").alias("error"),
                                                            F.when(~failed, said).alias("response"))))
    for k in range(2):
        # a third of the requests comes late, half of the results, and a fifth of them twice
        _drop(requests.where((F.col("doc_id") % 3 == 0) == bool(k)), os.path.join(base, "requests", f"drop{k}"))
        _drop(results.where(((F.col("doc_id") % 2 == 0) == bool(k)) | (F.col("doc_id") % 5 == 0)), os.path.join(base, "results", f"drop{k}"))
        changes = M.file_changes(spark, os.path.join(base, "requests"), os.path.join(base, "results"))
        M.run_available(M.task_events(changes), os.path.join(base, "events"), os.path.join(base, "ckpt-events"))
        events = M.stored_events(spark, os.path.join(base, "events"))
        M.run_available(M.run_reports(events), os.path.join(base, "reports"), os.path.join(base, "ckpt-reports"))
    told = spark.read.parquet(os.path.join(base, "events")).where("event = 'answer'").groupBy("run").agg(F.count(F.lit(1)).alias("n_first_answers"))
    report = M.latest_reports(spark.read.schema(M.REPORTS).parquet(os.path.join(base, "reports")))
    return report.join(told, "run", "left").withColumn("n_first_answers", F.coalesce("n_first_answers", F.lit(0).cast("long")))
