"""Queries: norm merge, missing report, re-queue, completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import norms as NM
from ..operators import requeue as RQ
from ..sources import schemas as SC
from ..sources.files import parse_json_lines
from . import derive as D
from .registry import query


def _combined(spark: SparkSession, sf_dir: str):
    docs = D.read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = D.read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id")
    return NM.combine_norms(docs, labels, "doc_id", "id", suffix="_new")


@query("combine_norms", sql="""
SELECT DISTINCT d.doc_id AS doc_id, d.lang AS lang, d.source AS source, d.n_chars AS n_chars,
       l.quality AS quality_new, l.toxic AS toxic_new
FROM documents d LEFT JOIN labels l ON d.doc_id IS NOT DISTINCT FROM l.doc_id""")
def combine_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5 + U4 + A15: left join on differently named keys, new columns suffixed, duplicates dropped."""
    merged, _ = _combined(spark, sf_dir)
    return merged


@query("combine_missing", sql="""
SELECT d.doc_id AS doc_id, d.lang AS lang,
       coalesce(CAST(l.quality AS VARCHAR), '#N/D') AS quality_new,
       coalesce(CAST(l.toxic AS VARCHAR), '#N/D') AS toxic_new
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE l.quality IS NULL OR l.toxic IS NULL""")
def combine_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X22 + F5 report of rows lacking right-side values, rendered with the X21 sentinel."""
    merged, new_cols = _combined(spark, sf_dir)
    miss = NM.missing_rows(merged, new_cols).select("doc_id", "lang", *new_cols)
    return miss.select("doc_id", "lang", *[F.coalesce(F.col(c).cast("string"), F.lit("#N/D")).alias(c)
                                            for c in new_cols])


@query("pick_and_rename", sql="""
SELECT l_orderkey, l_linenumber, l_quantity AS fam_quantity, l_tax AS fam_tax
FROM lineitem""")
def pick_and_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P15 + P16: pick columns by prefix and rename by substring (logprobs_ -> fam_)."""
    li = D.read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("logprobs_quantity"),
        F.col("l_tax").alias("logprobs_tax"), "l_discount")
    picked = NM.pick_prefixed(li, "l_orderkey", "l_linenumber", "logprobs")
    return NM.rename_substring(picked, "logprobs_", "fam_")


def _error_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An error file as text lines: error records for 'error' events, a corrupt line
    for 'view' events, blank lines for the rest (S6 input)."""
    ev = D.read(spark, sf_dir, "events")
    rec = F.to_json(F.struct(F.concat(F.lit("conv_"), F.col("user_id").cast("string"), F.lit("_0")).alias("custom_id"),
                             F.struct(F.lit("server_error").alias("code")).alias("error")))
    return ev.select(F.when(F.col("event_type") == "error", rec)
                      .when(F.col("event_type") == "view", F.lit('{"custom_id": broken'))
                      .otherwise(F.lit("")).alias("value"))


@query("requeue_failed", sql="""
SELECT 'conv_' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS custom_id, conv_id, turn
FROM conversations
WHERE 'conv_' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) IN (
  SELECT 'conv_' || CAST(user_id AS VARCHAR) || '_0' FROM events WHERE event_type = 'error')""")
def requeue_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6 + J6: tolerant parse of an error file (blank lines skipped, bad lines set
    aside), then the requests whose id failed, by left semi join."""
    lines = _error_lines(spark, sf_dir).where(F.trim("value") != "")
    parsed = parse_json_lines(lines, SC.OPENAI_RESULT)
    failed = parsed.where(F.col("_bad").isNull()).select("custom_id")
    conv = D.read(spark, sf_dir, "conversations")
    requests = conv.select(F.concat(F.lit("conv_"), F.col("conv_id").cast("string"), F.lit("_"),
                                    F.col("turn").cast("string")).alias("custom_id"), "conv_id", "turn")
    return RQ.requeue(requests, failed)


@query("completeness", sql="""
WITH req AS (SELECT DISTINCT lang AS run, doc_id FROM documents),
res AS (SELECT d.lang AS run, l.doc_id, bool_or(l.quality = 0) AS failed
        FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY 1, 2),
j AS (SELECT coalesce(req.run, res.run) AS run, req.doc_id IS NOT NULL AS has_req,
             res.doc_id IS NOT NULL AS has_res, res.failed AS failed
      FROM req FULL OUTER JOIN res ON req.run = res.run AND req.doc_id = res.doc_id)
SELECT run,
       count(*) FILTER (WHERE has_req) AS n_requests,
       count(*) FILTER (WHERE has_req AND has_res AND NOT failed) AS n_answered,
       count(*) FILTER (WHERE has_req AND coalesce(failed, false)) AS n_failed,
       count(*) FILTER (WHERE has_req AND NOT has_res) AS n_missing,
       count(*) FILTER (WHERE NOT has_req) AS n_extra,
       bool_and(NOT has_req OR (has_res AND NOT failed)) AS all_finished
FROM j GROUP BY run""")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run (language), requests vs answered / failed (quality 0) / missing."""
    docs = D.read(spark, sf_dir, "documents").select(F.col("lang").alias("run"), F.col("doc_id").alias("task_id"))
    labels = D.read(spark, sf_dir, "labels")
    results = (labels.join(D.read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
                     .select(F.col("lang").alias("run"), F.col("doc_id").alias("task_id"),
                             (F.col("quality") == 0).alias("failed")))
    return RQ.completeness(docs, results)
