"""Queries: seeded shuffles and exact-size splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sampling as SP
from . import derive as D
from .registry import query

SEED = 42


def _norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as a norm table with two ratings per item, and their texts."""
    docs = D.read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "text")
    labels = D.read(spark, sf_dir, "labels")
    j = docs.join(labels, "doc_id")
    return j.select("doc_id", (F.col("n_chars") / 1000.0).alias("rating_a"),
                    F.when(F.col("lang") != "de", (F.col("quality") * 2 + F.col("toxic") + 1) * 1.0)
                     .alias("rating_b"), "text")


_NORMS_SQL = """
WITH n AS (
  SELECT d.doc_id AS doc_id, d.n_chars / 1000.0 AS rating_a,
         CASE WHEN d.lang <> 'de' THEN (l.quality * 2 + l.toxic + 1) * 1.0 END AS rating_b, md5(d.text) AS text_hash,
         md5(CAST(d.doc_id AS VARCHAR) || '#42') AS h
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
"""


@query("seeded_shuffle", sql=_NORMS_SQL + "SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) AS position FROM n")
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded shuffle of the norm table as a position column."""
    return SP.seeded_order(_norms(spark, sf_dir), "doc_id", SEED).select("doc_id", "position")


@query("split_exact", sql=_NORMS_SQL + """
SELECT doc_id, text_hash, CASE WHEN row_number() OVER (ORDER BY h, doc_id) <= (SELECT round_even(0.5 * count(*), 0) FROM n)
                    THEN 'train' ELSE 'test' END AS split
FROM n""")
def split_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4 + J7: exactly round(0.5 * N) rows drawn for training, the rest is the test set."""
    split = SP.split_exact(_norms(spark, sf_dir), "doc_id", 0.5, SEED, rule="round")
    return split.select("doc_id", F.md5("text").alias("text_hash"), "split")


@query("split_random", sql=_NORMS_SQL + """
SELECT doc_id, text_hash, CASE WHEN row_number() OVER (ORDER BY h, doc_id) <= (SELECT ceil(0.41060 * count(*)) FROM n)
                    THEN 'test' ELSE 'train' END AS split
FROM n""")
def split_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: test share 0.41060, n_test = ceil(f * N)."""
    split = SP.split_exact(_norms(spark, sf_dir), "doc_id", 0.41060, SEED, rule="ceil", drawn="test", rest="train")
    return split.select("doc_id", F.md5("text").alias("text_hash"), "split")


_STRATA_SQL = _NORMS_SQL + """,
s AS (SELECT *, CASE WHEN abs(rating_a - rating_b) >= 1 THEN 'big'
                     WHEN abs(rating_a - rating_b) < 1 THEN 'other' END AS stratum FROM n),
t AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id) AS rn,
             count(*) OVER (PARTITION BY stratum) AS cnt FROM s WHERE stratum IS NOT NULL),
u AS (SELECT doc_id, stratum, text_hash,
             CASE WHEN rn <= ceil(CASE stratum WHEN 'big' THEN 0.2 ELSE 0.434383 END * cnt)
                  THEN 'test' ELSE 'train' END AS split FROM t)
"""
FRACTIONS = {"big": 0.2, "other": 0.434383}


def _stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _norms(spark, sf_dir)
    diff = F.abs(F.col("rating_a") - F.col("rating_b"))
    stratum = F.when(diff >= 1, F.lit("big")).when(diff < 1, F.lit("other"))
    return SP.split_stratified(n, "doc_id", stratum, FRACTIONS, SEED)


@query("split_stratified", sql=_STRATA_SQL + "SELECT doc_id, stratum, text_hash, split FROM u")
def split_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6 + U1 + F2: 20 % test where the two ratings differ by >= 1, 43.4383 % where
    they differ by < 1; rows with a missing difference fall in neither stratum."""
    return _stratified(spark, sf_dir).select("doc_id", "stratum", F.md5("text").alias("text_hash"), "split")


@query("split_sizes", sql=_STRATA_SQL + "SELECT split, stratum, count(*) AS n FROM u GROUP BY split, stratum")
def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts per split and stratum."""
    return SP.split_sizes(_stratified(spark, sf_dir), ["split", "stratum"])
