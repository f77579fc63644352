"""Queries: text and token operators over whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import scoring as S
from ..functions import text as X
from ..operators import requests as Q
from ..operators.numbering import with_row_number
from . import derive as D
from .registry import query, r6


@query("word_first_quoted", sql="""
SELECT doc_id,
       regexp_extract_all('Word: "' || text || '" (' || lang || ')', '"(.*?)"', 1)[1] AS word
FROM documents""")
def word_first_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 over prompts wrapping each whole document text in straight quotes."""
    docs = D.read(spark, sf_dir, "documents")
    prompt = F.concat(F.lit('Word: "'), F.col("text"), F.lit('" ('), F.col("lang"), F.lit(")"))
    return docs.select("doc_id", X.first_quoted(prompt).alias("word"))


@query("word_last_quoted", sql="""
WITH m AS (
  SELECT doc_id, regexp_extract_all('Quelle „' || source || '” oder „' || text || '”.', '„(.*?)”', 1) AS xs
  FROM documents)
SELECT doc_id, nullif(xs[len(xs)], '') AS word FROM m""")
def word_last_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2 with the German quote pair (X3): last quoted run, empty -> NULL."""
    q = X.LOCALES["german"]
    docs = D.read(spark, sf_dir, "documents")
    prompt = F.concat(F.lit("Quelle „"), F.col("source"), F.lit("” oder „"), F.col("text"), F.lit("”."))
    return docs.select("doc_id", X.last_quoted(prompt, q["open"], q["close"]).alias("word"))


def _answer():
    return F.expr("""
  CASE event_type
    WHEN 'error'  THEN props
    WHEN 'click'  THEN '"k": "' || CAST(value AS STRING) || '"'
    WHEN 'view'   THEN 'rated ' || CAST(value AS STRING) || ' then ' || CAST(-user_id AS STRING)
    WHEN 'signup' THEN CAST(value AS STRING) || '-' || CAST(user_id AS STRING)
    ELSE 'no number here' END""")


@query("number_from_answer", sql="""
SELECT event_id,
       round(CASE event_type
         WHEN 'error' THEN CAST(json_extract(props, '$.k') AS DOUBLE)
         WHEN 'click' THEN value
         WHEN 'view' THEN CAST(-user_id AS DOUBLE)
         WHEN 'signup' THEN CAST(-user_id AS DOUBLE)
       END, 6) AS number
FROM events""")
def number_from_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X5 tiers on answers made from event columns: bare JSON value, quoted value,
    last signed number ("12.3-46" gives -46), none."""
    ev = D.read(spark, sf_dir, "events")
    return ev.select("event_id", r6(X.number_from_answer(_answer(), "k")).alias("number"))


def _coerce_text():
    return F.expr("""
  CASE event_type
    WHEN 'click'    THEN CAST(value AS STRING)
    WHEN 'view'     THEN ' ' || CAST(user_id AS STRING) || ' '
    WHEN 'error'    THEN CAST(value AS STRING) || 'd'
    WHEN 'signup'   THEN 'nan'
    ELSE CAST(user_id AS STRING) || 'e2' END""")


@query("coerce_numeric", sql="""
SELECT event_id,
       round(CASE event_type
         WHEN 'click' THEN value
         WHEN 'view' THEN CAST(user_id AS DOUBLE)
         WHEN 'purchase' THEN CAST(user_id AS DOUBLE) * 100
       END, 6) AS number
FROM events""")
def coerce_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text -> number with failures ('6.5d', 'nan') as NULL."""
    ev = D.read(spark, sf_dir, "events")
    return ev.select("event_id", r6(N.coerce_numeric(_coerce_text())).alias("number"))


@query("softmax_topk", sql="""
WITH v AS (
  SELECT vec_id, CAST(x AS DOUBLE) AS x, i - 1 AS idx
  FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)),
m AS (SELECT vec_id, max(x) AS mx FROM v GROUP BY vec_id),
l AS (SELECT v.vec_id, m.mx + ln(sum(exp(v.x - m.mx))) AS lse FROM v JOIN m USING (vec_id) GROUP BY v.vec_id, m.mx),
r AS (SELECT v.vec_id, v.idx, v.x - l.lse AS logprob,
             row_number() OVER (PARTITION BY v.vec_id ORDER BY v.x DESC, v.idx) AS rank
      FROM v JOIN l USING (vec_id))
SELECT vec_id, CAST(rank AS INTEGER) AS rank, CAST(idx AS INTEGER) AS token_index, round(logprob, 6) AS logprob
FROM r WHERE rank <= 5""")
def softmax_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X17 + T7: vocabulary scores -> log-softmax -> top 5 per step (the step is one
    embeddings row); the 5-entry result is exploded for comparison."""
    emb = D.read(spark, sf_dir, "embeddings")
    top = emb.select("vec_id", F.posexplode(S.softmax_topk("embedding", 5)).alias("pos", "t"))
    return top.select("vec_id", (F.col("pos") + 1).cast("int").alias("rank"),
                      F.col("t.index").cast("int").alias("token_index"), r6("t.logprob").alias("logprob"))


@query("token_bytes", sql="""
WITH b AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '[0-9A-F]{2}') AS hx FROM documents)
SELECT doc_id, CAST(len(hx) AS INTEGER) AS n_bytes,
       CAST(list_sum(list_transform(hx, lambda h: CAST('0x' || h AS INTEGER))) AS BIGINT) AS byte_sum,
       CAST(len(list_filter(hx, lambda h: CAST('0x' || h AS INTEGER) >= 128)) AS INTEGER) AS n_high
FROM b""")
def token_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X18 over whole document texts: UTF-8 byte values, summarised per text."""
    docs = D.read(spark, sf_dir, "documents")
    b = docs.select("doc_id", S.token_bytes("text").alias("b"))
    return b.select("doc_id", F.size("b").cast("int").alias("n_bytes"),
                    F.aggregate("b", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("byte_sum"),
                    F.size(F.filter("b", lambda x: x >= 128)).cast("int").alias("n_high"))


@query("add_default_role", sql="""
SELECT conv_id, turn, coalesce(CASE WHEN role = 'assistant' THEN role END, 'user') AS role,
       CAST(length(text) AS INTEGER) AS n_chars
FROM conversations""")
def add_default_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13 on contents records built from conversation turns whose role is blanked
    except for assistant turns."""
    conv = D.read(spark, sf_dir, "conversations")
    contents = F.array(F.struct(F.when(F.col("role") == "assistant", F.col("role")).alias("role"),
                                F.array(F.struct(F.col("text").alias("text"))).alias("parts")))
    recs = conv.select("conv_id", "turn", F.struct(contents.alias("contents")).alias("request"))
    fixed = Q.add_default_role(recs)
    first = F.col("request.contents")[0]
    return fixed.select("conv_id", "turn", first["role"].alias("role"),
                        F.length(first["parts"][0]["text"]).cast("int").alias("n_chars"))


@query("mean_abs_diff", sql="""
SELECT l_orderkey, l_linenumber, round(round_even((l_discount + l_tax) / 2 * 100, 0) / 100, 6) AS mean_rating,
       round(abs(l_discount - l_tax), 6) AS diff
FROM lineitem""")
def mean_abs_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P21 (mean of two ratings, pandas rounding) and P22 (absolute difference)."""
    li = D.read(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     r6(N.mean_of_two("l_discount", "l_tax")).alias("mean_rating"),
                     r6(N.abs_diff("l_discount", "l_tax")).alias("diff"))


@query("sorted_words", sql="""
SELECT row_number() OVER (ORDER BY lower(p_name), p_partkey) AS position, p_partkey, p_name
FROM part""")
def sorted_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable sort by lower-cased word (input order breaks ties); the position is a column."""
    part = D.read(spark, sf_dir, "part").select("p_partkey", "p_name")
    return with_row_number(part, [F.lower("p_name"), F.col("p_partkey")], name="position")


@query("sorted_by_diff", sql="""
SELECT row_number() OVER (ORDER BY abs(l_discount - l_tax) DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey)
         AS position, l_orderkey, l_linenumber, l_partkey, l_suppkey, round(abs(l_discount - l_tax), 6) AS diff
FROM lineitem""")
def sorted_by_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descending sort by rating difference, positions numbered without a single-task sort."""
    li = D.read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", N.abs_diff("l_discount", "l_tax").alias("d"))
    ranked = with_row_number(li, [F.col("d").desc(), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
                             name="position")
    return ranked.select("position", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6("d").alias("diff"))


@query("json_field", sql="""
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
       CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS kind
FROM events""")
def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields read from JSON text of unknown layout through VARIANT; a truncated
    record (error events here) yields NULL instead of failing."""
    ev = D.read(spark, sf_dir, "events")
    doc = F.when(F.col("event_type") == "error",
                 F.concat(F.lit('{"kind": "'), F.col("event_type")))  # truncated JSON
    doc = doc.otherwise(F.concat(F.lit('{"kind": "'), F.col("event_type"), F.lit('"}')))
    return ev.select("event_id", X.json_field("props", "$.k", "int").alias("k"),
                     X.json_field(doc, "$.kind", "string").alias("kind"))
