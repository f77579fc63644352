"""Queries: result records joined to requests and scored."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as X
from ..operators import responses as R
from ..operators.request_store import RequestStore
from ..sinks import files as K
from . import derive as D
from .registry import query, r6

_E = """
WITH t AS (
  SELECT vec_id + 1 AS task_no, 'w' || CAST(vec_id AS VARCHAR) AS word, label,
         CAST(embedding[1] AS DOUBLE) AS e1, CAST(embedding[2] AS DOUBLE) AS e2,
         CAST(embedding[3] AS DOUBLE) AS e3, CAST(embedding[4] AS DOUBLE) AS e4,
         CAST(embedding[5] AS DOUBLE) AS e5
  FROM embeddings),
w AS (
  SELECT *, 'famexp_task_' || CAST(task_no AS VARCHAR) AS task_id,
         -abs(e1) AS lp1,
         ((label + 3) * exp(-abs(e1)) + (label + 4) * exp(-1 - abs(e2)) + (label + 2) * exp(-2 - abs(e3))
          + CASE WHEN e4 > 0 THEN 0 ELSE (label + 5) * exp(-3 - abs(e4)) END
          + (CASE WHEN e5 > 0 THEN 4 ELSE label + 1 END) * exp(-4 - abs(e5)))
         / (exp(-abs(e1)) + exp(-1 - abs(e2)) + exp(-2 - abs(e3))
            + CASE WHEN e4 > 0 THEN 0 ELSE exp(-3 - abs(e4)) END + exp(-4 - abs(e5))) AS ws
  FROM t)
"""


def _scored(spark: SparkSession, sf_dir: str, dialect: str, mode: str = "weighted_sum",
            json_answers: bool = False) -> DataFrame:
    company = {"openai": "OpenAI", "google": "Google", "local": "Local"}[dialect]
    prompt = D.JSON_PROMPT if json_answers else D.PROMPT
    requests = R.canonical_requests(D.derived_requests(spark, sf_dir, company, prompt))
    results = R.canonical_results(D.derived_results(spark, sf_dir, dialect, json_answers))
    joined = R.join_results(results, requests)
    return R.score(joined, mode=mode, feature_label="Familiarity")


def _out(df: DataFrame) -> DataFrame:
    return df.select("task_id", "word", "answer_text", "value", r6("logprob").alias("logprob"),
                     r6("weighted_sum").alias("weighted_sum"))


@query("score_openai", headline=True, sql=_E + """
SELECT task_id, word,
       CASE WHEN label = 2 THEN '5.' ELSE CAST(label + 3 AS VARCHAR) END AS answer_text,
       CASE WHEN label = 2 THEN 5.0 ELSE CAST(label + 3 AS DOUBLE) END AS value,
       CASE WHEN label <> 2 THEN round(lp1, 6) END AS logprob,
       CASE WHEN label <> 2 THEN round(ws, 6) END AS weighted_sum
FROM w""")
def score_openai(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat dialect, gate A (one token), last request wins."""
    return _out(_scored(spark, sf_dir, "openai"))


@query("score_local", headline=True, sql=_E + """
SELECT task_id, word,
       CASE WHEN label = 2 THEN '5.' ELSE CAST(label + 3 AS VARCHAR) END AS answer_text,
       CASE WHEN label = 2 THEN 5.0 ELSE CAST(label + 3 AS DOUBLE) END AS value,
       CASE WHEN label <> 2 THEN round(lp1, 6) END AS logprob,
       CASE WHEN label <> 2 THEN round(ws, 6) END AS weighted_sum
FROM w""")
def score_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local dialect (step list holds the end token), gate B (integer answer < 1000)."""
    return _out(_scored(spark, sf_dir, "local"))


@query("score_google", headline=True, sql=_E + """
SELECT task_id, word,
       CASE WHEN label = 2 THEN 'The rating is 5' ELSE CAST(label + 3 AS VARCHAR) END AS answer_text,
       CASE WHEN label = 2 THEN 5.0 ELSE CAST(label + 3 AS DOUBLE) END AS value,
       round(lp1, 6) AS logprob,
       CASE WHEN label <> 2 THEN round(ws, 6) END AS weighted_sum
FROM w""")
def score_google(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents dialect: value by X5 always, logprob whenever present, gate B for the sum."""
    return _out(_scored(spark, sf_dir, "google"))


@query("score_stored", sql=_E + """
SELECT task_id, word,
       CASE WHEN label = 2 THEN '5.' ELSE CAST(label + 3 AS VARCHAR) END AS answer_text,
       CASE WHEN label = 2 THEN 5.0 ELSE CAST(label + 3 AS DOUBLE) END AS value,
       CASE WHEN label <> 2 THEN round(lp1, 6) END AS logprob,
       CASE WHEN label <> 2 THEN round(ws, 6) END AS weighted_sum
FROM w""")
def score_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 over a stored request table: superseded requests added first, the current ones after
    them, then results in two drops, each joined to the buckets without moving a request."""
    store = RequestStore(spark, f"requests_{uuid.uuid4().hex}", K.scratch_dir(spark, "request-store"), 8)
    requests = R.canonical_requests(D.derived_requests(spark, sf_dir, "OpenAI"))
    store.add(requests.where("line_no % 2 = 0"), 0)  # the derived superseded ones have even numbers
    store.add(requests.where("line_no % 2 = 1"), 1)
    results = R.canonical_results(D.derived_results(spark, sf_dir, "openai"))
    drops = [R.score(store.join(results.where(f"line_no % 2 = {k}")), mode="weighted_sum", feature_label="Familiarity") for k in range(2)]
    return _out(drops[0].unionByName(drops[1]))


@query("word_mismatch", sql=_E + """
SELECT task_id, word,
       CASE WHEN label = 1 THEN word || 'x' ELSE word END AS word_out,
       CAST(label + 3 AS DOUBLE) AS value,
       label = 1 AS word_mismatch
FROM w""")
def word_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """json mode: X4 word from the answer, X5 value, X9 mismatch flag."""
    s = _scored(spark, sf_dir, "openai", mode="json", json_answers=True)
    return s.select("task_id", "word", X.word_from_answer("answer_text").alias("word_out"),
                    "value", "word_mismatch")


@query("live_score", sql=_E + """
SELECT task_id,
       CASE WHEN label <> 2 THEN CAST(left(CAST(label + 3 AS VARCHAR), 1) AS INTEGER) END AS first_digit,
       CASE WHEN ws <> 0 THEN round(ws, 6) END AS live_weighted
FROM w""")
def live_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X14 (no gate, zero -> NULL) and X15 (first character as integer)."""
    res = R.canonical_results(D.derived_results(spark, sf_dir, "google"))
    return res.select("task_id", X.first_char_int("answer_text").alias("first_digit"),
                      r6(S.live_expected_rating("first_top")).alias("live_weighted"))


@query("last_request_wins", headline=True, sql="""
WITH ranked AS (
  SELECT l_orderkey, l_partkey, l_linenumber,
         row_number() OVER (PARTITION BY l_orderkey
                            ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS rn
  FROM lineitem)
SELECT o.o_orderkey AS o_orderkey, o.o_orderstatus AS o_orderstatus,
       r.l_partkey AS last_partkey, r.l_linenumber AS last_linenumber
FROM orders o JOIN ranked r ON o.o_orderkey = r.l_orderkey AND r.rn = 1""")
def last_request_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14 + J1 at table scale: line items are 'requests' keyed by order (last line
    wins), orders are the probe side; inner equi-join on the key."""
    li = D.read(spark, sf_dir, "lineitem").select(
        F.lit("").alias("run"), F.col("l_orderkey").alias("task_id"),
        F.col("l_partkey").alias("last_partkey"), F.col("l_linenumber").alias("last_linenumber"),
        # line order: line number, ties broken by part and supplier key
        F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("line_no"))
    last = R.last_per_key(li).drop("line_no")
    orders = D.read(spark, sf_dir, "orders").select(
        F.lit("").alias("run"), F.col("o_orderkey").alias("task_id"), "o_orderstatus")
    j = orders.join(last, ["run", "task_id"], "inner")
    return j.select(F.col("task_id").alias("o_orderkey"), "o_orderstatus", "last_partkey",
                    F.col("last_linenumber").cast("int").alias("last_linenumber"))


RUN_NAME = "familiarity_live_gemini"


@query("live_results", sql=_E + """
SELECT word AS Word, CASE WHEN label <> 2 THEN CAST(left(CAST(label + 3 AS VARCHAR), 1) AS INTEGER) END AS familiarity,
       CASE WHEN ws <> 0 THEN round(ws, 6) END AS familiarity_logprob,
       CAST(len(list_filter([CAST(label + 3 AS VARCHAR), CAST(label + 4 AS VARCHAR), CAST(label + 2 AS VARCHAR),
                             CASE WHEN e4 > 0 THEN 'I' ELSE CAST(label + 5 AS VARCHAR) END,
                             CASE WHEN e5 > 0 THEN '4' ELSE CAST(label + 1 AS VARCHAR) END],
                            lambda t: t <> 'I')) AS INTEGER) AS n_numeric
FROM w""")
def live_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P14 + X14 + X15 + F4: live one-word answers as a result table whose columns are
    named after the experiment's short name (``familiarity``, ``familiarity_logprob``);
    the word column is named after the placeholder without braces."""
    res = R.canonical_results(D.derived_results(spark, sf_dir, "google"))
    req = R.canonical_requests(D.derived_requests(spark, sf_dir, "Google"))
    j = R.join_results(res, req)
    short = X.short_name_of(RUN_NAME)
    key = D.experiment("Google").prompt_key.strip("{}")
    return j.select(X.first_quoted("prompt").alias(key),
                    X.first_char_int("answer_text").alias(short),
                    r6(S.live_expected_rating("first_top")).alias(short + "_logprob"),
                    F.size(S.numeric_alternatives("first_top")).cast("int").alias("n_numeric"))


@query("score_vertex", sql=_E + """
SELECT row_number() OVER (ORDER BY lower(word), task_no) AS position, word,
       CASE WHEN label = 2 THEN 5.0 ELSE CAST(label + 3 AS DOUBLE) END AS value
FROM w""")
def score_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertex flow: results keyed by the word itself (no request join), value by X5
    from the first candidate's text (X7), rows with candidates only (F7), stable sort by
    the lower-cased word (T1) materialised as a position."""
    from ..operators.numbering import with_row_number
    tasks = D.embedding_tasks(spark, sf_dir)
    keyed = D.parse_lines(D.result_lines(tasks, "google", key_by_word=True), D.SC.RESULT_UNION)
    canon = R.canonical_results(keyed).where(F.col("has_candidates"))
    rated = canon.select(F.col("task_id").alias("word"),
                         X.number_from_answer("answer_text", "Familiarity").alias("value"), "line_no")
    return with_row_number(rated, [F.lower("word"), F.col("line_no")], name="position").select(
        "position", "word", "value")


_LI_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
             "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("score_lineitem", headline=True, sql="""
WITH n AS (
  SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
                                     l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS task_no,
         'p' || CAST(l_partkey AS VARCHAR) AS word, CAST(l_quantity AS INTEGER) AS q, l_discount AS d, l_tax AS t
  FROM lineitem)
SELECT 'famexp_task_' || CAST(task_no AS VARCHAR) AS task_id, word,
       CAST(q % 7 + 1 AS DOUBLE) AS value,
       round(0.0 - d, 6) AS logprob,
       round(((q % 7 + 1) * exp(-d) + ((q + 3) % 7 + 1) * exp(-1 - t)) / (exp(-d) + exp(-1 - t)), 6) AS weighted_sum
FROM n""")
def score_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 + X11 at table scale: every line item is one task -- numbered (P2), rendered
    as a chat request (P8) and as a one-token chat answer whose alternatives come from
    quantity, discount and tax -- and both sides go through JSON, the canonical
    relation, the last-wins join and the scoring projection."""
    from ..operators import requests as Q
    from ..operators.numbering import with_row_number
    li = D.read(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("int")
    numbered = with_row_number(li, _LI_ORDER, name="task_no").select(
        "task_no", F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("word"),
        q.alias("q"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"))
    requests = Q.build_requests(numbered.select("task_no", "word"), D.experiment("OpenAI"))
    req_lines = requests.select(F.col("json").alias("value"), F.col("task_no").alias("line_no"))
    tok = [(F.col("q") % 7 + 1).cast("string"), ((F.col("q") + 3) % 7 + 1).cast("string"), F.lit("x")]
    lps = [F.lit(0.0) - F.col("d"), F.lit(-1.0) - F.col("t"), F.lit(-2.0)]
    top = F.array(*[F.struct(t.alias("token"), lp.alias("logprob")) for t, lp in zip(tok, lps)])
    step = F.struct(tok[0].alias("token"), lps[0].alias("logprob"), top.alias("top_logprobs"))
    rec = F.struct(F.concat(F.lit(D.EXPERIMENT_PATH + "_task_"), F.col("task_no").cast("string")).alias("custom_id"),
                   F.struct(F.struct(F.array(F.struct(
                       F.struct(tok[0].alias("content")).alias("message"),
                       F.struct(F.array(step).alias("content")).alias("logprobs"))).alias("choices")).alias("body")
                            ).alias("response"))
    res_lines = numbered.select(F.to_json(rec).alias("value"), F.col("task_no").alias("line_no"))
    reqs = R.canonical_requests(D.parse_lines(req_lines, D.SC.REQUEST_UNION))
    res = R.canonical_results(D.parse_lines(res_lines, D.SC.RESULT_UNION))
    s = R.score(R.join_results(res, reqs), "weighted_sum", "Familiarity")
    return s.select("task_id", "word", "value", r6("logprob").alias("logprob"),
                    r6("weighted_sum").alias("weighted_sum"))


@query("score_german", sql=_E + """
SELECT task_id, word,
       CASE WHEN label = 1 THEN word || 'x' ELSE word END AS word_out,
       CAST(label + 3 AS DOUBLE) AS value,
       label = 1 AS word_mismatch
FROM w""")
def score_german(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X3 in the full path: German prompt with „…” quotes, JSON answers labelled
    ``Wort`` / ``Erwerbsalter`` (json mode: X4 + X5 + X9 with the German labels)."""
    q = X.LOCALES["german"]
    requests = R.canonical_requests(D.derived_requests(spark, sf_dir, "OpenAI", D.GERMAN_PROMPT))
    results = R.canonical_results(D.derived_results(spark, sf_dir, "openai", json_answers=True,
                                                    word_label=q["word_label"],
                                                    feature_label=q["feature_label"]))
    s = R.score(R.join_results(results, requests), mode="json", feature_label=q["feature_label"],
                word_label=q["word_label"], locale="german")
    return s.select("task_id", "word", X.word_from_answer("answer_text", q["word_label"]).alias("word_out"),
                    "value", "word_mismatch")


@query("score_last_quoted", sql=_E + """
SELECT task_id, 'are' AS first_word, word AS last_word,
       CASE WHEN label <> 2 THEN round(ws, 6) END AS weighted_sum
FROM w""")
def score_last_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 vs X2 in the full path: a few-shot prompt quotes an example word before the
    rated one; the first-quote rule returns the example, the last-quote rule (used for
    the iconicity runs) returns the rated word."""
    requests = R.canonical_requests(D.derived_requests(spark, sf_dir, "OpenAI", D.FEW_SHOT_PROMPT))
    results = R.canonical_results(D.derived_results(spark, sf_dir, "openai"))
    joined = R.join_results(results, requests).withColumn("first_word", X.first_quoted("prompt"))
    s = R.score(joined, "weighted_sum", "Familiarity", word_rule="last", carry=("first_word",))
    return s.select("task_id", "first_word", F.col("word").alias("last_word"),
                    r6("weighted_sum").alias("weighted_sum"))
