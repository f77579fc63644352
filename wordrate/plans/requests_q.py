"""Queries: request building (P1-P14, K1 index, S11 + J8) over the ``part`` / ``orders`` tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import requests as Q
from ..sources import catalogue as C
from . import derive as D
from .registry import query

_PROMPT_SQL = "replace('How familiar is the word \"{Word}\"? Answer with a number from 1 to 7.', '{Word}', p_name)"
_NUMBERED = f"""
WITH w AS (
  SELECT row_number() OVER (ORDER BY p_partkey) AS task_no, p_name,
         {_PROMPT_SQL} AS prompt
  FROM part)
"""


def _requests(spark: SparkSession, sf_dir: str, company: str) -> DataFrame:
    part = D.read(spark, sf_dir, "part")
    words = Q.number_words(part, ["p_partkey"], column="p_name")
    return Q.build_requests(words, D.experiment(company))


@query("request_openai", headline=True, sql=_NUMBERED + """
SELECT task_no, 'famexp_task_' || CAST(task_no AS VARCHAR) AS task_id, prompt,
       CAST(json_object('custom_id', 'famexp_task_' || CAST(task_no AS VARCHAR),
         'method', 'POST', 'url', '/v1/chat/completions',
         'body', json_object('model', 'gpt-4o-mini-2024-07-18', 'temperature', 0.0::DOUBLE,
            'logprobs', true, 'top_logprobs', 5, 'response_format', json_object('type', 'text'),
            'messages', [json_object('role', 'user', 'content', prompt)])) AS VARCHAR) AS json
FROM w""")
def request_openai(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat requests for every part name, numbered in key order."""
    return _requests(spark, sf_dir, "OpenAI").select("task_no", "task_id", "prompt", "json")


@query("request_google", sql=_NUMBERED + """
SELECT task_no, 'famexp_task_' || CAST(task_no AS VARCHAR) AS task_id, prompt,
       CAST(json_object('key', 'famexp_task_' || CAST(task_no AS VARCHAR),
         'request', json_object('model', 'models/gemini-2.0-flash',
            'contents', [json_object('parts', [json_object('text', prompt)])],
            'generation_config', json_object('temperature', 0.0::DOUBLE, 'response_logprobs', true,
                                             'logprobs', 5))) AS VARCHAR) AS json
FROM w""")
def request_google(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contents/parts requests."""
    return _requests(spark, sf_dir, "Google").select("task_no", "task_id", "prompt", "json")


@query("request_local", sql=_NUMBERED + """
SELECT task_no, 'famexp_task_' || CAST(task_no AS VARCHAR) AS task_id, prompt,
       CAST(json_object('id', 'famexp_task_' || CAST(task_no AS VARCHAR), 'prompt', prompt,
         'temperature', 0.0::DOUBLE, 'response_logprobs', true, 'logprobs', 5,
         'model', 'llama3.1-8B-Instruct') AS VARCHAR) AS json
FROM w""")
def request_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat local-model requests (no ft_dir set, so none is written)."""
    return _requests(spark, sf_dir, "Local").select("task_no", "task_id", "prompt", "json")


@query("request_vertex", sql=_NUMBERED + """
SELECT task_no, p_name AS task_id, prompt,
       CAST(json_object('key', p_name, 'request', json_object(
            'contents', [json_object('role', 'user', 'parts', [json_object('text', prompt)])],
            'generation_config', json_object('temperature', 0.0::DOUBLE))) AS VARCHAR) AS json
FROM w""")
def request_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: requests keyed by the word itself."""
    r = _requests(spark, sf_dir, "Vertex")
    return r.select("task_no", F.col("record.key").alias("task_id"), "prompt", "json")


@query("batch_chunks", sql="""
WITH n AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS task_no FROM orders)
SELECT CAST(floor((task_no - 1) / 1000) AS BIGINT) AS batch_index, count(*) AS n_tasks,
       min(task_no) AS first_task, max(task_no) AS last_task
FROM n GROUP BY 1""")
def batch_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: consecutive slices of 1000 tasks (the provider file size is a parameter)."""
    orders = D.read(spark, sf_dir, "orders")
    n = Q.number_words(orders, ["o_orderkey"], column="o_orderkey")
    return (n.withColumn("batch_index", Q.batch_index("task_no", 1000))
             .groupBy("batch_index")
             .agg(F.count(F.lit(1)).alias("n_tasks"), F.min("task_no").alias("first_task"),
                  F.max("task_no").alias("last_task")))


# --- fixed values: a catalogue with three experiments over one word table ---------
CATALOGUE_YAML = """
experiments:
  fam_standard_openai:
    dataset_column: "p_name"
    prompt_path: "standard.txt"
    model_name: "gpt-4o-mini-2024-07-18"
    company: "OpenAI"
  fam_standard_gemini:
    dataset_column: "p_name"
    prompt_path: "standard.txt"
    model_name: "gemini-2.0-flash"
    company: "Google"
  fam_unquoted_local:
    dataset_column: "p_name"
    prompt_path: "unquoted.txt"
    model_name: "llama3.1-8B-Instruct"
    company: "Local"
"""
CATALOGUE_PROMPTS = {"standard.txt": 'How familiar is the word "{Word}"? Answer with a number from 1 to 7.',
                     "unquoted.txt": "How familiar is the word {p_name}? Answer with a number from 1 to 7."}
# ----------------------------------------------------------------------------------


@query("experiment_catalogue", sql="""
WITH w AS (SELECT row_number() OVER (ORDER BY p_partkey) AS task_no, p_name FROM part),
e AS (SELECT * FROM (VALUES
  ('fam_standard_openai', 'OpenAI',
   'How familiar is the word "{Word}"? Answer with a number from 1 to 7.', '{Word}'),
  ('fam_standard_gemini', 'Google',
   'How familiar is the word "{Word}"? Answer with a number from 1 to 7.', '{Word}'),
  ('fam_unquoted_local', 'Local',
   'How familiar is the word {p_name}? Answer with a number from 1 to 7.', '{p_name}')) AS t(run, company, tmpl, k))
SELECT e.run AS run, w.task_no AS task_no, 'famexp_task_' || CAST(w.task_no AS VARCHAR) AS task_id,
       replace(e.tmpl, e.k, w.p_name) AS prompt
FROM w CROSS JOIN e""")
def experiment_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S11 + J8: every word paired with every catalogue experiment in one scan.
    The unquoted prompt has no P4 placeholder, so P5 (the column name) is used."""
    cat = C.read_catalogue(CATALOGUE_YAML)
    exps = C.experiments(cat, D.EXPERIMENT_PATH, CATALOGUE_PROMPTS)
    part = D.read(spark, sf_dir, "part")
    words = Q.number_words(part, ["p_partkey"], column="p_name")
    r = Q.build_requests(words, exps)
    return r.select("run", "task_no", "task_id", "prompt")


_TEMPLATE = "Word: {p_name}; brand {P_BRAND}; size {p_size}; price {p_retailprice}; colour {colour}."


@query("partial_template", sql="""
SELECT p_partkey,
       'Word: ' || p_name || '; brand ' || p_brand || '; size ' || CAST(p_size AS VARCHAR)
       || '; price ' || CAST(p_retailprice AS VARCHAR) || '; colour {colour}.' AS text
FROM part""")
def partial_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots filled from the row by lower-cased name; unknown slots kept."""
    part = D.read(spark, sf_dir, "part")
    return part.select("p_partkey",
                       X.partial_template(_TEMPLATE, part.columns, match="reference").alias("text"))


@query("placeholder_key", sql="""
WITH p AS (SELECT doc_id, 'Rate the word "{' || text || '}" from 1 to 7.' AS prompt FROM documents),
q AS (SELECT doc_id, prompt, strpos(prompt, '"{') AS s FROM p),
r AS (SELECT doc_id, prompt, s, CASE WHEN s > 0 THEN strpos(substr(prompt, s + 2), '}"') ELSE 0 END AS e FROM q)
SELECT doc_id, CASE WHEN s > 0 AND e > 0 THEN substr(prompt, s + 1, e + 1) END AS prompt_key
FROM r""")
def placeholder_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4 over whole document texts wrapped as placeholders."""
    docs = D.read(spark, sf_dir, "documents")
    prompt = F.concat(F.lit('Rate the word "{'), F.col("text"), F.lit('}" from 1 to 7.'))
    return docs.select("doc_id", X.placeholder_key(prompt).alias("prompt_key"))


@query("catalogue_requests", sql="""
WITH w AS (SELECT row_number() OVER (ORDER BY p_partkey) AS task_no, p_name FROM part),
t AS (SELECT task_no, 'famexp_task_' || CAST(task_no AS VARCHAR) AS tid,
             replace('How familiar is the word "{Word}"? Answer with a number from 1 to 7.', '{Word}', p_name) AS q,
             replace('How familiar is the word {p_name}? Answer with a number from 1 to 7.', '{p_name}', p_name) AS u
      FROM w)
SELECT 'fam_standard_openai' AS run, task_no,
       CAST(json_object('custom_id', tid, 'method', 'POST', 'url', '/v1/chat/completions',
         'body', json_object('model', 'gpt-4o-mini-2024-07-18', 'temperature', 0.0::DOUBLE, 'logprobs', true,
            'top_logprobs', 5, 'response_format', json_object('type', 'text'),
            'messages', [json_object('role', 'user', 'content', q)])) AS VARCHAR) AS json
FROM t
UNION ALL
SELECT 'fam_standard_gemini', task_no,
       CAST(json_object('key', tid, 'request', json_object('model', 'models/gemini-2.0-flash',
            'contents', [json_object('parts', [json_object('text', q)])],
            'generation_config', json_object('temperature', 0.0::DOUBLE, 'response_logprobs', true,
                                             'logprobs', 5))) AS VARCHAR)
FROM t
UNION ALL
SELECT 'fam_unquoted_local', task_no,
       CAST(json_object('id', tid, 'prompt', u, 'temperature', 0.0::DOUBLE, 'response_logprobs', true,
            'logprobs', 5, 'model', 'llama3.1-8B-Instruct') AS VARCHAR)
FROM t""")
def catalogue_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12 for a mixed catalogue: one scan, every word paired with three experiments of
    three providers, each row rendered by its provider's builder."""
    cat = C.read_catalogue(CATALOGUE_YAML)
    exps = C.experiments(cat, D.EXPERIMENT_PATH, CATALOGUE_PROMPTS)
    part = D.read(spark, sf_dir, "part")
    words = Q.number_words(part, ["p_partkey"], column="p_name")
    return Q.build_requests(words, exps).select("run", "task_no", "json")
