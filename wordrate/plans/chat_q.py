"""Queries: chat training records, dialect conversion, transcripts, model scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chat as CH
from ..operators import model_scoring as MS
from ..sinks import files as K
from . import derive as D
from .registry import query

# --- fixed values: templates of the derived fine-tuning records ------------------
USER_TEMPLATE = "Rate the familiarity of this {lang} text from 1 to 7: {text}"
ASSISTANT_TEMPLATE = "Familiarity: {rating}"
# ----------------------------------------------------------------------------------


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = D.read(spark, sf_dir, "documents").select("doc_id", "lang", "text", "n_chars")
    labelled = docs.join(D.read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    rated = labelled.select("doc_id", "lang", "text", (F.col("n_chars") / 997.0).alias("rating"))
    return CH.chat_records(rated, USER_TEMPLATE, "rating", ASSISTANT_TEMPLATE)


_REC_SQL = """
WITH x AS (
  SELECT doc_id, lang, text, n_chars / 997.0 AS v FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
p AS (SELECT *, v * 100.0 AS p, floor(v * 100.0) AS k, v * 134217729.0 AS c FROM x),
e AS (SELECT *, (((c - (c - v)) * 100.0 - p) + (v - (c - (c - v))) * 100.0) AS err FROM p),
r AS (
  SELECT doc_id, 'Rate the familiarity of this ' || lang || ' text from 1 to 7: ' || text AS u,
         'Familiarity: ' || CAST((CASE WHEN p - k = 0.5 AND err < 0 THEN k
                                       WHEN p - k = 0.5 AND err > 0 THEN k + 1
                                       ELSE round_even(p, 0) END) / 100.0 AS VARCHAR) AS a
  FROM e)
"""


@query("chat_records", sql=_REC_SQL + """
SELECT doc_id, u AS user_content, a AS assistant_content,
       'User: ' || u || chr(10) || 'Assistant: ' || a || chr(10) AS transcript
FROM r""")
def chat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P17 + P18 (+ P20 array form): user/assistant records from labelled documents."""
    r = _records(spark, sf_dir)
    return r.select("doc_id", F.col("messages")[0]["content"].alias("user_content"),
                    F.col("messages")[1]["content"].alias("assistant_content"),
                    CH.transcript("messages").alias("transcript"))


@query("chat_to_contents", sql=_REC_SQL + """
SELECT doc_id, 1 AS position, 'user' AS role, u AS text FROM r
UNION ALL
SELECT doc_id, 2 AS position, 'model' AS role, a AS text FROM r""")
def chat_to_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages -> contents/parts, assistant -> model (bounded 2-element explode for comparison)."""
    r = _records(spark, sf_dir).select("doc_id", CH.to_contents("messages").alias("contents"))
    e = r.select("doc_id", F.posexplode("contents").alias("pos", "c"))
    return e.select("doc_id", (F.col("pos") + 1).alias("position"), F.col("c.role").alias("role"),
                    F.col("c.parts")[0]["text"].alias("text"))


@query("chat_transcript", sql="""
WITH k AS (
  SELECT conv_id, turn,
         CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || text || chr(10) AS line
  FROM conversations WHERE role IN ('user', 'assistant'))
SELECT conv_id, turn, line, CAST(length(line) AS BIGINT) AS line_chars,
       CAST(coalesce(sum(length(line)) OVER (PARTITION BY conv_id ORDER BY turn
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset
FROM k""")
def chat_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20 + F3 (long form): transcript lines of each conversation with their offsets;
    system turns are dropped."""
    return CH.transcript_lines(D.read(spark, sf_dir, "conversations"))


@query("model_scores", sql="""
SELECT conv_id, turn, CAST(length(text) % 7 + 1 AS DOUBLE) AS score FROM conversations""")
def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: prompts scored by a supplied model in groups of 5 inside Spark tasks
    (the stand-in model returns characters mod 7 + 1)."""
    conv = D.read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return MS.score_prompts(conv, "text", MS.length_scorer_factory).select("conv_id", "turn", "score")


@query("model_scores_resumed", sql="""
SELECT conv_id, turn, CAST(length(text) % 7 + 1 AS DOUBLE) AS score FROM conversations""")
def model_scores_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 in two runs over one ledger: the first is given the first turns only, the second
    everything, and sends what the ledger lacks."""
    folder = K.scratch_dir(spark, "ledger")
    conv = D.read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    for rows in (conv.where("turn < 2"), conv):
        out = MS.score_resumable(rows, ["conv_id", "turn"], "text", MS.length_scorer_factory, folder)
    return out.select("conv_id", "turn", "score")


@query("local_run_records", sql="""
WITH v AS (
  SELECT vec_id, CAST(x AS DOUBLE) AS x, CAST((i - 1) // 16 AS INTEGER) AS step, CAST((i - 1) % 16 AS INTEGER) AS idx
  FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)),
m AS (SELECT vec_id, step, max(x) AS mx FROM v GROUP BY vec_id, step),
l AS (SELECT v.vec_id, v.step, m.mx + ln(sum(exp(v.x - m.mx))) AS lse
      FROM v JOIN m USING (vec_id, step) GROUP BY v.vec_id, v.step, m.mx),
r AS (SELECT v.vec_id, v.step, v.idx, v.x - l.lse AS lp,
             row_number() OVER (PARTITION BY v.vec_id, v.step ORDER BY v.x DESC, v.idx) AS rk
      FROM v JOIN l USING (vec_id, step)),
t AS (SELECT vec_id,
             string_agg(CAST(idx AS VARCHAR), '' ORDER BY step) FILTER (WHERE rk = 1) AS answer_text,
             max(lp) FILTER (WHERE rk = 1 AND step = 0) AS logprob,
             sum(idx * exp(lp)) FILTER (WHERE rk <= 5 AND step = 0)
               / sum(exp(lp)) FILTER (WHERE rk <= 5 AND step = 0) AS ws,
             sum(length(CAST(idx AS VARCHAR))) FILTER (WHERE rk = 1) AS n_bytes
      FROM r GROUP BY vec_id)
SELECT 'famexp_task_' || CAST(vec_id + 1 AS VARCHAR) AS task_id, answer_text,
       4 AS n_steps, round(logprob, 6) AS logprob, round(ws, 6) AS weighted_sum, CAST(n_bytes AS BIGINT) AS n_bytes
FROM t""")
def local_run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X17 + X18 + X19: a local model run assembled into result records -- each
    embeddings row holds the raw scores of 4 generated steps over a 16-token vocabulary
    (token text = its index) -- rendered to JSON, parsed back as the local dialect,
    and scored (X11 over the step-1 alternatives)."""
    from ..functions import scoring as S
    from ..operators import responses as R
    from ..sources import schemas as SC
    emb = D.read(spark, sf_dir, "embeddings")
    steps_scores = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: F.slice("embedding", s * 16 + 1, 16))
    steps = MS.generation_steps(steps_scores, lambda i: i.cast("string"), 5)
    tid = F.concat(F.lit(D.EXPERIMENT_PATH + "_task_"), (F.col("vec_id") + 1).cast("string"))
    rec = MS.local_result_record(tid, F.lit("llama3.1-8B-Instruct"), steps)
    lines = emb.select(F.to_json(rec).alias("value"), F.col("vec_id").alias("line_no"))
    parsed = D.parse_lines(lines, SC.RESULT_UNION)
    canon = R.canonical_results(parsed)
    bytes_ = F.aggregate(F.col("r.response.body.choices")[0]["logprobs"]["content"], F.lit(0).cast("bigint"),
                         lambda a, s: a + F.size(s["bytes"]))
    with_bytes = parsed.select(F.struct("*").alias("r")).select(
        F.col("r.id").alias("task_id"), bytes_.alias("n_bytes"))
    return (canon.join(with_bytes, "task_id")
                 .select("task_id", "answer_text", F.col("n_steps").cast("int").alias("n_steps"),
                         F.round("first_logprob", 6).alias("logprob"),
                         F.round(S.expected_rating("first_top"), 6).alias("weighted_sum"), "n_bytes"))
