"""Request and result records derived from the driver tables.

The driver tables hold no model answers, so the registered queries derive them
deterministically from table columns: every ``embeddings`` row becomes one answered
task whose step-1 alternatives come from the first vector entries.  Records are
rendered to JSON lines with ``to_json`` and parsed back with the explicit dialect
schemas, so the queries exercise the same scan -> canonical -> join -> score path as
real result files, and the DuckDB oracle can recompute every value from the columns.

Derivation rule per embeddings row (vec_id, embedding e[1..], label):
  task_no = vec_id + 1, word = 'w' || vec_id
  answer  = label + 3 as text; label 2 answers with two steps ("5", ".") / a sentence
  alternatives: tokens  [label+3, label+4, label+2, 'I' if e4 > 0 else label+5,
                         '４' (full-width 4) if e5 > 0 else label+1]
                logprobs [-|e1|, -1-|e2|, -2-|e3|, -3-|e4|, -4-|e5|]
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.requests import Experiment, build_requests
from ..session import table_path
from ..sources import schemas as SC

# --- fixed values used by the derived experiments -------------------------------
PROMPT = 'How familiar is the word "{Word}"? Answer with a number from 1 to 7.'
JSON_PROMPT = ('Rate the familiarity of "{Word}" from 1 to 7. Answer as JSON: '
               '{"Word": "<word>", "Familiarity": <rating>}')
EXPERIMENT_PATH = "famexp"
FULL_WIDTH_FOUR = "４"
GERMAN_PROMPT = ('Wie vertraut ist das Wort „{Word}”? Antworte als JSON: '
                 '{"Wort": "<wort>", "Erwerbsalter": <zahl>}')
FEW_SHOT_PROMPT = 'Example: "are" rates 2. How iconic is the word "{Word}"? Answer with a number from 1 to 7.'
# ---------------------------------------------------------------------------------


def experiment(company: str, run: str = "original", prompt: str = PROMPT) -> Experiment:
    models = {"OpenAI": "gpt-4o-mini-2024-07-18", "Google": "gemini-2.0-flash",
              "Local": "llama3.1-8B-Instruct", "HuggingFace": "llama3.1-8B-Instruct",
              "Vertex": "gemini-3-pro"}
    return Experiment(name=run, experiment_path=EXPERIMENT_PATH, prompt=prompt, company=company,
                      model_name=models[company], dataset_column="Word")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def _e(i: int) -> Column:
    return F.col("embedding")[i - 1].cast("double")


def _alternatives() -> list[tuple[Column, Column]]:
    lab = F.col("label")
    tok = [
        (lab + 3).cast("string"),
        (lab + 4).cast("string"),
        (lab + 2).cast("string"),
        F.when(_e(4) > 0, F.lit("I")).otherwise((lab + 5).cast("string")),
        F.when(_e(5) > 0, F.lit(FULL_WIDTH_FOUR)).otherwise((lab + 1).cast("string")),
    ]
    lp = [F.lit(-float(i)) - F.abs(_e(i + 1)) for i in range(5)]
    return list(zip(tok, lp))


def embedding_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read(spark, sf_dir, "embeddings")
    return emb.select((F.col("vec_id") + 1).alias("task_no"),
                      F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"),
                      "embedding", "label")


def request_lines(tasks: DataFrame, company: str, prompt: str = PROMPT) -> DataFrame:
    """Request JSON lines plus an older, superseded request for label-0 tasks.

    The superseded line comes first (smaller line_no) so last-wins (A14) must drop it.
    """
    exp = experiment(company, prompt=prompt)
    req = build_requests(tasks.select("task_no", "word"), exp).select("task_no", "json")
    stale = build_requests(tasks.filter(F.col("label") == 0)
                                .select("task_no", F.concat(F.col("word"), F.lit("_old")).alias("word")), exp
                           ).select("task_no", "json")
    return (req.select(F.col("json").alias("value"), (F.col("task_no") * 2 + 1).alias("line_no"))
               .unionByName(stale.select(F.col("json").alias("value"), (F.col("task_no") * 2).alias("line_no"))))


def result_lines(tasks: DataFrame, dialect: str, json_answers: bool = False, key_by_word: bool = False,
                 word_label: str = "Word", feature_label: str = "Familiarity") -> DataFrame:
    """Result JSON lines in one dialect, derived per task (see module docstring).
    ``key_by_word``: the record id is the word itself (requests built by P10)."""
    tid = (F.col("word") if key_by_word
           else F.concat(F.lit(EXPERIMENT_PATH + "_task_"), F.col("task_no").cast("string")))
    lab = F.col("label")
    alts = _alternatives()
    if json_answers:
        said = F.when(lab == 1, F.concat(F.col("word"), F.lit("x"))).otherwise(F.col("word"))
        answer = F.concat(F.lit('{"' + word_label + '": "'), said, F.lit('", "' + feature_label + '": '),
                          (lab + 3).cast("string"), F.lit("}"))
    elif dialect == "google":
        answer = F.when(lab == 2, F.lit("The rating is 5")).otherwise((lab + 3).cast("string"))
    else:
        answer = F.when(lab == 2, F.lit("5.")).otherwise((lab + 3).cast("string"))
    if dialect in ("openai", "local"):
        top = F.array(*[F.struct(t.alias("token"), lp.alias("logprob")) for t, lp in alts])
        first = F.struct(alts[0][0].alias("token"), alts[0][1].alias("logprob"), top.alias("top_logprobs"))
        second = F.struct(F.lit(".").alias("token"), F.lit(-0.5).alias("logprob"),
                          F.array(F.struct(F.lit(".").alias("token"), F.lit(-0.5).alias("logprob"))).alias("top_logprobs"))
        end = F.struct(F.lit("<|eot_id|>").alias("token"), F.lit(0.0).alias("logprob"),
                       F.array(F.struct(F.lit("<|eot_id|>").alias("token"), F.lit(0.0).alias("logprob"))).alias("top_logprobs"))
        if dialect == "openai":
            steps = F.when(lab == 2, F.array(first, second)).otherwise(F.array(first))
        else:
            steps = F.when(lab == 2, F.array(first, second, end)).otherwise(F.array(first, end))
        body = F.struct(F.array(F.struct(F.lit(0).alias("index"),
                                         F.struct(F.lit("assistant").alias("role"), answer.alias("content")).alias("message"),
                                         F.struct(steps.alias("content")).alias("logprobs"),
                                         F.lit("stop").alias("finish_reason"))).alias("choices"))
        status = F.lit(200 if dialect == "openai" else -1)
        resp = F.struct(status.alias("status_code"), body.alias("body"))
        if dialect == "openai":
            rec = F.struct(F.concat(F.lit("batch_req_"), F.col("task_no").cast("string")).alias("id"),
                           tid.alias("custom_id"), resp.alias("response"))
        else:
            rec = F.struct(tid.alias("id"), resp.alias("response"))
    elif dialect == "google":
        cands = F.array(*[F.struct(lp.alias("logProbability"), t.alias("token")) for t, lp in alts])
        chosen = F.array(F.struct(alts[0][1].alias("logProbability"), alts[0][0].alias("token")))
        cand = F.struct(F.struct(F.array(F.struct(answer.alias("text"))).alias("parts"),
                                 F.lit("model").alias("role")).alias("content"),
                        F.struct(chosen.alias("chosenCandidates"),
                                 F.array(F.struct(cands.alias("candidates"))).alias("topCandidates")
                                 ).alias("logprobsResult"))
        rec = F.struct(tid.alias("key"), F.struct(F.array(cand).alias("candidates")).alias("response"))
    else:
        raise ValueError(dialect)
    return tasks.select(F.to_json(rec).alias("value"), F.col("task_no").alias("line_no"))


def parse_lines(lines: DataFrame, ddl: str) -> DataFrame:
    """JSON text lines -> records with the explicit schema (what ``spark.read.json`` does)."""
    from ..sources.files import parse_json_lines
    return parse_json_lines(lines, ddl, keep=("line_no",)).drop("_bad")


def derived_requests(spark: SparkSession, sf_dir: str, company: str, prompt: str = PROMPT) -> DataFrame:
    return parse_lines(request_lines(embedding_tasks(spark, sf_dir), company, prompt), SC.REQUEST_UNION)


def derived_results(spark: SparkSession, sf_dir: str, dialect: str, json_answers: bool = False,
                    word_label: str = "Word", feature_label: str = "Familiarity") -> DataFrame:
    lines = result_lines(embedding_tasks(spark, sf_dir), dialect, json_answers,
                         word_label=word_label, feature_label=feature_label)
    return parse_lines(lines, SC.RESULT_UNION)
