"""Word table x prompt template -> provider request records.

A request table has one row per (run, task): ``run, task_no, task_id, word, prompt,
record`` where ``record`` is the provider struct, and ``json`` its JSON line.  All of
it is column expressions over the word table; the experiment settings are literals
or, for several experiments at once, a literal array exploded per word (J8) -- no
join and no driver-side loop.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .numbering import number_in_file_order, with_row_number


@dataclass(frozen=True)
class Experiment:
    """Settings of one experiment (one catalogue entry, S11)."""

    name: str                      # run name; default in the reference: "original"
    experiment_path: str           # folder; the task id prefix (P3)
    prompt: str                    # template text (S10)
    company: str = "OpenAI"        # OpenAI | Google | HuggingFace | Local | Vertex
    model_name: str = "gpt-4o-2024-08-06"
    temperature: float = 0.0
    logprobs: bool = True
    top_logprobs: int = 5
    dataset_column: str = "word"
    ft_dir: str | None = None
    extra: Mapping[str, object] = field(default_factory=dict)

    @property
    def prompt_key(self) -> str:
        """P4 on the constant template, falling back to P5 (column name)."""
        import re
        m = re.search(r'"(\{.*?\})"', self.prompt, flags=re.S)
        return m.group(1) if m else "{" + self.dataset_column + "}"


def number_words(words: DataFrame, order_cols: Sequence[str], column: str = "word",
                 num_partitions: int | None = None) -> DataFrame:
    """P1 + P2: project the word column and number rows 1.. in ``order_cols`` order."""
    numbered = with_row_number(words, list(order_cols), name="task_no", num_partitions=num_partitions)
    return numbered.select(F.col("task_no"), F.col(column).alias("word"))


def number_words_in_file_order(words: DataFrame, column: str = "word") -> DataFrame:
    """P1 + P2 in input order: the words of a file scan as they lie, numbered 1.. where they are."""
    return number_in_file_order(words.select(column), name="task_no").select("task_no", F.col(column).alias("word"))


def task_id(experiment_path: Column | str, task_no: Column | str = "task_no") -> Column:
    """``{experiment_path}_task_{n}``."""
    path = F.lit(experiment_path) if isinstance(experiment_path, str) else experiment_path
    n = F.col(task_no) if isinstance(task_no, str) else task_no
    return F.concat(path, F.lit("_task_"), n.cast("string"))


def _openai(tid: Column, prompt: Column, e: Column) -> Column:
    """Chat-completions request."""
    return F.struct(
        tid.alias("custom_id"),
        F.lit("POST").alias("method"),
        F.lit("/v1/chat/completions").alias("url"),
        F.struct(
            e["model_name"].alias("model"),
            e["temperature"].alias("temperature"),
            e["logprobs"].alias("logprobs"),
            e["top_logprobs"].alias("top_logprobs"),
            F.struct(F.lit("text").alias("type")).alias("response_format"),
            F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("messages"),
        ).alias("body"),
    )


def _google(tid: Column, prompt: Column, e: Column) -> Column:
    """contents/parts request with snake-case generation settings."""
    return F.struct(
        tid.alias("key"),
        F.struct(
            F.concat(F.lit("models/"), e["model_name"]).alias("model"),
            F.array(F.struct(F.array(F.struct(prompt.alias("text"))).alias("parts"))).alias("contents"),
            F.struct(e["temperature"].alias("temperature"),
                     e["logprobs"].alias("response_logprobs"),
                     e["top_logprobs"].alias("logprobs")).alias("generation_config"),
        ).alias("request"),
    )


def _vertex(word: Column, prompt: Column, e: Column) -> Column:
    """P10: contents/parts request keyed by the word, role user, no log-probabilities."""
    return F.struct(
        X.as_text(word).alias("key"),
        F.struct(
            F.array(F.struct(F.lit("user").alias("role"),
                             F.array(F.struct(prompt.alias("text"))).alias("parts"))).alias("contents"),
            F.struct(e["temperature"].alias("temperature")).alias("generation_config"),
        ).alias("request"),
    )


def _local(tid: Column, prompt: Column, e: Column) -> Column:
    """Flat local-model request; ``ft_dir`` only when set (NULL drops in to_json)."""
    return F.struct(
        tid.alias("id"),
        prompt.alias("prompt"),
        e["temperature"].alias("temperature"),
        e["logprobs"].alias("response_logprobs"),
        e["top_logprobs"].alias("logprobs"),
        e["model_name"].alias("model"),
        e["ft_dir"].alias("ft_dir"),
    )


BUILDERS = {"OpenAI": "openai", "Google": "google", "HuggingFace": "local", "Local": "local", "Vertex": "vertex"}


def _settings_literal(e: Experiment) -> Column:
    return F.struct(
        F.lit(e.name).alias("run"),
        F.lit(e.experiment_path).alias("experiment_path"),
        F.lit(e.prompt).alias("prompt_template"),
        F.lit(e.prompt_key).alias("prompt_key"),
        F.lit(e.company).alias("company"),
        F.lit(e.model_name).alias("model_name"),
        F.lit(float(e.temperature)).alias("temperature"),
        F.lit(bool(e.logprobs)).alias("logprobs"),
        F.lit(int(e.top_logprobs)).alias("top_logprobs"),
        F.lit(e.ft_dir).cast("string").alias("ft_dir"),
    )


def build_requests(numbered_words: DataFrame, experiments: Experiment | Sequence[Experiment],
                   provider: str | None = None) -> DataFrame:
    """P3, P6, P8-P12 and J8.

    ``numbered_words``: (task_no, word).  With several experiments every word is paired
    with every experiment by exploding a literal array (the catalogue is a handful of
    settings read on the driver), so the word table is scanned once.
    The result has one ``record`` column per provider family actually requested; all
    rows of one call must share a provider family unless ``provider`` is None, in
    which case ``json`` (the rendered line) is the common output.
    """
    exps = [experiments] if isinstance(experiments, Experiment) else list(experiments)
    for e in exps:
        if e.company not in BUILDERS:
            raise ValueError(f"Unknown company: {e.company}")
    if len(exps) == 1:
        with_exp = numbered_words.withColumn("_exp", _settings_literal(exps[0]))
    else:
        with_exp = numbered_words.withColumn("_exp", F.explode(F.array(*[_settings_literal(e) for e in exps])))
    e = F.col("_exp")
    tid = task_id(e["experiment_path"])
    prompt = X.fill_template(e["prompt_template"], e["prompt_key"], F.col("word"))
    families = {BUILDERS[x.company] for x in exps}
    if provider is None and len(families) == 1:
        provider = families.pop()
    records = {"openai": _openai(tid, prompt, e), "google": _google(tid, prompt, e),
               "local": _local(tid, prompt, e), "vertex": _vertex(F.col("word"), prompt, e)}
    base = [e["run"].alias("run"), F.col("task_no"), tid.alias("task_id"), F.col("word"), prompt.alias("prompt")]
    if provider is not None:
        rec = records[provider]
        return with_exp.select(*base, rec.alias("record"), F.to_json(rec).alias("json"))
    family = F.col("_exp.company")
    line = F.lit(None).cast("string")
    for comp, fam in BUILDERS.items():
        line = F.when(family == comp, F.to_json(records[fam])).otherwise(line)
    return with_exp.select(*base, line.alias("json"))


def add_default_role(records: DataFrame, contents_path: str = "request.contents",
                     default_role: str = "user") -> DataFrame:
    """Every content lacking a role gets ``default_role``; others pass through."""
    top, _, inner = contents_path.partition(".")
    contents = F.col(contents_path)
    fixed = F.transform(contents, lambda c: c.withField("role", F.coalesce(c["role"], F.lit(default_role))))
    if not inner:
        return records.withColumn(top, fixed)
    return records.withColumn(top, F.col(top).withField(inner, fixed))


def batch_index(task_no: Column | str = "task_no", chunk_size: int = 50000) -> Column:
    """K1: consecutive slices of ``chunk_size`` tasks -> 0-based batch number."""
    n = F.col(task_no) if isinstance(task_no, str) else task_no
    return F.floor((n - F.lit(1)) / F.lit(chunk_size)).cast("long")
