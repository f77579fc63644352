"""Chat-style training records and their dialect conversions.

Array form: one record per row with ``messages array<struct<role, content>>``; all
conversions are higher-order functions on that array (no explode, no grouping).
Long form (the ``conversations`` table, one row per turn): the transcript is produced
as ordered lines with their character offset inside the transcript, computed with a
range-partitioned prefix sum, so a huge conversation is never gathered in one task.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as X
from .numbering import prefix_sum

# --- fixed values: transcript speaker labels -------------------------------------
SPEAKERS = {"user": "User: ", "assistant": "Assistant: "}
# ----------------------------------------------------------------------------------


def chat_records(df: DataFrame, user_template: str, answer_column: str,
                 assistant_template: str | None = None, match: str = "reference") -> DataFrame:
    """P17 + P18: user = filled prompt template; assistant = filled answer template,
    or the rounded answer text alone.  The answer column is first rendered as text
    ``str(round(x, 2))`` and the templates see that text."""
    answer = N.answer_text(F.col(answer_column))
    cols = {c: (answer if c == answer_column else F.col(c)) for c in df.columns}
    user = X.partial_template(user_template, cols, match=match)
    assistant = X.partial_template(assistant_template, cols, match=match) if assistant_template else answer
    messages = F.array(F.struct(F.lit("user").alias("role"), user.alias("content")),
                       F.struct(F.lit("assistant").alias("role"), assistant.alias("content")))
    return df.withColumn("messages", messages)


def to_contents(messages: Column | str = "messages") -> Column:
    """Chat messages -> contents/parts; role ``assistant`` becomes ``model``."""
    m = F.col(messages) if isinstance(messages, str) else messages
    return F.transform(m, lambda x: F.struct(
        F.when(x["role"] == "assistant", F.lit("model")).otherwise(x["role"]).alias("role"),
        F.array(F.struct(x["content"].alias("text"))).alias("parts")))


def _line(role: Column, content: Column) -> Column:
    label = F.when(role == "user", F.lit(SPEAKERS["user"])).when(role == "assistant", F.lit(SPEAKERS["assistant"]))
    return F.concat(label, content, F.lit("\n"))


def transcript(messages: Column | str = "messages") -> Column:
    """P20 + F3 (array form): 'User: ...\\n' / 'Assistant: ...\\n' lines, other roles dropped."""
    m = F.col(messages) if isinstance(messages, str) else messages
    kept = F.filter(m, lambda x: x["role"].isin("user", "assistant"))
    return F.array_join(F.transform(kept, lambda x: _line(x["role"], x["content"])), "")


def transcript_lines(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                     text: str = "text", num_partitions: int | None = None) -> DataFrame:
    """P20 + F3 (long form): one row per kept turn with its line and the character
    offset of the line inside the conversation's transcript."""
    kept = (turns.where(F.col(role).isin("user", "assistant"))
                 .select(conv, turn, _line(F.col(role), F.col(text)).alias("line")))
    kept = kept.withColumn("line_chars", F.length("line").cast("long"))
    return prefix_sum(kept, [conv], [turn], "line_chars", out="offset", num_partitions=num_partitions)


def output_stem(path: str) -> str:
    """K8: output name from a dataset name -- only the last extension is removed
    (a version dot such as ``llama3.1`` stays)."""
    base = os.path.basename(path)
    stem, _ = os.path.splitext(base)
    return stem + ".jsonl"
