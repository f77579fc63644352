"""Result records -> canonical responses -> joined, scored rating rows.

Flow (one projection per step, one shuffle for the join):

    results (any dialect) --canonical_results--> (run, task_id, dialect, answer_text,
                                                  n_steps, first_logprob, first_top, ...)
    requests (any dialect) --canonical_requests--> (run, task_id, prompt, line_no)
                           --last_per_key-------> one request per (run, task_id)
    results JOIN requests on (run, task_id)  (J1-J3, inner; request fields win: J4)
    --score--> word, answer_text, value, logprob, weighted_sum, word_mismatch
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import scoring as S
from ..functions import text as X

DIALECTS = ("openai", "google", "local")
MODES = ("json", "number", "weighted_sum")


def _has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def _field(df: DataFrame, name: str) -> Column:
    return F.col(name) if _has(df, name) else F.lit(None).cast("string")


def dialect_of(df: DataFrame) -> Column:
    """S12 per row: ``custom_id`` before ``key`` before ``id`` (chat results also carry ``id``)."""
    return (F.when(_field(df, "custom_id").isNotNull(), F.lit("openai"))
             .when(_field(df, "key").isNotNull(), F.lit("google"))
             .when(_field(df, "id").isNotNull(), F.lit("local")))


def _run_col(df: DataFrame) -> Column:
    return F.col("run") if _has(df, "run") else F.lit("").alias("run")


def canonical_requests(df: DataFrame) -> DataFrame:
    """Request records of any dialect -> (run, task_id, dialect, prompt, line_no, word?)."""
    d = dialect_of(df)
    prompt_openai = F.try_element_at(F.col("body.messages"), F.lit(1))["content"] if _has(df, "body") else F.lit(None)
    # All string parts of all contents, newline-joined; a content without parts
    # adds nothing (flatten would otherwise turn the whole prompt NULL)
    no_text = F.array().cast("array<string>")
    prompt_google = (F.nullif(F.array_join(F.flatten(F.transform(
        F.col("request.contents"),
        lambda c: F.coalesce(F.transform(c["parts"], lambda p: p["text"]), no_text))), "\n"), F.lit(""))
        if _has(df, "request") else F.lit(None))
    prompt_local = F.col("prompt") if _has(df, "prompt") else F.lit(None)
    out = df.select(
        _run_col(df).alias("run"),
        F.coalesce(_field(df, "custom_id"), _field(df, "key"), _field(df, "id")).alias("task_id"),
        d.alias("dialect"),
        F.when(d == "openai", prompt_openai).when(d == "google", prompt_google)
         .when(d == "local", prompt_local).cast("string").alias("prompt"),
        (F.col("line_no") if _has(df, "line_no") else F.lit(None).cast("long")).alias("line_no"),
        *([F.col("word")] if _has(df, "word") else []),
    )
    return out.filter(F.col("task_id").isNotNull())  # F1


def canonical_results(df: DataFrame) -> DataFrame:
    """Result records of any dialect -> one canonical relation."""
    d = dialect_of(df)
    choice = F.try_element_at(F.col("response.body.choices"), F.lit(1))
    steps = choice["logprobs"]["content"]
    first_step = F.try_element_at(steps, F.lit(1))
    chat_top = F.transform(first_step["top_logprobs"],
                           lambda t: F.struct(t["token"].alias("token"), t["logprob"].alias("logprob")))
    cand = F.try_element_at(F.col("response.candidates"), F.lit(1))
    g_text = F.try_element_at(cand["content"]["parts"], F.lit(1))["text"]
    g_chosen = cand["logprobsResult"]["chosenCandidates"]
    g_top_steps = cand["logprobsResult"]["topCandidates"]
    g_top = F.transform(F.try_element_at(g_top_steps, F.lit(1))["candidates"],
                        lambda t: F.struct(t["token"].alias("token"), t["logProbability"].alias("logprob")))
    is_google = d == "google"
    return df.select(
        _run_col(df).alias("run"),
        F.coalesce(_field(df, "custom_id"), _field(df, "key"), _field(df, "id")).alias("task_id"),
        d.alias("dialect"),
        F.when(is_google, g_text).otherwise(choice["message"]["content"]).alias("answer_text"),
        F.when(is_google, F.size(g_chosen)).otherwise(F.size(steps)).alias("n_steps"),
        F.when(is_google, F.try_element_at(g_chosen, F.lit(1))["logProbability"])
         .otherwise(first_step["logprob"]).alias("first_logprob"),
        F.when(is_google, F.when(F.size(g_top_steps) > 0, g_top)).otherwise(chat_top).alias("first_top"),
        F.coalesce(F.size(F.col("response.candidates")) > 0, F.lit(False)).alias("has_candidates"),
        (F.col("line_no") if _has(df, "line_no") else F.lit(None).cast("long")).alias("line_no"),
        (F.col("processed_time").try_cast("timestamp") if _has(df, "processed_time")
         else F.lit(None).cast("timestamp")).alias("event_time"),
    ).filter(F.col("task_id").isNotNull())


def last_per_key(df: DataFrame, keys=("run", "task_id"), order: str = "line_no") -> DataFrame:
    """Keep the last record per key (dict-build semantics: last wins).

    ``max_by`` is a partial aggregate, so a hot key is combined map-side before the
    shuffle and never gathered in one task.
    """
    payload = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*payload), F.col(order)).alias("_last"))
    return agg.select(*keys, *[F.col("_last")[c].alias(c) for c in payload])


def join_results(results: DataFrame, requests: DataFrame) -> DataFrame:
    """J1 (chat, custom_id), J2 (contents, key), J3 (local, id) and J4: results (probe)
    inner-join deduplicated requests on (run, task_id).

    Duplicate results are all kept; the join strategy is left to Catalyst/AQE (a
    broadcast happens only when the runtime size of the request side is small).
    """
    req = last_per_key(requests.select("run", "task_id", "prompt", "line_no",
                                       *(["word"] if "word" in requests.columns else [])))
    req = req.withColumnRenamed("line_no", "request_line_no")
    return results.join(req, ["run", "task_id"], "inner")


def score(joined: DataFrame, mode: str = "weighted_sum", feature_label: str = "AoA",
          word_label: str = "Word", locale: str = "default", word_rule: str = "first",
          word_source: str = "prompt", carry: tuple[str, ...] = ()) -> DataFrame:
    """X1-X16 in one projection.

    ``mode``: json (X4+X5+X9) or number / weighted_sum (raw answer + gated X10/X11);
    the google dialect always parses the value with X5.  Gates by dialect: openai =
    one token (X12); local and google = integer answer below 1000 (X13).  ``carry``
    names extra input columns passed through unchanged.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; expected one of {MODES}")
    q = X.LOCALES[locale]
    pick = X.first_quoted if word_rule == "first" else X.last_quoted
    word_in = pick(F.col("prompt"), q["open"], q["close"])
    word_out = X.word_from_answer(F.col("answer_text"), word_label)
    x5 = X.number_from_answer(F.col("answer_text"), feature_label)
    d = F.col("dialect")
    gate = (F.when(d == "openai", F.coalesce(F.col("n_steps") == 1, F.lit(False)))
             .otherwise(S.integer_answer(F.col("answer_text"))))
    numeric_mode = mode != "json"
    if numeric_mode:
        logprob = (F.when(d == "google", F.col("first_logprob"))
                    .otherwise(S.gated(gate, F.col("first_logprob"))))
        weighted = F.when(gate, S.expected_rating(F.col("first_top")))
        value = F.when(d == "google", x5).otherwise(N.coerce_numeric(F.col("answer_text")))
        mismatch = F.lit(False)
    else:
        logprob = F.lit(None).cast("double")
        weighted = F.lit(None).cast("double")
        value = x5
        mismatch = F.coalesce((d != "google") & word_in.isNotNull() & word_out.isNotNull()
                              & (word_in != word_out), F.lit(False))
    keep = [c for c in ("run", "task_id", "dialect", "line_no") if c in joined.columns] + list(carry)
    # word_source="prompt": the quoted word of the prompt (X1/X2, reference behaviour);
    # "column": the word carried by the request table, which avoids X1's few-shot trap.
    word = F.col("word") if (word_source == "column" and "word" in joined.columns) else word_in
    return joined.select(
        *keep,
        word.alias("word"),
        F.col("answer_text"),
        value.alias("value"),
        logprob.cast("double").alias("logprob"),
        weighted.cast("double").alias("weighted_sum"),
        mismatch.alias("word_mismatch"),
    )


def mismatches(scored: DataFrame) -> DataFrame:
    """K6 / X9 diagnostics: rows whose input and output words differ."""
    return scored.filter(F.col("word_mismatch"))
