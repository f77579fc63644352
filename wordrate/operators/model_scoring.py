"""M1: score prompts with a caller-supplied model, in small groups, inside Spark tasks.

The model (a Python callable ``prompts -> outputs``) is built once per task by
``factory``; prompts stream through as Arrow batches and are regrouped into calls of
``batch_size`` prompts, whatever the size of the Arrow batches: a group that a batch leaves
open is filled from the next, and only the last group of a task may be short.  One
output per prompt, in input order.  Calling remote services or loading weights is the
factory's business, not this module's.

``score_resumable`` also keeps a ledger: a task writes the answers of every group, with the
prompts' keys, before it sends the next one.  A run that is started again (and a task that
Spark starts again) leaves out what the ledger holds, so no prompt that was answered is sent
a second time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from ..session import storage_uri
from ..sources.files import parse_json_lines

#: Groups after which a task goes on in a new ledger file (what a file system that shows
#: only closed files could lose).
LEDGER_GROUPS = 200


def _grouped(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows of a task in tables of ``size`` rows; the last one may have fewer."""
    open_rows, held = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, size - held)
            open_rows.append(part)
            held, at = held + part.num_rows, at + part.num_rows
            if held == size:
                yield pa.Table.from_batches(open_rows)
                open_rows, held = [], 0
    if open_rows:
        yield pa.Table.from_batches(open_rows)


def _answers(model, prompts: list[str]) -> list:
    out = list(model(prompts))
    if len(out) != len(prompts):
        raise ValueError("model returned a different number of outputs than prompts")
    return out


def score_prompts(df: DataFrame, prompt_col: str, factory: Callable[[], Callable[[list[str]], Sequence]],
                  out_col: str = "score", out_type: T.DataType = T.DoubleType(), batch_size: int = 5) -> DataFrame:
    """``df`` with ``out_col``: what the model says to each row's prompt."""
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, out_type)])
    at, kind = df.columns.index(prompt_col), to_arrow_type(out_type)
    names = to_arrow_schema(schema).names

    def run(batches):
        model = factory()  # once per task
        for group in _grouped(batches, batch_size):
            out = _answers(model, group.column(at).to_pylist())
            yield from pa.Table.from_arrays([*group.columns, pa.array(out, kind)], names=names).combine_chunks().to_batches()

    return df.mapInArrow(run, schema)


# --- with a ledger -------------------------------------------------------------------------

def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path.rstrip("/"))


def ledger(spark, folder: str, keys: Sequence[T.StructField], out_col: str, out_type: T.DataType) -> DataFrame:
    """What a ledger holds: keys and answer, one row per key.  A line that a dying task left
    unfinished is not read."""
    schema = T.StructType([*keys, T.StructField(out_col, out_type)])
    fs, base = _file_system(storage_uri(spark, folder))
    files = [f for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if f.is_file and f.size]
    if not files:
        return spark.createDataFrame([], schema)
    lines = spark.read.text(folder)
    rows = parse_json_lines(lines, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields))
    return rows.where(F.col("_bad").isNull()).drop("_bad").dropDuplicates([k.name for k in keys])


def _sending(names, key_at, prompt_at, factory, folder, job, out_col, batch_size):
    def run(batches):
        from pyspark import TaskContext
        ctx = TaskContext.get()
        fs, base = _file_system(folder)
        fs.create_dir(base, recursive=True)
        mine = f"{job}-{ctx.partitionId()}-"
        told = set()  # by an earlier attempt of this task
        for f in fs.get_file_info(pafs.FileSelector(base)):
            if f.base_name.startswith(mine):
                with fs.open_input_stream(f.path) as old:
                    for line in old.read().decode("utf-8", "ignore").split("\n")[:-1]:
                        told.add(json.dumps([json.loads(line).get(n) for n in names]))

        def fresh():
            for batch in batches:
                keys = zip(*[batch.column(i).to_pylist() for i in key_at])
                left = [i for i, k in enumerate(keys) if json.dumps(list(k)) not in told] if told else None
                yield batch if left is None else batch.take(pa.array(left, pa.int64()))

        model, out, sent = factory(), None, 0
        try:
            for k, group in enumerate(_grouped(fresh(), batch_size)):
                answers = _answers(model, group.column(prompt_at).to_pylist())
                if out is None:
                    out = fs.open_output_stream(f"{base}/{mine}{uuid.uuid4().hex}.jsonl")
                rows = zip(*[group.column(i).to_pylist() for i in key_at], answers)
                out.write("".join(json.dumps(dict(zip([*names, out_col], r)), ensure_ascii=False) + "\n" for r in rows).encode())
                out.flush()
                sent += group.num_rows
                if (k + 1) % LEDGER_GROUPS == 0:
                    out.close()
                    out = None
        finally:
            if out is not None:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array([sent], pa.int64())], names=["sent"])
    return run


def score_resumable(df: DataFrame, keys: Sequence[str], prompt_col: str, factory: Callable[[], Callable[[list[str]], Sequence]],
                    folder: str, out_col: str = "score", out_type: T.DataType = T.DoubleType(), batch_size: int = 5) -> DataFrame:
    """``df`` with ``out_col``, every prompt sent once over all runs with the same ledger ``folder``.

    ``keys`` (such as run and task_id; JSON-like values, not null) name a prompt; rows of one key
    are one prompt, the first sent one's answer holds for all.  A run that stops leaves what it
    was answered in the ledger; start it again to go on.  The rows come from the ledger, by a join."""
    spark = df.sparkSession
    fields = [df.schema[k] for k in keys]
    done = ledger(spark, folder, fields, out_col, out_type)
    todo = df.select(*keys, prompt_col).dropDuplicates(list(keys)).join(done, list(keys), "left_anti").select(*keys, prompt_col)
    run = _sending(list(keys), list(range(len(keys))), len(keys), factory, storage_uri(spark, folder), uuid.uuid4().hex, out_col, batch_size)
    todo.mapInArrow(run, "sent long").agg(F.sum("sent")).first()
    return df.join(ledger(spark, folder, fields, out_col, out_type), list(keys), "left")


def length_scorer_factory():
    """Deterministic stand-in model for tests: (number of characters mod 7) + 1."""
    def model(prompts: list[str]) -> list[float]:
        return [float(len(p or "") % 7 + 1) for p in prompts]
    return model


def generation_steps(step_scores, token_of, k: int = 5):
    """X17 per generated step: raw vocabulary scores (``array<array<float>>``) -> the
    step list of a result record: chosen (arg-max) token, its log-probability, UTF-8
    bytes (X18) and the top-k alternatives.  ``token_of(index_column)`` maps a
    vocabulary index to its token text (a Column expression)."""
    from ..functions import scoring as S

    def entry(tok, lp):
        return F.struct(tok.alias("token"), lp.alias("logprob"), S.token_bytes(tok).alias("bytes"))

    def step(top):
        first = top[0]
        alts = F.transform(top, lambda t: entry(token_of(t["index"]), t["logprob"]))
        return F.struct(token_of(first["index"]).alias("token"), first["logprob"].alias("logprob"),
                        S.token_bytes(token_of(first["index"])).alias("bytes"), alts.alias("top_logprobs"))

    # top-k once per step (bound as a lambda variable), then the record entries
    tops = F.transform(step_scores, lambda sc: S.softmax_topk(sc, k))
    return F.transform(tops, step)


def local_result_record(task_id, model, steps):
    """The canonical local-run result record (status_code -1, one choice); the
    answer text is the concatenation of the chosen tokens."""
    text = F.array_join(F.transform(steps, lambda s: s["token"]), "")
    choice = F.struct(F.lit(0).alias("index"),
                      F.struct(F.lit("assistant").alias("role"), text.alias("content"),
                               F.lit(None).cast("string").alias("refusal"),
                               F.array().cast("array<string>").alias("annotations")).alias("message"),
                      F.struct(steps.alias("content")).alias("logprobs"))
    body = F.struct(model.alias("model"), F.array(choice).alias("choices"))
    return F.struct(task_id.alias("id"), F.struct(F.lit(-1).alias("status_code"), body.alias("body")).alias("response"))
