"""R1, R2 and A16 while files land: exact first answers, overdue tasks, finished runs.

Request and result files of any dialect are one stream of changes (run, task, what happened).

1. ``task_events`` keeps one state per (run, task): whether it was requested, answered or
   failed, its prompt, and an answer that came before its request.  It gives one ``answer``
   event for the first answer of a task, whichever of request and answer comes first, an
   ``overdue`` event when a timer finds the task without a result, and ``count`` rows that say
   by how much the numbers of the run change.  Repeats within a batch of lines are combined
   before the shuffle, so a task with very many results costs a few rows.
2. ``run_reports`` reads those events and keeps the numbers of each run.  The changes of a run
   are summed in the tasks that read them, so a run of any size sends a row per batch of
   events.  It gives the report of A16 after every trigger that changed it, and marks the
   one in which the run is finished.

With ``forget`` a task's state is dropped that long after its last change (time to live); a repeat
that comes later counts as a new extra result.  Without it the state keeps every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators import responses as R
from ..sources import files as S
from ..sources import schemas as SC

CHANGES = "run string, task_id string, kind string, place string, failed boolean, prompt string, answer string"
NUMBERS = ["n_requests", "n_answered", "n_failed", "n_missing", "n_extra"]
EVENTS = "run string, task_id string, event string, prompt string, answer string, " + ", ".join(f"{n} long" for n in NUMBERS)
REPORTS = "run string, version long, " + ", ".join(f"{n} long" for n in NUMBERS) + ", all_finished boolean, finished boolean"

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_TASK = "requested boolean, prompt string, place string, answered boolean, failed boolean, answer string, told boolean, due long"
#: Columns of an answer that ``scored`` needs.
ANSWER = ("dialect string, answer_text string, n_steps int, first_logprob double, first_top array<struct<token:string,logprob:double>>, "
          "has_candidates boolean")


# --- changes -------------------------------------------------------------------------------

def _place() -> Column:
    """Order of lines among requests of a task: the file's time, name and block."""
    m = F.col("_metadata")
    return F.concat_ws("|", F.date_format(m["file_modification_time"], "yyyyMMddHHmmss.SSS"), m["file_path"], F.lpad(m["file_block_start"].cast("string"), 20, "0"))


def request_changes(requests: DataFrame) -> DataFrame:
    """Request records (of ``readStream`` or a table, with run) -> changes."""
    place = _place() if "_place" not in requests.columns else F.col("_place")
    rows = requests.withColumn("line_no", place)
    return R.canonical_requests(rows).select("run", "task_id", F.lit("request").alias("kind"), F.col("line_no").alias("place"),
                                             F.lit(False).alias("failed"), "prompt", F.lit(None).cast("string").alias("answer"))


def result_changes(results: DataFrame, failed: Column | None = None) -> DataFrame:
    """Result records -> changes.  ``failed`` tells failed ones (default: a record with an error)."""
    place = _place() if "_place" not in results.columns else F.col("_place")
    bad = F.col("error").isNotNull() if failed is None else failed
    rows = results.withColumn("line_no", F.struct(place.alias("place"), F.coalesce(bad, F.lit(False)).alias("failed")))
    body = F.to_json(F.struct("dialect", "answer_text", "n_steps", "first_logprob", "first_top", "has_candidates"))
    return R.canonical_results(rows).select("run", "task_id", F.lit("result").alias("kind"), F.col("line_no.place").alias("place"),
                                            F.col("line_no.failed").alias("failed"), F.lit(None).cast("string").alias("prompt"), body.alias("answer"))


def file_changes(spark: SparkSession, requests_dir: str, results_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The stream of both folders; runs come from the files' names or folders."""
    def read(ddl, folder):
        reader = spark.readStream.schema(ddl).option("recursiveFileLookup", True)
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        return reader.json(folder).withColumns({"run": S.run_of_file(F.col("_metadata.file_path")), "_place": _place()})

    return request_changes(read(SC.REQUEST_UNION, requests_dir)).unionByName(result_changes(read(SC.RESULT_UNION, results_dir)))


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the lines of one task in a batch: the last request; the first result, failed if any is."""
    for batch in batches:
        best: dict = {}
        for row in batch.to_pylist():
            key = (row["run"], row["task_id"], row["kind"])
            old = best.get(key)
            if old is None:
                best[key] = row
                continue
            failed = old["failed"] or row["failed"]
            later = (row["place"] or "", row["prompt"] or "") >= (old["place"] or "", old["prompt"] or "")
            earlier = (row["failed"], row["place"] or "", row["answer"] or "") < (old["failed"], old["place"] or "", old["answer"] or "")
            if later if row["kind"] == "request" else earlier:
                best[key] = row
            best[key]["any_failed"] = failed or old.get("any_failed", False)
        rows = [{**r, "any_failed": r.get("any_failed", r["failed"])} for r in best.values()]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(
            [(n, pa.bool_() if n in ("failed", "any_failed") else pa.string()) for n in ("run", "task_id", "kind", "place", "failed", "prompt", "answer", "any_failed")]))


# --- tasks ---------------------------------------------------------------------------------

def _class(requested: bool, answered: bool, failed: bool) -> list[int]:
    """What a task adds to n_requests, n_answered, n_failed, n_missing, n_extra."""
    return [int(requested), int(requested and answered and not failed), int(requested and failed), int(requested and not answered), int(answered and not requested)]


class _Tasks(StatefulProcessor):
    def __init__(self, overdue_ms: int | None, forget_ms: int | None):
        self.overdue_ms, self.forget_ms = overdue_ms, forget_ms

    def init(self, handle):
        self.handle = handle
        self.task = handle.getValueState("task", _TASK, self.forget_ms)

    def handleInputRows(self, key, rows, timerValues):
        run, task_id = key
        old = self.task.get()
        requested, prompt, place, answered, failed, answer, told, due = old or (False, None, None, False, False, None, False, None)
        before = _class(requested, answered, failed)
        first = None
        for r in rows:
            if r["kind"] == "request":
                if not requested or (r["place"] or "", r["prompt"] or "") >= (place or "", prompt or ""):
                    prompt, place = r["prompt"], r["place"]
                requested = True
            else:
                answered, failed = True, failed or r["any_failed"]
                if not r["failed"] and (first is None or (r["place"] or "", r["answer"] or "") < first):
                    first = (r["place"] or "", r["answer"] or "")
        if not told and answer is None and first is not None:
            answer = first[1]
        if answered and due is not None:
            self.handle.deleteTimer(due)
            due = None
        elif requested and not answered and due is None and self.overdue_ms is not None and not before[0]:
            due = timerValues.getCurrentProcessingTimeInMs() + self.overdue_ms
            self.handle.registerTimer(due)
        out = []
        if requested and answer is not None and not told:
            out.append(self._event(run, task_id, "answer", prompt, answer, [0] * 5))
            told, answer = True, None
        after = _class(requested, answered, failed)
        if after != before:
            out.append(self._event(run, task_id, "count", None, None, [a - b for a, b in zip(after, before)]))
        self.task.update((requested, prompt, place, answered, failed, answer, told, due))
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        old = self.task.get()
        if not old or old[3]:
            return iter(())
        self.task.update((*old[:7], None))
        return iter([self._event(key[0], key[1], "overdue", old[1], None, [0] * 5)])

    @staticmethod
    def _event(run, task_id, event, prompt, answer, numbers):
        return Row(run=run, task_id=task_id, event=event, prompt=prompt, answer=answer, **dict(zip(NUMBERS, numbers)))

    def close(self):
        pass


def task_events(changes: DataFrame, overdue_ms: int | None = None, forget_ms: int | None = None) -> DataFrame:
    """Events of every task (see the module's text); write them with ``run_available``."""
    combined = changes.mapInArrow(_combined, CHANGES + ", any_failed boolean")
    clock = "none" if overdue_ms is None and forget_ms is None else "processingTime"
    return combined.groupBy("run", "task_id").transformWithState(_Tasks(overdue_ms, forget_ms), EVENTS, "append", clock)


# --- runs ----------------------------------------------------------------------------------

def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        table = pa.Table.from_batches([batch]).group_by("run").aggregate([(n, "sum") for n in NUMBERS])
        yield from table.select(["run", *[f"{n}_sum" for n in NUMBERS]]).rename_columns(["run", *NUMBERS]).combine_chunks().to_batches()


class _Runs(StatefulProcessor):
    def init(self, handle):
        self.numbers = handle.getValueState("numbers", "version long, " + ", ".join(f"{n} long" for n in NUMBERS))

    def handleInputRows(self, key, rows, timerValues):
        old = self.numbers.get()
        version, *numbers = old or (0, 0, 0, 0, 0, 0)
        was = old is not None and numbers[2] == 0 and numbers[3] == 0
        for r in rows:
            numbers = [a + r[n] for a, n in zip(numbers, NUMBERS)]
        self.numbers.update((version + 1, *numbers))
        done = numbers[2] == 0 and numbers[3] == 0
        return iter([Row(run=key[0], version=version + 1, **dict(zip(NUMBERS, numbers)), all_finished=done, finished=done and not was)])

    def close(self):
        pass


def run_reports(events: DataFrame) -> DataFrame:
    """Report of each run after every trigger that changed it, with a rising version; ``finished``
    marks those in which the run got to have all its answers."""
    counts = events.where(F.col("event") == "count").select("run", *NUMBERS)
    sums = counts.mapInArrow(_summed, "run string, " + ", ".join(f"{n} long" for n in NUMBERS))
    return sums.groupBy("run").transformWithState(_Runs(), REPORTS, "append", "none")


def stored_events(spark: SparkSession, path: str) -> DataFrame:
    """The stream of events that ``run_available`` has written."""
    return spark.readStream.schema(EVENTS).parquet(path)


def latest_reports(reports: DataFrame) -> DataFrame:
    """A16 from the reports written so far: one row per run."""
    last = reports.groupBy("run").agg(F.max_by(F.struct(*NUMBERS, "all_finished"), "version").alias("r"))
    return last.select("run", "r.*")


def scored(events: DataFrame, mode: str = "weighted_sum", feature_label: str = "AoA") -> DataFrame:
    """The first answers among the events, scored like batch results."""
    rows = events.where(F.col("event") == "answer").select("run", "task_id", "prompt", F.from_json("answer", ANSWER).alias("a"))
    return R.score(rows.select("run", "task_id", "prompt", "a.*"), mode=mode, feature_label=feature_label)


def run_available(stream: DataFrame, out_path: str, checkpoint: str) -> None:
    """Process everything present now and stop.  State lies in RocksDB, on the executors' disks and
    (its changes) in ``checkpoint``; the rows are appended to ``out_path`` exactly once.  Timers are
    looked at when there is something new (a batch without rows would always ask for another)."""
    conf = stream.sparkSession.conf
    own = {"spark.sql.streaming.stateStore.providerClass": _ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    was = {name: conf.get(name, None) for name in own}
    for name, value in own.items():
        conf.set(name, value)
    try:
        q = (stream.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint)
                   .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        for name, value in was.items():
            conf.unset(name) if value is None else conf.set(name, value)
