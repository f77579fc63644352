"""R1 + R2: score result files as they land (Structured Streaming).

result files (any dialect, explicit schema) --readStream--> canonical results
  --R2 dedupe per (run, task_id)--> stream-static inner join with the request table
  --score (same expressions as batch)--> append sink

A task's first answer is always kept, however old its own time stamp: provider batches
finish hours apart and land in any order.  Repeats are told by (run, task_id), the run
coming from the file's name or folder.  Without ``watermark`` the state holds one key per
answered task and repeats are dropped for good.  With it, the state forgets a key that long
after its *arrival* (the micro-batch's clock, which never runs late), so state is bounded by
the tasks that arrive in that time, and a repeat that arrives later is a new answer.  The sink
and its checkpoint live in shared storage, so a restarted query resumes exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import responses as R
from ..session import cut_lineage
from ..sources import files as S
from ..sources import schemas as SC


def scored_stream(spark: SparkSession, results_dir: str, requests: DataFrame, mode: str = "weighted_sum",
                  feature_label: str = "AoA", watermark: str | None = None,
                  max_files_per_trigger: int | None = None, materialize: bool = True) -> DataFrame:
    """The static side (requests, last one per task) is deduplicated once and, with
    ``materialize``, checkpointed to the shared checkpoint folder, so each micro-batch
    scans the stored table instead of re-running the dedupe aggregation."""
    reader = spark.readStream.schema(SC.RESULT_UNION).option("recursiveFileLookup", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.json(results_dir).withColumn("run", S.run_of_file(F.col("_metadata.file_path")))
    canon = R.canonical_results(raw)
    if watermark:
        canon = (canon.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", watermark)
                      .dropDuplicatesWithinWatermark(["run", "task_id"]))
    else:
        canon = canon.dropDuplicates(["run", "task_id"])
    req = R.last_per_key(requests.select("run", "task_id", "prompt", "line_no"))
    if materialize:
        req = cut_lineage(req)
    joined = canon.join(req.withColumnRenamed("line_no", "request_line_no"), ["run", "task_id"], "inner")
    return R.score(joined, mode=mode, feature_label=feature_label)


def run_available(stream: DataFrame, out_path: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Process everything present now (availableNow trigger) and stop."""
    q = (stream.writeStream.format(fmt).option("path", out_path).option("checkpointLocation", checkpoint)
               .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
