"""Re-queueing failed requests (J6, U3) and the per-run completeness report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def requeue(requests: DataFrame, failed: DataFrame, key: str = "custom_id", run: str | None = None) -> DataFrame:
    """Requests whose id occurs among the failed ids (left semi join).

    With ``run``, a failed id counts for the requests of its own run; one whose run is ''
    counts for every run.  The failed side is reduced to distinct ids first; a semi join
    never multiplies request rows, and AQE broadcasts the id set only when it is small at
    run time.
    """
    cols = [key] + ([run] if run else [])
    ids = failed.select(*[F.col(c).alias(f"_failed_{c}") for c in cols]).dropna(subset=[f"_failed_{key}"]).distinct()
    same = F.col(key) == F.col(f"_failed_{key}")
    if run:
        same = same & ((F.col(f"_failed_{run}") == "") | (F.col(f"_failed_{run}") == F.col(run)))
    return requests.join(ids, same, "left_semi")


def completeness(requests: DataFrame, results: DataFrame, run: str = "run", key: str = "task_id",
                 failed: str = "failed") -> DataFrame:
    """Per run -- requests, answered, failed, missing, extra, all_finished.

    ``results`` carries a boolean ``failed`` column.  One full outer join on
    (run, key) and one aggregation; results are first reduced to one row per key.
    """
    res = results.groupBy(run, key).agg(F.bool_or(F.col(failed)).alias("_failed"))
    req = requests.select(run, key).distinct().withColumn("_req", F.lit(True))
    j = req.join(res.withColumn("_res", F.lit(True)), [run, key], "full_outer")
    return (j.groupBy(run)
             .agg(F.count_if(F.col("_req").isNotNull()).alias("n_requests"),
                  F.count_if(F.col("_req").isNotNull() & F.col("_res").isNotNull() & ~F.col("_failed"))
                   .alias("n_answered"),
                  F.count_if(F.col("_req").isNotNull() & F.coalesce(F.col("_failed"), F.lit(False)))
                   .alias("n_failed"),
                  F.count_if(F.col("_req").isNotNull() & F.col("_res").isNull()).alias("n_missing"),
                  F.count_if(F.col("_req").isNull()).alias("n_extra"),
                  F.bool_and(F.col("_req").isNull() | (F.col("_res").isNotNull() & ~F.col("_failed")))
                   .alias("all_finished")))
