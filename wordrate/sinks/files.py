"""Writers (K1, K3, K4/K5, K6, K7).

All writers are distributed: every task writes its own files through Spark's commit
protocol, so a lost executor only re-runs its tasks.
"""

from __future__ import annotations

import os
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.requests import batch_index
from ..session import ensure_checkpoint_dir
from .batches import write_batches


def scratch_dir(spark: SparkSession, name: str = "scratch") -> str:
    """A fresh folder under the shared checkpoint location (never a node-local temp dir)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "wordrate-" + name, uuid.uuid4().hex)


def write_request_batches(requests: DataFrame, path: str, chunk_size: int = 50000, mode: str = "error",
                          stamp: str | None = None) -> None:
    """K1: requests (run, task_no, json) -> files ``{run}_batch_{i}_{stamp}.jsonl`` in ``path``, each
    with the JSON lines of ``chunk_size`` consecutive tasks in task order, ready to be sent.
    A batch goes to one task, so each batch is one file (its size is the provider limit,
    a parameter).  Tasks name the files; the manifest that ``sinks.batches`` commits tells
    which count.  ``mode``: error (batches of the same runs are there already), append or
    overwrite (batches of the same runs are replaced)."""
    if mode not in ("error", "append", "overwrite"):
        raise ValueError(mode)
    stamp = stamp or datetime.now(timezone.utc).strftime("%Y-%m-%d-%H-%M-%S")
    out = (requests.withColumn("batch_index", batch_index("task_no", chunk_size))
                   .repartition("run", "batch_index")
                   .sortWithinPartitions("run", "batch_index", "task_no")
                   .select("run", "batch_index", F.col("json").alias("value")))
    write_batches(out, path, stamp, mode)


def touch(spark: SparkSession, path: str, seconds: int) -> None:
    """Set a file's modification time (seconds since 1970)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).setTimes(p, 1000 * seconds, -1)


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """K4/K5: rows as JSON lines (raw UTF-8; NULL fields omitted)."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode(mode).text(path)


def write_splits(split: DataFrame, path: str, fraction: float, seed: int, fmt: str = "parquet",
                 mode: str = "error") -> None:
    """K7: one folder per split, named with percentage and seed like
    ``train_split_50.0_randomstate_42`` / ``test_split_50.0_randomstate_42``."""
    pct = fraction * 100
    name = (F.when(F.col("split") == "train", F.lit(f"train_split_{pct}_randomstate_{seed}"))
             .otherwise(F.lit(f"test_split_{100 - pct}_randomstate_{seed}")))
    split.withColumn("split_name", name).write.mode(mode).format(fmt).partitionBy("split_name").save(path)


def _promote(spark: SparkSession, staged: str, base: str) -> str:
    """Make ``staged`` the current version of ``base``; the previous one becomes ``_old``."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    current, old = path(base + "/current"), path(base + "/_old")
    if fs.exists(current):
        if fs.exists(old):
            fs.delete(old, True)
        fs.rename(current, old)
    fs.rename(path(staged), current)
    return base + "/current"


def write_versioned(df: DataFrame, base: str, fmt: str = "parquet") -> str:
    """K3: write a new version directory; the previous version stays readable as
    ``_old`` (nothing is overwritten in place).  Returns the new version path."""
    staged = base + "/staged-" + uuid.uuid4().hex
    df.write.format(fmt).save(staged)
    return _promote(df.sparkSession, staged, base)


def write_diagnostics(diag: DataFrame, path: str, mode: str = "error") -> None:
    """K6: warnings / rejects / missing rows as their own output beside the main one."""
    diag.write.mode(mode).json(path)


def rewrite_first_sheet(workbook: DataFrame, merged: DataFrame, first_sheet: str, base: str) -> str:
    """K3: replace the first sheet of a workbook (read with ``sheet="*"``, so it carries
    a ``sheet`` column) by ``merged`` and keep every other sheet unchanged; the result is
    written as a new version of ``base`` (previous version kept as ``_old``).  Every task
    writes the rows it holds as one part workbook with one worksheet per sheet name, so
    a large sheet is spread over several part files (read back together with
    ``sheet="*"``) instead of being gathered into one task.  Returns the new path."""
    from ..sources import xlsx
    xlsx.register(workbook.sparkSession)
    others = workbook.where(F.col("sheet") != first_sheet)
    cols = [c for c in merged.columns if c != "sheet"]
    full = merged.select(*cols, F.lit(first_sheet).alias("sheet")).unionByName(others, allowMissingColumns=True)
    staged = base + "/staged-" + uuid.uuid4().hex
    full.write.format("xlsx").mode("append").option("sheetColumn", "sheet").save(staged)
    return _promote(full.sparkSession, staged, base)
