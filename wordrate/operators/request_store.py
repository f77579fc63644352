"""J1-J3 over a stored request table: each new drop of results shuffles the results alone.

The store is a Parquet table bucketed by (run, task_id).  Requests are appended as they are
made; the last one of a task wins (A14) when they are read, which needs no shuffle, as all
requests of a task are in one bucket.  Results are dealt out by the same keys and buckets and
meet them there.  The table lies in a folder (shared storage); a new session opens it by its
name and folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import responses as R

KEYS = ["run", "task_id"]
_COLUMNS = "run STRING, task_id STRING, prompt STRING, word STRING, line_no STRUCT<added: BIGINT, place: STRING>"


class RequestStore:
    """Requests bucketed by task under ``path``, as table ``name`` of the session."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int):
        self.spark, self.name, self.buckets = spark, name, buckets
        # the buckets are part of the table: open it with those it was made with
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({_COLUMNS}) USING parquet "
                  f"CLUSTERED BY (run, task_id) SORTED BY (run, task_id) INTO {int(buckets)} BUCKETS LOCATION '{path}'")

    def add(self, requests: DataFrame, added: int) -> None:
        """Append canonical requests (run, task_id, prompt, line_no, perhaps word).  A task's last
        request is the one with the highest ``added``, and of these the highest line_no."""
        order = requests.schema["line_no"].dataType.simpleString()
        place = F.lpad(F.col("line_no").cast("string"), 20, "0") if order in ("bigint", "int") else F.to_json("line_no") if order.startswith("struct") else F.col("line_no").cast("string")
        word = F.col("word") if "word" in requests.columns else F.lit(None).cast("string")
        rows = requests.select("run", "task_id", "prompt", word.alias("word"), F.struct(F.lit(int(added)).cast("long").alias("added"), place.alias("place")).alias("line_no"))
        # one file per bucket and call
        rows.repartition(self.buckets, *KEYS).write.insertInto(self.name)

    def requests(self) -> DataFrame:
        """The last request of every task; no shuffle."""
        return R.last_per_key(self.spark.table(self.name), KEYS)

    def join(self, results: DataFrame) -> DataFrame:
        """Canonical results with their requests (J1-J4): ``responses.join_results`` with the
        requests where they lie."""
        return results.join(self.requests().withColumnRenamed("line_no", "request_line_no").hint("merge"), KEYS, "inner")

    def drop(self) -> None:
        """Forget the table; its folder stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
