"""Global ordering primitives that never put a whole table (or group) in one task.

``with_row_number``  dense 1-based numbering in a total order (P2, T4-T6).
``number_in_file_order``  numbering of a file scan as it lies, from counts per split (P2).
``prefix_sum(s)``    exclusive running sums of values within groups (Spearman ranks,
                     transcript offsets).

The first and the last range-partition the data on the ordering keys and number or sum inside each
partition, then add an offset per partition.  Range bounds are sampled, so two plans over
the same data may cut it differently; the ranged rows are therefore stored once (a reliable
checkpoint), each with its partition's number, and both the counts and the rows are read
from there.  Offsets have one row per partition at most, and are broadcast.  The ordering
keys must be unique (add a tie-breaker) so that the order is total.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_LOCAL_BITS = 33  # monotonically_increasing_id = partition_index << 33 | row_in_partition


def _n_partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return int(num_partitions)
    setting = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    try:
        return int(setting)
    except (TypeError, ValueError):  # a non-numeric setting such as "auto"
        return int(df.sparkSession.sparkContext.defaultParallelism)


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def with_row_number(df: DataFrame, order_cols, name: str = "row_no", start: int = 1,
                    num_partitions: int | None = None, total: str | None = None) -> DataFrame:
    """Append ``name`` = position in the total order of ``order_cols`` (+ start), and
    with ``total`` the row count of the whole input (from the same per-partition counts,
    so no extra pass)."""
    order = _cols(order_cols)
    n = _n_partitions(df, num_partitions)
    # the place in the order is a stored value: no later plan computes it again
    tagged = cut_lineage(df.repartitionByRange(n, *order)
                           .sortWithinPartitions(*order)
                           .withColumn("_wr_pid", F.spark_partition_id())
                           .withColumn("_wr_mid", F.monotonically_increasing_id()))
    counts = tagged.groupBy("_wr_pid").agg(F.count(F.lit(1)).alias("_wr_n"))
    offsets = counts.select(
        "_wr_pid",
        F.coalesce(F.sum("_wr_n").over(Window.orderBy("_wr_pid")
                                       .rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_wr_off"),
        *([F.sum("_wr_n").over(Window.partitionBy()).cast("long").alias(total)] if total else []))
    local = F.col("_wr_mid") - F.shiftleft(F.col("_wr_pid").cast("long"), _LOCAL_BITS)
    return (tagged.join(F.broadcast(offsets), "_wr_pid")  # one row per partition
                  .withColumn(name, (F.col("_wr_off") + local + F.lit(start)).cast("long"))
                  .drop("_wr_pid", "_wr_mid", "_wr_off"))


def number_in_file_order(df: DataFrame, name: str = "row_no", start: int = 1) -> DataFrame:
    """Append ``name`` = position of a row of a file scan in (file, place in the file) order (+ start),
    without moving or storing a row.

    Two passes over the scan: the first counts the rows of every split and notes the id its
    first row has in the scan (partition, place); the second adds a split's offset to a row's
    place in it.  Offsets have one row per split and are broadcast.  A scan that is cut otherwise in the
    second pass finds no offset and stops.  A source without files (a Python data source) is
    numbered in the order of its partitions.
    """
    try:
        where = df.select("*", F.col("_metadata.file_path").alias("_no_file"), F.col("_metadata.file_block_start").alias("_no_block"))
    except AnalysisException:
        where = df.select("*", F.lit("").alias("_no_file"), F.spark_partition_id().cast("long").alias("_no_block"))
    key = ["_no_file", "_no_block", "_no_pid"]
    tagged = where.select("*", F.spark_partition_id().alias("_no_pid"), F.monotonically_increasing_id().alias("_no_mid"))
    splits = tagged.groupBy(*key).agg(F.count(F.lit(1)).alias("_no_n"), F.min("_no_mid").alias("_no_first"))
    before = Window.orderBy("_no_file", "_no_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(*[F.col(c).alias(c + "2") for c in key], "_no_first", F.coalesce(F.sum("_no_n").over(before), F.lit(0)).alias("_no_off"))
    same = (F.col("_no_file") == F.col("_no_file2")) & (F.col("_no_block") == F.col("_no_block2")) & (F.col("_no_pid") == F.col("_no_pid2"))
    no = F.col("_no_off") + F.col("_no_mid") - F.col("_no_first") + F.lit(start)
    stop = F.raise_error(F.lit("the scan was cut differently in its second pass")).cast("long")
    return (tagged.join(F.broadcast(offsets), same, "left")  # one row per split of the scan
                  .withColumn(name, F.coalesce(no, stop).cast("long")).select(*df.columns, name))


def prefix_sum(df: DataFrame, group_cols: list[str], order_cols, value_col: str,
               out: str = "cum_before", num_partitions: int | None = None) -> DataFrame:
    """Append ``out`` = sum of ``value_col`` over rows of the same group that come
    strictly earlier in ``order_cols`` order (see ``prefix_sums``)."""
    return prefix_sums(df, group_cols, order_cols, {out: value_col}, num_partitions)


def prefix_sums(df: DataFrame, group_cols: list[str], order_cols, sums: dict[str, str],
                num_partitions: int | None = None, totals: dict[str, str] | None = None) -> DataFrame:
    """Append, for every (out, value column) of ``sums``, the sum of the value over rows of
    the same group that come strictly earlier in ``order_cols`` order; for every (out, value
    column) of ``totals``, the sum over the whole group (few groups only: one row per group
    is broadcast).

    The data is range-partitioned on (group, order), so every (partition, group)
    slice is bounded by the partition size.  The running sum inside a slice is a
    window over that slice only.  A group that began in an earlier partition is the
    first of its partition, so at most one slice per partition has an offset: the sum of
    the group's totals before it.  Nothing runs in Python.
    """
    order = _cols(order_cols)
    keys = [F.col(c) for c in group_cols] + order
    n = _n_partitions(df, num_partitions)
    values = list(dict.fromkeys([*sums.values(), *(totals or {}).values()]))
    ranged = df.repartitionByRange(n, *keys).withColumn("_ps_pid", F.spark_partition_id())
    in_slice = (Window.partitionBy("_ps_pid", *group_cols).orderBy(*order)
                      .rowsBetween(Window.unboundedPreceding, -1))
    local = cut_lineage(ranged.withColumns({f"_ps_local_{o}": F.coalesce(F.sum(v).over(in_slice), F.lit(0)).cast("long") for o, v in sums.items()}))

    slices = local.groupBy("_ps_pid", *group_cols).agg(*[F.sum(v).cast("long").alias(f"_ps_tot_{v}") for v in values])
    before = Window.partitionBy(*group_cols).orderBy("_ps_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(F.col("_ps_pid").alias("_ps_pid2"), *[F.col(c).alias(f"_ps_{c}") for c in group_cols],
                            F.count(F.lit(1)).over(before).alias("_ps_earlier"),
                            *[F.sum(f"_ps_tot_{v}").over(before).cast("long").alias(f"_ps_off_{o}") for o, v in sums.items()])
    offsets = offsets.filter("_ps_earlier > 0").drop("_ps_earlier")
    same = F.col("_ps_pid") == F.col("_ps_pid2")
    for c in group_cols:
        same = same & F.col(c).eqNullSafe(F.col(f"_ps_{c}"))
    out = (local.join(F.broadcast(offsets), same, "left")  # one row per partition at most
                .withColumns({o: F.coalesce(f"_ps_off_{o}", F.lit(0)) + F.col(f"_ps_local_{o}") for o in sums})
                .drop("_ps_pid", "_ps_pid2", *[f"_ps_{c}" for c in group_cols], *[f"_ps_local_{o}" for o in sums], *[f"_ps_off_{o}" for o in sums]))
    if totals:
        whole = slices.groupBy(*[F.col(c).alias(f"_ps_{c}") for c in group_cols]).agg(*[F.sum(f"_ps_tot_{v}").cast("long").alias(o) for o, v in totals.items()])
        in_group = F.lit(True)
        for c in group_cols:
            in_group = in_group & F.col(c).eqNullSafe(F.col(f"_ps_{c}"))
        out = out.join(F.broadcast(whole), in_group).drop(*[f"_ps_{c}" for c in group_cols])
    return out
