"""Exact-size seeded splits and shuffles.

Rows are ordered by ``md5(key || '#' || seed)`` (the same order on any engine).  A shuffle as a
column (T3) is numbered globally with the range-partitioned ``with_row_number``.  A split
needs no numbers: ``selection.places`` finds the n-th row of the order (per stratum) by
counting, and every row is labelled where it lies by comparing itself with that row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import with_row_number
from .selection import places, up_to


def seeded_key(key: str | Column, seed: int) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(k.cast("string"), F.lit("#" + str(seed))))


def seeded_order(df: DataFrame, key: str, seed: int = 42, name: str = "position",
                 num_partitions: int | None = None, total: str | None = None) -> DataFrame:
    """Seeded shuffle, materialised as a position column."""
    return with_row_number(df, [seeded_key(key, seed), F.col(key)], name=name, num_partitions=num_partitions,
                           total=total)


def sample_size(n: int, fraction: float, rule: str) -> int:
    """T4 ``round`` (pandas ``sample(frac)``: Python round, half to even);
    T5 ``ceil`` (test share of ``train_test_split``)."""
    if rule == "round":
        return int(round(fraction * n))
    if rule == "ceil":
        return int(math.ceil(fraction * n))
    raise ValueError(rule)


def _labelled(df: DataFrame, key: str, seed: int, found: dict, stratum: str | None, drawn: str, rest: str,
              num_partitions: int | None) -> DataFrame:
    """``df`` with split: every row compares itself with its stratum's place.  Only where rows of
    one key are to be told apart (some of the equal rows at the place are drawn) are these
    rows numbered."""
    order, k, kind = seeded_key(key, seed), F.col(key), df.schema[key].dataType
    taken, tied = F.lit(False), F.lit(False)
    ties = []
    for s, place in found.items():
        mine = F.lit(True) if stratum is None else F.col(stratum) == F.lit(s)
        before, at = up_to(place, order, k, kind)
        if place.needed in (0, place.equal):
            taken = taken | (mine & (before | at))
        else:
            taken, tied = taken | (mine & before), tied | (mine & at)
            ties.append((mine & at, place.needed))
    label = F.when(taken, F.lit(drawn)).otherwise(F.lit(rest))
    if not ties:
        return df.withColumn("split", label)
    out = df.where(~F.coalesce(tied, F.lit(False))).withColumn("split", label)
    for rows, needed in ties:
        # which of several rows of one key are drawn follows their place in the scan
        numbered = with_row_number(df.where(rows).withColumn("_at", F.monotonically_increasing_id()), ["_at"], name="_pos", num_partitions=num_partitions)
        out = out.unionByName(numbered.withColumn("split", F.when(F.col("_pos") <= needed, F.lit(drawn)).otherwise(F.lit(rest))).drop("_pos", "_at"))
    return out


def split_exact(df: DataFrame, key: str, fraction: float, seed: int = 42, rule: str = "round",
                drawn: str = "train", rest: str = "test", num_partitions: int | None = None) -> DataFrame:
    """T4/T5 + J7 / U5: the first n rows of the seeded order get ``drawn``, all others
    ``rest`` (the complement is a label, not a second anti-join scan).  Rows stay where they
    are; ``df`` is read once more for each histogram, its key only."""
    found = places(df, seeded_key(key, seed), F.col(key), lambda _, n: sample_size(n, fraction, rule))
    return _labelled(df, key, seed, found, None, drawn, rest, num_partitions)


def split_stratified(df: DataFrame, key: str, stratum: Column, fractions: dict[str, float],
                     seed: int = 42, rule: str = "ceil", drawn: str = "test", rest: str = "train",
                     num_partitions: int | None = None) -> DataFrame:
    """T6 + U1: per stratum, the first ceil(f * n_stratum) rows of the seeded order are
    ``drawn``.  Rows whose stratum is NULL belong to no stratum and are dropped (F2); a
    stratum without a configured fraction stops the job.  The strata are selected from
    together, by the same scans."""
    d = df.withColumn("stratum", stratum).where(F.col("stratum").isNotNull())

    def take(s, n):
        if s not in fractions:
            raise ValueError(f"no fraction given for stratum {s}")
        return sample_size(n, fractions[s], rule)

    found = places(d, seeded_key(key, seed), F.col(key), take, F.col("stratum"))
    return _labelled(d, key, seed, found, "stratum", drawn, rest, num_partitions)


def split_sizes(split: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """Row counts of splits (and strata)."""
    return split.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
