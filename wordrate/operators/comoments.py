"""Pairwise-complete correlation matrices from mergeable states, without a row per pair.

A state holds, for every column pair (i, j) over the rows where both are present, how many
they are and what column i does there: mean, sum of squared deviations, sum of co-deviations
with j, least and greatest value.  Each task reads its rows once, in Arrow batches, and gives
one state; states are merged in a tree of tasks (two states merge exactly as their rows
would), so a scan and a few kilobytes per task are all a Pearson matrix costs.

Rank correlations take the same way once every value has its ranks.  The average rank of a
value of column i depends on the partner j only through the rows where j is missing, so one
stacked table (column, value) with a count per partner, summed up in value order, gives the
ranks for all partners at once.  Its measured size decides how they get to the rows: broadcast
as sorted arrays and looked up, or, beyond the bound, joined to the stacked rows and put together
by row.

NaN and null are missing.  Infinite values have ranks; a Pearson cell with one is NaN.  A cell is
null where either column has one value only in the pair's rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .numbering import prefix_sums

#: Bytes of ranks (values and their ranks for every partner) that are broadcast.
RANK_BYTES = 32 << 20
_WAYS = 64
_CELLS = "col_x string, col_y string, pearson double, spearman double, n long"


# --- states: arrays [part, i, j] -----------------------------------------------------------

_N, _ALL, _MEAN, _SQ, _CO, _LO, _HI, _RSQ, _RCO = range(9)


def _zero(k: int) -> np.ndarray:
    s = np.zeros((9, k, k))
    s[_LO], s[_HI] = np.inf, -np.inf
    return s


def _of_rows(x: np.ndarray) -> np.ndarray:
    """The state of a block of rows."""
    k = x.shape[1]
    out = _zero(k)
    there = ~np.isnan(x)
    ok = np.isfinite(x)
    out[_ALL] = there.T.astype(float) @ there.astype(float)
    # deviations from a value of the column: exact for a constant, small for the others
    shift = np.array([np.median(x[ok[:, i], i]) if ok[:, i].any() else 0.0 for i in range(k)])
    m = ok.astype(float)
    d = np.where(ok, x - shift, 0.0)
    n, s = m.T @ m, d.T @ m
    mean = np.divide(s, n, out=np.zeros_like(s), where=n > 0)
    out[_N] = n
    out[_MEAN] = shift[:, None] + mean
    out[_SQ] = np.maximum((d * d).T @ m - s * mean, 0.0)
    out[_CO] = d.T @ d - s * mean.T
    for j in range(k):
        rows = x if ok[:, j].all() else x[ok[:, j]]
        seen = np.isfinite(rows)
        out[_LO, :, j] = np.where(seen, rows, np.inf).min(axis=0, initial=np.inf)
        out[_HI, :, j] = np.where(seen, rows, -np.inf).max(axis=0, initial=-np.inf)
    return out


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a + b
    out[_LO], out[_HI] = np.minimum(a[_LO], b[_LO]), np.maximum(a[_HI], b[_HI])
    n = out[_N]
    share = np.divide(b[_N], n, out=np.zeros_like(n), where=n > 0)
    delta = np.where((a[_N] > 0) & (b[_N] > 0), b[_MEAN] - a[_MEAN], 0.0)
    out[_MEAN] = np.where(a[_N] > 0, a[_MEAN], b[_MEAN]) + delta * share
    w = a[_N] * share
    out[_SQ] += delta * delta * w
    out[_CO] += delta * delta.T * w
    return out


def _cells(state: np.ndarray, columns: Sequence[str]) -> pa.RecordBatch:
    k = len(columns)
    wide = state[_LO] < state[_HI]
    with np.errstate(all="ignore"):
        r = state[_CO] / np.sqrt(state[_SQ] * state[_SQ].T)
        ranked = state[_RCO] / np.sqrt(state[_RSQ] * state[_RSQ].T)
    bad = state[_N] < state[_ALL]  # an infinite value
    pearson = np.where(bad, np.nan, r).ravel()
    gone = (~bad & ~(wide & wide.T & (state[_SQ] * state[_SQ].T > 0))).ravel()
    spearman = np.where(np.eye(k, dtype=bool), 1.0, ranked).ravel()
    x, y = np.repeat(columns, k), np.tile(columns, k)
    return pa.RecordBatch.from_arrays(
        [pa.array(x, pa.string()), pa.array(y, pa.string()), pa.array(pearson, mask=gone),
         pa.array(spearman, mask=~((state[_RSQ] * state[_RSQ].T) > 0).ravel()), pa.array(state[_ALL].ravel().astype(np.int64))],
        names=["col_x", "col_y", "pearson", "spearman", "n"])


# --- one state a task, a tree of merges ----------------------------------------------------

def _values(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64, copy=False) for i in range(k)])


def _merging(k):
    def run(batches: Iterable[pa.RecordBatch]):
        total = _zero(k)
        for batch in batches:
            for raw in batch.column(0):
                total = _merged(total, np.frombuffer(raw.as_py()).reshape(9, k, k))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["state"])
    return run


def _matrix(states: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(col_x, col_y, pearson, spearman, n) of all pairs from the tasks' states."""
    k, columns = len(columns), list(columns)
    none = states.sparkSession.createDataFrame([(_zero(k).tobytes(),)], "state binary")  # an empty table has a matrix too
    some = states.withColumn("way", F.spark_partition_id() % _WAYS).repartition("way").select("state").mapInArrow(_merging(k), "state binary")

    def run(batches):
        for batch in _merging(k)(batches):
            yield _cells(np.frombuffer(batch.column(0)[0].as_py()).reshape(9, k, k), columns)

    return some.unionByName(none).repartition(1).mapInArrow(run, _CELLS)  # one state per way at most


def _doubles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])


def value_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One scan: col_x, col_y, pearson, n for every pair of columns (spearman stays null)."""
    k = len(columns)

    def run(batches):
        total = _zero(k)
        for batch in batches:
            total = _merged(total, _of_rows(_values(batch, k)))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["state"])

    return _matrix(_doubles(df, columns).mapInArrow(run, "state binary"), columns)


# --- ranks ---------------------------------------------------------------------------------

def _ranks(rows: DataFrame, k: int, num_partitions: int | None) -> DataFrame:
    """col, v, c: a value's average rank among the rows where partner j is present too, less the
    mean rank, for every partner j."""
    there = [F.col(f"x{i}").isNotNull() & ~F.isnan(f"x{i}") for i in range(k)]
    masks = [_sum(F.when(there[j], F.lit(1 << (j - low)).cast("long")).otherwise(F.lit(0).cast("long")) for j in range(low, min(low + 62, k)))
             for low in range(0, k, 62)]
    marked = rows.select(*[f"x{i}" for i in range(k)], *[m.alias(f"m{b}") for b, m in enumerate(masks)])
    values = F.array(*[F.struct(F.lit(i).alias("col"), F.col(f"x{i}").alias("v")) for i in range(k)])
    stacked = marked.select(F.explode(values).alias("s"), *[f"m{b}" for b in range(len(masks))]).select("s.*", *[f"m{b}" for b in range(len(masks))])
    stacked = stacked.where(F.col("v").isNotNull() & ~F.isnan("v"))
    # rows per (column, value, which cells are there), then per partner
    combos = stacked.groupBy("col", "v", *[f"m{b}" for b in range(len(masks))]).agg(F.count(F.lit(1)).alias("w"))
    counts = combos.groupBy("col", "v").agg(*[
        F.sum(F.col("w") * F.getbit(F.col(f"m{j // 62}"), F.lit(j % 62))).alias(f"n{j}") for j in range(k)])
    before = prefix_sums(counts, ["col"], ["v"], {f"b{j}": f"n{j}" for j in range(k)}, num_partitions, totals={f"t{j}": f"n{j}" for j in range(k)})
    rank = F.array(*[F.when(F.col(f"n{j}") > 0, F.col(f"b{j}") + (F.col(f"n{j}") - F.col(f"t{j}")) / 2.0).otherwise(0.0) for j in range(k)])
    return before.select("col", "v", rank.alias("c"))


def _sum(columns: Iterable[Column]) -> Column:
    out = None
    for c in columns:
        out = c if out is None else out + c
    return out


def _pieces(batch: pa.RecordBatch, k: int) -> Iterable[pa.RecordBatch]:
    """Slices whose rows' ranks for all pairs fill some 32 MB at most."""
    step = max(1, (4 << 20) // (k * k))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def _ranked(state: np.ndarray, ranks: np.ndarray, there: np.ndarray) -> np.ndarray:
    """A state with rows' centred ranks [row, i, j] added."""
    both = there[:, :, None] & there[:, None, :]
    c = np.where(both, ranks, 0.0)
    state[_RSQ] += (c * c).sum(axis=0)
    state[_RCO] += (c * c.transpose(0, 2, 1)).sum(axis=0)
    return state


def _looked_up(rows: DataFrame, ranks: DataFrame, k: int) -> DataFrame:
    """States of value moments and ranks, the ranks from a broadcast of bounded size."""
    tables = [(np.zeros(0), np.zeros((0, k)))] * k
    found = ranks.toArrow()
    col = found.column("col").to_numpy()
    v = found.column("v").to_numpy()
    c = found.column("c").combine_chunks().flatten().to_numpy().reshape(-1, k) if found.num_rows else np.zeros((0, k))
    for i in range(k):
        at = np.flatnonzero(col == i)
        at = at[np.argsort(v[at], kind="stable")]
        tables[i] = (v[at], c[at])
    sent = rows.sparkSession.sparkContext.broadcast(tables)

    def run(batches):
        known, total = sent.value, _zero(k)
        for batch in batches:
            for piece in _pieces(batch, k):
                x = _values(piece, k)
                ranks = np.zeros((len(x), k, k))
                for i, (values, rank) in enumerate(known):
                    if len(values):
                        ranks[:, i, :] = rank[np.minimum(np.searchsorted(values, x[:, i]), len(values) - 1)]
                total = _merged(total, _ranked(_of_rows(x), ranks, ~np.isnan(x)))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["state"])

    return rows.mapInArrow(run, "state binary")


def _joined(rows: DataFrame, ranks: DataFrame, k: int) -> DataFrame:
    """The same states, the ranks joined to the stacked cells (a value of very many rows is split
    by the skew join) and put together by row."""
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))
    cells = rows.select("row", F.posexplode(F.array(*[f"x{i}" for i in range(k)])).alias("col", "v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    found = cells.join(ranks, ["col", "v"]).groupBy("row").agg(F.collect_list(F.struct("col", "v", "c")).alias("cells"))  # k at most

    def run(batches):
        total = _zero(k)
        for batch in batches:
            for piece in _pieces(batch, k):
                cells, n = piece.column(0), piece.num_rows
                x, ranks = np.full((n, k), np.nan), np.zeros((n, k, k))
                flat = cells.flatten()
                row, col = np.repeat(np.arange(n), cells.value_lengths().to_numpy()), flat.field("col").to_numpy()
                x[row, col] = flat.field("v").to_numpy()
                ranks[row, col] = flat.field("c").flatten().to_numpy().reshape(-1, k)
                total = _merged(total, _ranked(_of_rows(x), ranks, ~np.isnan(x)))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["state"])

    return found.select("cells").mapInArrow(run, "state binary")


def value_and_rank_moments(df: DataFrame, columns: Sequence[str], num_partitions: int | None = None, rank_bytes: int | None = None) -> DataFrame:
    """col_x, col_y, pearson, spearman, n for every pair: one scan counts the values, one more takes
    both kinds of moments."""
    k = len(columns)
    rows = _doubles(df, columns)
    ranks = cut_lineage(_ranks(rows, k, num_partitions))
    small = ranks.count() * 8 * (k + 2) <= (RANK_BYTES if rank_bytes is None else rank_bytes)
    return _matrix(_looked_up(rows, ranks, k) if small else _joined(rows, ranks, k), columns)
