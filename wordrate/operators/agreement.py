"""Agreement statistics between estimates and human ratings.

Every statistic is an aggregation with partial (map-side) combining.  Constant-size
facts (min, max, SD, n) are collected to the driver only where a second pass needs
them as literals (histogram edges, hexagon grid, density grid).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import cut_lineage
from .comoments import value_and_rank_moments, value_moments


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- A1-A6, X23 -------------------------------------------------------------------

def error_columns(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Signed error (pred - truth) and absolute error."""
    e = _c(pred) - _c(truth)
    return df.withColumn("error", e).withColumn("absolute_error", F.abs(e))


def error_metrics(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """A1 MAE, A2 bias, A3 SD of errors (n-1), A4 RMSE, A5 R^2 (1 - SSres/SStot,
    SStot = 0 gives 1 or 0 as scikit-learn does), A6 joint min / max.
    Rows with either value missing are left out."""
    t, p = _c(truth), _c(pred)
    d = df.where(t.isNotNull() & p.isNotNull() & ~F.isnan(t) & ~F.isnan(p))
    e = p - t
    ss_res = F.sum(e * e)
    ss_tot = F.var_pop(t) * F.count(F.lit(1))
    r2 = (F.when(ss_tot > 0, F.lit(1.0) - ss_res / ss_tot)
           .when(ss_res == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e).alias("bias"),
        F.stddev_samp(e).alias("sd_error"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        r2.alias("r2"),
        F.least(F.min(t), F.min(p)).alias("min_val"),
        F.greatest(F.max(t), F.max(p)).alias("max_val"),
    )


# --- A7-A9 ------------------------------------------------------------------------

def pearson_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson for every column pair, both orders; NULL when either
    side is constant.  One scan; each task gives a co-moment matrix, merged in a tree."""
    return value_moments(df, columns).select("col_x", "col_y", F.col("pearson").alias("r"), "n")


def spearman_matrix(df: DataFrame, columns: Sequence[str], num_partitions: int | None = None) -> DataFrame:
    """Pearson of average ranks computed within each pair's complete rows.  Ranks of all
    partners come from one prefix sum over (column, value)."""
    return value_and_rank_moments(df, columns, num_partitions).select("col_x", "col_y", F.col("spearman").alias("r"), "n")


def _placed(cells: DataFrame, columns: Sequence[str], upper: str, lower: str) -> DataFrame:
    order = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
    i, k = order[F.col("col_x")], order[F.col("col_y")]
    r = F.when(i < k, F.col(upper)).when(i > k, F.col(lower))
    return cells.select("col_x", "col_y", r.alias("r"), X.cell_label(r).alias("label"))


def combined_matrix(upper: DataFrame, lower: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A9 + X24: cell (i, j) from ``upper`` when i < j, from ``lower`` when i > j,
    missing on the diagonal; label is two decimals or '-'."""
    u = upper.select("col_x", "col_y", F.col("r").alias("r_up"))
    lo = lower.select("col_x", "col_y", F.col("r").alias("r_lo"))
    return _placed(u.join(lo, ["col_x", "col_y"], "full_outer"), columns, "r_up", "r_lo")


def combined_correlations(df: DataFrame, columns: Sequence[str], num_partitions: int | None = None) -> DataFrame:
    """A7 + A8 + A9: ``combined_matrix`` of a table's Pearson (above the diagonal) and Spearman
    (below), both taken by the same scan."""
    return _placed(value_and_rank_moments(df, columns, num_partitions), columns, "pearson", "spearman")


# --- A10-A12 ----------------------------------------------------------------------

def histogram(df: DataFrame, column: str, bins: int = 100) -> DataFrame:
    """A10: equal-width bins over [min, max]; the last bin is closed.  Bin membership
    is decided against the edges ``min + k*(max-min)/bins`` (numpy's rule), so values
    on an edge land where numpy puts them.  All bins are returned, empty ones with 0."""
    x = F.col(column).cast("double")
    stats = df.where(x.isNotNull() & ~F.isnan(x)).agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    lo, hi = stats["lo"], stats["hi"]
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, lower double, upper double, count long")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    step = (hi - lo) / bins

    def edge(k: Column) -> Column:
        return F.when(k >= bins, F.lit(hi)).otherwise(F.lit(lo) + k.cast("double") * F.lit(step))

    k0 = F.least(F.floor((x - F.lit(lo)) * F.lit(bins / (hi - lo))).cast("int"), F.lit(bins - 1))
    v = df.where(x.isNotNull() & ~F.isnan(x)).select(x.alias("x"), k0.alias("k0"))
    v = v.select("x", F.when(F.col("x") < edge(F.col("k0")), F.col("k0") - 1).otherwise(F.col("k0")).alias("k1"))
    k2 = F.when((F.col("x") >= edge(F.col("k1") + 1)) & (F.col("k1") != bins - 1), F.col("k1") + 1).otherwise(F.col("k1"))
    counts = v.select(k2.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    all_bins = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (all_bins.join(counts, "bin", "left")  # <= bins rows on both sides
                    .select((F.col("bin") + 1).alias("bin"), edge(F.col("bin")).alias("lower"),
                            edge(F.col("bin") + 1).alias("upper"),
                            F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def _nonsingular(lo: float, hi: float, expander: float = 0.1) -> tuple[float, float]:
    if hi - lo <= max(abs(lo), abs(hi)) * 1e-15 * 2:
        if lo == 0 and hi == 0:
            return -expander, expander
        return lo - expander * abs(lo), hi + expander * abs(hi)
    return lo, hi


def hexbin(df: DataFrame, x: str, y: str, gridsize: int = 30) -> DataFrame:
    """Hexagonal cell counts (matplotlib's lattice rule), non-empty cells only.

    Two offset rectangular lattices; a point goes to the nearer centre by
    du^2 + 3 dv^2 (ties to the second lattice).  One aggregation by cell."""
    xc, yc = F.col(x).cast("double"), F.col(y).cast("double")
    ok = xc.isNotNull() & yc.isNotNull() & ~F.isnan(xc) & ~F.isnan(yc)
    s = df.where(ok).agg(F.min(xc).alias("x0"), F.max(xc).alias("x1"),
                         F.min(yc).alias("y0"), F.max(yc).alias("y1")).first()
    if s["x0"] is None:
        return df.sparkSession.createDataFrame([], "lattice int, i int, j int, cx double, cy double, count long")
    nx = gridsize
    ny = int(nx / math.sqrt(3))
    xmin, xmax = _nonsingular(s["x0"], s["x1"])
    ymin, ymax = _nonsingular(s["y0"], s["y1"])
    pad = 1e-9 * (xmax - xmin)
    xmin, xmax = xmin - pad, xmax + pad
    sx, sy = (xmax - xmin) / nx, (ymax - ymin) / ny
    # Staged projections: each intermediate is computed once per row (a nested single
    # expression would repeat the lattice arithmetic many times over).
    pts = df.where(ok).select(((xc - F.lit(xmin)) / F.lit(sx)).alias("ix"), ((yc - F.lit(ymin)) / F.lit(sy)).alias("iy"))
    pts = pts.select("ix", "iy", F.rint("ix").alias("ix1"), F.rint("iy").alias("iy1"),
                     F.floor("ix").cast("double").alias("ix2"), F.floor("iy").cast("double").alias("iy2"))
    pts = pts.select("ix1", "iy1", "ix2", "iy2", (F.col("ix") - F.col("ix1")).alias("u1"),
                     (F.col("iy") - F.col("iy1")).alias("v1"), (F.col("ix") - F.col("ix2") - 0.5).alias("u2"),
                     (F.col("iy") - F.col("iy2") - 0.5).alias("v2"))
    d1 = F.col("u1") * F.col("u1") + 3.0 * F.col("v1") * F.col("v1")
    d2 = F.col("u2") * F.col("u2") + 3.0 * F.col("v2") * F.col("v2")
    pts = pts.select("ix1", "iy1", "ix2", "iy2", (d1 < d2).alias("first"))
    pts = pts.select(F.when(F.col("first"), 1).otherwise(2).alias("lattice"),
                     F.when(F.col("first"), F.col("ix1")).otherwise(F.col("ix2")).cast("int").alias("i"),
                     F.when(F.col("first"), F.col("iy1")).otherwise(F.col("iy2")).cast("int").alias("j"))
    lat1 = F.col("lattice") == 1
    inside = F.when(lat1, (F.col("i") >= 0) & (F.col("i") <= nx) & (F.col("j") >= 0) & (F.col("j") <= ny)).otherwise(
        (F.col("i") >= 0) & (F.col("i") < nx) & (F.col("j") >= 0) & (F.col("j") < ny))
    # Cells outside of the lattice (points beyond its border cells) are no cells of the plot.
    # The counted cells, at most a few thousand, are stored, so the test runs once per cell.
    cells = cut_lineage(pts.groupBy("lattice", "i", "j").agg(F.count(F.lit(1)).alias("count"))).where(inside)
    off = F.when(F.col("lattice") == 2, F.lit(0.5)).otherwise(F.lit(0.0))
    return cells.select("lattice", "i", "j",
                        (F.lit(xmin) + F.lit(sx) * (F.col("i") + off)).alias("cx"),
                        (F.lit(ymin) + F.lit(sy) * (F.col("j") + off)).alias("cy"), "count")


def error_density(df: DataFrame, column: str, gridsize: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density of a column on a grid (Scott bandwidth n^(-1/5)*SD,
    grid over [min - cut*bw, max + cut*bw]); kernel sums aggregated by grid point."""
    v = F.col(column).cast("double")
    d = df.where(v.isNotNull() & ~F.isnan(v))
    s = d.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(v).alias("sd"),
              F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    n = s["n"]
    if not n or s["sd"] is None or s["sd"] == 0:
        return df.sparkSession.createDataFrame([], "point int, x double, density double")
    bw = n ** (-1.0 / 5.0) * s["sd"]
    gmin, gmax = s["lo"] - bw * cut, s["hi"] + bw * cut
    step = (gmax - gmin) / (gridsize - 1)
    grid = [gmin + k * step for k in range(gridsize - 1)] + [gmax]
    # Equal values are counted first; a task then adds up all grid points of its values
    # at once, so no row is multiplied and gridsize rows leave a task.
    values = d.groupBy(v.alias("v")).agg(F.count(F.lit(1)).cast("double").alias("w"))

    def kernel_sums(batches):
        at, total = np.array(grid), np.zeros(len(grid))
        for batch in batches:
            x, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for start in range(0, len(x), 4096):
                z = (at[None, :] - x[start:start + 4096, None]) / bw
                total += w[start:start + 4096] @ np.exp(-0.5 * z * z)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(grid)), pa.int32()), pa.array(at), pa.array(total)], names=["point", "x", "s"])

    sums = values.mapInArrow(kernel_sums, "point int, x double, s double").groupBy("point", "x").agg(F.sum("s").alias("s"))
    norm = 1.0 / (n * bw * math.sqrt(2 * math.pi))
    return sums.select("point", "x", (F.col("s") * F.lit(norm)).alias("density"))
