"""Queries: agreement statistics."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agreement as AG
from . import derive as D
from .registry import query, r6

_WORDS = r"[^ \t\n\r]+"


def _doc_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = D.read(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", (F.col("n_chars") / 100.0).alias("truth"),
                       (F.regexp_count("text", F.lit(_WORDS)) / 15.0).alias("pred"))


_DOC_SQL = r"""
WITH d AS (SELECT doc_id, lang, n_chars / 100.0 AS truth,
                  len(regexp_extract_all(text, '[^ \t\n\r]+')) / 15.0 AS pred FROM documents),
e AS (SELECT *, pred - truth AS e FROM d)
"""
_METRICS_SQL = """count(*) AS n, round(avg(abs(e)), 6) AS mae, round(avg(e), 6) AS bias,
       round(stddev_samp(e), 6) AS sd_error, round(sqrt(avg(e * e)), 6) AS rmse,
       round(CASE WHEN var_pop(truth) * count(*) > 0 THEN 1 - sum(e * e) / (var_pop(truth) * count(*))
                  WHEN sum(e * e) = 0 THEN 1.0 ELSE 0.0 END, 6) AS r2,
       round(least(min(truth), min(pred)), 6) AS min_val, round(greatest(max(truth), max(pred)), 6) AS max_val"""


def _round_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, "n", *[r6(c).alias(c) for c in
                                   ("mae", "bias", "sd_error", "rmse", "r2", "min_val", "max_val")])


@query("error_metrics", sql=_DOC_SQL + "SELECT " + _METRICS_SQL + " FROM e")
def error_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X23 + A1-A6 over all documents (truth: characters/100, estimate: words/15)."""
    return _round_metrics(AG.error_metrics(_doc_ratings(spark, sf_dir), "truth", "pred"), [])


@query("error_metrics_by", sql=_DOC_SQL + "SELECT lang, " + _METRICS_SQL + " FROM e GROUP BY lang")
def error_metrics_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same statistics per language (the optional ``by`` keys)."""
    return _round_metrics(AG.error_metrics(_doc_ratings(spark, sf_dir), "truth", "pred", by=["lang"]), ["lang"])


COLS = ["quantity", "price", "discount", "tax", "constant"]
_BASE_SQL = """base AS (
  SELECT l_quantity AS quantity, l_extendedprice AS price,
         CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END AS discount,
         CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_tax END AS tax,
         1.0::DOUBLE AS constant
  FROM lineitem)"""


def _matrix_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = D.read(spark, sf_dir, "lineitem")
    return li.select(F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
                     F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("discount"),
                     F.when(F.col("l_returnflag") != "R", F.col("l_tax")).alias("tax"),
                     F.lit(1.0).alias("constant"))


def _pair_sql(x: str, y: str, spearman: bool) -> str:
    if spearman:
        src = (f"(SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS a, "
               f"rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS b "
               f"FROM (SELECT {x} AS a, {y} AS b FROM base WHERE {x} IS NOT NULL AND {y} IS NOT NULL))")
    else:
        src = f"(SELECT {x} AS a, {y} AS b FROM base WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    body = ("covar_pop(a, b) / CASE WHEN stddev_pop(a) * stddev_pop(b) > 0 "
            "THEN stddev_pop(a) * stddev_pop(b) END")
    out = []
    for cx, cy in ((x, y), (y, x)) if x != y else ((x, y),):
        out.append(f"SELECT '{cx}' AS col_x, '{cy}' AS col_y, {body} AS r, count(*) AS n FROM {src}")
    return "\nUNION ALL\n".join(out)


def _matrix_sql(spearman: bool) -> str:
    parts = [_pair_sql(x, y, spearman) for x, y in combinations_with_replacement(COLS, 2)]
    return "WITH " + _BASE_SQL + ",\nm AS (" + "\nUNION ALL\n".join(parts) + ")\n"


@query("pearson_matrix", sql=_matrix_sql(False) + "SELECT col_x, col_y, round(r, 6) AS r, n FROM m")
def pearson_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairwise-complete Pearson for every column pair (one pass, mergeable co-moments);
    the constant column gives missing correlations."""
    m = AG.pearson_matrix(_matrix_input(spark, sf_dir), COLS)
    return m.select("col_x", "col_y", r6("r").alias("r"), "n")


@query("spearman_matrix", sql=_matrix_sql(True) + "SELECT col_x, col_y, round(r, 6) AS r, n FROM m")
def spearman_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average ranks within each pair's complete rows, then Pearson."""
    m = AG.spearman_matrix(_matrix_input(spark, sf_dir), COLS)
    return m.select("col_x", "col_y", r6("r").alias("r"), "n")


_ORDER_SQL = "CASE {c} " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(COLS)) + " END"


@query("combined_matrix", sql="WITH " + _BASE_SQL + ",\n"
       + "p AS (" + "\nUNION ALL\n".join(_pair_sql(x, y, False) for x, y in combinations_with_replacement(COLS, 2))
       + "),\ns AS (" + "\nUNION ALL\n".join(_pair_sql(x, y, True) for x, y in combinations_with_replacement(COLS, 2))
       + "),\nc AS (SELECT p.col_x, p.col_y, CASE WHEN " + _ORDER_SQL.format(c="p.col_x") + " < "
       + _ORDER_SQL.format(c="p.col_y") + " THEN p.r WHEN " + _ORDER_SQL.format(c="p.col_x") + " > "
       + _ORDER_SQL.format(c="p.col_y") + " THEN s.r END AS r FROM p JOIN s ON p.col_x = s.col_x AND p.col_y = s.col_y)\n"
       + "SELECT col_x, col_y, round(r, 6) AS r, coalesce(printf('%.2f', r), '-') AS label FROM c")
def combined_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 + X24: Pearson above the diagonal, Spearman below, diagonal missing, 2-decimal labels."""
    c = AG.combined_correlations(_matrix_input(spark, sf_dir), COLS)
    return c.select("col_x", "col_y", r6("r").alias("r"), "label")


@query("histogram_100", sql="""
WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
k AS (SELECT o_totalprice AS x, lo, hi, (hi - lo) / 100 AS step,
             least(CAST(floor((o_totalprice - lo) * (100 / (hi - lo))) AS INTEGER), 99) AS k0
      FROM orders, s),
k1 AS (SELECT *, CASE WHEN x < CASE WHEN k0 >= 100 THEN hi ELSE lo + k0 * step END THEN k0 - 1 ELSE k0 END AS k1 FROM k),
k2 AS (SELECT *, CASE WHEN x >= CASE WHEN k1 + 1 >= 100 THEN hi ELSE lo + (k1 + 1) * step END AND k1 <> 99
                      THEN k1 + 1 ELSE k1 END AS bin FROM k1),
c AS (SELECT bin, count(*) AS cnt FROM k2 GROUP BY bin),
b AS (SELECT CAST(i AS INTEGER) AS bin FROM range(100) t(i))
SELECT b.bin + 1 AS bin,
       round(s.lo + b.bin * ((s.hi - s.lo) / 100), 6) AS lower,
       round(CASE WHEN b.bin + 1 >= 100 THEN s.hi ELSE s.lo + (b.bin + 1) * ((s.hi - s.lo) / 100) END, 6) AS upper,
       coalesce(c.cnt, 0) AS count
FROM b CROSS JOIN s LEFT JOIN c ON b.bin = c.bin""")
def histogram_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: 100 equal-width bins over [min, max] of order totals, last bin closed."""
    h = AG.histogram(D.read(spark, sf_dir, "orders"), "o_totalprice", 100)
    return h.select("bin", r6("lower").alias("lower"), r6("upper").alias("upper"), "count")


@query("hex_density", sql="""
WITH s AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0,
                  max(l_extendedprice) AS y1 FROM lineitem),
g AS (SELECT x0 - 1e-9 * (x1 - x0) AS xmin, (x1 + 1e-9 * (x1 - x0) - (x0 - 1e-9 * (x1 - x0))) / 30 AS sx,
             y0 AS ymin, (y1 - y0) / 17 AS sy FROM s),
p AS (SELECT (l_quantity - xmin) / sx AS ix, (l_extendedprice - ymin) / sy AS iy, xmin, sx, ymin, sy
      FROM lineitem, g),
q AS (SELECT *, round_even(ix, 0) AS ix1, round_even(iy, 0) AS iy1, floor(ix) AS ix2, floor(iy) AS iy2 FROM p),
r AS (SELECT *, (ix - ix1) * (ix - ix1) + 3.0 * (iy - iy1) * (iy - iy1)
                < (ix - ix2 - 0.5) * (ix - ix2 - 0.5) + 3.0 * (iy - iy2 - 0.5) * (iy - iy2 - 0.5) AS first FROM q),
c AS (SELECT CASE WHEN first THEN 1 ELSE 2 END AS lattice,
             CAST(CASE WHEN first THEN ix1 ELSE ix2 END AS INTEGER) AS i,
             CAST(CASE WHEN first THEN iy1 ELSE iy2 END AS INTEGER) AS j, xmin, sx, ymin, sy, first FROM r)
SELECT lattice, i, j,
       round(xmin + sx * (i + CASE WHEN lattice = 2 THEN 0.5 ELSE 0.0 END), 6) AS cx,
       round(ymin + sy * (j + CASE WHEN lattice = 2 THEN 0.5 ELSE 0.0 END), 6) AS cy,
       count(*) AS count
FROM c
WHERE CASE WHEN first THEN i BETWEEN 0 AND 30 AND j BETWEEN 0 AND 17 ELSE i BETWEEN 0 AND 29 AND j BETWEEN 0 AND 16 END
GROUP BY lattice, i, j, xmin, sx, ymin, sy""")
def hex_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hexagonal cell counts of (quantity, extended price), grid 30."""
    h = AG.hexbin(D.read(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", 30)
    return h.select("lattice", "i", "j", r6("cx").alias("cx"), r6("cy").alias("cy"), "count")


@query("error_density", sql="""
WITH d AS (SELECT value - user_id / 10.0 AS v FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL),
s AS (SELECT count(*) AS n, stddev_samp(v) AS sd, min(v) AS lo, max(v) AS hi FROM d),
b AS (SELECT n, pow(n, -1.0 / 5.0) * sd AS bw, lo, hi FROM s),
g AS (SELECT CAST(k AS INTEGER) AS point,
             CASE WHEN k = 199 THEN hi + bw * 3.0
                  ELSE (lo - bw * 3.0) + k * (((hi + bw * 3.0) - (lo - bw * 3.0)) / 199) END AS x, n, bw
      FROM range(200) t(k), b)
SELECT point, round(x, 6) AS x,
       round(sum(exp(-0.5 * pow((x - v) / bw, 2))) / (n * bw * sqrt(2 * pi())), 6) AS density
FROM g, d GROUP BY point, x, n, bw""")
def error_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussian kernel density of residuals (value - user_id/10) on a 200-point grid."""
    ev = D.read(spark, sf_dir, "events").select((F.col("value") - F.col("user_id") / 10.0).alias("v"))
    dens = AG.error_density(ev, "v", 200)
    return dens.select("point", r6("x").alias("x"), r6("density").alias("density"))
