"""Exact top-k by inner product, over vectors in falling order of length.

Vectors are rotated so that the leading coordinates carry most of the mass (the right
singular vectors of the table of directions, from its d x d Gram matrix).  Candidates are
dealt into blocks by falling length, and the blocks are worked off in waves, each four times as
long as the one before.  A query's threshold, its k-th best score so far, rises from wave to
wave: a block goes into a pair with a block of queries only while |longest query| * |longest
candidate| reaches the weakest threshold, which is decided on lengths alone, before any matrix
is joined.  Inside a pair the candidates are taken in chunks, longest first, and thresholds rise
from chunk to chunk: products of the leading coordinates plus the Cauchy-Schwarz bound
|query rest| * |candidate rest| rule candidates out before the rest is multiplied, and the
chunks end where |query| * |candidate| no longer reaches any threshold.  What is left is scored
exactly: sums below 2^52 are exact in doubles, larger ones are done in whole numbers.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordrate.session import cut_lineage

BLOCK = 4096  # candidates of a block
QUERIES = 1024  # queries of a block
BANDS = 256  # lengths that are told apart when blocks are dealt
LEAD = 16  # coordinates multiplied before the bound is tested
CHUNK = 512  # candidates of a block between two rises of the thresholds
GROWTH = 4  # blocks of a wave to those of the one before
SALT = 64  # query blocks that meet a copy of a candidate block
ROTATED = 2048  # coordinates up to which a rotation is worked out
_CELLS = BLOCK * 512  # numbers in a block; fewer rows, if vectors are longer
_WIDE = 10 ** 38 - 1


def quantised(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(vec_id, v, len) with v = floor(scale * x) per component, whole numbers as doubles, and
    their Euclidean length.  Vectors that are null or hold null or non-finite components, and
    rows without an id, go."""
    x = F.col(vec_col).cast("array<double>")
    usable = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    # a double of 2^53 or more is a whole number
    whole = lambda y: F.when(F.abs(y) < F.lit(2.0 ** 53), F.floor(y).cast("double")).otherwise(y)
    top = F.coalesce(F.array_max(F.transform("v", lambda c: F.abs(c))), F.lit(0.0))
    length = F.when(top > 0, top * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + (c / top) * (c / top)))).otherwise(F.lit(0.0))
    return (df.filter(F.col(id_col).isNotNull() & F.coalesce(usable, F.lit(False)))
            .select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: whole(c * F.lit(scale))).alias("v"))
            .withColumn("len", length))


def _padded(lists, d: int) -> np.ndarray:
    """Rows of ``d`` numbers; shorter vectors end in zeros."""
    out = np.zeros((len(lists), d))
    for row, v in zip(out, lists):
        row[:len(v)] = v
    return out


def _gram(d: int):
    """A task's part of the Gram matrix of the vectors' directions."""
    def run(batches):
        total = np.zeros((d, d))
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                m = _padded([x.values.to_numpy() for x in b.column(0)[at:at + BLOCK]], d)
                size = np.abs(m).max(axis=1, initial=0)
                m = m[size > 0] / size[size > 0, None]
                m /= np.linalg.norm(m, axis=1)[:, None]
                total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["g"])
    return run


def _added(d: int):
    def run(batches):
        total = np.zeros((d, d))
        for b in batches:
            for g in b.column(0):
                total += np.frombuffer(g.as_py()).reshape(d, d)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["g"])
    return run


def _rotation(v: DataFrame, d: int) -> np.ndarray:
    """Orthogonal columns, the heaviest direction first; the tasks' matrices are added up in a tree."""
    if d > ROTATED:
        return np.eye(d)
    parts = v.select("v").mapInArrow(_gram(d), "g binary")
    some = parts.withColumn("way", F.spark_partition_id() % 64).repartition("way").select("g").mapInArrow(_added(d), "g binary")
    whole = some.repartition(1).mapInArrow(_added(d), "g binary").collect()  # one d x d matrix
    gram = np.frombuffer(whole[0]["g"]).reshape(d, d) if whole else np.eye(d)
    return np.linalg.eigh(gram)[1][:, ::-1].copy()


def _packed(d: int):
    """One row for a block: its ids and matrix by falling length, and its largest length."""
    def run(key, group):
        import pandas as pd

        pdf = group.sort_values(["len", "vec_id"], ascending=[False, True])
        return pd.DataFrame({"block": [int(key[0])], "ids": [pdf["vec_id"].to_numpy("<i8").tobytes()], "m": [_padded(pdf["v"], d).tobytes()],
                             "top": [float(pdf["len"].max())]})
    return run


_BLOCK_SCHEMA = "block long, ids binary, m binary, top double"
_FOUND = "query_id long, vec_id long, score decimal(38,0)"


def _whole(a: np.ndarray, b: np.ndarray) -> int:
    return sum(int(x) * int(y) for x, y in zip(a.tolist(), b.tolist()) if x and y)


def _kept(query, score, ids, k):
    """Positions of each query's k best, ties to the smaller id, and its k-th score if there is one."""
    if score.dtype == object:
        order = np.array(sorted(range(len(score)), key=lambda i: (query[i], -score[i], ids[i])), np.int64)
    else:
        order = np.lexsort((ids, -score, query))
    q = query[order]
    start = np.searchsorted(q, q, side="left")
    rank = np.arange(len(q)) - start
    return order[rank < k], order[rank == k - 1]


def process(q, qi, c, ci, low, rotation, k):
    """The best ``k`` of a block of candidates ``c`` (rows by falling length, ids ``ci``) for each of
    the queries ``q`` (ids ``qi``) whose scores are not below ``low``: (query row, candidate id, score)
    and how many products were multiplied out."""
    low, lead = low.copy(), min(LEAD, q.shape[1])
    wide = max(np.abs(q).max(initial=0), np.abs(c).max(initial=0)) > 1e100
    with np.errstate(over="ignore", invalid="ignore"):
        qr, cr = q @ rotation, c @ rotation
        qrest, crest = np.linalg.norm(qr[:, lead:], axis=1), np.linalg.norm(cr[:, lead:], axis=1)
        qlen, clen = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    exact = not wide and float(qlen.max(initial=0)) * float(clen.max(initial=0)) < 2.0 ** 52
    slack = 1e-9 * (1 + qlen * clen.max(initial=0))
    kind = np.float64 if exact else object
    best = (np.zeros(0, np.int64), np.zeros(0, kind), np.zeros(0, np.int64))  # query row, score, id
    products = 0
    for a in range(0, len(c), CHUNK):
        b = min(a + CHUNK, len(c))
        rows = np.arange(len(q)) if wide else np.flatnonzero(qlen * clen[a] + slack >= low)
        if len(rows) == 0:
            break
        other = qi[rows, None] != ci[None, a:b]
        if wide:
            r, j = np.nonzero(other)
            products += len(r)
        else:
            floor = (low[rows] - slack[rows])[:, None]
            ok = (qr[rows, :lead] @ cr[a:b, :lead].T + qrest[rows, None] * crest[None, a:b] >= floor) & other
            if np.count_nonzero(ok) * 4 > ok.size:  # most are left: all at once
                s = np.where(ok, q[rows] @ c[a:b].T, -np.inf)
                products += ok.size
                if b - a > k:
                    floor = np.maximum(floor, -np.partition(-s, k - 1, axis=1)[:, k - 1:k] - 2 * slack[rows, None])
                r, j = np.nonzero(ok & (s >= floor))
                s = s[r, j]
            else:
                r, j = np.nonzero(ok)
                s = np.einsum("ij,ij->i", q[rows[r]], c[a + j])
                products += len(r)
        if exact:
            s = np.rint(s)
        else:
            s = np.array([_whole(q[rows[x]], c[a + y]) for x, y in zip(r.tolist(), j.tolist())] + [None], object)[:-1]
        best = tuple(np.concatenate(x) for x in zip(best, (rows[r], s, ci[a + j])))
        keep, last = _kept(*best, k)
        low[best[0][last]] = np.maximum(low[best[0][last]], np.clip(best[1][last], -1e300, 1e300).astype(float))
        best = tuple(x[keep] for x in best)
    return best[0], best[2], best[1], products


def _decimals(score: np.ndarray) -> pa.Array:
    kind = pa.decimal128(38, 0)
    if score.dtype != object:
        return pa.array(score.astype(np.int64)).cast(kind)
    # what has more than 38 digits stays too large for a long, too
    return pa.array([Decimal(max(-_WIDE, min(_WIDE, x))) for x in score.tolist()], kind)


def _score(k: int, d: int, rotation):
    """(query block, its thresholds, candidate block) -> each query's best of the block."""
    def run(batches):
        rot = rotation.value
        for batch in batches:
            t = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                q, c = (np.frombuffer(t[x][i].as_py()).reshape(-1, d) for x in ("q", "m"))
                qi, ci = (np.frombuffer(t[x][i].as_py(), "<i8") for x in ("qids", "ids"))
                low = np.frombuffer(t["low"][i].as_py(), "<f8")
                row, ids, score, _ = process(q, qi, c, ci, low, rot, k)
                yield pa.RecordBatch.from_arrays([pa.array(qi[row]), pa.array(ids), _decimals(score)], names=["query_id", "vec_id", "score"])
    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best so far: at most k rows a query and block of the wave come in."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_inner(vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of ``vectors(vec_id, embedding)`` for
    which the column expression ``is_query`` (of vec_id) holds, the ``k`` rows of another id
    with the highest inner products of the quantised vectors; ties go to the smaller vec_id,
    all rows if there are fewer.

    Unusable vectors (see ``quantised``) take no part.  A shorter vector counts as one that ends in
    zeros, an empty one as zeros.  Scores are exact whatever the size of the components; one among
    the best that is no 64-bit number stops the job.  Repeated rows are candidates of their own; a
    repeated query id is one query (its longest vector).  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    v = cut_lineage(quantised(vectors, scale=scale))
    facts = v.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    n, d = facts["n"], max(facts["d"] or 0, 1)
    if n == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    block, queries = max(1, min(block, _CELLS // d)), max(1, min(queries, _CELLS // d))
    rotation = spark.sparkContext.broadcast(_rotation(v, d))

    # blocks by falling length: a band of more than a block is dealt into several by id
    n_bands = min(-(-n // block), BANDS)
    cuts = v.approxQuantile("len", [i / n_bands for i in range(1, n_bands)], 0.1 / n_bands) if n_bands > 1 else []
    cuts = sorted(set(cuts), reverse=True)
    band = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c > F.col("len"))) if cuts else F.lit(0)
    banded = v.withColumn("band", band)
    bands, at = {}, 0
    for r in sorted(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("len").alias("top")).collect()):  # one row a band
        parts = -(-r["n"] // block)
        bands[r["band"]] = (at, parts, r["top"])
        at += parts
    first = F.create_map(*[F.lit(x) for b, (a, _, _) in bands.items() for x in (b, a)])
    many = F.create_map(*[F.lit(x) for b, (_, p, _) in bands.items() for x in (b, p)])
    dealt = banded.withColumn("block", first[F.col("band")] + F.pmod(F.xxhash64("vec_id"), many[F.col("band")]))
    cand = cut_lineage(dealt.select("block", "vec_id", "v", "len").groupBy("block").applyInPandas(_packed(d), _BLOCK_SCHEMA))
    asked = v.filter(is_query).withColumn("r", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("len"), F.xxhash64("v")))).filter("r = 1")
    n_query = -(-asked.count() // queries) or 1
    asks = asked.select(F.pmod(F.xxhash64("vec_id"), F.lit(n_query)).alias("block"), "vec_id", "v", "len").groupBy("block").applyInPandas(_packed(d), _BLOCK_SCHEMA)
    asks = cut_lineage(asks.select(F.col("block").alias("qblock"), F.col("ids").alias("qids"), F.col("m").alias("q"), F.col("top").alias("qtop")))

    found, lo, hi = None, 0, 1
    while lo < at:
        lows = _lows(asks, found, k)
        # the blocks of this wave that can reach the weakest threshold: lengths only
        reach = F.array(*[F.struct(F.lit(a + p).alias("end"), F.lit(float(top)).alias("top")) for a, p, top in bands.values()])
        near = F.filter(reach, lambda x: x["top"] * F.col("qtop") * F.lit(1 + 1e-9) + F.lit(1e-9) >= F.col("weakest"))
        end = F.least(F.array_max(F.transform(near, lambda x: x["end"])), F.lit(min(hi, at)))
        pairs = lows.select("qblock", "low", F.explode(F.when(end > lo, F.sequence(F.lit(lo), end - 1))).alias("block"))
        pairs = cut_lineage(pairs.withColumn("salt", F.expr(f"qblock div {SALT}")))
        if pairs.isEmpty():
            break
        # a copy of a candidate block for every SALT query blocks that it goes with
        copies = pairs.select("block", "salt").distinct().join(cand, "block").select("block", "salt", "m", "ids")
        work = pairs.join(asks.select("qblock", "qids", "q"), "qblock").join(copies.hint("merge"), ["block", "salt"])
        work = work.select("q", "qids", "low", "m", "ids", "qblock", "block").repartition(max(1, min(n_query * (min(hi, at) - lo), 4096)), "qblock", "block")
        new = work.select("q", "qids", "low", "m", "ids").mapInArrow(_score(k, d, rotation), _FOUND)
        found = cut_lineage(_ranked(new if found is None else new.unionByName(found.drop("rank")), k))
        lo, hi = hi, hi + (hi - lo) * GROWTH
    rotation.destroy()  # what needed it is stored
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast("long").alias("score"))


def _lows(asks: DataFrame, found: DataFrame | None, k: int) -> DataFrame:
    """qblock, qtop, low (the queries' thresholds in the order of the block), weakest."""
    none = F.lit(float("-inf"))
    every = asks.select("qblock", "qtop", F.posexplode(_ids("qids")).alias("pos", "query_id"))
    if found is None:
        every = every.withColumn("score", none)
    else:
        kth = found.filter(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("score"))
        every = every.join(kth, "query_id", "left").withColumn("score", F.coalesce("score", none))
    each = every.groupBy("qblock").agg(F.max("qtop").alias("qtop"), F.min("score").alias("weakest"),
                                       F.transform(F.sort_array(F.collect_list(F.struct("pos", "score"))), lambda x: x["score"]).alias("low"))  # a block of queries
    return each.withColumn("low", _packed_doubles("low"))


@F.arrow_udf(T.ArrayType(T.LongType()))
def _ids(col: pa.Array) -> pa.Array:
    return pa.array([np.frombuffer(x, "<i8").tolist() for x in col.to_pylist()], pa.list_(pa.int64()))


@F.arrow_udf(T.BinaryType())
def _packed_doubles(col: pa.Array) -> pa.Array:
    return pa.array([np.array(x, "<f8").tobytes() for x in col.to_pylist()], pa.binary())
