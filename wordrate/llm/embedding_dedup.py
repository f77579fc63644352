"""Near-duplicate vectors by collision-counting projections.

Unit vectors are projected on many random directions.  Projections are cut into windows
(cells of one width, with a random shift for each direction), ``K`` directions to a table
and ``L`` tables; every table sorts the vectors by their K windows, and two vectors that
fall together collide there.  A pair whose number of collisions reaches ``COUNT`` is
verified by its cosine in double precision.  Window width, K, L and the count are
calibrated for a pair exactly at the threshold: it is found with probability ``recall`` or
more, closer pairs with more.  K grows with the logarithm of the number of vectors, so a
cell keeps a bounded expected number of unrelated ones.

Equal vectors are one class, compared once.  A cell is compared in blocks of bounded size
(a crowded cell is split over several tasks), pairs are counted in the first table where
they collide, and only counts per vector and one link to the smallest neighbour leave a
task, never the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordrate.session import cut_lineage

from .graph import components

_U = np.uint64
COUNT = 2
WIDTH = 5.0  # window width over the spread of a projected threshold pair
BLOCK = 2048  # vectors of one side compared at a time
SEED = 20


def _same_window(ratio: float) -> float:
    """Probability that two values whose difference is N(0, 1) share a window ``ratio`` wide
    with a uniform random shift."""
    phi = 0.5 * math.erfc(ratio / math.sqrt(2))
    return 1 - 2 * phi - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-ratio * ratio / 2))


def calibrate(n: int, cosine: float, recall: float, expected: float = 512.0) -> tuple[int, int, float, float]:
    """(K, L, window width, probability of a threshold pair) for ``n`` vectors."""
    spread = math.sqrt(2 * (1 - cosine))
    near, far = _same_window(WIDTH), _same_window(WIDTH * spread / math.sqrt(2))
    k = max(1, round(math.log(max(n / expected, 1.0001)) / -math.log(far)))
    p, tables = near ** k, COUNT
    while True:
        miss = sum(math.comb(tables, c) * p ** c * (1 - p) ** (tables - c) for c in range(COUNT))
        if 1 - miss >= recall:
            return k, tables, WIDTH * spread, 1 - miss
        tables += 1


def _directions(d: int, k: int, tables: int, width: float):
    r = np.random.default_rng(SEED)
    return r.standard_normal((d, k * tables)), r.random(k * tables) * width


def _cells(x: np.ndarray, directions, k: int, tables: int, width: float) -> np.ndarray:
    """n x tables: the hash of the K windows of every vector in every table."""
    a, shift = directions
    w = np.floor((x @ a + shift) / width).astype(np.int64).astype(_U).reshape(len(x), tables, k)
    h = np.zeros((len(x), tables), _U) + np.arange(tables, dtype=_U) * _U(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = (h ^ w[:, :, j]) * _U(0x9E3779B97F4A7C15)
            h ^= h >> _U(29)
    return h


def _unit(col: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), "<f8").reshape(-1, d)


def _deal(d, k, tables, width):
    """(class, unit vector) -> a row for each table: table, cell, class, unit."""
    def run(batches):
        dirs = _directions(d, k, tables, width)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                h = _cells(_unit(b.column(1), d), dirs, k, tables, width).astype(np.int64)
                rows = pa.array(np.repeat(np.arange(b.num_rows), tables))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(tables, dtype=np.int32), b.num_rows)), pa.array(h.reshape(-1)), b.column(0).take(rows), b.column(2).take(rows)],
                    names=["table", "cell", "node", "copies"])
    return run


def _compare(d, k, tables, width, cosine):
    """Rows sorted by (table, cell, part); parts hold both sides of a block pair."""
    def links(table, ids, copies, x, cells, left, right, same):
        """Counts and smallest neighbours of a block pair."""
        near = x[left] @ x[right].T >= cosine - 1e-9
        if same:
            near &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
        i, j = np.nonzero(near)
        if len(i) == 0:
            return None
        i, j = left[i], right[j]
        hit = cells[i] == cells[j]
        ok = (hit.sum(axis=1) >= COUNT) & (hit.argmax(axis=1) == table)
        i, j = i[ok], j[ok]
        # the verification proper: each pair on its own, in double precision
        ok = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
        i, j = i[ok], j[ok]
        if len(i) == 0:
            return None
        n = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        low = ids.copy()
        np.minimum.at(low, i, ids[j])
        np.minimum.at(low, j, ids[i])
        # a block pair's own components, so that one link a vector joins all that is linked
        root = low
        while True:
            new = root.copy()
            np.minimum.at(new, i, root[j])
            np.minimum.at(new, j, root[i])
            if (new == root).all():
                break
            root = new
        at = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(n[at].astype(np.int64)), pa.array(root[at])], names=["node", "links", "low"])

    def group(t, dirs):
        table, side = t["table"].to_numpy(), t["side"].to_numpy()
        ids, copies = t["node"].to_numpy(), t["copies"].to_numpy()
        key = np.stack([table, t["cell"].to_numpy(), t["part"].to_numpy()])
        new = np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(ids))
        many = end - start > 1
        if not many.any():
            return
        x = _unit(t["unit"].combine_chunks(), d)
        for a, b in zip(start[many], end[many]):
            xs = x[a:b]
            cells = _cells(xs, dirs, k, tables, width)
            sd = side[a:b]
            left, right = np.flatnonzero(sd != 1), np.flatnonzero(sd != 0)
            out = links(table[a], ids[a:b], copies[a:b].astype(float), xs, cells, left, right, bool((sd == 2).all()))
            if out is not None:
                yield out

    def run(batches):
        dirs = _directions(d, k, tables, width)
        held = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            t = pa.Table.from_batches([batch])
            if held is not None:
                t = pa.concat_tables([held, t])
            t = t.combine_chunks()
            key = np.stack([t["table"].to_numpy(), t["cell"].to_numpy(), t["part"].to_numpy()])
            other = np.flatnonzero((key != key[:, -1:]).any(axis=0))
            n = int(other[-1]) + 1 if len(other) else 0
            if n:
                yield from group(t.slice(0, n).combine_chunks(), dirs)
            held = t.slice(n).combine_chunks()  # one part: 2 * BLOCK rows at most
        if held is not None:
            yield from group(held, dirs)
    return run


def _classes(id_col: str, vec_col: str, df: DataFrame) -> DataFrame:
    """vec_id, unit (little-endian doubles; null if the vector takes no part)."""
    @F.arrow_udf("binary")
    def unit(col: pa.Array) -> pa.Array:
        out = []
        for v in col.to_pylist():
            b = None
            if v and None not in v:
                x = np.asarray(v, "<f8")
                top = np.abs(x).max()
                if np.isfinite(top) and top > 0:
                    x = x / top  # no overflow or underflow in the square
                    x = x / np.sqrt(x @ x)
                    b = x.tobytes()
            out.append(b)
        return pa.array(out, pa.binary())
    return df.select(F.col(id_col).cast("long").alias("vec_id"), unit(F.col(vec_col).cast("array<double>")).alias("unit"))


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.9, recall: float = 0.995, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding)``: vec_id, n_links (other rows with
    cosine >= ``cosine``), component_id (smallest vec_id reachable over links, itself
    included), kept (vec_id = component_id).

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, nor do vectors of different lengths with each other.  Repeated rows are linked
    with each other.  Rows with a null id link with nothing and get a null component.
    """
    rows = cut_lineage(_classes("vec_id", "embedding", vectors))
    usable = rows.filter("vec_id is not null and unit is not null")
    classes = cut_lineage(usable.groupBy("unit").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")))
    sizes = [r["s"] // 8 for r in classes.select(F.length("unit").alias("s")).distinct().collect()]
    found = None
    for d in sorted(sizes):
        part = classes.filter(F.length("unit") == 8 * d)
        k, tables, width, _ = calibrate(part.count(), cosine, recall)
        dealt = part.select("node", "unit", "copies").mapInArrow(_deal(d, k, tables, width), "table int, cell long, node long, copies long")
        dealt = cut_lineage(dealt)
        # crowded cells are split into blocks, and block pairs into parts
        crowd = (dealt.groupBy("table", "cell").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
                 .withColumn("blocks", F.ceil(F.col("size") / block).cast("int")))
        placed = dealt.join(crowd.select("table", "cell", "blocks"), ["table", "cell"]).withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        placed = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        placed = placed.select("table", "cell", "node", "copies",
                               (F.least("b", "other") * F.col("blocks") + F.greatest("b", "other")).alias("part"),
                               F.when(F.col("b") == F.col("other"), 2).when(F.col("b") < F.col("other"), 0).otherwise(1).alias("side"))
        full = placed.join(part.select("node", "unit"), "node").select("table", "cell", "part", "side", "node", "copies", "unit")
        # the directions' windows are taken anew from the vectors, so a row carries one key only
        out = (full.repartition("table", "cell", "part").sortWithinPartitions("table", "cell", "part")
               .mapInArrow(_compare(d, k, tables, width, cosine), "node long, links long, low long"))
        found = out if found is None else found.union(out)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = cut_lineage(found)
    group = components(found.select(F.col("node").alias("u"), F.col("low").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = (classes.join(links, "node", "left").join(group, "node", "left")
             .select("unit", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")))
    out = rows.join(named, "unit", "left")
    mine = F.col("vec_id").isNotNull() & F.col("component_id").isNotNull()
    component = F.when(mine, F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(mine, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
