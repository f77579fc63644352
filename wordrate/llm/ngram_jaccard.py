"""Self-join of documents on the Jaccard similarity of their word n-gram sets.

Method: a size-aware heavy-light join.  Every set is ordered by one global order of
tokens (n-gram hashes), common tokens last.  Two sets of similarity t share at least
``ceil(t * n)`` tokens of either, so they share ``c`` of the first ``n - ceil(t * n) + c``.

* light sets (fewer than ``x`` tokens): every 2-subset of that prefix (c = 2) is a key; sets
  that share a key are candidates.  Subsets are selective, and few for small sets.
* heavy sets (and light ones that a heavy one can match): every token of the prefix
  (c = 1) is posted to an inverted list; the lists are scanned and the number of lists a
  pair shares is compared with the number that its overlap requires.
* the boundary ``x`` minimises the rows that both sides cost, from the histogram of sizes.

Sets that are equal are one node (64-bit hash of the set), so exact copies cost no pairs.
Where a list is long, its nodes are first compared with a few pivots of the list; only
nodes of different components found so far are then paired, which is complete: a pair left
out is already in one component.  Every candidate is verified on the whole texts.

Commonness is read from a count table of fixed size that covers every token of every
document; it only decides the order, never what is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordrate.session import cut_lineage

from . import byte_words as B
from . import hashing as H
from .batches import bounded, let_go, pieces, small_batches
from .graph import components
from .sketch import blocks, summed

_U = np.uint64
SKETCH_BITS = 24  # 16M counters: 64 MB per task, whatever the input
TEXT_BYTES = 1 << 19  # bytes of text hashed at a time
LONG_LIST = 24  # nodes of a list from which pivots are tried first
PIVOTS = 12
TURNS = 2
POSTING_COST = 3.0  # rows a posting costs (its own, and its share of scanned pairs)


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-gram hashes) of every text of the batch; null: empty."""
    raw, off = H.buffer_of(batch.column(1))
    raw = H.LOWER[raw]
    starts, ends, text = B.word_bounds(raw, off, ~H.SPACE)
    hs, per = B.word_hashes(raw, starts, ends), np.bincount(text, minlength=batch.num_rows)
    end = np.cumsum(per)
    for i in range(batch.num_rows):
        found = np.sort(H.shingles(hs[end[i] - per[i]:end[i]], k))
        new = np.ones(len(found), bool)
        np.not_equal(found[1:], found[:-1], out=new[1:])
        yield i, found[new]


def _need(n, percent: int):
    """Tokens that a set of ``n`` must share with any set it is linked to."""
    return -(-percent * n // 100)


def _node(tokens: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        s = H.mix(tokens * _U(0x2545F4914F6CDD1D)).sum(dtype=_U) + H.mix(tokens).sum(dtype=_U) * _U(3)
    return int(H.mix(np.array([s + _U(len(tokens))]))[0].astype(np.int64))


_PROFILE = "doc_id long, tkey long, n_shingles long, node long, block long, counts binary"
_NAMES = ["doc_id", "tkey", "n_shingles", "node", "block", "counts"]


def _profile(k: int):
    def run(batches):
        table = np.zeros(1 << SKETCH_BITS, np.int32)
        mask = _U((1 << SKETCH_BITS) - 1)
        for big in batches:
            for batch in pieces(big, "text", TEXT_BYTES):
                n, node, seen = [], [], [np.zeros(0, _U)]
                for _, t in _sets(batch, k):
                    n.append(len(t))
                    node.append(_node(t) if len(t) else None)
                    seen.append(t)
                np.add.at(table, (np.concatenate(seen) & mask).astype(np.int64), 1)
                none = pa.nulls(len(n), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(node, pa.int64()), none, pa.nulls(len(n), pa.binary())],
                    names=_NAMES)
        b = blocks(table)
        del table
        let_go()
        none = pa.nulls(len(b), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, none, none, none, pa.array(b["block"], pa.int64()), pa.array(b["counts"], pa.binary())], names=_NAMES)
    return run


def common_classes(table: np.ndarray) -> np.ndarray:
    """0 for a counter that chance alone explains, else 1-15 growing with its count."""
    mean = table.mean()
    usual = mean + 6 * np.sqrt(mean) + 4
    out = np.zeros(len(table), np.uint8)
    high = np.flatnonzero(table > usual)
    out[high] = np.clip(1 + np.log2(table[high] / usual), 1, 15).astype(np.uint8)
    return out


def light_boundary(histogram: dict[int, int], percent: int, limit: int) -> int:
    """The size below which enumerating 2-subsets is the cheaper side."""
    best, at, light = 0.0, 4, 0.0
    for x in range(4, limit):
        n = x
        p = n - _need(n, percent)
        light += histogram.get(n, 0) * ((p + 2) * (p + 1) / 2 - POSTING_COST * (p + 1))
        # sets from percent * x to x stay in the lists as well, for their heavy partners
        both = sum(histogram.get(m, 0) * POSTING_COST * (m - _need(m, percent) + 1) for m in range(_need(x + 1, percent), x + 1))
        if light + both < best:
            best, at = light + both, x + 1
    return at


def _postings(k: int, percent: int, classes, x: int):
    def run(batches):
        cls, mask = classes.value, _U((1 << SKETCH_BITS) - 1)
        for big in batches:
            for batch in pieces(big, "text", TEXT_BYTES):
                key, node, size, light = [], [], [], []
                for _, t in _sets(batch, k):
                    n = len(t)
                    if n * (100 - percent) < percent:  # linked to equal sets only
                        continue
                    name = _node(t)
                    order = np.sort((cls[(t & mask).astype(np.int64)].astype(_U) << _U(60)) | (t >> _U(4)))
                    p = n - _need(n, percent)
                    if n < x:
                        first = order[:p + 2]
                        a, b = np.triu_indices(len(first), 1)
                        with np.errstate(over="ignore"):
                            ks = H.mix(first[a] * _U(0x9E3779B97F4A7C15) + first[b])
                        key.append(ks)
                        node.append(np.full(len(ks), name))
                        size.append(np.full(len(ks), n))
                        light.append(np.ones(len(ks), bool))
                    # a set that may share one token only with a set it is linked to has no 2-subsets to meet it by
                    if n >= _need(x, percent) or n * percent <= 100:
                        key.append(order[:p + 1])
                        node.append(np.full(p + 1, name))
                        size.append(np.full(p + 1, n))
                        light.append(np.zeros(p + 1, bool))
                if key:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(key).astype(np.int64)), pa.array(np.concatenate(node).astype(np.int64)),
                         pa.array(np.concatenate(size).astype(np.int32)), pa.array(np.concatenate(light))],
                        names=["key", "node", "n", "light"])
        let_go()
    return run


def _shared(batches):
    """Rows of keys that two nodes or more have, each (key, node) once.  Input sorted by
    (key, node); only the last key of a batch is carried to the next."""
    rest = None
    def emit(t, final):
        key, node = t["key"].to_numpy(), t["node"].to_numpy()
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        start = np.ones(len(key), bool)
        start[1:] = key[1:] != key[:-1]
        group = np.cumsum(start) - 1
        many = np.bincount(group, weights=new) >= 2
        # an open key that is known to be shared keeps one row behind to compare with
        hold = group == group[-1] if not final else np.zeros(len(key), bool)
        return t.filter(pa.array(new & many[group] & ~hold)), t.filter(pa.array(new & hold)) if not final else None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        t = pa.Table.from_batches([batch])
        if rest is not None and rest.num_rows:
            t = pa.concat_tables([rest, t]).combine_chunks()
        out, rest = emit(t, False)
        if out.num_rows:
            yield from out.to_batches()
    if rest is not None and rest.num_rows:
        out, _ = emit(rest, True)
        yield from out.to_batches()
    let_go()


def _verify(k: int, percent: int):
    def run(batches):
        last_text, last = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            ta, tb = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                x, y = ta[i].as_py(), tb[i].as_py()
                if y != last_text:
                    last_text = y
                    last = next(_sets(pa.RecordBatch.from_arrays([pa.array([0]), pa.array([y])], names=["i", "text"]), k))[1]
                s = next(_sets(pa.RecordBatch.from_arrays([pa.array([0]), pa.array([x])], names=["i", "text"]), k))[1]
                both = len(np.intersect1d(s, last, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(last) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["u", "v"])
        let_go()
    return run


def _links(docs: DataFrame, sets: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are linked, as edges (u, v)."""
    pairs = cut_lineage(pairs)
    if pairs.limit(1).count() == 0:
        return pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    # one document stands for its node; a document id may repeat, so its text's hash is kept with it
    reps = cut_lineage(sets.filter("doc_id is not null").join(nodes, "node").groupBy("node")
                       .agg(F.min(F.struct("doc_id", "tkey")).alias("r")).select("node", "r.doc_id", "r.tkey"))
    texts = cut_lineage(docs.join(bounded(reps), ["doc_id", "tkey"]).select("node", "text").dropDuplicates(["node"]))
    left = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "ta"}), "a")
    full = left.join(texts.withColumnsRenamed({"node": "b", "text": "tb"}), "b").select("a", "b", "ta", "tb")
    return full.mapInArrow(_verify(k, percent), "u long, v long")


def _fits(na: str, nb: str, percent: int):
    return F.expr(f"100 * least({na}, {nb}) >= {percent} * greatest({na}, {nb})")


def _labelled(rows: DataFrame, edges: DataFrame | None) -> DataFrame:
    """The postings with their node's component so far, of lists with two components or more."""
    if edges is None:
        return rows.withColumn("label", F.col("node"))
    label = components(edges).withColumnRenamed("component", "label")
    mine = rows.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = mine.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    return mine.join(mixed, "key", "left_semi")


def _second(rows: DataFrame) -> DataFrame:
    """The other side of a pair: every column but the key renamed with a 2."""
    keep = [c for c in ("node", "n", "label", "ks", "ls") if c in rows.columns]
    return rows.select("key", *[F.col(c).alias(c + "2") for c in keep])


def ngram_jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_shingles (distinct n-grams of
    ``k`` words), component_id (smallest doc_id reachable over links, itself included).

    Words are runs of bytes other than \\x20 and \\x09-\\x0D after folding A-Z; a text of
    fewer than ``k`` words is one n-gram.  Two documents are linked if
    100 * intersection >= percent * union.  Null, empty and blank texts have no n-grams and
    link with nothing.  Rows with a null doc_id get a null component and link nothing.  A
    repeated doc_id is several rows; each keeps its own set.  Other columns of ``docs``
    are ignored, an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("tkey", F.xxhash64("text"))
    # whole texts are read twice (sizes and counts, then postings); both passes are narrow
    prof = cut_lineage(docs.mapInArrow(_profile(k), _PROFILE))
    sets = prof.filter("block is null").select("doc_id", "tkey", "n_shingles", "node")
    classes = spark.sparkContext.broadcast(
        common_classes(summed(prof.filter("block is not null").select("block", "counts"), 1 << SKETCH_BITS)))
    limit = 256
    sizes = {r["n"]: r["c"] for r in sets.filter(F.col("n_shingles") < limit).groupBy(F.col("n_shingles").alias("n"))
             .agg(F.count(F.lit(1)).alias("c")).collect()}  # at most 256 rows
    x = light_boundary(sizes, percent, limit)
    posts = docs.filter("doc_id is not null").mapInArrow(_postings(k, percent, classes, x), "key long, node long, n int, light boolean")
    shared = cut_lineage(posts.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_shared, "key long, node long, n int, light boolean"))

    edges = None
    # 1. long lists: every node against a few pivots of its list, while that joins components
    size = shared.groupBy("key").agg(F.count(F.lit(1)).alias("g")).filter(F.col("g") > LONG_LIST)
    crowded = cut_lineage(shared.join(size, "key"))
    for turn in range(TURNS):
        mine = _labelled(crowded, edges)
        long = mine.groupBy("key").agg(
            *[F.min_by(F.struct("node", "n", "label"), F.xxhash64("node", F.lit(turn * PIVOTS + s))).alias(f"p{s}") for s in range(PIVOTS)]
        ).select("key", F.array_distinct(F.array(*[f"p{s}" for s in range(PIVOTS)])).alias("ps"))
        star = (mine.join(long, "key").select("node", "n", "label", "light", F.explode("ps").alias("p"))
                .filter(F.col("label") != F.col("p.label")).filter(_fits("n", "p.n", percent))
                .groupBy(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b"))
                .agg(F.count(F.lit(1)).alias("c"), F.max("light").alias("light"), F.max("n").alias("n"))
                # a pivot's lists are a part of those that the pair shares
                .filter(F.col("light") | (F.col("c") * 40 >= F.col("n"))).select("a", "b"))
        new = cut_lineage(_links(docs, sets, star, k, percent))
        if new.limit(1).count() == 0:
            break
        edges = new if edges is None else cut_lineage(edges.union(new))

    # 2. all lists, complete: pairs of nodes that are not in one component yet
    mine = cut_lineage(_labelled(shared, edges))
    size = mine.groupBy("key").agg(F.count(F.lit(1)).alias("g"))
    short = mine.join(size.filter(F.col("g") <= LONG_LIST).select("key"), "key")
    # lists shared + the tokens behind the shorter prefix bound the overlap from above
    rest = f"greatest(ceil({percent} * n / 100), ceil({percent} * n2 / 100)) - 1"
    enough = f"(c + {rest}) * (100 + {percent}) >= {percent} * (n + n2)"
    pairs = (short.join(_second(short), "key").filter("node < node2 and label <> label2").filter(_fits("n", "n2", percent))
             .groupBy(F.col("node").alias("a"), F.col("node2").alias("b"))
             .agg(F.count(F.lit(1)).alias("c"), F.max("light").alias("light"), F.first("n").alias("n"), F.first("n2").alias("n2"))
             .filter(F.expr(f"light or {enough}")).select("a", "b"))
    # in long lists each pair is made once, in its first common list, and counted there
    hot = mine.join(size.filter(F.col("g") > LONG_LIST).select("key"), "key")
    lists = (mine.filter("not light").join(hot.select("node").distinct(), "node").join(size, "key").groupBy("node")
             .agg(F.collect_list("key").alias("ks"), F.sort_array(F.collect_list(F.when(F.col("g") > LONG_LIST, F.col("key")))).alias("ls")))
    hot = hot.join(lists, "node", "left")
    once = f"element_at(array_intersect(ls, ls2), 1) = key and {enough.replace('(c +', '(size(array_intersect(ks, ks2)) +', 1)}"
    more = (hot.join(_second(hot), "key").filter("node < node2 and label <> label2").filter(_fits("n", "n2", percent))
            .filter(F.expr(f"light or ({once})")).select(F.col("node").alias("a"), F.col("node2").alias("b")))
    second = cut_lineage(_links(docs, sets, pairs.union(more).distinct(), k, percent))
    edges = second if edges is None else edges.union(second)

    # nodes linked to each other, and the smallest document of each group
    label = components(edges)
    named = sets.join(label, "node", "left").withColumn("_g", F.coalesce("component", "node"))
    low = named.filter("node is not null and doc_id is not null").groupBy("_g").agg(F.min("doc_id").alias("_low"))
    return (named.join(low, "_g", "left")
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("_low", "doc_id")).alias("component_id")))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that are linked, directly or over others, to one of a
    smaller doc_id; columns and order of columns as they were.  Rows of one doc_id stay or
    go together, rows without an id stay."""
    comp = ngram_jaccard_components(docs, k, percent)
    gone = cut_lineage(comp.filter("component_id < doc_id").select(F.col("doc_id").alias("gone")).distinct())
    own = docs.select(*[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(docs.columns)], F.col("doc_id").cast("long").alias("id"))
    kept = own.join(bounded(gone), F.col("id") == F.col("gone"), "left_anti")
    return kept.select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(docs.columns)])
