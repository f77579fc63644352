"""Toxicity scores: a linear classifier on byte n-grams scaled by naive Bayes ratios.

Features are the distinct n-grams of 4, 6 and 8 bytes of the text, after folding A-Z and
turning every other ASCII byte that is no letter into a space, hashed into a table of
fixed size.  Each feature is scaled by the log ratio of its smoothed shares in the two
classes (counted over every labelled training document), and a logistic regression weighs
the scaled features.  Its weights are fitted on the training documents of at most
``fit_rows`` ids, those with the smallest hash; everything else covers all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordrate.session import cut_lineage

from . import hashing as H
from .batches import bounded, pieces, small_batches
from .sketch import BLOCK_SCHEMA, blocks, summed

_U = np.uint64
BITS = 20
FEATURES = 20_000  # n-grams kept: those whose ratio is farthest from chance
FIT_ROWS = 20_000
THRESHOLD = 0.7

#: ASCII letters folded, bytes of non-ASCII characters kept, all else a space.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


def _grams(batch: pa.RecordBatch, column: int):
    """(text, feature) of every n-gram position of a batch; n-grams never cross texts."""
    raw, off = H.buffer_of(batch.column(column))
    # a space before and after every text
    n = len(off) - 1
    data = np.full(len(raw) + 2 * n, 32, np.uint8)
    where = np.arange(len(raw)) + 1 + 2 * np.repeat(np.arange(n), np.diff(off))
    data[where] = _FOLD[raw]
    off = off + 2 * np.arange(n + 1)
    text = np.repeat(np.arange(n, dtype=np.int32), np.diff(off))
    b = data.astype(_U)
    with np.errstate(over="ignore"):
        two = b[:-1] * _U(0x100) + b[1:]
        four = two[:-2] * _U(0x10000) + two[2:]
        six = four[:-2] * _U(0x10000) + two[4:]
        eight = four[:-4] * _U(0x9E3779B97F4A7C15) + four[4:] * _U(0xC2B2AE3D27D4EB4F)
        for size, g, mult in ((4, four, 0x2545F4914F6CDD1D), (6, six, 0xD6E8FEB86659FD93), (8, eight, 0xA0761D6478BD642F)):
            slot = ((g * _U(mult)) >> _U(64 - BITS)).astype(np.int32)
            if size > 4:
                slot = slot ^ np.int32(size * 0x1234)
            inside = text[:len(slot)] == text[size - 1:size - 1 + len(slot)]
            yield text[:len(slot)][inside], slot[inside]


def _present(batch: pa.RecordBatch, column: int, chosen: np.ndarray | None = None):
    """Distinct (text, feature) pairs by text, of the chosen features only if given."""
    n = batch.num_rows
    found = []
    for text, slot in _grams(batch, column):
        if chosen is not None:
            hit = chosen[slot]
            text, slot = text[hit], slot[hit]
        found.append((np.searchsorted(text, np.arange(n + 1)), slot))
    # of equal features of a text, only one is where its cell of ``last`` says; no sort
    last = np.empty(1 << BITS, np.int32)
    distinct = [np.zeros(0, np.int32)]
    for i in range(n):
        slot = np.concatenate([s[cut[i]:cut[i + 1]] for cut, s in found])
        at = np.arange(len(slot), dtype=np.int32)
        last[slot] = at
        distinct.append(slot[last[slot] == at])
    return np.repeat(np.arange(n), [len(d) for d in distinct[1:]]), np.concatenate(distinct)


def _count(batches):
    """Documents of each class that hold each feature: one table per class, end to end."""
    table = np.zeros(2 << BITS, np.int32)
    for big in batches:
        for batch in pieces(big, "text"):
            y = batch.column(batch.schema.get_field_index("toxic")).to_numpy()
            text, slot = _present(batch, batch.schema.get_field_index("text"))
            table += np.bincount(slot + (y[text].astype(np.int64) << BITS), minlength=len(table)).astype(np.int32)
    yield pa.RecordBatch.from_pandas(blocks(table), schema=pa.schema([("block", pa.int64()), ("counts", pa.binary())]))


def _rows(place):
    """Arrow map: (doc_id, text, toxic) -> toxic and the places of the chosen features it holds."""
    def run(batches):
        for big in batches:
            for batch in pieces(big, "text"):
                text, slot = _present(batch, 1, place.value >= 0)
                cut = np.searchsorted(text, np.arange(batch.num_rows + 1))
                at = np.concatenate([np.sort(place.value[slot[a:b]]) for a, b in zip(cut[:-1], cut[1:])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(2), pa.ListArray.from_arrays(cut.astype(np.int32), at)], names=["toxic", "at"])
    return run


def _fit(sample: DataFrame, ratio: np.ndarray, l2: float = 1e-4):
    """Weights and bias of a logistic regression on binary features scaled by ``ratio``, from
    ``sample(toxic, at)``: gradients are summed on the executors, the driver holds one weight
    per feature."""
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    # each class weighs the square root of what would make both count alike
    weight = {y: (0.5 * sum(n.values()) / n[y]) ** 0.5 if len(n) > 1 else 1.0 for y in n}
    size = max(1, len(ratio))
    scale = sample.sparkSession.sparkContext.broadcast(ratio)
    vector = F.udf(lambda at: Vectors.sparse(size, at, scale.value[at] if at else []), VectorUDT())
    data = sample.select(F.col("toxic").cast("double").alias("label"), vector("at").alias("features"),
                         F.when(F.col("toxic") == 1, F.lit(weight.get(1, 1.0))).otherwise(F.lit(weight.get(0, 1.0))).alias("weight"))
    # the mean is over the weights' sum, the penalty over the rows
    l2 *= sum(n.values()) / max(1e-9, sum(n[y] * weight[y] for y in n))
    model = LogisticRegression(weightCol="weight", regParam=l2, standardization=False, maxIter=400).fit(data)
    return model.coefficients.toArray()[:len(ratio)] * ratio, model.intercept


class Model:
    """Weights per hashed feature and a bias; small enough to broadcast (4 MB)."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def score(self, batch: pa.RecordBatch, column: int) -> np.ndarray:
        text, slot = _present(batch, column, self.weights != 0)
        z = np.bincount(text, self.weights[slot].astype(np.float64), minlength=batch.num_rows) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """A model from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``; labelled rows with
    a null id, text or label are left out, and an id labelled twice both ways counts as toxic.
    Without rows of both classes every text scores 0.5."""
    spark = docs.sparkSession
    small_batches(spark)
    known = cut_lineage(labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
                        .agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")))
    texts = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # only labels of the documents given count: totals, shares and the sample cover the same rows
    marked = cut_lineage(texts.select("doc_id").join(bounded(known), "doc_id").groupBy("doc_id", "toxic").agg(F.count(F.lit(1)).alias("n")))
    rows = texts.join(bounded(marked.select("doc_id", "toxic")), "doc_id").select("doc_id", "text", "toxic")
    totals = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.sum("n").alias("n")).collect()}
    if len(totals) < 2:
        return Model(np.zeros(1 << BITS), 0.0)
    table = summed(rows.select("text", "toxic").mapInArrow(_count, BLOCK_SCHEMA), 2 << BITS)
    clean, toxic = table[:1 << BITS].astype(float), table[1 << BITS:].astype(float)
    p, q = (toxic + 0.5) / (totals[1] + 1), (clean + 0.5) / (totals[0] + 1)
    ratio = np.log(p / q)
    # how far a feature's toxic share is from what chance gives at its frequency
    share = totals[1] / (totals[0] + totals[1])
    both = clean + toxic
    far = np.where(both >= 3, (toxic - both * share) / np.sqrt(both * share * (1 - share) + 1e-9), 0)
    keep = np.argsort(-np.abs(far), kind="stable")[:FEATURES]
    keep = keep[np.abs(far[keep]) > 3]
    place = np.full(1 << BITS, -1, np.int32)
    place[keep] = np.arange(len(keep))
    ids = cut_lineage(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).select("doc_id"))
    sample = rows.join(bounded(ids), "doc_id", "left_semi").mapInArrow(_rows(spark.sparkContext.broadcast(place)), "toxic int, at array<int>").persist()
    try:
        w, b = _fit(sample, ratio[keep])
    finally:
        sample.unpersist()
    weights = np.zeros(1 << BITS)
    weights[keep] = w
    return Model(weights, b)


def held_out(doc_id):
    """Whether an id's crc32 (of its decimal text) leaves 1 modulo 3: never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def scores(docs: DataFrame, model: Model):
    """A column expression of the score of ``text`` (null: as empty)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text], names=["text"])
        own = Model(*shared.value)
        parts = [own.score(b, 0) for b in pieces(batch, "text")]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return score(F.col("text").cast("string"))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, held_out, score (0 to 1), predicted
    (1 from ``threshold`` up).  Null and empty texts get the score of no features; a null
    doc_id is never learned from and not held out.  Other columns are ignored."""
    model = train(docs.filter(~held_out("doc_id")), labels, fit_rows)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), scores(docs, model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; learned from the rows that
    are not held out."""
    model = train(docs.filter(~held_out("doc_id")), labels, fit_rows)
    return docs.filter(scores(docs, model) < threshold)
