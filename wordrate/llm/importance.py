"""Target-distribution importance resampling with bit-sliced sums.

Every run of 1 to ``longest`` words is a feature; its CRC-32 picks one of ``buckets``.  A
bucket's gain is 1000 times the log ratio of its smoothed shares in the target and in the
corpus, rounded down; a document's weight is the sum of its features' gains, and documents
are drawn by weight plus Gumbel noise from a hash of their id.

The sum is taken over bit planes: a document's counts per bucket become planes of ``buckets``
bits (plane j holds bit j of every count), the gains become planes in two's complement, and
the weight is the sum over pairs of planes of popcount(AND) times the power of two of the
pair, negative for the gains' sign plane.  All of it is exact in integers.

Corpus counts are summed by bucket from one partial table per task; the gains are ``buckets``
numbers, whatever the corpus.  Only ids and numbers are stored and ranked; texts are never
shuffled.  The draw orders narrow rows by ranges, so no task sees more than its range.

Defined results: a null text has no words, a document without features weighs 0; a null id
hashes as the empty string and is ranked as the smallest; repeated rows count, and are
drawn, each for itself (equal ids in order of n_features, weight).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordrate.operators.numbering import with_row_number
from wordrate.session import cut_lineage

from . import byte_words as B
from .batches import pieces
from .hashing import buffer_of

BUCKETS = 10_000
LONGEST = 3
SCALE = 1000
_ROWS = 64  # documents whose counts are spread out at a time


def _features(column, buckets, longest):
    """(words per text, text of every feature, bucket of every feature) of an Arrow column."""
    buf, off = buffer_of(column)
    raw = B.lowered(buf)
    starts, ends, text = B.word_bounds(raw, off)
    where, crc = B.run_crcs(raw, starts, ends, text, longest)
    return np.bincount(text, minlength=len(off) - 1), where, (crc % np.uint32(buckets)).astype(np.int64)


def _counting(buckets, longest):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in pieces(batch, "_text"):
                total += np.bincount(_features(piece.column(0), buckets, longest)[2], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])
    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, text_col: str = "text") -> DataFrame:
    """bucket, n: features of all texts in every bucket that has any."""
    parts = texts.select(F.col(text_col).alias("_text")).mapInArrow(_counting(buckets, longest), "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS, scale: int = SCALE) -> np.ndarray:
    """The gain of every bucket from two ``bucket_counts``, as whole numbers."""
    def table(counts):
        out = [0] * buckets
        for r in counts.collect():  # at most ``buckets`` rows
            out[r["bucket"]] = r["n"]
        return out, sum(out)

    (s, s_all), (t, t_all) = table(corpus), table(target)
    top, bottom = float(s_all + buckets), float(t_all + buckets)
    return np.array([math.floor(scale * math.log((float(t[b] + 1) * top) / (float(s[b] + 1) * bottom))) for b in range(buckets)], np.int64)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of 0/1 as rows of 64-bit words."""
    pad = -bits.shape[1] % 64
    return np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1).view(np.uint64)


def gain_planes(gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(planes, what a bit of each counts): two's complement, so the last counts below zero."""
    size = max(int(gain.max()).bit_length(), int(~gain.min()).bit_length(), 0) + 1
    planes = np.stack([(gain >> k) & 1 for k in range(size)]).astype(np.uint8)
    value = np.array([1 << k for k in range(size - 1)] + [-(1 << (size - 1))], np.int64)
    return _packed(planes), value


def weights(counts: np.ndarray, planes: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Exact sums of counts times gains for rows of bucket counts."""
    out = np.zeros(len(counts), np.int64)
    for j in range(int(counts.max(initial=0)).bit_length()):
        plane = _packed(((counts >> j) & 1).astype(np.uint8))
        out += (np.bitwise_count(plane[:, None, :] & planes[None, :, :]).sum(axis=2, dtype=np.int64) @ value) << j
    return out


def _weighing(gain, longest):
    planes, value = gain_planes(gain)
    buckets = len(gain)

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "_text"):
                n_words, where, bucket = _features(piece.column(piece.num_columns - 1), buckets, longest)
                rows = piece.num_rows
                order = np.argsort(where, kind="stable")
                bucket, n_features = bucket[order], np.bincount(where, minlength=rows)
                first = np.concatenate([[0], np.cumsum(n_features)])
                weight = np.zeros(rows, np.int64)
                for a in range(0, rows, _ROWS):
                    b = min(a + _ROWS, rows)
                    row = np.repeat(np.arange(b - a), n_features[a:b])
                    flat = np.bincount(row * buckets + bucket[first[a]:first[b]], minlength=(b - a) * buckets)
                    weight[a:b] = weights(flat.reshape(b - a, buckets), planes, value)
                yield pa.RecordBatch.from_arrays(
                    piece.columns[:-1] + [pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(weight, pa.int64())],
                    names=[*piece.schema.names[:-1], "n_words", "n_features", "weight"])
    return run


def noise(id_col: Column, seed: int = 42, scale: int = SCALE) -> Column:
    """Gumbel noise from the first 32 bits of sha256(``seed:id``), scaled and rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def document_weights(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = 42,
                     id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """id, n_words, n_features, weight, score (weight plus noise) of every document."""
    gain = gains(bucket_counts(docs, buckets, longest, text_col), bucket_counts(target, buckets, longest, target_text), buckets)
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = own.schema["_id"].dataType.simpleString()
    out = own.mapInArrow(_weighing(gain, longest), f"_id {kind}, n_words long, n_features long, weight long")
    return out.withColumn("score", F.col("weight") + noise(F.col("_id"), seed)).withColumnRenamed("_id", id_col)


def importance_ranks(docs: DataFrame, target: DataFrame, parts: int = 5, of: int = 100, min_words: int = 20, id_col: str = "doc_id",
                     **how) -> DataFrame:
    """``document_weights`` with rank: 1, 2, 3... by falling score (ties: smaller id) for the
    floor(parts * N / of) drawn of the N documents with at least ``min_words`` words, else null."""
    scored = cut_lineage(document_weights(docs, target, id_col=id_col, **how))
    able = F.col("n_words") >= min_words
    ranked = with_row_number(scored.filter(able), [F.col("score").desc(), F.col(id_col), F.col("n_features"), F.col("weight")],
                             name="rank", total="_all")
    drawn = F.when(F.col("rank") <= F.expr(f"{int(parts)} * _all div {int(of)}"), F.col("rank"))
    rest = scored.filter(~able).withColumn("rank", F.lit(None).cast("long"))
    return ranked.withColumn("rank", drawn).drop("_all").unionByName(rest)
