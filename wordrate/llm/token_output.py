"""Token-id output: documents packed into fixed-size sequences, as binary columns.

Pieces are placed best-fit-decreasing: longest first, each into the open sequence with the
least room that still holds it.  Room is searched in a segment tree over capacities (leaf c
counts the open sequences with c tokens left): the smallest non-empty leaf from the piece's
length on is one walk of the tree.

Tokenising and packing happen in one narrow pass without a shuffle.  A task packs windows of
at most ``window_tokens`` tokens (a longer document is a window of its own), so its memory
is bounded and a lost task is redone from its input split alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import RANKS, cuts, encoder

WINDOW_TOKENS = 1 << 23


class CapacityTree:
    """A segment tree over capacities 0..size with the number of open bins at each."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.count = [0] * (2 * self.width)

    def add(self, capacity: int, by: int) -> None:
        i = capacity + self.width
        while i:
            self.count[i] += by
            i >>= 1

    def at_least(self, need: int) -> int:
        """The smallest capacity >= need that an open bin has, or -1."""
        i = need + self.width
        if self.count[i]:
            return need
        # up to the first ancestor with something to the right, then down its left edge
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.width
            i >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Items of every bin, in the order they were placed."""
    tree, open_, bins = CapacityTree(capacity), [[] for _ in range(capacity + 1)], []
    for i in sorted(range(len(lengths)), key=lambda j: -lengths[j]):
        n = lengths[i]
        room = tree.at_least(n)
        if room < 0:
            b, room = len(bins), capacity
            bins.append([])
        else:
            b = open_[room].pop()
            tree.add(room, -1)
        bins[b].append(i)
        if room > n:
            open_[room - n].append(b)
            tree.add(room - n, 1)
    return bins


SEQUENCES = ("sequence_id long, n_tokens int, n_segments int, doc_ids array<long>, doc_starts array<long>, "
             "cu_seqlens array<int>, ids binary, positions binary")


def _sequences(capacity: int, end_id: int, path: str, window: int):
    def emit(pieces: list, at: int) -> pa.RecordBatch:
        rows = []
        task = TaskContext.get().partitionId() << 32
        for k, items in enumerate(best_fit_decreasing([len(p[2]) for p in pieces], capacity)):
            parts = [pieces[i] for i in items]
            size = [len(p[2]) for p in parts]
            rows.append({
                "sequence_id": task + at + k, "n_tokens": sum(size), "n_segments": len(parts),
                "doc_ids": [p[0] for p in parts], "doc_starts": [p[1] for p in parts],
                "cu_seqlens": np.concatenate([[0], np.cumsum(size)]).tolist(),
                "ids": np.concatenate([p[2] for p in parts]).tobytes(),
                "positions": np.concatenate([np.arange(n, dtype="<u2" if capacity <= 65536 else "<u4") for n in size]).tobytes()})
        return pa.RecordBatch.from_pylist(rows, pa.schema([
            ("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("n_segments", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
            ("doc_starts", pa.list_(pa.int64())), ("cu_seqlens", pa.list_(pa.int32())), ("ids", pa.binary()), ("positions", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        held, tokens, at = [], 0, 0
        for batch in batches:
            texts = batch.column(1)
            for i, d in enumerate(batch.column(0).to_pylist()):
                ids = np.append(encode(texts[i].as_py() or ""), np.uint32(end_id))
                if ids.max() > 65535:
                    raise ValueError("ids do not fit the 16-bit matrix; the vocabulary is too large")
                ids = ids.astype("<u2")
                held += [(d, s, ids[s:s + n]) for s, n in cuts(len(ids), capacity)]
                tokens += len(ids)
                if tokens >= window:
                    out = emit(held, at)
                    yield from (out.slice(j, 1024) for j in range(0, out.num_rows, 1024))
                    at += out.num_rows
                    held, tokens = [], 0
        if held:
            out = emit(held, at)
            yield from (out.slice(j, 1024) for j in range(0, out.num_rows, 1024))
    return run


def token_sequences(docs: DataFrame, capacity: int = 2048, end_id: int = 50256, path: str = RANKS, window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """Sequences of at most ``capacity`` ids of ``docs(doc_id, text)``: sequence_id, n_tokens,
    n_segments, doc_ids and doc_starts (the document of every segment and how many of its
    ids come before it), cu_seqlens (0 and the cumulative segment lengths), ids
    (little-endian unsigned 16-bit, one row of the packed matrix, unpadded), positions
    (likewise; they start at 0 in every segment).

    A document is its ids and ``end_id``.  One longer than ``capacity`` is split without loss,
    the first piece taking the remainder.  A null text is empty (one id); null and repeated
    doc_ids are documents of their own; other columns are ignored.  The vocabulary must
    have at most 65,536 ids.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_sequences(capacity, end_id, path, window_tokens), SEQUENCES)


def write_matrix(sequences: DataFrame, path: str, capacity: int = 2048, pad_id: int = 0) -> None:
    """Parquet of the sequences with ``ids`` and ``positions`` padded to ``capacity``, so that the
    rows of a file are an id matrix."""
    wide = lambda c, fill: F.expr(f"concat({c}, unhex(repeat('{fill}', {capacity} - n_tokens)))")
    pad = pad_id.to_bytes(2, "little").hex()
    sequences.withColumn("ids", wide("ids", pad)).withColumn("positions", wide("positions", "0000")).write.parquet(path)
