"""Packing of documents into sequences under several capacities at once.

A sequence has capacities for tokens, for documents and for attention cost (the sum of the
squared piece lengths).  Pieces are placed in falling order of length by vector best fit:
of the open sequences in which a piece fits in every dimension, the one whose weighted
residual after it has the smallest norm (or the largest weighted dot product of demand and
residual) takes it; a new one is opened if none fits.  A capacity that the token capacity
implies has no weight.

Tokenising is a narrow pass.  Only the pieces' lengths are shuffled, into blocks of a fixed
expected number of pieces, so packing quality does not depend on partitions and no block
grows with the input.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordrate.session import cut_lineage

from .tokens import PIECES, RANKS, piece_table

BLOCK = 16_384  # pieces packed together


def best_fit(length: np.ndarray, capacity: int, max_docs: int, max_cost: float, by: str = "norm") -> np.ndarray:
    """The bin of every item (all items fit a bin on their own)."""
    # each dimension as a share of its capacity; one that can't bind has no weight
    caps = np.array([capacity, max_docs, max_cost], float)
    weight = np.array([1.0, float(max_docs < capacity), float(max_cost < float(capacity) ** 2)])
    need = np.stack([length, np.ones(len(length)), length.astype(float) ** 2], axis=1)
    left = np.zeros((len(length) + 1, 3))
    live = np.zeros(len(length) + 1, np.int64)  # bins that can still take something
    n_live = n_bins = 0
    out = np.zeros(len(length), np.int64)
    order = np.argsort(-length, kind="stable")
    smallest = length.min() if len(length) else 0
    for step, i in enumerate(order):
        d = need[i]
        rows = live[:n_live]
        r = left[rows]
        fits = np.flatnonzero((r[:, 0] >= d[0]) & (r[:, 1] >= d[1]) & (r[:, 2] >= d[2]))
        if len(fits):
            rest = (r[fits] - d) / caps
            score = -(weight * rest * rest).sum(axis=1) if by == "norm" else (weight * rest * (d / caps)).sum(axis=1)
            at = rows[fits[np.argmax(score)]]
        else:
            at = n_bins
            n_bins += 1
            left[at] = caps
            if n_live < len(live):
                live[n_live] = at
                n_live += 1
        left[at] -= d
        out[i] = at
        if step % 256 == 255:
            rows = live[:n_live]
            open_ = rows[(left[rows, 0] >= smallest) & (left[rows, 1] >= 1)]
            n_live = len(open_)
            live[:n_live] = open_
    return out


def _pack(capacity: int, max_docs: int, max_cost: float, by: str):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        length = pdf["length"].to_numpy()
        at = best_fit(length, capacity, max_docs, max_cost, by)
        order = np.argsort(at, kind="stable")
        cum = np.cumsum(length[order]) - length[order]
        new = np.append(True, at[order][1:] != at[order][:-1]) if len(at) else np.zeros(0, bool)
        offset = np.zeros(len(at), np.int64)
        offset[order] = cum - cum[new][np.cumsum(new) - 1]
        return pdf.drop(columns="block").assign(sequence_id=(int(key[0]) << 32) + at, offset=offset)
    return run


def pack_documents(docs: DataFrame, capacity: int = 2048, end_id: int = 0, max_docs: int | None = None,
                   max_cost: float | None = None, by: str = "norm", path: str = RANKS, block: int = BLOCK) -> DataFrame:
    """One row per piece of every row of ``docs(doc_id, text)``: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset.

    A document is its ids and ``end_id``; only one longer than ``capacity`` is cut, the first
    piece taking the remainder.  ``max_docs`` and ``max_cost`` limit the pieces and the sum of
    squared lengths of a sequence; unset, they are what ``capacity`` allows.  A null text is
    empty (one id); rows with a null or repeated doc_id are documents of their own.
    """
    max_docs = max_docs or capacity
    max_cost = float(capacity) ** 2 if max_cost is None else float(max_cost)
    if max_cost < float(capacity) ** 2 and max_cost < 1:
        raise ValueError("max_cost must allow a piece")
    # a piece alone must fit its cost: shorter pieces where the cost capacity is tight
    width = min(capacity, int(max_cost ** 0.5))
    pieces = cut_lineage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                         .mapInArrow(piece_table(width, end_id, path), PIECES))
    blocks = -(-pieces.count() // block) or 1
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)))
    return dealt.groupBy("block").applyInPandas(_pack(capacity, max_docs, max_cost, by), PIECES + ", sequence_id long, offset long")
