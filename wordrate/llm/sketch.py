"""Fixed-size count tables summed over all rows of a corpus.

Every task counts hashed items in one numpy table and emits the cells that are not zero, in
compressed blocks; the blocks of one place are summed in Spark, and the whole table (a size
set by ``bits``, not by the data) is what the driver gets to broadcast.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

_BLOCK = 1 << 20
_WAYS = 64  # groups that first sum the tasks' parts of a block
BLOCK_SCHEMA = "block long, counts binary"


def _packed(part: np.ndarray) -> bytes:
    """The non-zero cells of a block: gaps between them, then their counts."""
    at = np.flatnonzero(part)
    cells = np.concatenate([np.diff(at, prepend=0), part[at]]).astype("<u4")
    return zlib.compress(cells.tobytes(), 1)


def _add(total: np.ndarray, raw: bytes) -> None:
    cells = np.frombuffer(zlib.decompress(raw), "<u4")
    n = len(cells) // 2
    total[np.cumsum(cells[:n], dtype=np.int64)] += cells[n:]


def blocks(table: np.ndarray) -> pd.DataFrame:
    """A task's table as (block, packed counts) rows; blocks of zeros are left out."""
    parts = [(b // _BLOCK, table[b:b + _BLOCK]) for b in range(0, len(table), _BLOCK)]
    return pd.DataFrame([(i, _packed(p)) for i, p in parts if p.any()], columns=["block", "counts"])


def _merge(key, pdf):
    total = np.zeros(_BLOCK, np.int64)
    for raw in pdf["counts"]:
        _add(total, raw)
    return pd.DataFrame({"block": [key[0]], "counts": [_packed(np.minimum(total, 2**32 - 1))]})


def summed(parts: DataFrame, size: int) -> np.ndarray:
    """The whole table of ``size`` counts from the tasks' blocks."""
    out = np.zeros(-(-size // _BLOCK) * _BLOCK, np.uint32)
    # two levels, so that one block's parts from very many tasks never meet in one task
    first = parts.selectExpr(f"block * {_WAYS} + pmod(hash(counts), {_WAYS}) AS block", "counts")
    half = first.groupBy("block").applyInPandas(_merge, BLOCK_SCHEMA)
    whole = half.selectExpr(f"block div {_WAYS} AS block", "counts").groupBy("block").applyInPandas(_merge, BLOCK_SCHEMA)
    for r in whole.collect():  # bounded: the table's fixed size
        _add(out[r["block"] * _BLOCK:(r["block"] + 1) * _BLOCK], r["counts"])
    return out[:size]
