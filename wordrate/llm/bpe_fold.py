"""Byte-level BPE: a fold of ranked merges over the byte arrays of distinct words.

Texts are split into pieces by the vocabulary's pattern and reduced, chunk by chunk, to
their distinct pieces.  Each of these words is folded: the adjacent pair of the lowest rank
is merged, the leftmost first, until no pair has a rank.  The rank map is one array, a hash
table from a pair of ids to the merged id.  Documents then take their words' ids, and
decoding concatenates the ids' bytes.  Nothing is shuffled: memory is bounded by a chunk,
and a lost task is redone from its split.

``encode_words`` does the fold with Spark's higher-order functions over a literal rank map.
``encode`` does the same fold, step by step for all words of one length at once, in numpy:
over the words of a corpus, interpreted lambdas take several times the CPU allowed (see the
README for the figures).
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .batches import pieces
from .tokens import RANKS, read_ranks

CHUNK_BYTES = 4 << 20
LONG = 64  # bytes of a piece from which it is merged with a heap: a fold is quadratic in it

_TABLE_BITS = 19
_MASK = (1 << _TABLE_BITS) - 1
# multipliers of the two probes; products of a 32-bit key stay below 2**63
_M0, _S0, _M1, _S1 = 1640531527, 17, 1103515245, 9


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(left id, right id) -> merged id for every pair of tokens that joins to a token."""
    out = {}
    for token, r in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                out[a, b] = r
    return out


def _probe(key, which: int):
    m, s = ((_M0, _S0), (_M1, _S1))[which]
    return ((key * m) >> s) & _MASK


def rank_table(pairs: dict[tuple[int, int], int]) -> np.ndarray:
    """A two-probe hash table: slot = key << 16 | merged id with key = left << 16 | right, -1 if empty."""
    table = [-1] * (_MASK + 1)
    for (a, b), r in pairs.items():
        entry, which = (a << 16 | b) << 16 | r, 0
        for _ in range(500):
            at = _probe(entry >> 16, which)
            entry, table[at] = table[at], entry
            if entry < 0:
                break
            which = 1 if _probe(entry >> 16, 0) == at else 0
        else:
            raise ValueError("the vocabulary has too many pairs for the table")
    return np.array(table, np.int64)


def _byte_ids(ranks: dict[bytes, int]) -> np.ndarray:
    return np.array([ranks[bytes([i])] for i in range(256)], np.int32)


def merged_by_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one long piece, in time n log n."""
    n = len(word)
    end, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n

    def push(i):
        j = right[i]
        if j < n:
            r = ranks.get(word[i:end[j]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[i], end[j]))
    heap: list = []
    for i in range(n - 1):
        push(i)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        j = right[i]
        if not alive[i] or end[i] != mid or j >= n or end[j] != stop:
            continue
        alive[j], end[i], right[i] = False, stop, right[j]
        if right[j] < n:
            left[right[j]] = i
        push(i)
        if left[i] >= 0:
            push(left[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:end[i]]])
        i = right[i]
    return out


_NONE = np.int32(1 << 30)


def _ranks(left: np.ndarray, right: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The merged id of every pair, _NONE if it has no rank."""
    key = left.astype(np.int64) << 16 | right
    out = np.full(key.shape, _NONE, np.int32)
    for which in (0, 1):
        e = table[_probe(key, which)]
        hit = e >> 16 == key
        out[hit] = (e[hit] & 0xFFFF).astype(np.int32)
    return out


def fold_words(words: list[bytes], byte_id: np.ndarray, table: np.ndarray, ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(ids end to end, ids of each word).  Words of one length are folded in lockstep: every
    step merges the leftmost lowest pair of each word that still has one, so all that go on
    stay equally long."""
    size = np.array([len(w) for w in words], np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    order = np.argsort(size, kind="stable")
    cut = np.searchsorted(size[order], np.arange(LONG + 2))
    for n in range(1, LONG + 1):
        rows = order[cut[n]:cut[n + 1]]
        if len(rows) == 0:
            continue
        parts = byte_id[np.frombuffer(b"".join(words[i] for i in rows), np.uint8)].reshape(len(rows), n)
        rank = _ranks(parts[:, :-1], parts[:, 1:], table)
        while parts.shape[1] > 1:
            at = rank.argmin(axis=1)
            low = rank[np.arange(len(rows)), at]
            go = low < _NONE
            if not go.all():
                done.append((rows[~go], parts[~go]))
                rows, parts, rank, at, low = rows[go], parts[go], rank[go], at[go], low[go]
            if len(rows) == 0:
                break
            every, width = np.arange(len(rows)), parts.shape[1]
            parts[every, at] = low
            keep = np.ones(parts.shape, bool)
            keep[every, at + 1] = False
            parts = parts[keep].reshape(len(rows), width - 1)
            keep = np.ones(rank.shape, bool)
            keep[every, at] = False
            rank = rank[keep].reshape(len(rows), width - 2)
            # only the pairs beside the merged part are new
            for side in (-1, 0):
                i = at + side
                ok = np.flatnonzero((i >= 0) & (i < width - 2))
                rank[ok, i[ok]] = _ranks(parts[ok, i[ok]], parts[ok, i[ok] + 1], table)
        if len(rows):
            done.append((rows, parts))
    for i in order[cut[LONG + 1]:]:
        done.append((np.array([i]), np.array([merged_by_heap(words[i], ranks)], np.int32)))
    out_size = np.zeros(len(words), np.int64)
    for rows, parts in done:
        out_size[rows] = parts.shape[1]
    first = np.cumsum(out_size) - out_size
    flat = np.zeros(int(out_size.sum()), "<u4")
    for rows, parts in done:
        flat[first[rows][:, None] + np.arange(parts.shape[1])] = parts
    return flat, out_size


def _encode(path: str, pattern: str, table):
    """(doc_id, text) -> (doc_id, ids), chunk by chunk."""
    def run(batches):
        import regex

        find = regex.compile(pattern).findall
        ranks = read_ranks(path)
        byte_id = _byte_ids(ranks)
        for big in batches:
            for batch in pieces(big, "text", CHUNK_BYTES):
                number: dict[str, int] = {}
                take: list[int] = []
                counts = []
                for text in batch.column(1).to_pylist():
                    found = find(text) if text else []
                    counts.append(len(found))
                    take += [number.setdefault(w, len(number)) for w in found]
                flat, size = fold_words([w.encode() for w in number], byte_id, table.value, ranks)
                num = np.array(take, np.int64)
                n = size[num]
                end = np.cumsum(n)
                first = np.cumsum(size) - size
                data = flat[np.arange(end[-1] if len(end) else 0) - np.repeat(end - n, n) + np.repeat(first[num], n)].tobytes()
                edge = np.append(0, end)[np.append(0, np.cumsum(counts))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([data[4 * a:4 * b] for a, b in zip(edge[:-1], edge[1:])], pa.binary())], names=["doc_id", "ids"])
    return run


def folded(words: Column, table: np.ndarray) -> Column:
    """Every array of byte ids in ``words`` with its merges done, by higher-order functions over
    a literal rank map."""
    literal = F.from_json(F.lit(json.dumps(table.tolist(), separators=(",", ":"))), "array<bigint>")

    def rank(a, b):
        key = a.cast("long") * 65536 + b

        def hit(which):
            m, s = ((_M0, _S0), (_M1, _S1))[which]
            return F.get(literal, F.shiftright(key * m, s).bitwiseAND(F.lit(_MASK)))

        first = hit(0)
        return F.when(F.shiftright(first, 16) == key, first.bitwiseAND(F.lit(65535))).otherwise(
            F.transform(F.array(hit(1)), lambda e: F.when(F.shiftright(e, 16) == key, e.bitwiseAND(F.lit(65535))))[0])

    def step(parts):
        ranks = F.zip_with(parts, F.slice(parts, F.lit(2), F.size(parts)), rank)
        # bound once: the ranks of all pairs, then the lowest and its leftmost place
        return F.transform(F.array(ranks), lambda r: F.transform(F.array(F.array_min(r)), lambda low: F.when(low.isNull(), parts).otherwise(
            F.transform(F.array(F.array_position(r, low).cast("int")), lambda at: F.concat(
                F.slice(parts, F.lit(1), at - 1), F.array(low.cast("int")), F.slice(parts, at + 2, F.size(parts))))[0]))[0])[0]

    def fold(word):
        return F.aggregate(F.slice(word, F.lit(2), F.greatest(F.size(word), F.lit(0))), word, lambda parts, _: step(parts))

    return F.transform(words, fold)


def _joined(path: str):
    def run(batches):
        ranks = read_ranks(path)
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            tokens[r] = t
        size = np.array([len(t) for t in tokens], np.int64)
        first, raw = np.cumsum(size) - size, np.frombuffer(b"".join(tokens), np.uint8)
        for big in batches:
            for batch in pieces(big, "ids"):
                at = batch.schema.get_field_index("ids")
                data, off = H.buffer_of(batch.column(at))
                ids = np.frombuffer(data.tobytes(), "<u4")
                n = size[ids]
                end = np.cumsum(n)
                out = raw[np.arange(end[-1] if len(end) else 0) - np.repeat(end - n, n) + np.repeat(first[ids], n)].tobytes()
                cut = np.append(0, end)[off // 4]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([out[a:b] for a, b in zip(cut[:-1], cut[1:])], pa.binary())], names=[*batch.schema.names, "decoded"])
    return run


def encode(docs: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids) of every row of ``docs(doc_id, text)``; ids as little-endian unsigned 32-bit
    numbers in a binary.  Special tokens' strings are plain text.  A null text is empty (no
    ids); null and repeated doc_ids are rows of their own; other columns are ignored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(rank_table(pair_ranks(read_ranks(path))))
    return rows.mapInArrow(_encode(path, pattern, table), "doc_id long, ids binary")


def encode_words(words: DataFrame, path: str = RANKS) -> DataFrame:
    """``words(word)``, a binary column, with ids: the same fold by Spark's higher-order functions
    alone.  A null or empty word has no ids."""
    ranks = read_ranks(path)
    byte_id = F.from_json(F.lit(json.dumps(_byte_ids(ranks).tolist())), "array<int>")
    hexed = F.hex("word")
    values = F.when(F.length("word") > 0, F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.get(byte_id, F.conv(F.substring(hexed, i * 2 - 1, F.lit(2)), 16, 10).cast("int"))))
    return words.withColumn("ids", folded(F.array(F.coalesce(values, F.array().cast("array<int>"))), rank_table(pair_ranks(ranks)))[0])


def decode(encoded: DataFrame, path: str = RANKS) -> DataFrame:
    """``encoded(doc_id, ids)`` with decoded, the concatenated bytes of the ids."""
    return encoded.select("doc_id", "ids").mapInArrow(_joined(path), "doc_id long, ids binary, decoded binary")
