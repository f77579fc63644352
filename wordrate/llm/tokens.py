"""Token ids of documents by a public byte-level vocabulary, inside tasks."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa

#: The rank file of the byte-level vocabulary; its JSON form gives the same ids.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def encoder(path: str = RANKS, pattern: str = public_tokenizers.PATTERN):
    """text -> numpy array of ids, without special tokens (their strings are plain text)."""
    import tiktoken

    enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    return lambda text: enc.encode_to_numpy(text, disallowed_special=()).astype(np.uint32) if text else np.zeros(0, np.uint32)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: whole if they fit, else full pieces after
    a first one that takes the remainder."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)] if n else []


def piece_table(capacity: int, end_id: int, path: str):
    """Arrow map: (doc_id, text) -> one row per piece of the document's ids and its end id."""
    def run(batches):
        encode = encoder(path)
        for batch in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            texts = batch.column(1)
            for i, d in enumerate(batch.column(0).to_pylist()):
                ids = np.append(encode(texts[i].as_py() or ""), np.uint32(end_id)).astype("<u4")
                for k, (s, n) in enumerate(cuts(len(ids), capacity)):
                    doc.append(d)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[s:s + n].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
