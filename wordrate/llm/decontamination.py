"""Benchmark decontamination: documents' words that lie in windows of benchmark items.

A window is ``length`` consecutive words of an item; an item of fewer words (but not none) is
one window.  The distinct windows of all items are a hash set broadcast to the tasks,
which scan the documents' own windows, look the hits up by their words and mark them; one
pass over the documents, no shuffle.  The set's measured size is checked first.  A larger set
is not broadcast: the documents' windows that pass a bitmap of fixed size go to the items'
windows by a join, and the hits come back to their texts by another.

Defined results: a null text has no words; an item without words has no window; repeated
documents give one row each; items of equal id count once, with the windows of all their
texts; a null item id is an item named by the empty string.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordrate.session import cut_lineage

from . import byte_words as B
from .batches import pieces
from .hashing import buffer_of

LENGTH = 10
#: Bytes of windows and item ids up to which the set is broadcast.
SET_BYTES = 64 << 20
#: Cells of the bitmap that a larger set is summed up in.
BITMAP_BITS = 27

_WINDOWS = "item string, words int, hash long, window binary"
_FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
_FOUND_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _joined(raw, starts, ends, i, n) -> bytes:
    """The words i to i + n - 1 with one space between them."""
    return b" ".join(raw[starts[j]:ends[j]].tobytes() for j in range(i, i + n))


def _benchmark_windows(length):
    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "_text"):
                buf, off = buffer_of(piece.column(1))
                raw = B.lowered(buf)
                starts, ends, text = B.word_bounds(raw, off)
                names = piece.column(0).to_pylist()
                count = np.bincount(text, minlength=len(names)) if len(text) else np.zeros(len(names), np.int64)
                first = np.cumsum(count) - count
                h = B.word_hashes(raw, starts, ends)
                rows = []
                for k, (a, c) in enumerate(zip(first, count)):
                    n = min(int(c), length)
                    if n:
                        hashes = B.run_hashes(h[a:a + c], n).view(np.int64).tolist()
                        rows += [(names[k], n, hashes[j], _joined(raw, starts, ends, a + j, n)) for j in range(len(hashes))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.binary()))],
                    names=["item", "words", "hash", "window"])
    return run


def windows_of(benchmark: DataFrame, length: int = LENGTH, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, words (in the window), hash, window (its words, joined by one space): the distinct
    windows of every item."""
    own = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_item"), F.col(text_col).alias("_text"))
    return own.mapInArrow(_benchmark_windows(length), _WINDOWS).dropDuplicates(["item", "window"])


class _Text:
    """The words of a piece of texts and their candidate windows."""

    def __init__(self, column):
        buf, self.off = buffer_of(column)
        self.raw = B.lowered(buf)
        self.starts, self.ends, self.text = B.word_bounds(self.raw, self.off)
        self.hashes = B.word_hashes(self.raw, self.starts, self.ends)
        n = len(self.off) - 1
        self.count = np.bincount(self.text, minlength=n) if n else np.zeros(0, np.int64)

    def candidates(self, n, known):
        """First words of the windows of ``n`` words in one text whose hash ``known`` accepts."""
        h = B.run_hashes(self.hashes, n)
        at = np.flatnonzero(known(h))
        at = at[self.text[at] == self.text[at + n - 1]]
        return at.tolist(), h[at].view(np.int64).tolist()

    def window(self, i, n):
        return _joined(self.raw, self.starts, self.ends, i, n)

    def rows(self, hits):
        """(n_words, n_hit, items, spans) columns from hits (first word, words, item names)."""
        n = len(self.off) - 1
        edge = np.zeros(len(self.starts) + 1, np.int64)
        items: dict[int, set] = {}
        for i, size, names in hits:
            edge[i] += 1
            edge[i + size] -= 1
            items.setdefault(int(self.text[i]), set()).update(names)
        hit = np.cumsum(edge[:-1]) > 0
        n_hit = np.bincount(self.text[hit], minlength=n) if n else self.count
        # maximal runs of hit words within a text, as places in its bytes
        at = np.flatnonzero(hit)
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (self.text[at[1:]] != self.text[at[:-1]])
        first, last = at[new], at[np.append(new[1:], True)] if len(at) else at
        spans = [[] for _ in range(n)]
        for a, b in zip(first.tolist(), last.tolist()):
            t = int(self.text[a])
            spans[t].append({"start": int(self.starts[a] - self.off[t]), "end": int(self.ends[b] - self.off[t])})
        return [pa.array(self.count, pa.int64()), pa.array(n_hit, pa.int64()),
                pa.array([sorted(items.get(t, ())) for t in range(n)], pa.list_(pa.string())), pa.array(spans, _FOUND_TYPE)]


def _hash_set(rows):
    """(items of every window, sorted hashes of the windows of every size): plain values to broadcast."""
    items: dict[bytes, list[str]] = {}
    hashes: dict[int, set] = {}
    for r in rows:
        items.setdefault(bytes(r["window"]), []).append(r["item"])
        hashes.setdefault(r["words"], set()).add(r["hash"])
    return items, {n: np.sort(np.array(list(h), np.int64).view(np.uint64)) for n, h in hashes.items()}


class _Known:
    """A hash set in a task."""

    def __init__(self, items, hashes):
        self.items, self.hashes = items, hashes
        # the high bits of the hashes, so that most windows need no search
        self.high = {n: np.zeros(1 << 20, bool) for n in self.hashes}
        for n, h in self.hashes.items():
            self.high[n][(h >> np.uint64(44)).astype(np.int64)] = True

    def known(self, n):
        def test(h):
            out = self.high[n][(h >> np.uint64(44)).astype(np.int64)]
            at = np.flatnonzero(out)
            place = np.minimum(np.searchsorted(self.hashes[n], h[at]), len(self.hashes[n]) - 1)
            out[at] = self.hashes[n][place] == h[at]
            return out
        return test

    def hits(self, text: _Text):
        for n in self.hashes:
            for i, _ in zip(*text.candidates(n, self.known(n))):
                names = self.items.get(text.window(i, n))
                if names:
                    yield i, n, names


def _scan(windows, names):
    def run(batches):
        known = _Known(*windows.value)
        for batch in batches:
            for piece in pieces(batch, "_text"):
                text = _Text(piece.column(piece.num_columns - 1))
                yield pa.RecordBatch.from_arrays(piece.columns[:-1] + text.rows(known.hits(text)), names=names)
    return run


def _found_by_set(own: DataFrame, windows: DataFrame) -> DataFrame:
    sent = own.sparkSession.sparkContext.broadcast(_hash_set(windows.toLocalIterator()))  # its size has been checked
    kept = own.drop("_text")
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept.schema] + [_FOUND])
    return own.mapInArrow(_scan(sent, [*kept.columns, "n_words", "n_hit", "items", "spans"]), schema)


def _bitmap(windows: DataFrame) -> np.ndarray:
    """Which cells of the fixed bitmap the windows' hashes fall in."""
    def run(batches):
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            cell = np.unique(h >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell // 8), pa.array(1 << (cell % 8))], names=["at", "bits"])
    cells = windows.select("hash").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.expr("bit_or(bits)").alias("bits"))
    out = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    for r in cells.toLocalIterator():  # at most 2^24 cells, whatever the benchmark
        out[r["at"]] = r["bits"]
    return out


def _candidate_windows(bitmap, sizes):
    def run(batches):
        bits = bitmap.value

        def known(h):
            cell = (h >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
            return (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 > 0

        for batch in batches:
            for piece in pieces(batch, "_text"):
                text, digest, place, size, window = _Text(piece.column(1)), [], [], [], []
                names = piece.column(0).to_pylist()
                first = np.cumsum(text.count) - text.count
                for n in sizes:
                    for i, _ in zip(*text.candidates(n, known)):
                        t = int(text.text[i])
                        digest.append(names[t])
                        place.append(int(i - first[t]))
                        size.append(n)
                        window.append(text.window(i, n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digest, pa.binary()), pa.array(place, pa.int64()), pa.array(size, pa.int32()), pa.array(window, pa.binary())],
                    names=["_digest", "place", "words", "window"])
    return run


def _marked(names):
    """Rows with their text's hits -> rows with what was found."""
    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "_text"):
                text = _Text(piece.column(piece.schema.get_field_index("_text")))
                first = np.cumsum(text.count) - text.count
                hits = [(int(first[t]) + h["place"], h["words"], h["items"])
                        for t, found in enumerate(piece.column(piece.schema.get_field_index("_hits")).to_pylist()) for h in found or ()]
                yield pa.RecordBatch.from_arrays(piece.columns[:-2] + text.rows(hits), names=names)
    return run


def _found_by_join(own: DataFrame, windows: DataFrame) -> DataFrame:
    """For any size of benchmark.  Equal texts are one; hits go by the text's digest."""
    sizes = sorted(r["words"] for r in windows.select("words").distinct().collect())  # at most ``length`` sizes
    bitmap = own.sparkSession.sparkContext.broadcast(_bitmap(windows))
    own = own.withColumn("_digest", F.unhex(F.sha2(F.coalesce("_text", F.lit("")), 256)))
    found = own.select("_digest", "_text").mapInArrow(
        _candidate_windows(bitmap, sizes), "_digest binary, place long, words int, window binary").dropDuplicates(["_digest", "place", "words"])
    items = windows.groupBy("window").agg(F.collect_set("item").alias("items"))
    hits = found.join(items, "window").groupBy("_digest").agg(F.collect_list(F.struct("place", "words", "items")).alias("_hits"))
    names = [c for c in own.columns if c not in ("_text", "_digest")]
    schema = ", ".join([f"{c} {own.schema[c].dataType.simpleString()}" for c in names] + [_FOUND])
    both = own.join(hits, "_digest", "left").select(*names, "_text", "_hits")
    return both.mapInArrow(_marked([*names, "n_words", "n_hit", "items", "spans"]), schema)


def _found(own: DataFrame, benchmark: DataFrame, length: int, set_bytes: int) -> DataFrame:
    windows = cut_lineage(windows_of(benchmark, length))
    size = windows.agg(F.sum(F.octet_length("window") + F.octet_length("item") + 100)).first()[0] or 0
    if size <= set_bytes:
        return _found_by_set(own, windows)
    return _found_by_join(own, windows)


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, id_col: str = "doc_id",
                  text_col: str = "text", set_bytes: int = SET_BYTES) -> DataFrame:
    """One row per document: its id, n_words, n_hit (words inside any window), items (sorted ids of
    the items with a window in it) and spans (maximal runs of hit words, as bytes of the text)."""
    own = docs.select(F.col(id_col).alias("own_0"), F.col(text_col).alias("_text"))
    return _found(own, benchmark, length, set_bytes).withColumnRenamed("own_0", id_col)


def decontaminated(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, remove: str = "spans",
                   text_col: str = "text", set_bytes: int = SET_BYTES) -> DataFrame:
    """``docs`` without benchmark passages: each run of hit words is cut out of its text
    (``remove="spans"``), or the documents that hold one go (``"documents"``)."""
    if remove not in ("spans", "documents"):
        raise ValueError(remove)
    names = docs.columns
    own = docs.select(*[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(names)], F.col(f"`{text_col}`").alias("_text"))
    found = _found(own, benchmark, length, set_bytes)
    if remove == "documents":
        return found.filter("n_hit = 0").select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(names)])
    raw = F.col(f"own_{names.index(text_col)}").cast("binary")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["end"]))
    starts = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.octet_length(raw).cast("long")))
    parts = F.zip_with(ends, starts, lambda a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")).cast("string"))
    text = F.when(F.size("spans") == 0, F.col(f"own_{names.index(text_col)}")).otherwise(F.array_join(parts, ""))
    return found.select(*[(text if c == text_col else F.col(f"own_{i}")).alias(c) for i, c in enumerate(names)])


def digests(found: DataFrame) -> DataFrame:
    """Of ``contamination``'s rows: counts, and the items as one hash."""
    return found.withColumn("n_items", F.size("items").cast("long")) \
        .withColumn("items_sha256", F.sha2(F.array_join("items", ",").cast("binary"), 256)) \
        .withColumn("contaminated", F.col("n_hit") > 0).drop("items", "spans")
