"""Removal of repeated byte passages, the copy in the smallest document kept.

A byte goes if it lies in a string of ``length`` bytes that also starts in a document with
a smaller doc_id: where its longest previous factor, the longest match in an earlier document,
is ``length`` or more.  In suffix order that match is with the previous or the next suffix of
smaller origin, so these two and what neighbours share between them give every factor.

The suffixes are dealt out so that equal strings always meet.  The smallest hash among the
k-grams of a ``length``-byte window (its anchor) depends on the window's bytes alone, and
consecutive windows mostly share it, so a text falls into runs of windows of one anchor.
Runs go to the task of their anchor; there, runs whose bytes are equal are one class, whose
smallest document keeps them, and the factors of the classes' windows settle the rest.

* texts that are equal count as one: all of a later copy goes, and only the first is read on;
* pass 1 finds the anchors that occur in at least two texts (exactly, per range of hashes) and
  marks them in a bitmap of fixed size; a false mark costs a row, never a result;
* pass 2 sends the runs of marked anchors;
* an anchor with too many classes for one task is settled window by window, by aggregates;
* the spans found come back to their documents in one join.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordrate.session import cut_lineage, ensure_checkpoint_dir

from . import hashing as H
from .batches import bounded, let_go, pieces, small_batches

_U = np.uint64
GRAM = 16  # bytes of an anchor
BITMAP_BITS = 28  # 32 MB, whatever the input
_LOW = _U((1 << 40) - 1)
CLASS_LIMIT = 100_000  # rows of one anchor held in a task
TEXT_BYTES = 1 << 18  # bytes of text hashed at a time; a task holds some 100 times as many
HASHES = 1 << 18  # hashes of anchors sent together, a row for each range
RUN_BYTES = 1 << 20  # bytes of runs settled at a time; a task holds some 100 times as many

#: ``places``: where in the text the run is found, little-endian 32-bit numbers.
_RUNS = "anchor long, run binary, doc_id long, tkey long, places binary"
_FOUND = "doc_id long, tkey long, span long, run binary, places binary"


def _runs(raw: np.ndarray, off: np.ndarray, length: int):
    """(anchor hash, first window, last window, text) of each run; positions in ``raw``."""
    none = np.zeros(0, np.int64)
    count = len(raw) - length + 1
    if count <= 0:
        return none.astype(_U), none, none, none
    g = H.byte_windows(raw, GRAM)
    # hash in the high half, place in the low half: the minimum is the leftmost smallest hash
    low = (g >> _U(32) << _U(32)) | np.arange(len(g), dtype=_U)
    span, width = length - GRAM + 1, 1
    m = low
    while width * 2 <= span:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    m = np.minimum(m[:len(m) - (span - width)], m[span - width:]) if span > width else m
    at = (m[:count] & _U(0xFFFFFFFF)).astype(np.int64)
    # a window must lie in one text
    size = np.diff(off)
    ok = np.zeros(count + 1, np.int64)
    long = size >= length
    np.add.at(ok, off[:-1][long], 1)
    np.add.at(ok, np.minimum(off[1:][long] - length + 1, count), -1)
    start = np.flatnonzero(np.cumsum(ok[:count]) > 0)
    if len(start) == 0:
        return none.astype(_U), none, none, none
    p = at[start]
    new = np.ones(len(start), bool)
    new[1:] = (p[1:] != p[:-1]) | (start[1:] != start[:-1] + 1)
    first = start[new]
    last = start[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]
    return g[p[new]], first, last, np.searchsorted(off, first, side="right") - 1


def _anchors(length: int, ranges: int):
    """Pass 1: the hashes of each text's anchors, once a text, by range; of several texts sent
    together that share one, two are sent."""
    def sent(parts):
        u, c = np.unique(np.concatenate(parts), return_counts=True)
        u = np.sort(np.concatenate([u, u[c > 1]]))
        r = (u % _U(ranges)).astype(np.int64)
        order = np.argsort(r, kind="stable")
        u, r = u[order], r[order]
        cut = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else []
        return pa.RecordBatch.from_arrays(
            [pa.array(r[cut], pa.int64()), pa.array([_short(x) for x in np.split(u, cut[1:])] if len(r) else [], pa.binary())],
            names=["range", "hashes"])

    def run(batches):
        parts, held = [], 0
        for big in batches:
            for batch in pieces(big, "text", TEXT_BYTES):
                raw, off = H.buffer_of(batch.column(batch.schema.get_field_index("text")))
                h, _, _, text = _runs(raw, off, length)
                order = np.lexsort((text, h))
                h, text = h[order], text[order]
                once = np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1]))[:len(h)]
                parts.append(h[once] & _LOW)
                held += len(parts[-1])
                if held >= HASHES:
                    yield sent(parts)
                    parts, held = [], 0
        if parts:
            yield sent(parts)
        let_go()
    return run


def _short(h: np.ndarray) -> bytes:
    """Five bytes of every hash: two that agree by chance only mark an anchor too many."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _long(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = _U((1 << BITMAP_BITS) - 1)
    return (h & mask).astype(np.int64), (h >> _U(40 - BITMAP_BITS) & mask).astype(np.int64)


def _repeated(batches):
    """The bits of the hashes that were sent at least twice, for the ranges of this task."""
    found = []
    rows: dict[int, list] = {}
    for batch in batches:
        for r, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows.setdefault(r, []).append(_long(b))
    for parts in rows.values():
        h = np.sort(np.concatenate(parts))
        parts.clear()
        found.append(np.unique(h[1:][h[1:] == h[:-1]]))
    if found:
        a, b = _places(np.concatenate(found))
        bits = np.unique(np.concatenate([a, b]))
        word, mask = bits >> 16, bits & 0xFFFF
        cut = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(bits) else []
        yield pa.RecordBatch.from_arrays(
            [pa.array(word[cut], pa.int64()), pa.array([x.astype("<u2").tobytes() for x in np.split(mask, cut[1:])] if len(bits) else [], pa.binary())],
            names=["page", "bits"])
    let_go()


def _page(batches):
    """One 8 KB page of the bitmap from the bits of all tasks; rows sorted by page."""
    page, bits = None, None
    def row():
        return pa.RecordBatch.from_arrays([pa.array([page], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["page", "bits"])
    for batch in batches:
        for p, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if p != page:
                if page is not None:
                    yield row()
                page, bits = p, np.zeros(1 << 16, np.uint8)
            bits[np.frombuffer(b, "<u2")] = 1
    if page is not None:
        yield row()


def _marked(length: int, bitmap):
    """Pass 2: the runs whose anchor is marked."""
    def run(batches):
        for big in batches:
            for batch in pieces(big, "text", TEXT_BYTES):
                raw, off = H.buffer_of(batch.column(2))
                h, first, last, text = _runs(raw, off, length)
                a, b = _places(h & _LOW)
                bits = bitmap.value
                hit = ((bits[a >> 3] >> (a & 7).astype(np.uint8)) & (bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)
                h, first, last, text = h[hit], first[hit], last[hit], text[hit]
                # a run that repeats in its text is sent once; its first and last window
                # cover it, so their hashes tell it
                w = H.byte_windows(raw, length)
                order = np.lexsort((first, w[last], w[first], h, text))
                h, first, last, text = h[order], first[order], last[order], text[order]
                new = np.ones(len(h), bool)
                new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1]) | (w[first[1:]] != w[first[:-1]]) | (w[last[1:]] != w[last[:-1]])
                places = (first - off[text]).astype("<i4")
                edge = np.append(np.flatnonzero(new), len(h)).astype(np.int32)
                h, first, last, text = h[new], first[new], last[new], text[new]
                size = last - first + length
                ends = np.cumsum(size)
                idx = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)
                data = raw[idx] if len(idx) else raw[:0]

                def binary(offsets, values):
                    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])

                take = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((h >> _U(33)).astype(np.int64)), binary(np.append(0, ends), data), batch.column(0).take(take), batch.column(1).take(take), binary(4 * edge, places)],
                    names=["anchor", "run", "doc_id", "tkey", "places"])
        let_go()
    return run


def _suffix_order(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): the suffixes from ``at`` in order of their first ``length`` bytes, by prefix
    doubling, and the bytes (up to ``length``) that each shares with the one before it."""
    padded = np.append(data, np.zeros(8, np.uint8)).astype(_U)
    word = np.zeros(len(data), _U)
    for j in range(8):
        word = word << _U(8) | padded[j:len(data) + j]
    ranks, width = [np.unique(word, return_inverse=True)[1].astype(np.int64)], 8
    while width * 2 <= length:
        rank = ranks[-1]
        nxt = np.zeros(len(rank), np.int64)
        nxt[:-width] = rank[width:] + 1
        ranks.append(np.unique(rank * (len(rank) + 2) + nxt, return_inverse=True)[1].astype(np.int64))
        width *= 2
    key = ranks[-1][at] * (len(data) + 2) + ranks[-1][at + length - width]
    order = np.argsort(key, kind="stable")
    key, pos = key[order], at[order]
    lcp = np.zeros(len(pos), np.int64)
    lcp[1:][key[1:] == key[:-1]] = length
    other = np.flatnonzero(key[1:] != key[:-1]) + 1
    x, y, same = pos[other - 1], pos[other], np.zeros(len(other), np.int64)
    for rank in reversed(ranks):  # shared blocks of 32, 16 and 8 bytes, each once at most
        same[rank[x + same] == rank[y + same]] += width
        width //= 2
    rest = word[x + same] ^ word[y + same]
    for j in range(1, 8):
        same += rest < _U(1) << _U(64 - 8 * j)
    lcp[other] = np.minimum(same, length - 1)
    return order, lcp


def _before(lcp: np.ndarray, origin: np.ndarray) -> np.ndarray:
    """What each suffix shares with the previous one of smaller origin in the order (0: none).

    Every suffix points at the one before it; while that is of no smaller origin, it points on
    to where that one points, as all between are of no smaller origin either."""
    ptr, least = np.arange(len(lcp)) - 1, lcp.copy()
    act = np.flatnonzero(least > 0)
    while len(act):
        p = ptr[act]
        on = (p >= 0) & (origin[p] >= origin[act])
        act, p = act[on], p[on]
        share, to = np.minimum(least[act], least[p]), ptr[p]
        least[act], ptr[act] = share, to
        act = act[share > 0]
    # what still points at a suffix of no smaller origin shares nothing with any before it
    return np.where((ptr >= 0) & (origin[ptr] < origin), least, 0)


def longest_previous_factors(data: np.ndarray, first: np.ndarray, count: np.ndarray, origin: np.ndarray, length: int):
    """(string, offset, factor) of the windows of several strings laid end to end in ``data``: the
    longest match, up to ``length`` bytes, with a window of a string of smaller ``origin``.
    String i has ``count[i]`` windows from ``first[i]`` on.

    In suffix order the longest match is with the previous or the next suffix of smaller origin;
    it is as long as the least that neighbours between them share."""
    string = np.repeat(np.arange(len(first)), count)
    offset = np.arange(len(string)) - np.repeat(np.cumsum(count) - count, count)
    factor = np.zeros(len(string), np.int64)
    if len(string):
        order, lcp = _suffix_order(data, first[string] + offset, length)
        org = origin[string][order]
        after = _before(np.append(0, lcp[:0:-1]), org[::-1])[::-1]
        factor[order] = np.maximum(_before(lcp, org), after)
    return string, offset, factor


def later_copies(data: np.ndarray, first: np.ndarray, count: np.ndarray, origin: np.ndarray, length: int):
    """(string, offset) of the windows whose longest previous factor reaches ``length``."""
    string, offset, factor = longest_previous_factors(data, first, count, origin, length)
    later = np.flatnonzero(factor >= length)
    return string[later], offset[later]


def _pack(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Windows first..last of a run, counted from its start, as one number."""
    return first.astype(np.int64) << 16 | (last - first)


def _settle(length: int, limit: int):
    """Rows sorted by (anchor, run, doc_id) in; spans out.  ``span`` null: a class of an
    anchor with more than ``limit`` rows, to be settled window by window."""
    def rows_of(t, rows, span, with_run):
        """(doc_id, tkey, span, run, places) of some rows of ``t``."""
        p = t.take(pa.array(rows)).combine_chunks()
        col = lambda n: p[n].combine_chunks()
        span = pa.nulls(len(rows), pa.int64()) if span is None else pa.array(span)
        run = col("run") if with_run else pa.nulls(len(rows), pa.binary())
        return pa.RecordBatch.from_arrays([col("doc_id"), col("tkey"), span, run, col("places")], names=["doc_id", "tkey", "span", "run", "places"])

    def classes(t, before):
        """(class of each row, its smallest document); ``before``: an earlier row of the first class."""
        anchor, run, doc = t["anchor"].to_numpy(), t["run"].combine_chunks(), t["doc_id"].to_numpy()
        new = np.ones(len(doc), bool)
        if len(doc) > 1:
            new[1:] = (anchor[1:] != anchor[:-1]) | pc.not_equal(run[1:], run[:-1]).to_numpy(zero_copy_only=False)
        cls = np.cumsum(new) - 1
        low = doc[new]
        if before is not None and before["anchor"][0].as_py() == anchor[0] and before["run"][0].as_py() == run[0].as_py():
            low[0] = min(low[0], before["doc_id"][0].as_py())
        return new, cls, low

    def spans(t, rows, first, last):
        return rows_of(t, rows, _pack(first, last), False) if len(rows) else None

    def whole(t, new, cls, low):
        """Rows of a class whose smallest document is another one: all windows go."""
        rows = np.flatnonzero(t["doc_id"].to_numpy() > low[cls])
        size = pc.binary_length(t["run"]).to_numpy().astype(np.int64)[rows]
        return spans(t, rows, np.zeros(len(rows), np.int64), size - length)

    def group(t):
        """Whole anchors."""
        new, cls, low = classes(t, None)
        yield whole(t, new, cls, low)
        anchor = t["anchor"].to_numpy()
        heads = np.flatnonzero(new)
        ga = anchor[heads]
        gnew = np.append(True, ga[1:] != ga[:-1])
        g = np.cumsum(gnew) - 1
        many = np.bincount(g)[g] >= 2
        heads = heads[many]
        if len(heads) == 0:
            return
        own = low[cls[heads]]
        raw, off = H.buffer_of(t["run"].take(pa.array(heads)).combine_chunks())
        string, offset = later_copies(raw, off[:-1], np.diff(off) - length + 1, own, length)
        if len(string) == 0:
            return
        edge = np.append(True, (string[1:] != string[:-1]) | (offset[1:] != offset[:-1] + 1))
        end = np.append(np.flatnonzero(edge)[1:] - 1, len(string) - 1)
        c, lo, hi = cls[heads[string[edge]]], offset[edge], offset[end]
        # every row of the class that belongs to its smallest document
        mine = np.flatnonzero(t["doc_id"].to_numpy() == low[cls])
        a, b = np.searchsorted(cls[mine], c), np.searchsorted(cls[mine], c, side="right")
        rep = np.repeat(np.arange(len(c)), b - a)
        rows = mine[np.arange(len(rep)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)]
        yield spans(t, rows, lo[rep], hi[rep])

    def crowd(t, before):
        """A part of an anchor with too many rows: what is settled, and the classes' own rows."""
        new, cls, low = classes(t, before)
        yield whole(t, new, cls, low)
        rows = np.flatnonzero(t["doc_id"].to_numpy() == low[cls])
        if len(rows):
            yield rows_of(t, rows, None, True)

    def run(batches):
        held, crowded, before = None, None, None
        def flush(t):
            """Complete anchors of ``t``, in pieces of bounded size."""
            nonlocal crowded, before
            anchor = t["anchor"].to_numpy()
            if crowded is not None:
                n = int(np.searchsorted(anchor != crowded, True)) if (anchor != crowded).any() else len(anchor)
                if n:
                    yield from crowd(t.slice(0, n).combine_chunks(), before)
                    before = t.slice(n - 1, 1)
                if n == len(anchor):
                    return
                crowded = before = None
                t = t.slice(n).combine_chunks()
                anchor = anchor[n:]
            ends = np.cumsum(pc.binary_length(t["run"]).to_numpy().astype(np.int64))
            at = 0
            while at < len(anchor):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + RUN_BYTES, side="right")))
                while to < len(anchor) and anchor[to] == anchor[to - 1]:
                    to += 1
                yield from group(t.slice(at, to - at).combine_chunks())
                at = to
        for batch in batches:
            if batch.num_rows == 0:
                continue
            t = pa.Table.from_batches([batch])
            if held is not None and held.num_rows:
                t = pa.concat_tables([held, t])
            t = t.combine_chunks()
            anchor = t["anchor"].to_numpy()
            last = anchor[-1]
            other = np.flatnonzero(anchor != last)
            n = int(other[-1]) + 1 if len(other) else 0
            done, held = t.slice(0, n), t.slice(n)
            if n:
                yield from (x for x in flush(done.combine_chunks()) if x is not None)
            if crowded is not None and last == crowded or held.num_rows > limit:
                if crowded != last:
                    crowded, before = last, None
                yield from (x for x in flush(held.combine_chunks()) if x is not None)
                held = None
        if held is not None and held.num_rows:
            yield from (x for x in flush(held.combine_chunks()) if x is not None)
        let_go()
    return run


def _cut(length: int):
    def run(batches):
        for big in batches:
            for batch in pieces(big, "text", TEXT_BYTES):
                keep, size, gone, parts = [], [], [], []
                texts, spans = batch.column(1), batch.column(2)
                for i in range(batch.num_rows):
                    raw = (texts[i].as_py() or "").encode()
                    s = spans[i].values
                    if s is not None and len(s) == 0:  # a whole copy
                        keep.append(b"")
                        size.append(len(raw))
                        gone.append(len(raw))
                        parts.append([{"start": 0, "end": len(raw)}])
                        continue
                    if s is None:
                        keep.append(raw)
                        size.append(len(raw))
                        gone.append(0)
                        parts.append([])
                        continue
                    span, places = s.field("span").to_numpy(), s.field("places")
                    n = pc.binary_length(places).to_numpy() // 4
                    first = np.frombuffer(b"".join(places.to_pylist()), "<i4") + np.repeat(span >> 16, n)
                    last = first + np.repeat(span & 0xFFFF, n) + length
                    d = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(d, first, 1)
                    np.add.at(d, last, -1)
                    out = np.cumsum(d[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], out.view(np.int8), [0]])))
                    keep.append(np.frombuffer(raw, np.uint8)[~out].tobytes())
                    size.append(len(raw))
                    gone.append(int(out.sum()))
                    parts.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()),
                     pa.array(parts, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(keep, pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "removed", "kept"])
        let_go()
    return run


COPIES = 2_000_000  # later copies up to which they are told by a broadcast


def later_whole_copies(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, tkey) of the documents whose whole text, of ``length`` bytes or more, is that of a
    document with a smaller id."""
    long = docs.filter((F.octet_length("text") >= length) & F.col("doc_id").isNotNull()).select("doc_id", "tkey", F.md5("text").alias("h"))
    low = long.groupBy("h").agg(F.min("doc_id").alias("low"))
    found = cut_lineage(long.join(low, "h").filter("doc_id > low").select("doc_id", "tkey").distinct())
    return bounded(found, COPIES)


def repeated_spans(docs: DataFrame, length: int = 50, class_limit: int = CLASS_LIMIT) -> DataFrame:
    """(doc_id, tkey, spans) of the documents with later copies.  A span has the windows of a
    run that go, as the first of them (from the run's start) and how many follow, and the
    places of the run in the text.  ``docs``: doc_id, tkey, text."""
    spark = docs.sparkSession
    docs = docs.filter("doc_id is not null")
    n = spark.conf.get("spark.sql.shuffle.partitions")
    ranges = 4 * (int(n) if n.isdigit() else spark.sparkContext.defaultParallelism)
    bits = (docs.select("text").mapInArrow(_anchors(length, ranges), "range long, hashes binary")
            .repartition("range").mapInArrow(_repeated, "page long, bits binary")
            .repartition("page").sortWithinPartitions("page").mapInArrow(_page, "page long, bits binary"))
    bitmap = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    for r in bits.collect():  # 32 MB at most: the bitmap's fixed size
        bitmap[r["page"] << 13:(r["page"] + 1) << 13] = np.frombuffer(r["bits"], np.uint8)
    bitmap = spark.sparkContext.broadcast(bitmap)
    runs = docs.select("doc_id", "tkey", "text").mapInArrow(_marked(length, bitmap), _RUNS)
    # written as a table: compressed, and read twice
    path = f"{ensure_checkpoint_dir(spark)}/spans-{uuid.uuid4().hex}"
    (runs.repartition("anchor").sortWithinPartitions("anchor", "run", "doc_id")
         .mapInArrow(_settle(length, class_limit), _FOUND).write.parquet(path))
    found = spark.read.schema(_FOUND).parquet(path)
    # anchors with too many classes: window by window
    each = (found.filter("span is null").select("doc_id", "tkey", "run", "places", F.explode(F.expr(f"sequence(0, length(run) - {length})")).alias("o"))
            .select("doc_id", "tkey", "places", "o", F.expr(f"substring(run, o + 1, {length})").alias("w")))
    low = each.groupBy("w").agg(F.min("doc_id").alias("low"))
    more = each.join(low, "w").filter("doc_id > low").select("doc_id", "tkey", F.shiftleft(F.col("o").cast("long"), 16).alias("span"), "places")
    return (found.filter("span is not null").select("doc_id", "tkey", "span", "places").union(more)
            .groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("span", "places")).alias("spans")))


def remove_later_copies(docs: DataFrame, length: int = 50, class_limit: int = CLASS_LIMIT) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_bytes, n_removed, removed (spans
    of the UTF-8 bytes, end exclusive, maximal), kept (the remaining bytes).

    Null texts are empty.  Rows with a null doc_id are kept whole and count as no earlier
    document; rows of one doc_id never remove each other's bytes.  Texts shorter than
    ``length`` bytes are kept.  Other columns are ignored, an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = _with_spans(docs.withColumn("tkey", F.xxhash64("text")), length, class_limit)
    return docs.select("doc_id", "text", "spans").mapInArrow(
        _cut(length), "doc_id long, n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept binary")


def _with_spans(docs: DataFrame, length: int, class_limit: int) -> DataFrame:
    """``docs(doc_id, tkey, text, ...)`` with spans: null if nothing goes, empty if all goes."""
    small_batches(docs.sparkSession)
    copies = later_whole_copies(docs, length)
    spans = repeated_spans(docs.join(copies, ["doc_id", "tkey"], "left_anti"), length, class_limit)
    every = F.array().cast(spans.schema["spans"].dataType)
    marked = docs.join(copies.withColumn("_copy", F.lit(True)), ["doc_id", "tkey"], "left")
    return (marked.join(spans, ["doc_id", "tkey"], "left")
            .withColumn("spans", F.when(F.col("_copy"), every).otherwise(F.col("spans"))).drop("_copy"))


def without_later_copies(docs: DataFrame, length: int = 50) -> DataFrame:
    """``docs`` with every text cut to its kept bytes (a character that loses some of its
    bytes goes as a whole) and n_chars set to the new length, where that column is there."""
    cols = docs.columns
    own = [F.col(c).alias(f"own_{i}") for i, c in enumerate(cols)]
    marked = docs.select(*own, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = _with_spans(marked.withColumn("tkey", F.xxhash64("text")), length, CLASS_LIMIT)
    changed = F.col("spans").isNotNull()
    text = _kept_text(length)(F.col("text"), F.col("spans"))
    out = marked.withColumn("text", F.when(changed, text).otherwise(F.col("text")))
    final = {"text": F.col("text"), "n_chars": F.when(changed, F.length("text")).otherwise(F.col(f"own_{cols.index('n_chars')}")) if "n_chars" in cols else None}
    return out.select(*[(final[c].cast(docs.schema[c].dataType) if c in final else F.col(f"own_{i}")).alias(c) for i, c in enumerate(cols)])


def _kept_text(length: int):
    @F.arrow_udf("string")
    def kept(text: pa.Array, spans: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([pa.nulls(len(text), pa.int64()), text, spans], names=["doc_id", "text", "spans"])
        return pa.array([b.decode("utf-8", "ignore") for r in _cut(length)([batch]) for b in r.column(4).to_pylist()], pa.string())
    return kept
