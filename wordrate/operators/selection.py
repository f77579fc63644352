"""Distributed selection: the row at a given place of a seeded order, without moving rows.

Rows are ordered by (hash, key), per stratum.  The place sought is narrowed down by
histograms: one aggregate counts the rows by the next hex digits of the hash, the counts
tell which bin holds the place, and the next aggregate counts that bin alone.  Hashes are
spread evenly, so a bin shrinks by ``16 ** DIGITS`` each time; once it is small, or holds one
key only (however many rows share it), its distinct keys are read and the row is known.
Only the hash's and the stratum's columns are read, nothing wider than a bin's count is
shuffled, and the driver holds at most ``16 ** DIGITS`` counts a stratum.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 3
#: Rows of a bin whose distinct keys are read.
SMALL = 10_000


@dataclass(frozen=True)
class Place:
    """A row of the order: rows before (hash, key) number less than ``take`` of ``total``, and
    ``needed`` of the ``equal`` rows with that hash and key fill it up."""

    total: int
    take: int
    hash: str | None = None
    key: Any = None
    needed: int = 0
    equal: int = 0


def _counts(rows: DataFrame, open_bins: dict, depth: int) -> dict:
    """(stratum, next digits) -> (rows, whether all have one key) in the bins still looked into."""
    digits = F.substring("h", 1 + DIGITS * depth, DIGITS)
    kept = rows
    if depth:
        kept = rows.where(F.lit(False) if not open_bins else _any(
            [_same("stratum", s) & F.col("h").startswith(b["prefix"]) for s, b in open_bins.items()]))
    found = kept.groupBy("stratum", digits.alias("d")).agg(
        F.count(F.lit(1)).alias("n"), (F.min("x") == F.max("x")).alias("one"))
    out: dict = {}
    for r in found.collect():  # at most 16 ** DIGITS + 1 bins a stratum
        out.setdefault(r["stratum"], {})[r["d"]] = (r["n"], r["one"])
    return out


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _same(column: str, value) -> Column:
    return F.col(column).isNull() if value is None else F.col(column) == F.lit(value)


def places(df: DataFrame, order_hash: Column, key: Column, take: Callable[[Any, int], int],
           stratum: Column | None = None) -> dict[Any, Place]:
    """Of every stratum, the place of the ``take(stratum, rows)``-th row in the order of
    (``order_hash``, a string of hex digits, and ``key``); nulls come first."""
    h = F.coalesce(order_hash, F.lit(""))
    # x tells whether a bin holds several keys; the keys themselves are read later
    rows = df.select((F.lit(0) if stratum is None else stratum).alias("stratum"), h.alias("h"), key.alias("key"), F.xxhash64(key).alias("x"))
    out, bins, depth = {}, {}, 0
    small: dict = {}
    while depth == 0 or bins:
        for s, found in _counts(rows, bins, depth).items():
            if depth == 0:
                total = sum(n for n, _ in found.values())
                at = min(max(int(take(s, total)), 0), total)
                out[s] = Place(total, at)
                if not 0 < at < total:
                    continue
                bins[s] = {"prefix": "", "left": at}
            b = bins[s]
            for d in sorted(found):
                n, one = found[d]
                if b["left"] <= n:
                    break
                b["left"] -= n
            b["prefix"] += d
            if n <= SMALL or one or len(b["prefix"]) < DIGITS * (depth + 1):  # short: the hash has no digits left
                small[s] = bins.pop(s)
        depth += 1
    if small:
        kept = rows.where(_any([_same("stratum", s) & (F.col("h").startswith(b["prefix"]) if b["prefix"] else F.col("h") == "")
                                for s, b in small.items()]))
        keys = kept.groupBy("stratum", "h", "key").agg(F.count(F.lit(1)).alias("n"))
        found = {}
        for r in keys.orderBy("stratum", "h", F.col("key").asc_nulls_first()).collect():  # SMALL rows a stratum, or one key
            found.setdefault(r["stratum"], []).append(r)
        for s, b in small.items():
            left = b["left"]
            for r in found[s]:
                if left <= r["n"]:
                    out[s] = Place(out[s].total, out[s].take, r["h"], r["key"], left, r["n"])
                    break
                left -= r["n"]
    return out


def up_to(place: Place, order_hash: Column, key: Column, key_type) -> tuple[Column, Column]:
    """(whether a row comes before the place, whether it has the place's hash and key)."""
    if place.hash is None:  # nothing or everything is taken
        return F.lit(place.take > 0), F.lit(False)
    h, k = F.coalesce(order_hash, F.lit("")), F.lit(place.key).cast(key_type)
    less = key.isNull() & k.isNotNull() | F.coalesce(key < k, F.lit(False))
    return (h < place.hash) | ((h == place.hash) & less), (h == place.hash) & key.eqNullSafe(k)
