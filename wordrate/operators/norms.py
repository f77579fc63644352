"""Merging estimates into norm tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def pick_prefixed(df: DataFrame, *prefixes: str) -> DataFrame:
    """Columns whose name starts with any prefix, in table order."""
    return df.select(*[c for c in df.columns if c.startswith(prefixes)])


def rename_substring(df: DataFrame, old: str, new: str) -> DataFrame:
    """Rename every column containing ``old`` (e.g. ``logprobs_`` -> ``fam_``)."""
    return df.withColumnsRenamed({c: c.replace(old, new) for c in df.columns if old in c})


def combine_norms(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                  suffix: str = "_new", null_keys: str = "match") -> tuple[DataFrame, list[str]]:
    """Left outer join on differently named keys, then exact duplicates dropped.

    The key keeps the left name; right columns that are new to the left get
    ``suffix``; columns present on both sides get ``_x`` / ``_y``.  NULL keys match
    each other (``null_keys="match"``, the pandas rule) or never (``"drop"``).
    Returns the merged table and the list of suffixed columns (U4).
    """
    right_cols = [c for c in right.columns if c != right_key]
    new_cols = [c for c in right_cols if c not in left.columns]
    shared = [c for c in right_cols if c in left.columns and c != left_key]
    r = right.select(F.col(right_key).alias("_rk"),
                     *[F.col(c).alias(c + suffix) if c in new_cols else F.col(c).alias(c + "_y") for c in right_cols])
    lft = left.withColumnsRenamed({c: c + "_x" for c in shared})
    cond = lft[left_key].eqNullSafe(r["_rk"]) if null_keys == "match" else lft[left_key] == r["_rk"]
    merged = lft.join(r, cond, "left").drop("_rk").dropDuplicates()
    return merged, [c + suffix for c in new_cols]


def missing_rows(merged: DataFrame, new_cols: list[str]) -> DataFrame:
    """X22 + F5 (K6 report): rows where any new right-side column is missing or blank."""
    types = dict(merged.dtypes)
    return merged.filter(X.missing_or_blank(*new_cols, types=types))


def render_missing(df: DataFrame, sentinel: str = "#N/D") -> DataFrame:
    """X21 at the sink: every column as text with missing cells as the sentinel."""
    return df.select(*[X.sentinel(c, sentinel).alias(c) for c in df.columns])
