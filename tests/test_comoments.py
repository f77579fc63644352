"""Correlation matrices against pandas and numpy: missing cells, ties, constants, both ways to the ranks."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wordrate.operators import agreement as AG
from wordrate.operators import comoments as CM

NAMES = list("abcdef")


def table(n, seed):
    r = np.random.default_rng(seed)
    x = pd.DataFrame({"a": r.integers(0, 5, n) * 1.0, "b": r.normal(1e6, 1, n), "c": np.full(n, 0.1), "d": r.integers(0, 50, n) / 7, "e": r.normal(size=n)})
    x["f"] = x.a + x.e  # correlated with two others
    for c, share in (("a", 0.1), ("b", 0.3), ("d", 0.05), ("f", 0.5)):
        x.loc[r.random(n) < share, c] = np.nan
    return x


def frame(spark, x, parts=7):
    rows = [[None if np.isnan(v) and i % 2 else float(v) for v in row] for i, row in enumerate(x.to_numpy())]  # nulls and NaN are missing
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in x.columns)).repartition(parts)


def expected(x, method):
    out = {}
    for i in x.columns:
        for j in x.columns:
            both = x[[i, j]].dropna() if i != j else x[[i]].dropna()
            a, b = both[i], both[j if i != j else i]
            if method == "spearman":
                a, b = a.rank(), b.rank()
            ok = len(both) and a.nunique() > 1 and b.nunique() > 1
            out[i, j] = (pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-9) if ok else None, len(both))
    return out


def cells(df):
    return {(r.col_x, r.col_y): (r.r, r.n) for r in df.collect()}


@pytest.mark.parametrize("n,seed", [(3000, 1), (3, 2), (1, 3)])
def test_matrices_match_numpy(spark, n, seed):
    x = table(n, seed)
    df = frame(spark, x)
    assert cells(AG.pearson_matrix(df, NAMES)) == expected(x, "pearson")
    assert cells(AG.spearman_matrix(df, NAMES, 5)) == expected(x, "spearman")


def test_ranks_by_join_equal_ranks_by_broadcast(spark):
    x = table(2000, 4)
    x["e"] = 1.0 * (x.e > -0.4)  # one value with most of the rows
    far = CM.value_and_rank_moments(frame(spark, x), NAMES, 3, rank_bytes=0).collect()
    near = CM.value_and_rank_moments(frame(spark, x), NAMES, 3).collect()
    for got in (far, near):
        assert {(r.col_x, r.col_y): (r.spearman, r.n) for r in got} == expected(x, "spearman")
        assert {(r.col_x, r.col_y): (r.pearson, r.n) for r in got} == expected(x, "pearson")


def test_combined_from_one_scan(spark):
    x = table(500, 5)
    df = frame(spark, x)
    one = AG.combined_correlations(df, NAMES).collect()
    two = AG.combined_matrix(AG.pearson_matrix(df, NAMES), AG.spearman_matrix(df, NAMES), NAMES).collect()
    assert sorted((r.col_x, r.col_y, r.label) for r in one) == sorted((r.col_x, r.col_y, r.label) for r in two)


def test_empty_and_missing_tables(spark):
    none = frame(spark, table(5, 6)).limit(0)
    want = {(i, j): (None, 0) for i in NAMES for j in NAMES}
    assert cells(AG.pearson_matrix(none, NAMES)) == want and cells(AG.spearman_matrix(none, NAMES)) == want
    blank = spark.createDataFrame([(None, float("nan")), (None, 1.0)], "a double, b double")
    assert cells(AG.spearman_matrix(blank, ["a", "b"])) == {("a", "a"): (None, 0), ("a", "b"): (None, 0), ("b", "a"): (None, 0), ("b", "b"): (None, 1)}


def test_infinite_values(spark):
    df = spark.createDataFrame([(1.0, 2.0), (float("inf"), 3.0), (2.0, 9.0)], "a double, b double")
    p, s = cells(AG.pearson_matrix(df, ["a", "b"])), cells(AG.spearman_matrix(df, ["a", "b"]))
    assert np.isnan(p["a", "b"][0]) and p["b", "b"] == (pytest.approx(1.0), 3)
    assert s["a", "b"] == (pytest.approx(0.5), 3)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([np.nan, 0.1, 0.1, 1e9, 1e9 + 1, -3.0, 7.5]), min_size=3, max_size=3), min_size=1, max_size=30), st.data())
def test_states_merge_as_their_rows_do(rows, data):
    x = np.array(rows)
    cut = data.draw(st.integers(0, len(rows)))
    whole = CM._of_rows(x)
    parts = CM._merged(CM._of_rows(x[:cut]) if cut else CM._zero(3), CM._of_rows(x[cut:]) if cut < len(rows) else CM._zero(3))
    for part in (CM._N, CM._ALL, CM._LO, CM._HI):
        assert np.array_equal(whole[part], parts[part])
    ok = whole[CM._N] > 0
    assert np.allclose(whole[CM._MEAN][ok], parts[CM._MEAN][ok], rtol=1e-12)
    scale = 1 + whole[CM._SQ] + whole[CM._SQ].T
    assert np.all(np.abs(whole[CM._SQ] - parts[CM._SQ]) <= 1e-9 * scale) and np.all(np.abs(whole[CM._CO] - parts[CM._CO]) <= 1e-9 * scale)
