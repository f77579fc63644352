"""Operators against brute force on small inputs: numbering, prefix sums, ranks,
splits, histogram, hexbin, combine."""

import random

import pytest
from pyspark.sql import functions as F

from wordrate.operators import agreement as AG
from wordrate.operators import norms as NM
from wordrate.operators import sampling as SP
from wordrate.operators.numbering import prefix_sum, with_row_number


def test_with_row_number_matches_sort(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.randint(0, 50)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v long")
    got = {r["id"]: r["n"] for r in with_row_number(df, ["v", "id"], "n", num_partitions=7).collect()}
    expect = {id_: k + 1 for k, (id_, _) in enumerate(sorted(rows, key=lambda t: (t[1], t[0])))}
    assert got == expect


def test_prefix_sum_matches_brute_force(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("abc"), i, rnd.randint(1, 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, o long, c long")
    got = {(r["g"], r["o"]): r["before"] for r in prefix_sum(df, ["g"], ["o"], "c", "before", 5).collect()}
    for g, o, _ in rows:
        assert got[(g, o)] == sum(c for g2, o2, c in rows if g2 == g and o2 < o)


def _avg_ranks(values):
    order = sorted(values)
    return [order.index(v) + 1 + (order.count(v) - 1) / 2 for v in values]


def _pearson(a, b):
    n = len(a)
    ma, mb = sum(a) / n, sum(b) / n
    cov = sum((x - ma) * (y - mb) for x, y in zip(a, b))
    va = sum((x - ma) ** 2 for x in a)
    vb = sum((y - mb) ** 2 for y in b)
    return cov / (va * vb) ** 0.5 if va > 0 and vb > 0 else None


def test_spearman_with_ties_and_nulls(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([None, 1.0, 2.0, 3.0, 4.0]), rnd.choice([None, 1.5, 2.5, 2.5, 9.0]), float(rnd.randint(0, 9)))
            for _ in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r["col_x"], r["col_y"]): r["r"] for r in AG.spearman_matrix(df, ["a", "b", "c"], 4).collect()}
    cols = {"a": 0, "b": 1, "c": 2}
    for x in cols:
        for y in cols:
            pairs = [(r[cols[x]], r[cols[y]]) for r in rows if r[cols[x]] is not None and r[cols[y]] is not None]
            ra, rb = _avg_ranks([p[0] for p in pairs]), _avg_ranks([p[1] for p in pairs])
            exp = _pearson(ra, rb)
            assert got[(x, y)] == pytest.approx(exp, abs=1e-9)
    assert got[("a", "b")] == got[("b", "a")]


def test_pearson_constant_is_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.1, 5.0), (3.0, 5.9, 5.0)], "x double, y double, k double")
    m = {(r["col_x"], r["col_y"]): r["r"] for r in AG.pearson_matrix(df, ["x", "y", "k"]).collect()}
    assert m[("x", "k")] is None and m[("k", "k")] is None
    assert m[("x", "x")] == pytest.approx(1.0)
    assert -1 <= m[("x", "y")] <= 1


def test_splits_disjoint_covering_exact(spark):
    df = spark.range(1001).withColumnRenamed("id", "k")
    s = SP.split_exact(df, "k", 0.5, 42, "round", num_partitions=6)
    counts = {r["split"]: r["n"] for r in SP.split_sizes(s).collect()}
    assert counts == {"train": round(0.5 * 1001), "test": 1001 - round(0.5 * 1001)}
    assert s.select("k").distinct().count() == 1001
    strat = SP.split_stratified(df, "k", F.when(F.col("k") % 3 == 0, "a").otherwise("b"),
                                {"a": 0.2, "b": 0.434383}, num_partitions=5)
    c = {(r["stratum"], r["split"]): r["n"] for r in SP.split_sizes(strat, ["stratum", "split"]).collect()}
    assert c[("a", "test")] == 67 and c[("b", "test")] == 290  # ceil(0.2*334), ceil(0.434383*667)


def test_histogram_counts_everything(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 1, 2.5, 10]], "v double")
    h = AG.histogram(df, "v", 10).collect()
    assert len(h) == 10 and sum(r["count"] for r in h) == 5
    assert [r["count"] for r in h if r["bin"] == 10] == [1]   # max falls in the last (closed) bin


def test_hexbin_keeps_points_and_error_metrics(spark):
    rnd = random.Random(4)
    df = spark.createDataFrame([(rnd.random(), rnd.random()) for _ in range(500)], "x double, y double")
    cells = AG.hexbin(df, "x", "y", 30).collect()
    assert sum(c["count"] for c in cells) == 500
    m = AG.error_metrics(df, "x", "y").first()
    assert m["n"] == 500 and m["rmse"] >= m["mae"] >= 0


def test_combine_norms_suffix_and_missing(spark):
    left = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 2.0), (None, 3.0)], "Word string, FAM double")
    right = spark.createDataFrame([("a", 5.0, "x"), (None, 6.0, " ")], "word string, rating double, FAM string")
    merged, new = NM.combine_norms(left, right, "Word", "word")
    assert new == ["rating_new"]
    rows = {(r["Word"], r["FAM_x"]): r for r in merged.collect()}
    assert len(rows) == 3                                     # duplicate row dropped
    assert rows[("a", 1.0)]["rating_new"] == 5.0 and rows[("a", 1.0)]["FAM_y"] == "x"
    assert rows[(None, 3.0)]["rating_new"] == 6.0             # NULL keys match (pandas rule)
    assert {r["Word"] for r in NM.missing_rows(merged, new).collect()} == {"b"}


def test_spearman_fast_path_for_complete_columns(spark):
    rnd = random.Random(5)
    rows = [tuple(float(rnd.randint(0, 6)) for _ in range(5)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    got = {(r["col_x"], r["col_y"]): r["r"] for r in AG.spearman_matrix(df, list("abcde"), 4).collect()}
    for x in range(5):
        for y in range(5):
            ra = _avg_ranks([r[x] for r in rows])
            rb = _avg_ranks([r[y] for r in rows])
            assert got[("abcde"[x], "abcde"[y])] == pytest.approx(_pearson(ra, rb), abs=1e-9)


def test_sample_size_rules_and_unknown_mode(spark):
    assert SP.sample_size(5, 0.5, "round") == 2          # Python round: half to even
    assert SP.sample_size(7, 0.5, "round") == 4
    assert SP.sample_size(10, 0.41060, "ceil") == 5
    from wordrate.operators import responses as R
    df = spark.createDataFrame([("", "t", "p", "x", 1, None, None, None)],
                               "run string, task_id string, dialect string, answer_text string, n_steps int, "
                               "first_logprob double, first_top array<struct<token:string,logprob:double>>, "
                               "prompt string")
    try:
        R.score(df, mode="num")
        raise AssertionError("expected ValueError")
    except ValueError:
        pass


def test_combine_norms_null_keys_drop(spark):
    left = spark.createDataFrame([("a", 1.0), (None, 2.0)], "k string, x double")
    right = spark.createDataFrame([("a", 5.0), (None, 6.0)], "k2 string, y double")
    merged, _ = NM.combine_norms(left, right, "k", "k2", null_keys="drop")
    rows = {r["k"]: r["y_new"] for r in merged.collect()}
    assert rows == {"a": 5.0, None: None}


def _group_size_model_factory():
    def model(prompts):
        return [float(len(prompts))] * len(prompts)
    return model


def test_model_scoring_groups_of_five_in_order(spark):
    import sys

    from pyspark import cloudpickle

    from wordrate.operators import model_scoring as MS
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests/
    df = spark.range(23).select(F.col("id"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"))
    out = MS.score_prompts(df.repartition(2), "prompt", _group_size_model_factory, out_col="g", batch_size=5)
    rows = out.collect()
    assert sorted(r["id"] for r in rows) == list(range(23))
    assert all(1 <= r["g"] <= 5 for r in rows)
    lens = MS.score_prompts(df, "prompt", MS.length_scorer_factory).collect()
    assert all(r["score"] == float(len(r["prompt"]) % 7 + 1) for r in lens)


def test_stratified_split_rejects_unconfigured_stratum(spark):
    df = spark.range(30).withColumnRenamed("id", "k")
    with pytest.raises(Exception, match="no fraction given for stratum b"):
        SP.split_stratified(df, "k", F.when(F.col("k") < 10, "a").otherwise("b"), {"a": 0.5}).collect()
