"""Property tests: each example list becomes one DataFrame, and the
Spark expressions are compared with Python's own int() / re / float() behaviour."""

import math
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wordrate import functions as W
from wordrate.operators import agreement as AG
from wordrate.operators import responses as R

SETTINGS = settings(max_examples=15, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
TOKENS = st.one_of(st.integers(-999, 999).map(str), st.sampled_from([" 5", "+7", "4 ", "1_0", "５", "5.0", "I", "",
                                                                      " five", "-", "0x1", "٣"]),
                   st.text(alphabet="0123456789 +-_.aI", max_size=5))


def py_int(t):
    try:
        return int(t)
    except ValueError:
        return None


@SETTINGS
@given(st.lists(TOKENS, min_size=1, max_size=30))
def test_int_token_matches_python(spark, tokens):
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    got = [r[0] for r in df.select(W.int_token("t")).collect()]
    assert got == [py_int(t) for t in tokens]


#: answer -> rating, worked out by hand: the labelled string, then the labelled number,
#: then the last free number
RATINGS = [
    ('{"Familiarity": "4.5", "Familiarity": 3}', 4.5), ('{"Familiarity": 3} or 9', 3.0), ('"Familiarity" : .5', 0.5),
    ("I would say 4", 4.0), ("from 2 to -3.5", -3.5), ("+7", 7.0), ("5.", 5.0), ("about .25 or so", 0.25),
    ('{"Familiarity": "high"} 6', 6.0), ("none", None), ("", None), ('{"Age": 8}', 8.0), ("1-2", -2.0), ("3.4.5", 0.5),
]


def test_number_from_answer_by_hand(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(RATINGS)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", W.number_from_answer("t", "Familiarity").alias("v")).collect()}
    assert [got[i] for i in range(len(RATINGS))] == [v for _, v in RATINGS]


NUMBERS = st.decimals(min_value=0, max_value=999, places=2).map(lambda d: format(d, "f"))
WORDY = st.text(alphabet="abc xyz,;:", max_size=12)


@SETTINGS
@given(st.lists(st.tuples(WORDY, NUMBERS, WORDY, NUMBERS), min_size=1, max_size=20))
def test_number_from_answer_order(spark, rows):
    """The last free number wins; a labelled one beats every free one; a sign is kept."""
    texts = [x for a, n, b, m in rows for x in (f"{a} {n} {b} {m}", f'{a} "Familiarity": {n} {b} {m}', f"{a} -{n}")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", W.number_from_answer("t", "Familiarity").alias("v")).collect()}
    assert [got[i] for i in range(len(texts))] == [x for _, n, _, m in rows for x in (float(m), float(n), -float(n))]


ALTS = st.lists(st.tuples(st.one_of(st.integers(0, 99).map(str), st.sampled_from(["I", "As", " five"])),
                          st.floats(-30, 0)), min_size=1, max_size=6)


@SETTINGS
@given(st.lists(ALTS, min_size=1, max_size=20))
def test_expected_rating_within_numeric_tokens(spark, rows):
    df = spark.createDataFrame([(a,) for a in rows], "a array<struct<token:string,logprob:double>>")
    got = [r[0] for r in df.select(W.expected_rating("a")).collect()]
    for alts, value in zip(rows, got):
        nums = [int(t) for t, _ in alts if py_int(t) is not None]
        mass = sum(math.exp(lp) for t, lp in alts if py_int(t) is not None)
        if nums and mass > 0:
            assert min(nums) - 1e-9 <= value <= max(nums) + 1e-9
        else:
            assert value == 0.0


WORDS = st.text(alphabet=st.characters(blacklist_characters='"\n', blacklist_categories=("Cs",)), max_size=12)


@SETTINGS
@given(st.lists(WORDS, min_size=1, max_size=20))
def test_fill_then_first_quoted_gives_word_back(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "w string")
    filled = W.fill_template(F.lit('Rate "{Word}" from 1 to 7.'), F.lit("{Word}"), F.col("w"))
    got = [r[0] for r in df.select(W.first_quoted(filled)).collect()]
    assert got == words


@SETTINGS
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 5).map(float)),
                          st.one_of(st.none(), st.floats(-10, 10, allow_nan=False, allow_subnormal=False)),
                          st.integers(0, 3).map(float)), min_size=3, max_size=40))
def test_correlations_symmetric_bounded_diagonal(spark, rows):
    df = spark.createDataFrame(rows, "a double, b double, c double")
    for m in (AG.pearson_matrix(df, ["a", "b", "c"]), AG.spearman_matrix(df, ["a", "b", "c"], 3)):
        cells = {(r["col_x"], r["col_y"]): r["r"] for r in m.collect()}
        assert len(cells) == 9
        for (x, y), r in cells.items():
            assert cells[(y, x)] == r
            if r is not None:
                assert -1 - 1e-9 <= r <= 1 + 1e-9
                if x == y:
                    assert abs(r - 1) < 1e-9


def test_failure_rows_give_nulls_not_errors(spark):
    lines = ['{"custom_id": "t1", "error": {"code": "server_error"}, "response": null}',
             '{"custom_id": "t2", "response": {"status_code": 200, "body": {"choices": []}}}',
             '{"custom_id": "t3", "response": {"body": {"choices": [{"message": {"content": "4"}}]}}}',
             '{"key": "g1", "response": {"candidates": []}}',
             'not json at all']
    df = spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "value string, line_no long")
    from wordrate.sources.files import parse_json_lines
    from wordrate.sources import schemas as SC
    parsed = parse_json_lines(df, SC.RESULT_UNION, keep=("line_no",))
    assert parsed.where(F.col("_bad").isNotNull()).count() == 1
    canon = {r["task_id"]: r for r in R.canonical_results(parsed.where(F.col("_bad").isNull()).drop("_bad")).collect()}
    assert canon["t1"]["answer_text"] is None and canon["t2"]["answer_text"] is None
    assert canon["t3"]["answer_text"] == "4" and canon["t3"]["first_top"] is None
    assert canon["g1"]["answer_text"] is None and canon["g1"]["has_candidates"] is False
    reqs = spark.createDataFrame([("", t, f'Rate "{t}"', 0) for t in ("t1", "t2", "t3", "g1")],
                                 "run string, task_id string, prompt string, line_no long")
    scored = {r["task_id"]: r for r in R.score(R.join_results(
        R.canonical_results(parsed.where(F.col("_bad").isNull()).drop("_bad")), reqs)).collect()}
    assert scored["t1"]["weighted_sum"] is None and scored["t3"]["value"] == 4.0


@SETTINGS
@given(st.lists(st.one_of(st.integers(0, 100000).map(lambda k: k / 1000), st.floats(-1e6, 1e6, allow_subnormal=False)), min_size=1, max_size=60))
def test_python_round_matches_python(spark, values):
    from wordrate.functions.numeric import python_round
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(python_round("x", 2)).collect()]
    assert got == [round(v, 2) for v in values]


@SETTINGS
@given(st.lists(st.one_of(st.integers(-1000, 1000).map(lambda k: k / 1000), st.floats(-1, 1, allow_subnormal=False)), min_size=1, max_size=60))
def test_cell_label_matches_python_format(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(W.cell_label("x")).collect()]
    assert got == [f"{v:.2f}" for v in values]
