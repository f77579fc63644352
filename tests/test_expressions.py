"""Expression tables: parsing and scoring edge cases, golden step-1 alternatives."""

import pytest
from pyspark.sql import functions as F

from wordrate import functions as W


def one(spark, expr, value, ddl="t string"):
    return spark.createDataFrame([(value,)], ddl).select(expr.alias("o")).first()["o"]


@pytest.mark.parametrize("text,expected", [
    ("1-7", -7.0), ("4.5 and -6 .7", 0.7), ("5.", 5.0), ("", None), (None, None), (".7", 0.7),
    ('{"Word": "abdomen", "Familiarity": 5}', 5.0), ('"Familiarity": "3.5" then 9', 3.5),
    ("I would rate the familiarity with the abdomen as a 6.", 6.0), ("rating ４", 4.0),
])
def test_number_from_answer(spark, text, expected):
    assert one(spark, W.number_from_answer("t", "Familiarity"), text) == expected


@pytest.mark.parametrize("text,first,last", [
    ('Rate "abdication" now', "abdication", "abdication"),
    ('Example "imam": 3. Now "abdomen"', "imam", "abdomen"),
    ("no quotes", None, None),
    ('empty "" last', "", None),
])
def test_quoted_words(spark, text, first, last):
    assert one(spark, W.first_quoted("t"), text) == first
    assert one(spark, W.last_quoted("t"), text) == last


def test_german_quotes(spark):
    assert one(spark, W.first_quoted("t", "„", "”"), "Wie „Haus” und „Baum”") == "Haus"


@pytest.mark.parametrize("text,key", [('Rate "{Word}" now', "{Word}"), ("Rate {Word} now", None),
                                      ('a "{}" b', "{}"), ('x "{a} b}" y', "{a} b}")])
def test_placeholder_key(spark, text, key):
    assert one(spark, W.placeholder_key("t"), text) == key


def test_partial_template_rules(spark):
    df = spark.createDataFrame([("cat", 4.5)], "word string, Rating double")
    ref = df.select(W.partial_template("{word} {Word} {rating} {x}", df.columns, match="reference")).first()[0]
    fold = df.select(W.partial_template("{word} {Word} {rating} {x}", df.columns, match="casefold")).first()[0]
    assert ref == "cat cat {rating} {x}"
    assert fold == "cat cat 4.5 {x}"


@pytest.mark.parametrize("text,expected", [("5", 5.0), (" 7 ", 7.0), ("1d", None), ("abc", None),
                                           ("nan", None), ("1e2", 100.0), ("", None)])
def test_coerce_numeric(spark, text, expected):
    assert one(spark, W.coerce_numeric("t"), text) == expected


@pytest.mark.parametrize("tok,val", [("5", 5), (" 5", 5), ("+5", 5), ("４", 4), ("1_0", 10), ("5.0", None),
                                     (" five", None), ("I", None), ("", None)])
def test_int_token(spark, tok, val):
    assert one(spark, W.int_token("t"), tok) == val


@pytest.mark.parametrize("text,ok", [("5", True), ("999", True), ("1000", False), ("5.", False),
                                     ("４", True), ("", False), (None, False)])
def test_integer_answer_gate(spark, text, ok):
    assert one(spark, W.integer_answer("t"), text) is ok


GOLDEN = {
    "v02_task1": ([("4", -0.31899556517601013), ("5", -1.3189955949783325), ("3", -5.193995475769043),
                   ("6", -8.693995475769043), ("2", -16.44399642944336)], 4.262189001693707),
    "v01_task1": ([("5", -1.1236724853515625), ("4", -1.2486724853515625), ("6", -1.8736724853515625),
                   ("I", -1.9986724853515625), ("As", -2.8736724853515625)], 4.825836887095913),
    "v08_task1": ([("40", -0.5899749398231506), ("50", -0.8399749398231506), ("45", -4.714974880218506),
                   ("30", -5.464974880218506), ("60", -7.839974880218506)], 44.32908363413877),
    "v09_task1": ([("4", -0.5790143609046936), ("5", -0.8290143609046936), ("3", -5.829014301300049),
                   ("6", -8.954014778137207), ("４", -18.57901382446289)], 4.433796753395972),
    "v09_task2": ([("5", -0.01884729415178299), ("6", -4.018847465515137), ("4", -7.268847465515137),
                   (" five", -16.39384651184082), ("3", -17.76884651184082)], 5.017276718470371),
}


@pytest.mark.parametrize("name", sorted(GOLDEN))
def test_expected_rating_golden(spark, name):
    alts, expected = GOLDEN[name]
    df = spark.createDataFrame([(alts,)], "a array<struct<token:string,logprob:double>>")
    got = df.select(W.expected_rating("a")).first()[0]
    assert got == pytest.approx(expected, rel=1e-15, abs=1e-15)


def test_expected_rating_no_numeric_is_zero(spark):
    df = spark.createDataFrame([([("a", -0.1), ("b", -2.0)],)], "a array<struct<token:string,logprob:double>>")
    assert df.select(W.expected_rating("a")).first()[0] == 0.0
    assert df.select(W.live_expected_rating("a")).first()[0] is None


def test_softmax_topk_and_bytes(spark):
    df = spark.createDataFrame([([1.0, 3.0, 2.0, 0.5], "é")], "v array<float>, t string")
    row = df.select(W.softmax_topk("v", 2).alias("k"), W.token_bytes("t").alias("b")).first()
    assert [r["index"] for r in row["k"]] == [1, 2]
    assert row["k"][0]["logprob"] == pytest.approx(-0.4607734891568511)
    assert row["b"] == [195, 169]


def test_small_helpers(spark):
    assert one(spark, W.short_name("t"), "familiarity_rating_v01") == "familiarity"
    assert one(spark, W.short_name("t"), "a_b") == "a_b"
    assert one(spark, W.first_char_int("t"), "40") == 4
    assert one(spark, W.first_char_int("t"), "x4") is None
    assert one(spark, W.cell_label("r"), 0.125, "r double") == "0.12"
    assert one(spark, W.cell_label("r"), None, "r double") == "-"
    assert one(spark, W.answer_text("r"), 5.0, "r double") == "5.0"
    assert one(spark, W.answer_text("r"), 5.104, "r double") == "5.1"
    assert one(spark, W.mean_of_two(F.lit(0.01), F.lit(0.0)), 0, "x int") == 0.0


def test_short_name_rules_agree(spark):
    from wordrate.functions.text import short_name_of
    for name in ["familiarity_rating_v01", "a_b", "ab_c", "nounderscore", "_x"]:
        assert one(spark, W.short_name("t"), name) == short_name_of(name)


def test_numeric_alternatives_filter(spark):
    df = spark.createDataFrame([([("4", -0.1), (" five", -2.0), ("４", -3.0)],)],
                               "a array<struct<token:string,logprob:double>>")
    assert [t["token"] for t in df.select(W.numeric_alternatives("a")).first()[0]] == ["4", "４"]


def test_answer_text_matches_python_str_round(spark):
    vals = [5.0, 5.104, 2.675, 0.125, 12345678.25, 12345678.9, 12345678.0, -3.456, 0.0001, 99999999.99, 4.456]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(W.answer_text("x")).collect()]
    assert got == [str(round(v, 2)) for v in vals]
