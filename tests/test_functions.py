"""Column functions on literal edge cases."""

import datetime
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from epiflux.functions import cleaning, places, similarity, text
from epiflux.functions.fixed_values import MARKET_EXPOSURE, OUTCOME_GROUPS


def apply(spark, values, expression, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [row.y for row in rows.select("i", expression.alias("y")).orderBy("i").collect()]


def test_clean_date(spark):
    given = [
        "18.01.2020 - 23.01.2020", "1.3.20", " 05.02.2020 ", "01.23.2020", "1/2/2020",
        "01.01.2019", "pre 18.01.2020", None, "45.45.2020", "1x3x2020", "31.02.2020", "", "01.01.2021",
    ]
    day = datetime.date
    expected = [
        day(2020, 1, 18), day(2020, 3, 1), day(2020, 2, 5), day(2020, 1, 23), day(2020, 2, 1),
        None, None, None, None, None, None, None, None,
    ]
    got = apply(spark, given, cleaning.clean_date("x", "2019-01-08", "2020-12-31"))
    assert got == expected
    assert apply(spark, ["1.1.1901", "x"], cleaning.clean_date("x")) == [day(1901, 1, 1), None]
    assert apply(spark, ["bad"], cleaning.clean_date("x", missing="01.02.2020")) == [day(2020, 2, 1)]


def test_clean_age(spark):
    given = ["20s", "30-39", " 45 ", "80+", "-5", "119", "45.0", "0", "120", "x10-20", None, "10-20yrs", "10-20-"]
    expected = [25, 34, 45, 80, 5, 119, None, None, None, None, None, None, None]
    assert apply(spark, given, cleaning.clean_age("x")) == expected


def test_clean_float(spark):
    given = ["12.5N", "-3.2", "1|2", "1-2", "abc", None]
    assert apply(spark, given, cleaning.clean_float("x")) == [12.5, -3.2, None, None, None, None]


def test_clean_bin(spark):
    given = ["1", " 0 ", "yes", "2", None]
    assert apply(spark, given, cleaning.clean_bin("x", missing=0)) == [1, 0, 0, 0, None]
    assert apply(spark, given, cleaning.clean_bin("x")) == [1, 0, None, None, None]
    assert apply(spark, [2.0, 0.0, None, float("nan")], cleaning.clean_bin("x", 0, numeric=True), "double") == [2, 0, None, None]


def test_recode(spark):
    given = ["Dead", " died ", "stable", "recovered", "discharge", "DEATH", None]
    expected = ["died", "died", "recovered", "recovered", "ongoing", "ongoing", "ongoing"]
    assert apply(spark, given, cleaning.recode("x", OUTCOME_GROUPS, missing="ongoing")) == expected
    assert apply(spark, ["yes", "1", None], cleaning.recode("x", MARKET_EXPOSURE, missing=0)) == [1, 0, 0]
    assert apply(spark, ["a", None], cleaning.recode("x", {"b": "c"}, keep_unmapped=True)) == ["a", None]


def test_inf_and_int(spark):
    given = [1.5, float("inf"), float("-inf"), float("nan"), None]
    assert apply(spark, given, cleaning.inf_to_null("x"), "double") == [1.5, None, None, None, None]
    assert apply(spark, [2.9, None], cleaning.int_or_null("x"), "double") == [2, None]


def test_strip_and_normalize(spark):
    given = ["see https://t.co/ab?x=1 now 1,234.5 <b>z</b>", "1,,2 3.4.5", None]
    assert apply(spark, given, text.strip_nonwords("x"))[0] == "see  now  z"
    given = ["prepared preparedness preparation centres", "coronavirus cases tested"]
    assert apply(spark, given, text.normalize_terms("x")) == ["prepd prepdness prep centers", "virus case test"]


def test_strip_long_number_list(spark):
    """Whole texts: tens of thousands of groups must not exhaust the matcher's stack."""
    long = ",".join(["12"] * 50_000) + " end"
    assert apply(spark, [long], text.strip_nonwords("x")) == [" end"]


def test_hashtags_and_emoticons(spark):
    assert apply(spark, ["Hi #Covid x#no #año"], text.hashtags("x")) == [["#covid", "#año"]]
    assert apply(spark, ["see http://a.b :) ;P =D 10:30"], text.emoticons("x")) == [[":)", ";P", "=D", ":"]]


def test_entity_hashtags(spark):
    given = [
        "{u'hashtags': [{u'text': u'covid', u'indices': [1, 2]}, {u'text': u'covid', u'indices': [9, 12]}], u'urls': []}",
        "{u'hashtags': [], u'urls': []}",
        '{"x":1}',
        "{u'hashtags': [{u'text': bad, u'urls': []}",
        "{u'hashtags': [{u'text': u'menu'}], u'urls': []}",
        None,
    ]
    assert apply(spark, given, text.entity_hashtags("x")) == [["covid"], [""], None, [""], ["menu"], None]


def test_tokens_and_bigrams(spark):
    words = text.tokens("x")
    assert apply(spark, ["the fever and dry cough a ñu"], words) == [["fever", "dry", "cough", "ñu"]]
    rows = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    got = [row.t for row in rows.select(text.with_bigrams("w").alias("t")).collect()]
    assert got == [["a", "b", "c", "a b", "b c"], ["a"], []]


def test_places(spark):
    assert apply(spark, [" U.S.A. ", "#SF!"], places.fold_place("x")) == ["usa", "sf"]
    assert apply(spark, ["🇺🇸", "x🇺🇸", "US"], places.flag_code("x")) == ["US", None, None]
    assert apply(spark, ["US"], places.code_flag("x")) == ["🇺🇸"]
    assert apply(spark, ["(san jose), x, us "], places.first_part("x")) == ["san jose"]
    assert apply(spark, ["(san jose), x, us "], places.last_part("x")) == ["us"]
    assert apply(spark, ["a@b#c:d|e//f", "12"], places.fold_for_geocoder("x")) == ["abcdef", ""]


def plain_ratio(left, right):
    if not left or not right:
        return 0
    return int(round(100 * SequenceMatcher(None, left, right, autojunk=False).ratio()))


def test_block_ratio(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcé🙂") for _ in range(rng.randint(0, 12)))
    pairs = [("california", "california"), ("california", "California"), ("", "x"), ("", ""), ("ab" * 15, "ba" * 15)]
    pairs += [(word(), word()) for _ in range(300)]
    rows = spark.createDataFrame([*pairs, (None, "x"), ("x", None)], "l string, r string")
    got = rows.select("l", "r", similarity.block_ratio(F.col("l"), F.col("r")).alias("score")).collect()
    for row in got:
        want = None if None in (row.l, row.r) else plain_ratio(row.l, row.r)
        assert row.score == want, row
    assert [row.score for row in got[:3]] == [100, 90, 0]


@pytest.mark.parametrize("above", [0, 50, 75, 90])
def test_best_block_ratio_equals_brute_force(spark, above):
    """The length bound drops no choice that could win."""
    patterns = ["alabama", "alabma", "al", "new yrok", "zz", "north dakota"]
    choices = ["alabama", "alaska", "new york", "north dakota", "south dakota", "al"]
    rows = spark.createDataFrame([(p, choices) for p in patterns], "p string, c array<string>")
    best = similarity.best_by_block_ratio(F.col("p"), F.col("c"), above)
    got = {r.p: (r.b.score, r.b.choice) for r in rows.select("p", best.alias("b")).collect()}
    for p in patterns:
        loss, choice = min((-plain_ratio(p, c), c) for c in choices)
        if -loss > above:
            assert got[p] == (-loss, choice)
        else:
            assert got[p][0] is None or got[p][0] <= above


def test_char_ngrams(spark):
    assert apply(spark, ["abcab", "ab", ""], similarity.char_ngrams(F.col("x"), 2)) == [["ab", "bc", "ca"], ["ab"], [""]]
