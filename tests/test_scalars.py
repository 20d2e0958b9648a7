import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinspark.functions import text, vin
from kinspark.functions.similarity import _jaro_winkler, edit_distance_share, exact, gauss, jaro_winkler, log_ratio, similar


def _map(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_clean_text(spark):
    assert _map(spark, text.clean_text, [" A-b  c! ", "NaN", " none ", "<NA>", "", "!!", None, "x\ty"]) == ["ab c", None, None, None, None, None, None, "x y"]


def test_clean_description(spark):
    got = _map(spark, text.clean_description, ["See http://a.b/c?d now", "WWW.x.y z", "a--b", "nan", None, "https://only"])
    assert got == ["see now", "z", "a b", None, None, None]


def test_to_number(spark):
    assert _map(spark, text.to_number, ["1.5", " 2 ", "x", "nan", "4d", "5F", "", None, "1e3"]) == [1.5, 2.0, None, None, None, None, None, None, 1000.0]


def test_year_form(spark):
    assert _map(spark, text.year_form, ["2020.0", "2020", " 19x ", "", None, "nan", "2019.9"]) == ["2020", "2020", "19x", "", "", "nan", "2019"]


def test_matcher_form(spark):
    assert _map(spark, text.matcher_form, ["2.0", "2.5", " a ", None, "1e20"]) == ["2", "2.5", "a", "", "1e20"]


def test_value_map(spark):
    assert _map(spark, lambda c: text.mapped(c, text.TRANSMISSION), ["A", "m", "cvt", None]) == ["automatic", "manual", "cvt", None]


def test_null_tokens_and_prefix(spark):
    assert _map(spark, lambda c: text.null_if_token(c, ["", "nan"]), [" NaN ", "x", None, ""]) == [None, "x", None, None]
    assert _map(spark, lambda c: text.prefix3(text.compare_form(c)), [" Toyota", None, "ab"]) == ["toy", "", "ab"]


VINS = [  # number, legal, placeholder, check digit
    ("1M8GDM9AXKP042788", True, False, True),
    ("1M8GDM9A1KP042788", True, False, False),
    ("5GZCZ43D13S812715", True, False, True),
    ("11111111111111111", True, True, True),
    ("1M8GDM9AXKP04278O", False, False, False),
    ("1m8-gdm9axkp042788", True, False, True),
    ("1M8GDM9AXKP04278", False, False, False),
    ("12345678901234567", True, True, False),
]


@pytest.mark.parametrize("at", range(3))
def test_vins(spark, at):
    check = [vin.is_legal, vin.is_placeholder, vin.check_digit_ok][at]
    assert _map(spark, lambda c: check(vin.normalized(c)), [v[0] for v in VINS]) == [v[at + 1] for v in VINS]


def test_usable_vin(spark):
    assert _map(spark, vin.usable, ["1m8-gdm9axkp042788", "1" * 17, None, "x"]) == ["1M8GDM9AXKP042788", None, None, None]


def test_jaro_winkler_known_values():
    assert _jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert _jaro_winkler("dixon", "dicksonx") == pytest.approx(0.813333, abs=1e-6)
    assert _jaro_winkler("", "") == 0.0 and _jaro_winkler("a", "") == 0.0 and _jaro_winkler("ab", "ab") == 1.0


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_jaro_winkler_is_a_similarity(a, b):
    x = _jaro_winkler(a, b)
    assert 0.0 <= x <= 1.0 and (x == 1.0) == (a == b != "")


def test_similarity_columns(spark):
    df = spark.createDataFrame([("abc", "abd", 1.0, 3.0), (None, "x", None, 1.0), ("", "x", -1.0, 1.0)], "a string, b string, x double, y double")
    got = df.select(
        F.round(jaro_winkler("a", "b"), 4), exact(F.col("a"), F.col("b")), similar(jaro_winkler("a", "b"), 0.8), gauss(F.col("x"), F.col("y"), 1.0, 1.0),
        F.round(edit_distance_share(F.col("a"), F.col("b")), 4), F.round(log_ratio(F.col("x"), F.col("y")), 4),
    ).collect()
    assert [tuple(r) for r in got] == [(0.8222, 0.0, 1.0, 0.5, 0.3333, 0.4771), (None, 0.0, 0.0, 0.0, None, None), (0.0, 0.0, 0.0, 0.5, None, None)]
