import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tiltscale.functions.score import clean_result, parse_score

M = "!$*_&"

CASES = [
    (None, -999.0),
    ("", -999.0),
    ("no marker", -999.0),
    ("0.5" + M, 0.5),
    (f"x{M}1.5{M}", 1.5),
    (f"{M} -2 {M}", -2.0),
    (f"{M}\n1\n{M}", 1.0),
    (f"{M}\t1\r\n{M}", 1.0),
    (f"a{M}1{M}b{M}2{M}c", 2.0),
    (f"a{M}1{M}b{M}2", -999.0),
    (f"{M}7{M}", 7.0),
    (f"{M}score: 1{M}", -999.0),
    (f"{M}1,5{M}", -999.0),
    (M + M, -999.0),
    (f"{M}nan{M}", math.nan),
    (f"{M}-NaN{M}", math.nan),
    (f"{M}inf{M}", math.inf),
    (f"{M}-Infinity{M}", -math.inf),
    (f"{M}+1{M}", 1.0),
    (f"{M}.5{M}", 0.5),
    (f"{M}5.{M}", 5.0),
    (f"{M}.{M}", -999.0),
    (f"{M}1e3{M}", 1000.0),
    (f"{M}1e400{M}", math.inf),
    (f"{M}1_0{M}", 10.0),
    (f"{M}1__0{M}", -999.0),
    (f"{M}_1{M}", -999.0),
    (f"{M}1_.5{M}", -999.0),
    (f"{M}1d{M}", -999.0),
    (f"{M}1D{M}", -999.0),
    (f"{M}1.0f{M}", -999.0),
    (f"{M}0x1p3{M}", -999.0),
    (f"{M}−1{M}", -999.0),
    (f"{M} 1{M}", 1.0),
    (f"{M}\x1c1\x1f{M}", -999.0),
    (f"{M}\x851\u3000{M}", 1.0),
    (f"{M}٣{M}", 3.0),
    (f"{M}١.٥{M}", 1.5),
    (f"{M}\U0001d7da{M}", 2.0),
    (f"{M}\x001{M}", -999.0),
    (f"{M}1 2{M}", -999.0),
]


def expected(text):
    try:
        return float(text.split(M)[-2])
    except (AttributeError, IndexError, ValueError):
        return -999.0


def scores(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, result string")
    rows = df.select("id", parse_score(F.col("result")).alias("score")).collect()
    return [row.score for row in sorted(rows)]


def same(left, right):
    return left == right or (math.isnan(left) and math.isnan(right))


def test_cases(spark):
    texts = [text for text, _ in CASES]
    for (text, wanted), found in zip(CASES, scores(spark, texts)):
        assert same(found, wanted), (text, found)
        assert same(expected(text), wanted), text


def test_negative_zero_keeps_its_sign(spark):
    assert math.copysign(1, scores(spark, [f"{M}-0.0{M}"])[0]) == -1


pieces = st.sampled_from(
    [M, M, "!$", "1", "-", "+", ".", "e", "E", "_", "inf", "nan", " ", "\n", " ", "d", "f", "0x", "2", "٤", "x"]
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(pieces, max_size=9).map("".join), min_size=200, max_size=200))
def test_agrees_with_python_numbers(spark, texts):
    for text, found in zip(texts, scores(spark, texts)):
        assert same(found, expected(text)), repr(text)


@pytest.mark.parametrize("text, wanted", [(f"a{M}1{M}", "a1"), ("plain $1", "plain $1"), (None, None), (M, "")])
def test_clean_result(spark, text, wanted):
    df = spark.createDataFrame([(text,)], "result string")
    assert df.select(clean_result(F.col("result"))).first()[0] == wanted
