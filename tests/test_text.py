import datetime as dt

import pytest
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.functions import values as V


def one(spark, col, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], names).select(col(*[F.col(n) for n in names])).first()[0]


@pytest.mark.parametrize(("raw", "key"), [("Jhanjra Underground Project", "jhanjra"), ("jhanjra project", "jhanjra"), ("The Mine", "the mine"), ("A.B-C, Ltd.", "b-c")])
def test_norm_key(spark, raw, key):
    assert one(spark, T.norm_key, raw) == key


def test_names_and_questions(spark):
    assert one(spark, T.clean_name, "  Gevra   OCP : ") == "Gevra OCP"
    assert one(spark, T.normalize_question, "What's the  RESERVE?") == "what s the reserve"


def test_tokens(spark):
    assert one(spark, T.topic_tokens, "Khadan utpadan report of the Colliery aur parat") == ["mine", "production", "mine", "seam"]
    assert one(spark, T.match_tokens, "A gevra-2 OCP, gevra") == ["gevra", "ocp"]


@pytest.mark.parametrize(("text", "lang"), [("plain", "en"), ("यह हिंदी पाठ है", "hi"), ("a long English sentence with one कोयला word in the middle of it all", "mixed")])
def test_language(spark, text, lang):
    assert one(spark, T.detect_language, text) == lang


@pytest.mark.parametrize(
    ("raw", "day"),
    [("01.04.2021", "2021-04-01"), ("14-11-2023", "2023-11-14"), ("2021/4/1", "2021-04-01"), ("3 August 2023", "2023-08-03"), ("12-AUG-1998", "1998-08-12"), ("June 2023", "2023-06-01"), ("nonsense", None)],
)
def test_dates(spark, raw, day):
    got = one(spark, T.parse_date, raw)
    assert (got.isoformat() if got else None) == day


def test_labelled_date(spark):
    assert one(spark, T.detect_date, "Reserves as on : 01.04.2021\nand more") == dt.date(2021, 4, 1)


@pytest.mark.parametrize(("a", "b", "differ"), [(182.4, 176.5, True), (100.0, 101.0, False), (0.001, 0.005, False), (-5.0, 5.0, True)])
def test_differs(spark, a, b, differ):
    assert one(spark, V.differs, a, b) is differ


def test_quantities(spark):
    assert one(spark, lambda v, u: V.format_quantity(v, u), 182.4, "million_tonnes") == "182.4 million tonnes"
    assert one(spark, V.format_quantity, 100.0) == "100"


def test_markers(spark):
    assert one(spark, T.markers, "x [1] and [12]") == "x [[c:1]] and [[c:12]]"
    assert one(spark, T.plain_markers, "x [[c:1]]") == "x [1]"


def test_score(spark):
    run = lambda kind, conf: spark.createDataFrame([(kind, conf, "proved reserve : 182.40", "182.40")], "k string, c double, m string, v string").select(V.score(F.lit(0.93), F.col("k"), F.col("c"), F.col("m"), F.col("v"))).first()[0]
    assert run("text", None) == 0.93
    assert run("ocr", None) == round(0.93 * 0.75, 3)
    assert run("ocr", 0.8) == round(0.93 * (0.6 + 0.35 * 0.8), 3)
