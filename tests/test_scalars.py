from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hearthline import config as C
from hearthline.functions import scalars as S


def apply(spark, fn, values, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v")).alias("x")).collect()]


def test_construction_age(spark):
    given = ["England and Wales: 1930-1949", "2007 onwards", " 2019 ", "1849", "2051", "unknown", None, "1850"]
    assert apply(spark, S.construction_age_num, given) == [1939, 2009, 2019, None, None, None, None, 1850]


def test_floor_level(spark):
    given = ["Basement", "-1", "Ground", "00", "1st", "03", "top floor", None, "GF", "2nd Floor", "12 th floor", "123", ""]
    assert apply(spark, S.floor_level_num, given) == [-1, -1, 0, 0, 1, 3, None, None, 0, 2, 12, 123, None]


def test_postcode_district(spark):
    assert apply(spark, S.postcode_district, ["AB4 1AB", "ab4 1ab", None, " x y"]) == ["AB4", "AB4", "UNK", ""]


@pytest.mark.parametrize(
    "flag, text, expected",
    [
        ("FLAG_CAVITY_INSULATED", "Cavity wall, filled cavity", 1),
        ("FLAG_SOLID_BRICK_BARE", "Solid brick, as built, no insulation (assumed)", 1),
        ("FLAG_SINGLE_GLAZED", "Some double glazing, single elsewhere", 0),
        ("FLAG_SINGLE_GLAZED", "Single glazed", 1),
        ("FLAG_SINGLE_GLAZED", "single\ndouble", 1),
        ("FLAG_SINGLE_GLAZED", None, 0),
        ("FLAG_GAS_BOILER", "Boiler, MAINS GAS", 1),
        ("FLAG_ELECTRIC_HEATING", "Storage heaters", 1),
        ("FLAG_ELECTRIC_HEATING", "Electric storage heaters", 1),
    ],
)
def test_text_flags(spark, flag, text, expected):
    assert apply(spark, lambda c: S.text_flag(c, C.TEXT_FLAGS[flag][1]), [text]) == [expected]


def test_loft_depth(spark):
    given = ["Pitched, 250 mm loft insulation", "Pitched, 300 mm", "Pitched, no insulation", "Flat", "270 mm", None, "1200 mm", "5 mm"]
    assert apply(spark, S.loft_depth_mm, given) == [250, 300, 0, 0, 270, 0, 200, 0]


def test_parse_cost(spark):
    given = ["£4,000 - £14,000", "£25", None, "n/a", "£5 – £9", "£4,000 - £14,000", "2 kits at £3-£5", ",", "from 10 to 20", " 1 - 2 "]
    got = [tuple(x) for x in apply(spark, S.parse_cost, given)]
    none = (None, None, None)
    assert got == [
        (4000, 14000, 9000), (25, 25, 25), none, none, (5, 5, 5), (4000, 14000, 9000), (3, 5, 4), none, (10, 10, 10), (1, 2, 1.5),
    ]


def test_wall_type(spark):
    given = ["Timber frame with cavity wall", "Sandstone or limestone", "Cob", "", None, "Solid brick", "Cavity wall"]
    assert apply(spark, S.wall_type, given) == ["timber_system", "stone", "timber_system", "other", "other", "solid_brick", "cavity"]


def test_bands(spark):
    given = [95.0, 85.0, 70.0, 60.0, 45.0, 30.0, 10.0, 92.0, 81.0, 69.0, 91.999, 20.99, 21.0, -5.0, 140.0, None, float("nan")]
    want = list("ABCDEFGABC") + ["B", "G", "F", "G", "A", "C", "C"]
    assert apply(spark, S.score_to_band, given, "double") == want
    assert apply(spark, S.score_to_code, given, "double") == [C.BANDS.index(b) for b in want]


def test_confidence(spark):
    got = apply(spark, lambda c: F.bround(S.confidence_proxy(c), 3), [96.0, 92.0, 86.0, 91.5, 91.9995, 30.0], "double")
    assert got == [1.0, 0.0, 1.0, 0.0, 0.0, 0.941]


def test_eras(spark):
    years = [1900.0, 1899.0, 2007.0, None, 1966.0]
    assert apply(spark, S.era, years, "double") == ["1900-29", "pre-1900", "2007+", None, "1950-66"]
    right = lambda c: S.era(c, C.ERA_RIGHT_CLOSED, True, "nan")
    assert apply(spark, right, years, "double") == ["<1900", "<1900", "1980-09", "nan", "1950-79"]


def test_numbers_and_ratios(spark):
    assert apply(spark, S.to_number, [" 1.5 ", "1,000", "NaN", "x", None, " 7"]) == [1.5, None, None, None, None, 7.0]
    df = spark.createDataFrame([(3.0, 4.0), (5.0, 4.0), (1.0, 0.0), (None, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(S.clipped_ratio(F.col("a"), F.col("b"))).collect()] == [0.75, 1.0, None, None]


def test_measure_name(spark):
    assert apply(spark, S.measure_name, ["Solar PV, 2.5 kWp", " Loft ", None]) == ["Solar PV", "Loft", None]


def test_decoders(spark):
    df = spark.createDataFrame([([0.1, 0.2, 0.3, 0.4, 0.0, 0.0, 0.0],), ([0.0] * 6 + [1.0],)], "p array<double>")
    cum = S.cumulative(F.col("p"))
    half = F.array(*[F.lit(0.5)] * 7)
    rows = df.select(S.expected_class(F.col("p")), S.argmax_class(F.col("p")), S.threshold_class(cum, half), S.rank_class(F.col("p"))).collect()
    assert [tuple(r) for r in rows] == [(2, 3, 2, 0), (6, 6, 6, 1)]
