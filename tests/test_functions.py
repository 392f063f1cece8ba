"""Known facts of the text and numeric columns."""

import math

import pytest
from pyspark.sql import functions as F

from loomplan.functions import numeric as num
from loomplan.functions import text as txt
from loomplan.policy import MatchPolicy


def values(spark, texts, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def lit(*xs):
    return [F.lit(float(x)) for x in xs]


def test_normalize_text(spark):
    assert values(spark, [None, "  a\t b\n", "ﬁne ２", " x　y"], txt.normalize_text) == ["", "A B", "FINE 2", "X Y"]


def test_identifiers(spark):
    raw = ["OTSU51021001F2PC", "OTSU5102T1001F3PC", "OTSH59312V1003FNA", "OTSH-59915-1001", " ottr 300171 1001 ", "BAD-CODE", None]
    assert values(spark, raw, txt.clean_identifier) == ["OTSU-5102-1001", "OTSU-5102T-1001", "OTSH-59312V-1003", "OTSH-59915-1001", "OTTR-300171-1001", None, None]


def test_fabrics(spark):
    raw = ["100% Cotton", "Cotton 2% Elastane", "PV LINEN", "PVS", "AS PER SAMPLE", "KNITTED", "PVL", "TR", "EXCEL", None]
    assert values(spark, raw, txt.standard_fabric) == ["Cotton – 100%", "Cotton – Stretch", "Polyester – Viscose Linen Blend", "Polyester – Viscose Stretch", "Unspecified", "Unspecified", "Review Required", "Review Required", "Review Required", "Unspecified"]


def test_numbers(spark):
    raw = ["1,234.5", "12%", "NA", "-", None, "", "12d", "NaN", "inf", "1_000", "-3", "2.5", "3.5", " 7 "]
    assert values(spark, raw, txt.parse_number) == [1234.5, 0.12, 0, 0, 0, 0, None, None, None, None, -3, 2.5, 3.5, 7]
    assert values(spark, ["2.5", "3.5", "-0.4"], txt.parse_integer) == [2, 4, 0]


def test_categories_and_designs(spark):
    assert values(spark, ["tailored", "FORMAL", "x"], txt.canonical_category) == ["FORMAL", "FORMAL", None]
    assert values(spark, ["FORMAL"], lambda c: txt.canonical_category(c, legacy=True)) == [None]
    assert values(spark, [" plain ", "Prints (pigment)", "other"], txt.canonical_design) == ["SOLID", "PIGMENT PRINT", "OTHER"]
    assert values(spark, ["=1+2", "ok", "-x"], txt.safe_cell) == ["'=1+2", "ok", "'-x"]


def test_demand_facts(spark):
    mu, s, t, q = lit(math.log(700), 0, 0.7, 500)
    assert one(spark, num.newsvendor_order(mu, s, t)) == pytest.approx(1000)
    assert one(spark, num.expected_sales(q, mu, s)) == pytest.approx(500)
    assert one(spark, num.expected_sales(F.lit(5000.0), mu, s)) == pytest.approx(700)
    sigma = F.lit(0.6)
    order = num.newsvendor_order(mu, sigma, t)
    assert one(spark, num.expected_sales(order, mu, sigma) / order) == pytest.approx(0.7, abs=1e-6)
    assert one(spark, num.lognormal_conditional_mean(mu, sigma, F.lit(900.0))) > 900
    for z in (-6.0, -1.0, 0.0, 0.5, 4.5, 6.0):
        assert one(spark, num.normal_tail(F.lit(z))) == pytest.approx(math.erfc(z / 2**0.5) / 2, rel=1e-12)


def test_scores(spark):
    none = F.lit(None).cast("double")
    policy = MatchPolicy(detail_weight=0.5, neural_weight=0.7, colour_weight=0.2, texture_weight=0.1)
    assert one(spark, num.hybrid_score(F.lit(0.8), F.lit(0.6), F.lit(0.5), none, policy)) == 0.6556
    assert one(spark, num.cleaned_sales(F.lit(400), F.lit(390), F.lit(900))) == 400
    level = lambda x: one(spark, num.match_confidence(F.lit(x), F.lit(True), F.lit(0)))
    assert [level(x) for x in (0.90, 0.50, 0.4954, 0.49)] == ["High", "Medium", "Medium", "Low"]
    found = [one(spark, num.similarity(F.lit(d), F.lit(0.4), F.lit(0.1))) for d in (0.1, 0.2, 0.3, 0.5, 0.8, 1.0)]
    assert found == sorted(found, reverse=True)
    with pytest.raises(ValueError):
        MatchPolicy(neural_weight=0.9)


def test_colour(spark):
    assert one(spark, num.ciede2000(lit(50, 2.6772, -79.7751), lit(50, 0, -82.7485))) == pytest.approx(2.0425, abs=1e-4)
    l, a, b = (one(spark, c) for c in num.rgb_to_lab(*lit(255, 255, 255)))
    assert (l, a, b) == pytest.approx((100, 0, 0), abs=0.02)
    zero, unit = (F.array(*lit(*v)) for v in ((0, 0), (1, 0)))
    assert [one(spark, num.cosine_distance(*x)) for x in ((zero, zero), (zero, unit), (unit, unit))] == [0, 1, 0]


def test_a_vector_is_measured_once(spark):
    """And not for each of its elements."""
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>").select(num.l2_normalize(F.col("v")).alias("u"))
    assert [r["u"] for r in rows.collect()] == [[0.6, 0.8], [0.0, 0.0], None]
    assert rows._jdf.queryExecution().analyzed().toString().count("aggregate(") == 1
