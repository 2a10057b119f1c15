import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import geo, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [(999_999_999, "1000 Million"), (1e9, "1 Billion"), (1_234_567, "1.23 Million"), (0, "0 Thousand"), (999, "0.999 Thousand"), (None, None)])
def test_format_scale(spark, raw, want):
    assert one(spark, text.format_scale(F.lit(raw).cast("double"))) == want


@pytest.mark.parametrize("name, want", [("Republic of Utopia", "RU"), ("Free-Land", "FL"), ("Atlantis", "ATL"), ("A B C D E F", "ABCDE"), ("the", "THE")])
def test_abbreviate(spark, name, want):
    assert one(spark, text.abbreviate(F.lit(name))) == want


def test_text(spark):
    assert one(spark, text.fold_name(F.lit(" Élan "))) == "elan"
    assert one(spark, text.decode_entities(F.lit("&#x41;&#66;&amp;&eacute;&unknown;"))) == "AB&é&unknown;"
    assert one(spark, text.title_case(F.lit("THE state OF the union"))) == "The State of the Union"
    assert one(spark, text.first_number(F.lit("12, about 1,500 or 9999"))) == 1500.0
    assert one(spark, text.first_number(F.lit("none, 0000"))) is None
    assert tuple(one(spark, text.dms_degrees(F.lit("10 30 S, 20 15 36 W")))) == (-10.5, -20.26)
    assert one(spark, text.dms_degrees(F.lit("nowhere"))) is None
    assert one(spark, text.slug(F.lit("Sao  Tome!"), F.lit("x1"))) == "sao-tome--x1"
    assert one(spark, text.score_color(F.lit(150.0))) == "rgb(34, 197, 94)"
    assert one(spark, text.coordinate_text(F.lit(-1.5), F.lit(2.25))) == "1.50°S 2.25°E"
    assert one(spark, text.match_tier(F.lit("Abcd"), F.lit(" BC "))) == 2
    assert one(spark, text.grouped_integer(F.lit(1234567.5), "$")) == "$1,234,568"
    assert one(spark, text.source_label(F.lit("https://a.example.org/x"), (("b.org", "B"),))) == "a.example.org"
    assert one(spark, text.half_up(F.lit(3.8499999999999996), 1)) == 3.9
    assert one(spark, text.coverage_sentence({"a": F.lit(1), "b": F.lit(None)})) == "1/2: a; missing: b"


def test_sphere(spark):
    z = F.lit(0.0)
    assert one(spark, geo.bearing(z, z, F.lit(10.0), z)) == 0
    assert one(spark, geo.bearing(z, z, z, F.lit(10.0))) == pytest.approx(math.pi / 2)
    assert one(spark, geo.angular_distance(z, z, z, F.lit(180.0))) == pytest.approx(math.pi)
    assert one(spark, geo.angular_distance(z, F.lit(179.0), z, F.lit(-179.0))) == pytest.approx(math.radians(2))
    assert one(spark, geo.normalize_angle(F.lit(math.pi))) == math.pi
    assert one(spark, geo.normalize_angle(F.lit(math.pi + 1))) == pytest.approx(1 - math.pi)


def polygon(*points):
    return F.array(F.array(F.array(*(F.struct(F.lit(float(x)).alias("lng"), F.lit(float(y)).alias("lat")) for x, y in points))))


def test_rings(spark):
    dateline = polygon((179, 0), (-179, 0), (-179, 2), (179, 2), (179, 0))
    assert one(spark, geo.angular_extent(dateline)) == 2
    assert one(spark, geo.centroid(dateline))["lng"] == pytest.approx(179.8)
    square = polygon((0, 0), (4, 0), (4, 2), (0, 2), (0, 0))
    assert tuple(one(spark, geo.area_centroid(square))) == (2.0, 1.0)
    assert tuple(one(spark, geo.area_centroid(polygon((0, 0), (1, 1))))) == (0.0, 0.0)
    pole = polygon((0, 80), (120, 80), (-120, 81), (0, 80))
    assert one(spark, geo.angular_extent(pole)) == 1
    assert tuple(one(spark, geo.centroid(F.filter(square, lambda x: F.lit(False))))) == (0.0, 0.0)
