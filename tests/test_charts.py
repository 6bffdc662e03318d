import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from driftpanel.operators import chartdata, geometry


def test_round_breaks():
    # Ranges and the round edges an analyst's plotting tool would pick for them.
    assert chartdata.round_breaks(0.0, 100.0, 5) == (0.0, 20.0, 5)
    assert chartdata.round_breaks(1.0, 9.7, 5) == (0.0, 2.0, 5)
    assert chartdata.round_breaks(-0.31, 0.42, 8) == (pytest.approx(-0.4), pytest.approx(0.1), 9)
    assert chartdata.round_breaks(3.0, 3.0, 4) == (3, 1.0, 1)
    assert chartdata.sturges(100) == 8


def test_histogram_bins_are_right_closed_and_complete(spark):
    values = [0.0, 1.0, 1.0, 2.0, 3.0, 4.0, 10.0, float("inf"), float("-inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    out = chartdata.histogram(df, "v", bins=5).orderBy("bin").collect()
    assert [(r["lower"], r["upper"], r["n"]) for r in out] == [
        (0.0, 2.0, 4), (2.0, 4.0, 2), (4.0, 6.0, 0), (6.0, 8.0, 0), (8.0, 10.0, 1)
    ]


def test_histogram_of_nothing_and_of_one_value(spark):
    assert chartdata.histogram(spark.createDataFrame([], "v double"), "v").count() == 0
    one = chartdata.histogram(spark.createDataFrame([(3.0,)] * 4, "v double"), "v").collect()
    assert [r["n"] for r in one] == [4]


def test_even_histogram_counts_every_value(spark):
    df = spark.range(1000).select(F.sqrt("id").alias("v"))
    out = chartdata.histogram(df, "v", round_edges=False)
    assert out.agg(F.sum("n")).first()[0] == 1000 and out.count() == 11


def test_smooth_line(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=50)
    y = 2 * x + rng.normal(size=50)
    df = spark.createDataFrame([("a", float(u), float(v)) for u, v in zip(x, y)], "g string, x double, y double")
    out = chartdata.smooth_band(chartdata.smooth_line(df, "y", "x", ["g"])).orderBy("point").toPandas()
    assert len(out) == 80
    assert out["x"].iloc[0] == pytest.approx(x.min()) and out["x"].iloc[-1] == pytest.approx(x.max())
    slope, intercept = np.polyfit(x, y, 1)
    np.testing.assert_allclose(out["fit"], intercept + slope * out["x"])
    left = ((y - intercept - slope * x) ** 2).sum() / 48
    se = np.sqrt(left * (1 / 50 + (out["x"] - x.mean()) ** 2 / ((x - x.mean()) ** 2).sum()))
    np.testing.assert_allclose(out["se"], se)
    np.testing.assert_allclose(out["hi"] - out["fit"], 2.010635 * se, rtol=1e-5)


def test_boxplot(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 40.0]
    df = spark.createDataFrame([("g", v) for v in values] + [("g", None)], "g string, v double")
    row = chartdata.boxplot_stats(df, "v", ["g"]).first()
    assert (row["q1"], row["median"], row["q3"]) == (3.25, 5.5, 7.75)
    assert (row["whisker_low"], row["whisker_high"], row["n_outliers"], row["n"]) == (1.0, 9.0, 1, 10)


def test_composition_labels(spark):
    df = spark.createDataFrame([("Q1", 1.0, 2.0, 3.0, 4.0)], "q string, mean_pct_Two_or_More_2010 double, mean_pct_Two_or_More_2020 double, mean_pct_0_19_2010 double, mean_pct_0_19_2020 double")
    races = chartdata.composition_long(df, ["q"], df.columns[1:3], (2010, 2020)).collect()
    assert [tuple(r) for r in races] == [("Q1", "2010", "Two or More", 1.0), ("Q1", "2020", "Two or More", 2.0)]
    ages = chartdata.composition_long(df, ["q"], df.columns[3:], (2010, 2020), {"0_19": "0-19"}).collect()
    assert {r["group"] for r in ages} == {"0-19"}


def ring(*points):
    return [tuple(map(float, p)) for p in points]


RING = "array<struct<x:double,y:double>>"
SQUARE = ring((0, 0), (4, 0), (4, 4), (0, 4))


@pytest.mark.parametrize("points,area", [
    (SQUARE, 16.0),
    ([*SQUARE, SQUARE[0]], 16.0),
    (SQUARE[::-1], 16.0),
    (ring((0, 0), (2, 0), (0, 3)), 3.0),
    ([(x + 1.2e6, y + 6e5) for x, y in SQUARE], 16.0),
])
def test_ring_area(spark, points, area):
    df = spark.createDataFrame([(1, points)], f"unit int, ring {RING}")
    out = geometry.polygon_area(df).first()
    assert out["area_m2"] == pytest.approx(area) and out["area_ha"] == pytest.approx(area / 10_000)
    assert "ring" not in out.asDict()


def test_vertex_table_with_hole_and_parts(spark):
    hole = ring((1, 1), (1, 2), (2, 2), (2, 1))
    island = ring((10, 10), (11, 10), (11, 11), (10, 11))
    rows = [(1, r, i, x, y) for r, pts in enumerate((SQUARE, hole, island)) for i, (x, y) in enumerate(pts)]
    df = spark.createDataFrame(rows, "unit int, ring int, seq int, x double, y double")
    assert geometry.polygon_area_from_vertices(df).first()["area_m2"] == pytest.approx(16 - 1 + 1)


def test_vertex_gap_is_an_error(spark):
    df = spark.createDataFrame(
        [(1, 0, i, float(i), float(i * i)) for i in (0, 1, 3)],
        "unit int, ring int, seq int, x double, y double",
    )
    with pytest.raises(PySparkException, match="positions have gaps in ring 1 0"):
        geometry.polygon_area_from_vertices(df).collect()


def test_feet_to_metres(spark):
    df = spark.createDataFrame([(1, SQUARE)], f"unit int, ring {RING}")
    out = geometry.polygon_area(df, unit_in_m=geometry.US_SURVEY_FOOT).first()
    assert out["area_m2"] == pytest.approx(16 * 0.0929034, rel=1e-6)
    assert math.isclose(geometry.US_SURVEY_FOOT, 0.3048006096, rel_tol=1e-9)
