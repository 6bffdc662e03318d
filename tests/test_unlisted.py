"""Unlisted levels are errors, NULL groups are groups, fractional ids and missing labels."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from driftpanel.functions import scalars
from driftpanel.operators import bins, chartdata, infer
from driftpanel.operators.reshape import count_table, spread

ROWS = [("u", 500, 1.0), ("u", 1000, 2.0), ("v", 500, 3.0), ("v", 4000, 4.0)]


def test_unlisted_levels_raise(spark):
    df = spark.createDataFrame(ROWS, "unit string, buffer int, y double")
    with pytest.raises(PySparkException, match="4000"):
        spread(df, ["unit"], "buffer", [500, 1000], ["y"]).collect()
    assert spread(df, ["unit"], "buffer", [500, 1000], ["y"], other="drop").count() == 2
    text = df.withColumn("buffer", F.col("buffer").cast("string"))
    with pytest.raises(PySparkException, match="4000"):
        count_table(text, ["unit"], "buffer", ["500", "1000"]).collect()
    with pytest.raises(PySparkException, match="4000"):
        infer.anova_oneway(df, "y", "buffer", [500, 1000]).collect()


def test_null_groups_stay(spark):
    rows = [("a", 1.0), ("a", 3.0), (None, 5.0), (None, 7.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    found = bins.exact_quantiles(df, "v", [0.5], ["g"]).collect()
    assert {r.g: r.quantiles[0] for r in found} == {"a": 2.0, None: 6.0}
    assert {r.g: r["median"] for r in chartdata.boxplot_stats(df, "v", ["g"]).collect()} == {"a": 2.0, None: 6.0}
    counts = df.groupBy("g").agg(F.count("*").alias("n"))
    with_median = bins.with_median(counts, df, "v", ["g"], "m").collect()
    assert {r.g: (r.n, r.m) for r in with_median} == {"a": (2, 2.0), None: (2, 6.0)}


def test_ids_and_labels(spark):
    df = spark.createDataFrame([(53033001200.0, "530-33", None), (5.0, "x", "Other_Season")], "d double, t string, s string")
    found = df.select(
        scalars.normalize_id("d").alias("d"),
        scalars.normalize_id(F.col("d").cast("decimal(20,2)")).alias("e"),
        scalars.normalize_id("t").alias("t"),
        scalars.scenario_name(F.col("s"), F.lit(500)).alias("s"),
    ).collect()
    assert [tuple(r) for r in found] == [(53033001200, 53033001200, 53033, None), (5, 5, None, "Other 500 m")]
