import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from driftpanel.operators import bins, joins
from driftpanel.operators.bins import QUARTILES, TERCILES


def answers(spark, values, probs, accuracy=10_000, parts=4):
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(parts)
    return bins.exact_quantiles(df, "v", probs, accuracy=accuracy).first()["quantiles"]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.one_of(st.integers(-5, 5).map(float), st.floats(-1e6, 1e6)), min_size=1, max_size=200
    ),
    st.sampled_from([QUARTILES, TERCILES, [0.5], [0.1, 0.9]]),
    st.sampled_from([4, 20, 10_000]),
)
def test_equals_numpy(spark, values, probs, accuracy):
    got = answers(spark, values, probs, accuracy)
    np.testing.assert_allclose(got, np.quantile(values, probs), rtol=1e-12, atol=1e-9)


@pytest.mark.parametrize("shape", ["sorted", "ties", "heavy", "uneven"])
def test_brackets_hold_on_large_groups(spark, shape):
    """Sketch brackets are in use here: groups are far larger than the accuracy."""
    n = 300_000
    i = F.col("id")
    value = {
        "sorted": i.cast("double"),
        "ties": (i % 7).cast("double"),
        "heavy": F.exp(20.0 * ((i * 7919) % n) / n),
        "uneven": F.when(i % 3 == 0, 5.0).otherwise(((i * 104729) % n).cast("double")),
    }[shape]
    df = spark.range(0, n, 1, 37).select((i % 2).alias("g"), value.alias("v"))
    got = {r["g"]: r["quantiles"] for r in bins.exact_quantiles(df, "v", QUARTILES, ["g"], 500).collect()}
    pdf = df.toPandas()
    for g, part in pdf.groupby("g"):
        np.testing.assert_allclose(got[g], np.quantile(part["v"], QUARTILES), rtol=1e-12)


def test_only_bracket_values_reach_the_ranking_task(spark):
    n = 200_000
    df = spark.range(0, n, 1, 16).select(F.rand(3).alias("v")).cache()
    plan_rows = []
    original = joins.attach

    def spy(rows, per_group, on, how="left", limit=joins.SMALL_ROWS):
        marked = original(rows, per_group, on, how, limit)
        low, high = F.col("_low0"), F.col("_high0")
        plan_rows.append(marked.filter(F.col("_v").between(low, high)).count())
        return marked

    bins.attach = spy
    try:
        got = bins.exact_quantiles(df, "v", [0.5], accuracy=1_000).first()["quantiles"][0]
    finally:
        bins.attach = original
    assert got == pytest.approx(np.median(df.toPandas()["v"]), rel=1e-12)
    assert plan_rows[0] < n * 8 / 1_000


def test_null_and_nan_are_left_out(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    row = bins.exact_quantiles(df, "v", [0.0, 0.5, 1.0]).first()
    assert (row["n"], row["quantiles"]) == (2, [1.0, 2.0, 3.0])


def test_cut_keeps_ties_together_and_closes_the_first_bin(spark):
    values = [0.0, 0.0, 1.0, 1.0, 1.0, 2.0, 3.0, 4.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    out = bins.quantile_bins(df, "v", [0, 0.5, 1.0], ["low", "high"]).collect()
    assert {(r["v"], r["bin"]) for r in out} == {
        (0.0, "low"), (1.0, "low"), (2.0, "high"), (3.0, "high"), (4.0, "high")
    }


def test_value_on_an_edge_falls_in_the_lower_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 6)], "v double")
    out = bins.quantile_bins(df, "v", QUARTILES, ["a", "b", "c", "d"]).collect()
    assert {r["v"]: r["bin"] for r in out} == {1: "a", 2: "a", 3: "b", 4: "c", 5: "d"}


def test_repeated_breaks_are_an_error(spark):
    df = spark.createDataFrame([(0.0,), (0.0,), (0.0,), (9.0,)], "v double")
    with pytest.raises(PySparkException, match="breaks are not unique"):
        bins.quantile_bins(df, "v", QUARTILES, ["a", "b", "c", "d"]).collect()


def test_null_has_no_bin(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,)], "v double")
    out = bins.quantile_bins(df, "v", [0, 0.5, 1.0], ["low", "high"]).collect()
    assert {r["v"]: r["bin"] for r in out} == {1.0: "low", 2.0: "high", None: None}


def test_digits_merge_values_that_differ_in_noise(spark):
    noisy = [math.log(2), math.log(2) + 1e-15, 0.0, 5.0]
    df = spark.createDataFrame([(v,) for v in noisy], "v double")
    out = bins.quantile_bins(df, "v", [0, 0.5, 1.0], ["low", "high"], digits=9).collect()
    assert len({r["bin"] for r in out if abs(r["v"] - math.log(2)) < 1e-9}) == 1


def test_approximate_quantiles_are_near(spark):
    df = spark.range(0, 10_000).select(F.col("id").cast("double").alias("v"))
    got = bins.approximate_quantiles(df, "v", [0.25, 0.5]).first()["quantiles"]
    np.testing.assert_allclose(got, [2499.75, 4999.5], atol=3)


def test_many_groups_take_the_salted_join(spark):
    rows = spark.range(0, 4000).select((F.col("id") % 40).alias("k"), F.col("id").alias("v"))
    groups = rows.groupBy("k").agg(F.max("v").alias("top"))
    small = joins.attach(rows, groups, ["k"])
    large = joins.attach(rows, groups, ["k"], limit=10)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().toString()
    assert "_salt" in large._jdf.queryExecution().toString()
    assert sorted(small.select("k", "v", "top").collect()) == sorted(
        large.select("k", "v", "top").collect()
    )


def test_salted_left_join_keeps_unmatched_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    groups = spark.createDataFrame([(1, 9)], "k int, top int")
    out = joins.salted_join(rows, groups, ["k"]).collect()
    assert sorted((r["v"], r["top"]) for r in out if r["top"]) == [("a", 9)]
    assert len(out) == 3
