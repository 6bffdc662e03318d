"""Exact quantiles by refinement, and the joins and samples that must not gather a group."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from driftpanel.operators import bins, joins, ols, sample
from driftpanel.operators.bins import QUARTILES
from driftpanel.session import materialize, settled


def plan(df):
    return df._jdf.queryExecution().toString()


def quantiles_of(df, probs, ranked, by=("g",), accuracy=10_000):
    rows = bins.exact_quantiles(df, "v", probs, list(by), accuracy, ranked=ranked).collect()
    return {tuple(r[c] for c in by): r["quantiles"] for r in rows}


@pytest.mark.parametrize("ranked", [bins.RANKED, 40, 2])
def test_brackets_narrow_until_they_are_small(spark, ranked):
    """One group with 90 % of the rows, one all tied, one mostly tied, one spread over 300 magnitudes."""
    n = 60_000
    i = F.col("id")
    kind = F.when(i % 10 == 0, i % 3 + 1).otherwise(0)
    value = (
        F.when(kind == 0, F.sin(i) * 1000)
        .when(kind == 1, 7.25)
        .when(kind == 2, F.when(i % 20 == 0, -1.5).otherwise(i.cast("double")))
        .otherwise(F.pow(F.lit(10.0), ((i * 7919) % 600) - 300))
    )
    df = materialize(spark.range(0, n, 1, 16).select(kind.alias("g"), value.cast("double").alias("v")))
    probs = [0.0, 0.013, 0.25, 0.5, 0.9, 0.9999, 1.0]
    got = quantiles_of(df, probs, ranked, accuracy=200)
    for g, part in df.toPandas().groupby("g"):
        np.testing.assert_allclose(got[(g,)], np.quantile(part["v"], probs), rtol=1e-12)


def test_rank_outside_its_bracket_moves_the_bracket(spark):
    """Brackets that are wrong on purpose, above, below and beside the rank."""
    df = spark.range(0, 5000, 1, 8).select(F.col("id").cast("double").alias("_v"))
    table = spark.range(1).select(F.lit("kept").alias("own"))
    for low, high in ((4000.0, 4100.0), (-9.0, 3.0), (2499.5, 2499.5), (0.0, 4999.0)):
        bracket = table.select(
            F.lit(4999 * 0.5).alias("_place0"), F.lit(low).alias("_low0"), F.lit(high).alias("_high0")
        )
        found = bins._located(df, [], ["_v"], settled(bracket), table, 10.0, 64)
        assert found.collect()[0].asDict() == {"own": "kept", "_found0": 2499.5}


def test_infinite_values_rank_like_others(spark):
    values = [-math.inf, -1e308, 0.0, 1e308, math.inf, math.inf, math.inf]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for ranked in (bins.RANKED, 1):
        got = quantiles_of(df, [0.0, 1 / 6, 1 / 3, 0.5, 2 / 3, 1.0], ranked, ())[()]
        assert got == [-math.inf, -1e308, 0.0, 1e308, math.inf, math.inf]


def test_several_columns_share_the_passes(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i % 3), float(a), float(b) if i % 7 else None) for i, (a, b) in enumerate(rng.normal(size=(900, 2)))]
    df = spark.createDataFrame(rows, "g int, a double, b double")
    wanted = {"med_a": ("a", 0.5), "q1_b": ("b", 0.25), "top_b": ("b", 1.0), "med_b": ("b", 0.5)}
    out = bins.summarise(df, ["g"], [F.count("*").alias("n"), F.avg("a").alias("mean_a")], wanted).collect()
    pdf = df.toPandas()
    for r in out:
        part = pdf[pdf.g == r.g]
        b = part["b"].dropna()
        want = [len(part), part.a.mean(), part.a.median(), b.quantile(0.25), b.max(), b.median()]
        np.testing.assert_allclose([r.n, r.mean_a, r.med_a, r.q1_b, r.top_b, r.med_b], want, rtol=1e-12)


def test_summaries_keep_groups_without_values(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 3.0), ("y", None), (None, 5.0)], "g string, v double")
    out = bins.summarise(df, ["g"], [F.count("*").alias("n")], {"m": ("v", 0.5)}).collect()
    assert {r.g: (r.n, r.m) for r in out} == {"x": (2, 2.0), "y": (1, None), None: (1, 5.0)}
    empty = bins.summarise(df.limit(0), [], [F.count("*").alias("n")], {"m": ("v", 0.5)}).collect()
    assert [(r.n, r.m) for r in empty] == [(0, None)]


def test_no_task_sees_a_share_of_the_group(spark):
    """The lines that meet in one task are bounded by the bracket, not by the group."""
    counts = []
    original = bins._with_ranks

    def spy(counted, by, order):
        counts.append(counted.count())
        return original(counted, by, order)

    bins._with_ranks = spy
    try:
        df = materialize(spark.range(0, 400_000, 1, 16).select(F.rand(5).alias("v")))
        quantiles_of(df, [0.25, 0.5], 64, ())
    finally:
        bins._with_ranks = original
    assert len(counts) == 2 and counts[0] <= 2 * (bins.BUCKETS + 2) and counts[1] <= 2 * 67


# Joins -----------------------------------------------------------------------------------------


def test_attach_reads_a_written_table_without_a_job(spark):
    rows = spark.range(0, 4000).select((F.col("id") % 40).alias("k"), F.col("id").alias("v"))
    groups = joins.settle(rows.groupBy("k").agg(F.max("v").alias("top")))
    context = spark.sparkContext
    context.setJobGroup("attach", "build only")
    joined = joins.attach(rows, groups, ["k"])
    assert list(context.statusTracker().getJobIdsForGroup("attach")) == []
    context.setJobGroup("other", "run")
    assert "BroadcastHashJoin" in plan(joined) and joined.where("top % 40 = k").count() == 4000


def test_attach_one_record_without_a_job(spark):
    rows = spark.range(3).withColumn("k", F.lit("a"))
    record = spark.createDataFrame([(5.0, [1, 2])], "m double, q array<int>")
    spark.sparkContext.setJobGroup("beside", "build only")
    out = joins.attach(rows, record, [])
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("beside")) == []
    assert [(r.id, r.k, r.m, r.q) for r in out.collect()] == [(i, "a", 5.0, [1, 2]) for i in range(3)]


def test_full_join_counts_pairs_without_a_key_first(spark):
    def side(name, nulls, keys=2):
        rows = spark.range(nulls + keys).select(F.when(F.col("id") >= nulls, F.col("id") - nulls).alias("k"))
        return rows.withColumn(name, F.monotonically_increasing_id())

    assert joins.full_join(side("a", 3), side("b", 4), "k").where("k is null").count() == 12
    million = 1_000_000
    with pytest.raises(PySparkException, match="would make 1000000000000 pairs"):
        joins.full_join(side("a", million), side("b", million), "k").count()
    for left, right in ((million, 0), (0, million)):
        out = joins.full_join(side("a", left), side("b", right), "k")
        assert out.count() == million + 2
        spread = out.where("k is null").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert spread < million
    assert joins.full_join(side("a", 3), side("b", 4), "k", "keep").where("k is null").count() == 7
    with pytest.raises(PySparkException, match="over 11"):
        joins.full_join(side("a", 3), side("b", 4), "k", most_pairs=11).count()


def test_grid_of_levels_in_the_data(spark):
    rows = [("b", 2, 1.0), ("a", 10, 2.0), ("b", 10, None), (None, 2, 3.0)]
    df = spark.createDataFrame(rows, "s string, n int, v double")
    grid = joins.grid_of(df, ["s", "n"])
    assert [tuple(r) for r in grid.collect()] == [("a", 2), ("a", 10), ("b", 2), ("b", 10)]
    assert grid.schema == df.select("s", "n").schema
    with pytest.raises(PySparkException, match="more than 2 levels of v"):
        joins.grid_of(df, ["s", "v"], most=2).collect()
    assert joins.grid_of(df.limit(0), ["s", "n"]).collect() == []


# Samples and models ----------------------------------------------------------------------------


def test_samples_of_any_size_have_one_plan(spark):
    df = spark.range(0, 90_000, 1, 12).select((F.col("id") % 3 == 0).cast("int").alias("g"), "id")
    shapes = []
    for k in (10, 100_000):
        drawn = sample.group_sample(df, ["g"], k, 7, ["id"])
        lines = [x.split("(")[0].strip(" +-:*") for x in plan(drawn).split("Physical Plan")[1].splitlines()]
        shapes.append([x.split("[")[0].split()[0] for x in lines if x and "GroupLimit" not in x and "Sort" not in x])
        rows = drawn.collect()
        assert len(rows) == min(k, 30_000) + min(k, 60_000)
    assert shapes[0] == shapes[1]


def test_sample_holds_first_rows_of_each_group_however_batched(spark, monkeypatch):
    monkeypatch.setattr(sample, "_WAITING", 50)
    df = spark.range(0, 3000, 1, 5).select(
        F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 4).alias("g"), (F.col("id") % 2).alias("h"), "id"
    )
    drawn = sample.group_sample(df, ["g", "h"], 20, 42, ["id"]).collect()
    pdf = df.withColumn("d", F.md5(F.concat_ws(":", F.lit("42"), F.col("id").cast("string")))).toPandas()
    want = set()
    for _, part in pdf.groupby(["g", "h"], dropna=False):
        want |= set(part.sort_values("d").head(20)["id"])
    assert {r.id for r in drawn} == want and len(drawn) == len(want)
    assert sample.group_sample(df, [], 7, 42, ["id"]).count() == 7


def dense_rss(cells):
    """Least squares on one row per observation pair that has the cells' moments."""
    y, x, a, b = [], [], [], []
    for r in cells.itertuples():
        p = math.sqrt(r.sxx) / 2
        q = r.sxy / (4 * p)
        rest = math.sqrt(max(r.syy / 4 - q * q, 0))
        for s, t in ((1, 1), (1, -1), (-1, 1), (-1, -1)):
            x.append(r.xbar + s * p)
            y.append(r.ybar + s * q + t * rest)
            a.append(r.a)
            b.append(r.b)
    columns = [np.array(x)] + [np.array([float(v == w) for v in c]) for c in (a, b) for w in sorted(set(c))]
    design = np.column_stack(columns)
    beta, *_ = np.linalg.lstsq(design, np.array(y), rcond=None)
    return float(((np.array(y) - design @ beta) ** 2).sum())


@pytest.mark.parametrize("levels", [(9, 4), (4, 9), (6, 6), (1, 5)])
def test_additive_model_equals_dense_least_squares(spark, levels, monkeypatch):
    monkeypatch.setattr(ols, "_LEVELS", 2)
    rng = np.random.default_rng(sum(levels))
    rows = []
    for i in range(levels[0]):
        for j in range(levels[1]):
            if rng.random() < 0.7 or j == 0 or i == 0:
                sxx, syy = rng.uniform(1, 4, 2)
                sxy = rng.uniform(-0.9, 0.9) * math.sqrt(sxx * syy)
                rows.append((f"a{i}", f"b{j}", 4, *[float(v) for v in (*rng.normal(size=2), sxx, sxy, syy)]))
    cells = spark.createDataFrame(rows, "a string, b string, n long, xbar double, ybar double, sxx double, sxy double, syy double")
    got = ols.additive_fit(cells, "a", "b").collect()[0]
    pdf = cells.toPandas()
    assert got.rss == pytest.approx(dense_rss(pdf), rel=1e-8)
    mean = (pdf.n * pdf.ybar).sum() / pdf.n.sum()
    assert got.syy == pytest.approx((pdf.syy + pdf.n * (pdf.ybar - mean) ** 2).sum())
    assert (got.n, got.terms) == (int(pdf.n.sum()), pdf.a.nunique() + pdf.b.nunique())


def test_additive_model_of_disconnected_factors(spark):
    """Levels that never meet: the coefficients are not unique, what is left unexplained is."""
    rows = [(f"a{i}", f"b{i // 3}", 4, float(i), float(i * i % 7), 2.0, 0.5, 1.0) for i in range(9)]
    cells = spark.createDataFrame(rows, "a string, b string, n long, xbar double, ybar double, sxx double, sxy double, syy double")
    got = ols.additive_fit(cells, "a", "b").collect()[0]
    assert got.rss == pytest.approx(dense_rss(cells.toPandas()), rel=1e-8)


def test_additive_model_of_wide_factors(spark):
    """Two factors of 1,500 levels: only the smaller factor's moments are held."""
    n = 1500
    i = F.col("id")
    cells = spark.range(0, n * 40).select(
        (i % n).cast("string").alias("a"), ((i * 7 + F.floor(i / n) * 13) % n).cast("string").alias("b"),
        F.lit(3).cast("long").alias("n"), F.sin(i).alias("xbar"), (F.sin(i) * 2 + (i % n) / 100 + F.cos(i * 3) / 10).alias("ybar"),
        F.lit(1.0).alias("sxx"), F.lit(2.0).alias("sxy"), F.lit(4.5).alias("syy"),
    ).groupBy("a", "b").agg(*[F.first(c).alias(c) for c in ("n", "xbar", "ybar", "sxx", "sxy", "syy")])
    got = ols.additive_fit(materialize(cells), "a", "b").collect()[0]
    assert got.terms == 2 * n and 0 < got.rss < got.syy / 5
