"""Ordered categories, written tables and their end, published reports, polygons in one exchange."""

import math
import os

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from driftpanel import session
from driftpanel.functions import categories
from driftpanel.operators import bins, geometry
from driftpanel.operators.reshape import count_table, spread
from driftpanel.plans import reports
from driftpanel.session import materialize
from driftpanel.sources import tables

LEVELS = ["Low x", "Mid x", "High x"]


def files(folder):
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(folder) for f in fs)


def written(spark):
    own = f"{session.shared_dir(spark)}/driftpanel/{spark.sparkContext.applicationId}".removeprefix("file:")
    return {d for d in os.listdir(own) if not d.startswith(("_", "."))}


# Categories ------------------------------------------------------------------------------------


def test_categories_sort_by_code_everywhere(spark):
    df = spark.range(0, 90).select("id", (F.col("id") * 1.0).alias("v"))
    rows = bins.quantile_bins(df, "v", bins.TERCILES, LEVELS, out="bin", ordered=True)
    assert categories.categories_of(rows) == ["bin"]
    counts = rows.groupBy("bin").agg(F.count("*").alias("n"))
    assert [r.bin.label for r in counts.orderBy("bin").collect()] == LEVELS
    both = counts.union(counts).groupBy("bin").agg(F.sum("n").alias("n"))
    shown = categories.plain(both, codes=True).collect()
    assert [(r.bin, r.bin_code, r.n) for r in shown] == [(x, i, 60) for i, x in enumerate(LEVELS, 1)]
    assert rows.agg(F.max("bin").alias("top")).first().top.label == "High x"


def test_categories_pivot_by_label(spark):
    df = spark.createDataFrame([(1, "Mid x", 2.0), (1, "Low x", 1.0), (2, "High x", 3.0)], "u int, c string, v double")
    rows = categories.categorise(df, "c", LEVELS)
    wide = {r.u: (r["v_Low x"], r["v_Mid x"], r["v_High x"]) for r in spread(rows, ["u"], "c", LEVELS, ["v"]).collect()}
    assert wide == {1: (1.0, 2.0, None), 2: (None, None, 3.0)}
    assert sorted(tuple(r) for r in count_table(rows, ["u"], "c", LEVELS).collect()) == [(1, 1, 1, 0), (2, 0, 0, 1)]
    by_category = spread(rows, ["c"], "u", [1, 2], ["v"])
    assert [r.c.label for r in by_category.orderBy("c").collect()] == LEVELS
    with pytest.raises(PySparkException, match="not listed"):
        spread(rows, ["u"], "c", LEVELS[:2], ["v"]).collect()


def test_unlisted_label_is_an_error_and_null_stays(spark):
    df = spark.createDataFrame([("Low x",), (None,)], "c string")
    assert [r.c and tuple(r.c) for r in categories.categorise(df, "c", LEVELS).collect()] == [(1, "Low x"), None]
    with pytest.raises(PySparkException, match="c has a level that is not listed: other"):
        categories.categorise(spark.createDataFrame([("other",)], "c string"), "c", LEVELS).collect()
    assert categories.plain(df) is df


def test_categories_are_written_as_ordered_labels(spark):
    df = spark.createDataFrame([(c, i) for i, c in enumerate(reversed(LEVELS))], "c string, n int")
    path = session.scratch_path(spark, "csv")
    tables.write_csv(categories.categorise(df, "c", LEVELS).coalesce(1), path)
    back = tables.read_csv(spark, path, "c string, n int").collect()
    assert [(r.c, r.n) for r in back] == list(zip(LEVELS, (2, 1, 0), strict=True))


# Written tables --------------------------------------------------------------------------------


def test_scope_removes_its_tables_and_no_others(spark):
    before = materialize(spark.range(5), "outside")
    there = written(spark)
    with session.scope(spark):
        kept = materialize(spark.range(3), "outer")
        with session.scope(spark):
            assert materialize(spark.range(4), "inner").count() == 4
        assert kept.count() == 3
        assert written(spark) - there == {d for d in written(spark) if d.startswith("outer-")}
    assert written(spark) == there and before.count() == 5


def test_scope_removes_its_tables_after_an_error(spark):
    there = written(spark)
    with pytest.raises(ZeroDivisionError), session.scope(spark):
        materialize(spark.range(3), "lost")
        raise ZeroDivisionError
    with pytest.raises(PySparkException), session.scope(spark):
        materialize(spark.range(3).select(F.raise_error(F.lit("no"))), "failed")
    assert written(spark) == there
    with pytest.raises(PySparkException):
        materialize(spark.range(3).select(F.raise_error(F.lit("no")).cast("int").alias("x")), "failed")
    assert written(spark) == there


def test_sweep_takes_only_old_folders_of_others(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    assert session.sweep(spark) == []
    base = f"{tmp_path}/driftpanel"
    materialize(spark.range(1), "mine")
    for name, age in (("app-old", 100 * 3600), ("app-new", 60)):
        os.makedirs(f"{base}/{name}/table-1", exist_ok=True)
        lease = f"{base}/{name}/_LEASE"
        open(lease, "w").close()
        stamp = os.stat(lease).st_mtime - age
        os.utime(lease, (stamp, stamp))
    assert session.sweep(spark, hours=72) == ["app-old"]
    assert os.path.isdir(f"{base}/app-new") and spark.sparkContext.applicationId in os.listdir(base)
    assert session.sweep(spark, hours=0.001) == ["app-new"]


def test_reports_are_published_together(spark, tmp_path):
    folder = str(tmp_path / "out")
    one = spark.createDataFrame([(1, "a")], "x int, s string")
    reports.write_tables({"first": one, "second": one}, folder)
    assert open(f"{folder}/_COMPLETE").read().split() == ["first", "second"]
    published = files(folder)
    bad = one.select(F.raise_error(F.lit("no")).cast("int").alias("x"))
    with pytest.raises(PySparkException):
        reports.write_tables({"first": one.limit(0), "second": bad}, folder)
    assert files(folder) == published and not [d for d in os.listdir(folder) if d.startswith("_staging")]
    reports.write_tables({"first": one.union(one)}, folder)
    assert tables.read_csv(spark, f"{folder}/first", "x int, s string").count() == 2
    assert open(f"{folder}/_COMPLETE").read() == "first"


def test_export_leaves_nothing_but_its_tables(spark, tmp_path):
    there = written(spark)

    def build():
        rows = materialize(spark.range(100).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v")))
        return {"medians": bins.summarise(rows, ["g"], [F.count("*").alias("n")], {"median": ("v", 0.5)})}

    reports.export(spark, build, str(tmp_path / "out"))
    back = tables.read_csv(spark, str(tmp_path / "out" / "medians"), "g long, n long, median double").collect()
    assert sorted(tuple(r) for r in back) == [(0, 34, 49.5), (1, 33, 49.0), (2, 33, 50.0)]
    assert written(spark) == there

    def failing():
        materialize(spark.range(3))
        raise ValueError("on the way")

    with pytest.raises(ValueError):
        reports.export(spark, failing, str(tmp_path / "other"))
    assert written(spark) == there and not (tmp_path / "other").exists()


# Polygons --------------------------------------------------------------------------------------


def circle(n, reverse=False):
    angles = np.linspace(0, 2 * math.pi, n, endpoint=False)
    return list(enumerate(zip(np.cos(angles[:: -1 if reverse else 1]), np.sin(angles[:: -1 if reverse else 1]), strict=True)))


@pytest.mark.parametrize("stretch", [1, 2, 7, 8192])
def test_vertices_in_stretches(spark, stretch, monkeypatch):
    monkeypatch.setattr(geometry, "STRETCH", stretch)
    rows = [("u", 1, s, float(3 * x + 500), float(3 * y - 900)) for s, (x, y) in circle(50)]
    rows += [("u", 2, s + 5, float(x + 500), float(y - 900)) for s, (x, y) in circle(9, reverse=True)]
    rows += [("v", 1, 0, 1.0, 1.0), ("w", 1, 3, 0.0, 0.0), ("w", 1, 4, 2.0, 0.0), ("w", 1, 5, 0.0, 2.0)]
    df = spark.createDataFrame(rows, "unit string, ring int, seq int, x double, y double").repartition(5)
    got = {r.unit: r.area_m2 for r in geometry.polygon_area_from_vertices(df).collect()}
    area = lambda n: n / 2 * math.sin(2 * math.pi / n)
    assert got["u"] == pytest.approx(9 * area(50) - area(9), rel=1e-6)
    assert got["v"] == 0 and got["w"] == pytest.approx(2.0)
    for gap in (df.where("not (unit = 'u' and ring = 1 and seq = 20)"), df.union(df.where("unit = 'w' and seq = 4"))):
        with pytest.raises(PySparkException, match="gaps in ring"):
            geometry.polygon_area_from_vertices(gap).collect()


def test_vertices_move_once(spark):
    df = materialize(spark.range(0, 100).select(
        (F.col("id") % 4).alias("unit"), F.lit(1).alias("ring"), F.floor(F.col("id") / 4).alias("seq"),
        F.sin("id").alias("x"), F.cos("id").alias("y"),
    ))
    text = geometry.polygon_area_from_vertices(df)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert text.count("Scan parquet") == 1 and "SortMergeJoin" not in text
    assert sum("_stretch" in line for line in exchanges) == 1


# Report values ---------------------------------------------------------------------------------


def test_block_report_values(spark):
    """Two strata whose lines, changes and transitions are known by hand."""
    from driftpanel.plans.spec import BLOCK_SCENARIOS, PanelSpec

    rng = np.random.default_rng(2)
    units = 40
    x = {2010: rng.uniform(1, 9, units), 2020: rng.uniform(1, 9, units)}
    rows = []
    for season, buffer in BLOCK_SCENARIOS:
        for u in range(units):
            shift = 0.05 if u % 4 else -0.15
            for year in (2010, 2020):
                noise = 0.01 if u % 2 else -0.01
                y = 0.7 - 0.1 * math.log(x[year][u]) + noise + (shift if year == 2020 else 0.0)
                rows.append((u, season, buffer, year, float(y), float(x[year][u])))
    long = spark.createDataFrame(rows, "unit long, season string, buffer int, year int, ndvi double, hu_density double")
    out = reports.block_tables(long, PanelSpec())
    noise = np.where(np.arange(units) % 2, 0.01, -0.01)
    logs = np.log(x[2010])
    slope, intercept = np.polyfit(logs, 0.7 - 0.1 * logs + noise, 1)
    for r in out["regression_coefficients"].collect():
        assert (r.slope, r.intercept) == (pytest.approx(slope), pytest.approx(intercept)) and r.n == units
    change = (np.where(np.arange(units) % 4, 0.05, -0.15) + 0.7 - 0.1 * np.log(x[2020]) + noise) - (
        intercept + slope * np.log(x[2020])
    ) - (0.7 - 0.1 * logs + noise - intercept - slope * logs)
    for r in out["change_summary"].collect():
        assert r.mean_change == pytest.approx(change.mean()) and r.median_change == pytest.approx(np.median(change))
        assert r.sd_change == pytest.approx(change.std(ddof=1))
        assert (r.pct_brightened, r.pct_dimmed) == (75.0, 25.0)
    bright = [0.7 - 0.1 * logs + noise - intercept - slope * logs >= 0, None]
    bright[1] = bright[0] * 0 + ((0.7 - 0.1 * logs + noise - intercept - slope * logs) + change >= 0)
    want = {f"{a} -> {b}": int(((bright[0] == (a == "Bright")) & (bright[1] == (b == "Bright"))).sum()) for a in ("Bright", "Dim") for b in ("Bright", "Dim")}
    for r in out["transitions"].collect():
        assert {k: r[k] for k in want} == want
    box = out["box_change"].collect()
    assert {round(r.median, 12) for r in box} == {round(float(np.median(change)), 12)}
    test = out["season_t_test"].collect()[0]
    assert test["n"] == units and test["mean_diff"] == pytest.approx(0.0, abs=1e-12)
    assert [r.scenario for r in out["densification"].collect()] == ["Dormant 1000 m", "Growing 500 m", "Growing 1000 m", "Growing 2000 m"]
    quarters = [r.dens_q for r in out["transition_risk"].where("scenario = 'Growing 500 m'").collect()]
    assert quarters == ["Q1 (least)", "Q2", "Q3", "Q4 (most)"]
    risk = out["transition_risk"].groupBy("scenario").agg(F.sum("n_bright").alias("n"), F.sum("n_went_dim").alias("d")).collect()
    assert {(r.n, r.d) for r in risk} == {(int(bright[0].sum()), want["Bright -> Dim"])}
