import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from driftpanel import materialize
from driftpanel.functions import scalars
from driftpanel.operators import assoc, joins, panel, reshape, residual, sample
from driftpanel.plans import block
from driftpanel.plans.spec import BLOCK_SCENARIOS, PanelSpec

SPEC = PanelSpec()
LONG = "unit long, season string, buffer int, year int, ndvi double, hu_density double"


def long_frame(spark, rows):
    return spark.createDataFrame(rows, LONG)


def cell(unit, year, y, x, season="Growing_Season", buffer=1000):
    return (unit, season, buffer, year, y, x)


@pytest.fixture(scope="module")
def random_panel(spark):
    rng = np.random.default_rng(5)
    rows = []
    for season in ("Dormant_Season", "Growing_Season"):
        for buffer in (500, 1000, 2000):
            for unit in range(60):
                x0, x1 = rng.gamma(2.0, 3.0, 2)
                x0 = 0.0 if unit % 17 == 0 else x0
                for year, x in ((2010, x0), (2020, x1)):
                    y = 0.5 - 0.01 * math.log(max(x, 1e-10)) + rng.normal(0, 0.02)
                    rows.append((unit, season, buffer, year, float(y), float(x)))
    return long_frame(spark, rows).cache()


def test_unreadable_numbers_become_null(spark):
    df = spark.createDataFrame([("1.5", "2010"), ("abc", "x")], "a string, b string")
    out = panel.cast_columns(df, ["a"], ["b"]).collect()
    assert [tuple(r) for r in out] == [(1.5, 2010), (None, None)]


def test_zero_area_gives_null_density(spark):
    df = spark.createDataFrame([(4.0, 2.0), (4.0, 0.0), (0.0, 0.0)], "hu double, area_ha double")
    out = panel.add_density(df, {"d": "hu"}).collect()
    assert [r["d"] for r in out] == [2.0, None, None]


def test_floor_keeps_zero_density_and_drop_removes_it(spark):
    df = long_frame(
        spark,
        [cell(1, 2010, 0.4, 0.0), cell(2, 2010, 0.4, 2.0), cell(3, 2010, None, 2.0),
         cell(4, 2010, 0.4, None), cell(5, 2015, 0.4, 2.0)],
    )
    floor = panel.clean_panel(df, "ndvi", "hu_density", (2010, 2020)).collect()
    assert {r["unit"]: r["log_hu_density"] for r in floor} == {
        1: pytest.approx(math.log(1e-10)), 2: pytest.approx(math.log(2.0))
    }
    drop = panel.clean_panel(df, "ndvi", "hu_density", (2010, 2020), zero_policy="drop")
    assert [r["unit"] for r in drop.collect()] == [2]
    with pytest.raises(ValueError):
        panel.clean_panel(df, "ndvi", "hu_density", (2010, 2020), zero_policy="other")


def test_log_floor_keeps_null(spark):
    df = spark.createDataFrame([(None,), (0.0,)], "x double")
    out = [r[0] for r in df.select(scalars.log_floored(F.col("x"))).collect()]
    assert out == [None, pytest.approx(math.log(1e-10))]


def test_wide_keeps_only_complete_units(spark):
    df = long_frame(spark, [cell(1, 2010, 0.1, 1.0), cell(1, 2020, 0.2, 2.0), cell(2, 2010, 0.3, 1.0)])
    wide = block.wide_panel(df, SPEC).collect()
    assert len(wide) == 1
    row = wide[0]
    assert row["delta_y"] == pytest.approx(0.1)
    assert row["delta_log_x"] == pytest.approx(math.log(2))


def test_duplicate_cell_is_an_error(spark):
    df = long_frame(spark, [cell(1, 2010, 0.1, 1.0), cell(1, 2010, 0.2, 1.0), cell(1, 2020, 0.2, 1.0)])
    with pytest.raises(PySparkException, match="more than one row for year 2010 at 1"):
        block.wide_panel(df, SPEC).collect()
    assert panel.duplicate_cells(df, ["unit", "season", "buffer", "year"]).count() == 1


def test_semi_join_before_pivot_equals_after(spark, random_panel):
    early = block.wide_panel(random_panel, SPEC, BLOCK_SCENARIOS)
    late = joins.keep_scenarios(block.wide_panel(random_panel, SPEC, None), BLOCK_SCENARIOS)
    assert early.exceptAll(late).count() == 0 and late.exceptAll(early).count() == 0


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_one_shuffle_serves_both_pivots(spark, random_panel):
    together = block.season_wide(block.wide_panel(random_panel, SPEC, by_unit=True), SPEC)
    apart = block.season_wide(block.wide_panel(random_panel, SPEC), SPEC)
    assert (exchanges(together), exchanges(apart)) == (1, 2)
    assert together.exceptAll(apart).count() == 0 and apart.exceptAll(together).count() == 0


def test_change_rows_add_no_shuffle(spark, random_panel):
    stored = materialize(block.wide_panel(random_panel, SPEC))
    assert exchanges(block.change_rows(stored, SPEC)) == 0


def test_change_is_delta_y_minus_slope_times_delta_x(spark, random_panel):
    wide = block.wide_panel(random_panel, SPEC)
    rows = block.change_rows(wide, SPEC).toPandas()
    for _, part in rows.groupby(["season", "buffer"]):
        slope, intercept = np.polyfit(part[SPEC.x_base], part[SPEC.y_base], 1)
        np.testing.assert_allclose(
            part["change"], part["delta_y"] - slope * part["delta_log_x"], atol=1e-10
        )
        np.testing.assert_allclose(
            part["resid_2010"], part[SPEC.y_base] - (intercept + slope * part[SPEC.x_base]), atol=1e-9
        )
        assert abs(part["resid_2010"].sum()) < 1e-9


def test_results_do_not_depend_on_partitioning(spark, random_panel):
    def table(df):
        rows = block.change_rows(block.wide_panel(df, SPEC), SPEC)
        out = block.change_summary(rows, ["season", "buffer"]).toPandas()
        return out.sort_values(["season", "buffer"]).reset_index(drop=True).round(10)

    one, many = table(random_panel.coalesce(1)), table(random_panel.repartition(13, "ndvi"))
    assert one.equals(many[one.columns])


def test_transition_counts_add_up(spark, random_panel):
    rows = block.change_rows(block.wide_panel(random_panel, SPEC), SPEC)
    table = block.transition_table(rows, ["season", "buffer"]).toPandas()
    assert (table.drop(columns=["season", "buffer"]).sum(axis=1) == 60).all()


def test_states_and_directions_at_zero(spark):
    df = spark.createDataFrame(
        [(0.0, -1.0, 0.0), (-0.5, 0.0, 0.5), (0.2, 0.1, -0.1), (1e-14, -1e-14, -2e-14)],
        "resid_2010 double, resid_2020 double, change double",
    )
    exact = residual.classify(df, (2010, 2020)).collect()
    assert [(r["transition"], r["direction"]) for r in exact] == [
        ("Bright -> Dim", "No change"),
        ("Dim -> Bright", "Brightened"),
        ("Bright -> Bright", "Dimmed"),
        ("Bright -> Dim", "Dimmed"),
    ]
    steady = residual.classify(df, (2010, 2020), digits=9).collect()[3]
    assert (steady["transition"], steady["direction"]) == ("Bright -> Bright", "No change")


def test_constant_x_has_no_line(spark):
    rows = [cell(u, p, 0.1 * u, 1.0) for u in range(4) for p in (2010, 2020)]
    out = block.change_rows(block.wide_panel(long_frame(spark, rows), SPEC), SPEC).collect()
    assert all(r["change"] is None for r in out)


def test_interpretation_covers_the_six_cases(spark):
    df = spark.createDataFrame(list(scalars.INTERPRETATION), "transition string, direction string")
    out = residual.interpret(df).collect()
    assert [r["interpretation"] for r in out] == list(scalars.INTERPRETATION.values())
    other = spark.createDataFrame([("Dim -> Dim", "No change")], "transition string, direction string")
    assert residual.interpret(other).first()["interpretation"] is None


def test_normalize_id(spark):
    df = spark.createDataFrame([("Tract 53-001",), ("none",), (None,)], "t string")
    out = [r[0] for r in df.select(scalars.normalize_id("t")).collect()]
    assert out == [53001, None, None]


def test_full_join_null_keys(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (None, "y"), (3, "z")], "k int, r string")
    def rows(mode):
        return {(r["k"], r["l"], r["r"]) for r in joins.full_join(left, right, "k", mode).collect()}

    common = {(1, "a", "x"), (2, "c", None), (3, None, "z")}
    assert rows("match") == {*common, (None, "b", "y")}
    assert rows("keep") == {*common, (None, "b", None), (None, None, "y")}
    assert rows("drop") == common
    with pytest.raises(ValueError):
        joins.full_join(left, right, "k", "other")


def test_semi_join_to_a_table_and_to_a_list_agree(spark, random_panel):
    keys = ["season", "buffer"]
    table = joins.scenario_table(spark, BLOCK_SCENARIOS, keys)
    one = joins.keep_matching(random_panel, table.union(table), keys)
    two = joins.keep_scenarios(random_panel, BLOCK_SCENARIOS, keys)
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0
    assert joins.keep_scenarios(random_panel, []).count() == 0


def test_columns_by_prefix_ignore_case(spark):
    df = spark.createDataFrame([(1, "x", 2.0, 3.0)], "AGE0_4 int, name string, age5 double, Total double")
    assert reshape.columns_matching(df, "age") == ["AGE0_4", "age5"]
    assert reshape.columns_matching(df, numeric=True, exclude=["Total"]) == ["AGE0_4", "age5"]
    assert reshape.add_suffix(df, "_2010", "age").columns == ["AGE0_4_2010", "name", "age5_2010", "Total"]


def test_gather_by_period(spark):
    df = spark.createDataFrame([(1, 10.0, 20.0, 3.0, 4.0)], "t int, POP2010 double, POP2020 double, HU2010 double, HU2020 double")
    out = reshape.gather_by_period(df, ["t"], r"(POP|HU)(\d{4})").collect()
    assert [tuple(r) for r in out] == [(1, 2010, 10.0, 3.0), (1, 2020, 20.0, 4.0)]


def test_count_table_fills_zero(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "g string, v string")
    out = {r["g"]: (r["x"], r["y"], r["z"]) for r in reshape.count_table(df, ["g"], "v", ["x", "y", "z"]).collect()}
    assert out == {"a": (2, 0, 0), "b": (0, 1, 0)}


def test_transpose_is_its_own_inverse(spark):
    df = spark.createDataFrame([("p", 1.0, 2.0), ("q", 3.0, 4.0)], "s string, a double, b double")
    out = {r["variable"]: (r["p"], r["q"]) for r in reshape.transpose(df, "s", ["p", "q"], ["a", "b"]).collect()}
    assert out == {"a": (1.0, 3.0), "b": (2.0, 4.0)}


def test_round_and_format(spark):
    df = spark.createDataFrame([(1.23456, 7)], "a double, n int")
    assert reshape.round_columns(df, 2).first()["a"] == 1.23
    assert reshape.format_columns(df, {"a": "%.4f"}).first()["a"] == "1.2346"


def test_correlations(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.1, 5.0), (3.0, 5.9, 5.0), (4.0, None, 5.0)], "a double, b double, c double")
    row = assoc.correlate(df, {"ab": ("a", "b"), "ac": ("a", "c")}).first()
    assert row["ab"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4.1, 5.9])[0, 1])
    assert row["ac"] is None
    assert assoc.correlate(df, {"ab": ("a", "b")}, strict=True).first()["ab"] is None


def test_matrix_uses_complete_rows_only(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(40, 3))
    rows = [tuple(float(v) for v in r) for r in data] + [(9.0, None, 9.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    out = assoc.correlation_matrix(df, ["a", "b", "c"]).collect()
    want = np.corrcoef(data.T)
    assert len(out) == 9 and {r["n"] for r in out} == {40}
    for r in out:
        assert r["r"] == pytest.approx(want["abc".index(r["row"])]["abc".index(r["column"])])


def test_sample_size_and_repeatability(spark):
    df = spark.range(0, 3000).select((F.col("id") % 3 == 0).cast("int").alias("g"), "id")
    drawn = sample.group_sample(df, ["g"], 50, 42, ["id"]).collect()
    again = sample.group_sample(df.repartition(7), ["g"], 50, 42, ["id"]).collect()
    other = sample.group_sample(df, ["g"], 50, 43, ["id"]).collect()
    assert sorted(drawn) == sorted(again) and sorted(drawn) != sorted(other)
    assert len(drawn) == 100
    assert sample.group_sample(df.filter("id < 30"), ["g"], 50, 42, ["id"]).count() == 30


def test_sample_limits_groups_before_the_shuffle(spark):
    df = spark.range(0, 9000).select((F.col("id") % 3 == 0).cast("int").alias("g"), "id")
    plan = sample.group_sample(df, ["g"], 50, 42, ["id"])._jdf.queryExecution().toString()
    assert "WindowGroupLimit [g" in plan and "Partial" in plan
    large = sample.group_sample(df, ["g"], 2000, 42, ["id"])
    assert "_slice" in large._jdf.queryExecution().toString()
    by_hash = df.filter("g = 1").orderBy(F.md5(F.concat_ws(":", F.lit("42"), "id"))).limit(2000)
    assert sorted(r["id"] for r in large.filter("g = 1").collect()) == sorted(
        r["id"] for r in by_hash.collect()
    )
    assert large.count() == 4000


def test_strict_and_long_correlation_forms_agree(spark):
    df = spark.range(0, 50).select(
        F.col("id").cast("double").alias("a"), F.sin("id").alias("b"), F.cos("id").alias("c")
    )
    long = {r["variable"]: r["r"] for r in assoc.correlate_long(df, "a", ["b", "c"]).collect()}
    wide = assoc.correlate(df, {"b": ("a", "b"), "c": ("a", "c")}, strict=True).first()
    assert long == {"b": wide["b"], "c": wide["c"]}
