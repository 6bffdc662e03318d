"""One query per operator and result table, over the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftpanel.checks import fixtures as fx
from driftpanel.functions import categories, scalars
from driftpanel.operators import assoc, chartdata, compose, geometry, infer, ols, panel
from driftpanel.operators import residual, sample
from driftpanel.operators.joins import full_join, grid_of, keep_matching, left_join, scenario_table
from driftpanel.operators.reshape import (
    add_suffix,
    columns_matching,
    count_table,
    format_columns,
    round_columns,
    spread,
    transpose,
)
from driftpanel.plans import block, prepare, tract
from driftpanel.plans.spec import (
    ALL_SCENARIOS,
    BLOCK_SCENARIOS,
    BUFFERS,
    SCENARIO_ORDER,
    SEASONS,
    TRANSITIONS,
)
from driftpanel.session import materialize, scratch_path
from driftpanel.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SPEC, TRACT = fx.SPEC, fx.TRACT_SPEC
DIGITS = 6


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def significant(df: DataFrame, *columns: str, digits: int = 8) -> DataFrame:
    """Columns as text with so many significant digits, whatever their size."""
    form = f"%.{digits - 1}e"
    text = {c: F.when(F.col(c).isNotNull(), F.format_string(form, F.col(c) + F.lit(0.0))) for c in columns}
    return df.withColumns(text)


def report(df: DataFrame, **digits: int) -> DataFrame:
    """Doubles rounded for comparison, negative zero made plain."""
    wanted = {
        f.name: digits.get(f.name, DIGITS)
        for f in df.schema.fields
        if f.dataType.simpleString() == "double"
    }
    out = round_columns(df, wanted)
    return out.withColumns({c: F.col(c) + F.lit(0.0) for c in wanted}) if wanted else out


# Shared inputs ---------------------------------------------------------------------------------


def wide(
    spark: SparkSession, sf: str, unit: str = "supplier", scenarios=ALL_SCENARIOS, by_unit=False
):
    return block.wide_panel(fx.unit_panel(spark, sf, unit), SPEC, scenarios, by_unit=by_unit)


def changes(spark: SparkSession, sf: str, unit: str = "supplier", scenarios=ALL_SCENARIOS):
    return block.analysed(fx.unit_panel(spark, sf, unit), SPEC, scenarios)


def stored_changes(spark: SparkSession, sf: str, unit: str = "supplier"):
    """Change rows in the retained scenarios, written once for several passes."""
    return changes(spark, sf, unit, BLOCK_SCENARIOS)


def demo(spark: SparkSession, sf: str, unit: str = "supplier"):
    return tract.demographics(
        fx.band_counts(spark, sf, unit),
        fx.type_counts(spark, sf, unit),
        fx.BAND_GROUPS,
        fx.TYPE_GROUPS,
        fx.PERIODS,
    )


def tract_rows(spark: SparkSession, sf: str):
    return tract.analysed_with_demographics(fx.tract_panel(spark, sf), demo(spark, sf), TRACT)


def tract_wide(spark: SparkSession, sf: str):
    return tract.tract_wide(fx.tract_panel(spark, sf), TRACT)


def tercile_rows(spark: SparkSession, sf: str):
    return tract.with_tercile(
        tract_rows(spark, sf), "pct_Standard_Type_2000", "Standard", "tercile", SPEC.label_digits
    )


# Sources, projections and joins ----------------------------------------------------------------


@query
def csv_roundtrip(spark, sf):
    rows = fx.unit_panel(spark, sf)
    path = scratch_path(spark, "csv")
    tables.write_csv(rows, path)
    return report(tables.read_csv(spark, path, rows.schema))


@query
def scenario_grid(spark, sf):
    """Every season × buffer with its row count in the panel, sorted."""
    grid = scenario_table(spark, ALL_SCENARIOS, ["season", "buffer"])
    counts = fx.unit_panel(spark, sf, "part").groupBy("season", "buffer").agg(
        F.count("*").alias("n")
    )
    return grid.join(counts, ["season", "buffer"], "left").fillna(0, ["n"]).orderBy(
        "season", "buffer"
    )


@query
def scenario_grid_from_data(spark, sf):
    """Every season x buffer x year of the levels found, also where no unit has a row."""
    rows = fx.unit_panel(spark, sf, "part", years=None)
    factors = ["season", "buffer", "year"]
    counts = rows.groupBy(*factors).agg(F.count("*").alias("n"))
    return grid_of(rows, factors).join(counts, factors, "left").fillna(0, ["n"])


@query
def semi_join_scenarios(spark, sf):
    keys = ["season", "buffer"]
    table = scenario_table(spark, BLOCK_SCENARIOS, keys)
    rows = keep_matching(fx.unit_panel(spark, sf, "part"), table, keys)
    return report(rows.select("unit", "season", "buffer", "year", "y", "hu"))


@query
def round_report(spark, sf):
    fit = ols.ols_by_stratum(wide(spark, sf, "part"), SPEC.y_base, SPEC.x_base, SPEC.strata)
    short = round_columns(fit, {"intercept": 5, "slope": 5, "r2": 5})
    text = format_columns(short.withColumn("se_text", F.col("slope_se")), {"se_text": "%.4f"})
    return report(text.select("season", "buffer", "intercept", "slope", "r2", "se_text"))


@query
def project_panel(spark, sf):
    rows = fx.unit_panel(spark, sf, "part")
    return report(rows.select("unit", "year", "season", "buffer", "y", "area_ha").drop("area_ha"))


@query
def select_by_pattern(spark, sf):
    rows = wide(spark, sf, "part")
    by_prefix = columns_matching(rows, ["Y_", "DELTA_"])
    by_type = columns_matching(rows, numeric=True, exclude=["unit", "buffer", *by_prefix])
    dated = [c for c in by_type if c in columns_matching(rows, pattern=r"_(1996|2000)$")]
    return report(rows.select("unit", "season", "buffer", *by_prefix, *dated))


@query
def suffix_full_join(spark, sf):
    years = [fx.year_bands(spark, sf, y) for y in fx.PERIODS]
    return report(prepare.two_year_counts(*years, fx.PERIODS, "BAND"))


@query
def density_join(spark, sf):
    rows = fx.unit_panel(spark, sf, "part")
    return report(
        rows.select("unit", "season", "buffer", "year", "area_ha", "hu_density", "pop_density")
    )


@query
def unit_year_join(spark, sf):
    rows = fx.tract_panel(spark, sf)
    return report(
        rows.select("unit", "season", "year", "y", "area_ha", "pop", "hu", "hu_density")
    )


@query
def normalize_id(spark, sf):
    rows = fx.table(spark, sf, "customer")
    return rows.select("c_custkey", scalars.normalize_id("c_name").alias("id"))


@query
def normalize_id_numeric(spark, sf):
    """Fractional, whole and decimal ids: the digits of the nearest whole number."""
    rows = fx.table(spark, sf, "customer")
    typed = {"real": "c_acctbal", "whole": F.col("c_custkey"), "exact": F.col("c_acctbal").cast("decimal(12,2)")}
    return rows.select("c_custkey", *[scalars.normalize_id(c).alias(n) for n, c in typed.items()])


@query
def head_by_key(spark, sf):
    shares = compose.shares_long(
        fx.band_counts(spark, sf), "tract20l", fx.BAND_GROUPS, fx.PERIODS
    )
    return report(sample.head_by(shares.filter(F.col("year") == fx.BASE), ["unit"], 3))


@query
def distinct_sorted(spark, sf):
    return sample.distinct_sorted(fx.unit_panel(spark, sf, "part"), ["season", "buffer"])


# Panel -----------------------------------------------------------------------------------------


@query
def clean_panel(spark, sf):
    rows = fx.unit_panel(spark, sf, "part", years=None)
    out = panel.clean_panel(rows, "y", "hu_density", fx.PERIODS, ints=["buffer"])
    return report(out.select("unit", "season", "buffer", "year", "y", "log_hu_density"))


@query
def clean_panel_drop_zero(spark, sf):
    rows = fx.unit_panel(spark, sf, "part", years=None)
    out = panel.clean_panel(
        rows, "y", "hu_density", fx.PERIODS, ints=["buffer"], zero_policy="drop"
    )
    return report(out.select("unit", "season", "buffer", "year", "y", "log_hu_density"))


@query
def panel_wide(spark, sf):
    return report(wide(spark, sf, "part").drop("delta_log_x", "delta_y"))


@query
def panel_deltas(spark, sf):
    rows = tract_wide(spark, sf)
    return report(
        rows.select(
            "unit", "season", "delta_log_x", "delta_y", "delta_hu", "delta_pop",
            "hu_density_1996", "hu_density_2000", "delta_hu_density",
        )
    )


@query
def panel_counts(spark, sf):
    return panel.panel_counts(wide(spark, sf, "part", BLOCK_SCENARIOS), "unit")


@query
def buffer_wide(spark, sf):
    rows = spread(
        fx.unit_panel(spark, sf, "part"),
        ["unit", "year", "season"],
        "buffer",
        BUFFERS,
        ["y"],
        name=lambda _, level: f"b{level}",
    )
    return report(rows)


@query
def season_wide(spark, sf):
    return report(block.season_wide(wide(spark, sf, "part", by_unit=True), SPEC))


@query
def change_wide(spark, sf):
    return report(block.change_by_scenario(changes(spark, sf), SPEC))


@query
def unpivot_value_year(spark, sf):
    return report(fx.unit_totals_long(spark, sf))


# Baseline line and change ----------------------------------------------------------------------


@query
def ols_by_stratum(spark, sf):
    fit = ols.ols_by_stratum(wide(spark, sf, "part"), SPEC.y_base, SPEC.x_base, SPEC.strata)
    return report(fit)


@query
def ols_by_stratum_p(spark, sf):
    fit = ols.ols_by_stratum(wide(spark, sf, "part"), SPEC.y_base, SPEC.x_base, SPEC.strata)
    return report(ols.with_slope_p(fit).select("season", "buffer", "slope_p"))


@query
def ols_by_stratum_digits(spark, sf):
    fit = ols.ols_by_stratum(wide(spark, sf, "part"), SPEC.y_base, SPEC.x_base, SPEC.strata)
    columns = ["intercept", "slope", "slope_se", "r2", "t"]
    return significant(fit, *columns).select(*SPEC.strata, *columns, "n")


@query
def densification_ols_digits(spark, sf):
    fit = block.densification(stored_changes(spark, sf, "part"), ["scenario"])
    columns = ["intercept", "slope", "slope_se", "r2", "t"]
    return significant(fit, *columns).select("scenario", *columns, "n")


@query
def pseudo_residual(spark, sf):
    rows = changes(spark, sf, "part")
    return report(
        rows.select(*SPEC.ids, "resid_1996", "pred_2000", "resid_2000", "change")
    )


@query
def state_transition(spark, sf):
    rows = changes(spark, sf, "part")
    return rows.select(*SPEC.ids, "state_1996", "state_2000", "transition", "direction")


@query
def transition_interpretation(spark, sf):
    rows = residual.interpret(changes(spark, sf, "part"))
    return rows.groupBy("transition", "direction", "interpretation").agg(
        F.count("*").alias("n")
    )


@query
def scenario_label(spark, sf):
    rows = residual.label_scenarios(wide(spark, sf, "part"), SCENARIO_ORDER)
    return (
        rows.groupBy("scenario", "scenario_order")
        .agg(F.count("*").alias("n"))
        .orderBy("scenario_order")
    )


@query
def change_summary(spark, sf):
    rows = changes(spark, sf, "part")
    return report(block.change_summary(rows, SPEC.strata, SPEC.label_digits))


@query
def transition_table(spark, sf):
    return block.transition_table(changes(spark, sf, "part"), SPEC.strata)


@query
def bright_subset(spark, sf):
    rows = block.bright_rows(stored_changes(spark, sf, "part"), SPEC)
    return report(rows.select(*SPEC.ids, "resid_1996", "went_dim"))


@query
def quantile_bins_grouped(spark, sf):
    rows = block.with_density_quartile(block.bright_rows(stored_changes(spark, sf), SPEC), SPEC)
    return rows.select("unit", "scenario", "dens_q")


@query
def transition_risk_by_quartile(spark, sf):
    return report(block.transition_risk(stored_changes(spark, sf), SPEC))


@query
def densification_ols(spark, sf):
    fit = block.densification(stored_changes(spark, sf, "part"), ["scenario"])
    return report(fit.select("scenario", "n", "slope", "slope_se", "r2"))


@query
def densification_ols_p(spark, sf):
    fit = block.densification(stored_changes(spark, sf, "part"), ["scenario"])
    return report(ols.with_slope_p(fit).select("scenario", "slope_p"))


@query
def trajectory_filter(spark, sf):
    rows = stored_changes(spark, sf, "part")
    near = rows.withColumns({c: F.round(c, 9) for c in ("delta_y", "delta_log_x")})
    kept = sample.moved_enough(near, "delta_y", "delta_log_x", 0.01, 0.05)
    return report(kept.select("unit", "scenario", "delta_y", "delta_log_x", "direction"))


@query
def group_sample(spark, sf):
    rows = changes(spark, sf, "part")
    drawn = sample.group_sample(rows, ["scenario"], 400, 42, ["unit"])
    return report(
        drawn.select("unit", "scenario", "y_1996", "y_2000", SPEC.x_base, SPEC.x_target)
    )


# Scenario comparison ---------------------------------------------------------------------------


@query
def corr_strict(spark, sf):
    rows = fx.unit_panel(spark, sf, "part", years=None)
    full = assoc.correlate(rows, {"r": ("pop", "hu")}, strict=True)
    sides = [add_suffix(fx.year_bands(spark, sf, y).drop("YEAR"), f"_{y}", "band") for y in fx.PERIODS]
    gaps = assoc.correlate(
        full_join(*sides, on="tract20l"), {"r": ("band1_1996", "band1_2000")}, strict=True
    )
    return report(
        full.withColumn("input", F.lit("complete")).unionByName(
            gaps.withColumn("input", F.lit("with gaps"))
        )
    )


@query
def corr_strict_bands(spark, sf):
    """All ten bands, most with gaps, and their totals with gaps made 0, all complete."""
    years = [fx.year_bands(spark, sf, y) for y in fx.PERIODS]
    both = prepare.two_year_counts(*years, fx.PERIODS, "BAND")
    pairs = {f"r{i}": (f"band{i}_1996", f"band{i}_2000") for i in range(1, 11)}
    rows = assoc.correlate(both, pairs, strict=True).withColumn("input", F.lit("with gaps"))
    filled = assoc.correlate(both.fillna(0.0), pairs, strict=True)
    return report(rows.unionByName(filled.withColumn("input", F.lit("filled"))))


@query
def level_checks(spark, sf):
    """Counts against each other, and built share against the outcome, before the analysis."""
    rows = fx.source_panel(spark, sf, "part", years=None)
    return report(prepare.level_checks(rows.withColumnRenamed("NDVI", "y"), SPEC))


@query
def corr_complete(spark, sf):
    sides = [add_suffix(fx.year_bands(spark, sf, y).drop("YEAR"), f"_{y}", "band") for y in fx.PERIODS]
    pairs = {f"r{i}": (f"band{i}_1996", f"band{i}_2000") for i in range(1, 11)}
    return report(assoc.correlate(full_join(*sides, on="tract20l"), pairs))


@query
def cross_season_corr(spark, sf):
    return report(block.cross_season_levels(wide(spark, sf, "part", by_unit=True), SPEC))


@query
def cross_season_change_corr(spark, sf):
    return report(block.cross_season_change(changes(spark, sf), SPEC))


@query
def cross_buffer_change_corr(spark, sf):
    return report(block.cross_buffer_change(changes(spark, sf), SPEC))


@query
def change_corr_matrix(spark, sf):
    return report(block.change_matrix(changes(spark, sf), SPEC))


@query
def change_corr_matrix_growing(spark, sf):
    rows = changes(spark, sf, scenarios=BLOCK_SCENARIOS)
    growing = rows.filter(F.col("season") == SEASONS[1])
    table = block.change_by_buffer(growing, SPEC)
    return report(assoc.correlation_matrix(table, [f"b{b}" for b in BUFFERS]))


@query
def nested_f_season(spark, sf):
    cells = block.scenario_cells(wide(spark, sf, "part"), SPEC)
    return report(ols.nested_f(cells, ["buffer"]))


@query
def nested_f_season_p(spark, sf):
    cells = block.scenario_cells(wide(spark, sf, "part"), SPEC)
    return report(infer.with_f_p(ols.nested_f(cells, ["buffer"])).select("buffer", "p"))


@query
def nested_f_buffer(spark, sf):
    cells = block.scenario_cells(wide(spark, sf, "part"), SPEC)
    return report(ols.nested_f(cells, ["season"]))


@query
def nested_f_buffer_p(spark, sf):
    cells = block.scenario_cells(wide(spark, sf, "part"), SPEC)
    return report(infer.with_f_p(ols.nested_f(cells, ["season"])).select("season", "p"))


@query
def model_selection(spark, sf):
    cells = block.scenario_cells(wide(spark, sf, "part"), SPEC)
    return report(ols.model_selection(cells, "season", "buffer"))


@query
def model_selection_additive2(spark, sf):
    cells = block.scenario_cells(wide(spark, sf), SPEC)
    table = ols.model_selection(cells, "season", "buffer")
    return report(table.filter(F.col("position") == 4).select("model", "k", "n", "r2", "aic", "bic"))


# Inference -------------------------------------------------------------------------------------

def _buffer_triples(spark, sf):
    return prepare.buffer_tests(fx.unit_panel(spark, sf, "part", years=None), SPEC)


@query
def paired_t_buffers(spark, sf):
    return report(_buffer_triples(spark, sf))


@query
def paired_t_buffers_p(spark, sf):
    return report(infer.with_t_p(_buffer_triples(spark, sf)).select("first", "second", "p"))


@query
def paired_t_buffers_ci(spark, sf):
    return report(infer.with_t_p(_buffer_triples(spark, sf)).select("first", "second", "lo", "hi"))


def _season_pairs(spark, sf, by=()):
    rows = block.change_by_season(changes(spark, sf), SPEC)
    return infer.paired_t(
        rows if by else rows.filter(F.col("buffer") == 1000), [SEASONS], by
    )


@query
def paired_t_season(spark, sf):
    return report(_season_pairs(spark, sf))


@query
def paired_t_season_by_buffer(spark, sf):
    return report(_season_pairs(spark, sf, ["buffer"]))


@query
def paired_t_season_p(spark, sf):
    return report(infer.with_t_p(_season_pairs(spark, sf)).select("first", "second", "p"))


@query
def paired_t_season_ci(spark, sf):
    return report(infer.with_t_p(_season_pairs(spark, sf)).select("first", "second", "lo", "hi"))


def _growing(spark, sf):
    return stored_changes(spark, sf, "part").filter(F.col("season") == "Growing_Season")


@query
def anova_oneway(spark, sf):
    return report(infer.anova_oneway(_growing(spark, sf), "change", "buffer", BUFFERS))


@query
def anova_oneway_p(spark, sf):
    table = infer.anova_oneway(_growing(spark, sf), "change", "buffer", BUFFERS)
    return report(infer.with_f_p(table).select("df1", "df2", "p"))


@query
def tukey_hsd_diff(spark, sf):
    return report(infer.tukey_differences(_growing(spark, sf), "change", "buffer", BUFFERS))


@query
def tukey_hsd(spark, sf):
    table = infer.tukey_differences(_growing(spark, sf), "change", "buffer", BUFFERS)
    return report(infer.tukey_hsd(table).select("pair", "diff", "lwr", "upr", "p_adj"))


@query
def cohens_d(spark, sf):
    return report(block.season_effect(changes(spark, sf, "part"), SPEC))


@query
def cohens_d_buffer(spark, sf):
    return report(block.buffer_effect(changes(spark, sf, "part"), SPEC))


@query
def mean_ci(spark, sf):
    return report(infer.mean_ci(stored_changes(spark, sf, "part"), "change", ["scenario", *SPEC.strata]))


@query
def slope_ci(spark, sf):
    fit = ols.ols_by_stratum(wide(spark, sf, "part"), SPEC.y_base, SPEC.x_base, SPEC.strata)
    return report(ols.slope_interval(fit).select(*SPEC.strata, "slope", "slope_se", "lo", "hi"))


# Composition -----------------------------------------------------------------------------------


@query
def composition_grouped(spark, sf):
    return report(
        prepare.age_shares(fx.band_counts(spark, sf, "part"), fx.PERIODS, "unit", fx.BAND_GROUPS)
    )


@query
def composition_share_race(spark, sf):
    return report(
        prepare.race_shares(fx.type_counts(spark, sf, "part"), fx.PERIODS, "unit", fx.TYPE_GROUPS)
    )


@query
def composition_share(spark, sf):
    return report(
        compose.shares_by_union(
            fx.type_counts(spark, sf), "tract20l", fx.TYPE_GROUPS, fx.PERIODS, compose.joined
        )
    )


@query
def delta_chi_grouped(spark, sf):
    rows = compose.composition_wide(
        fx.band_counts(spark, sf, "part"), "tract20l", fx.BAND_GROUPS, fx.PERIODS, "age"
    )
    return report(rows.select("unit", "total_pop_1996", "total_pop_2000", "delta_chi_age"))


@query
def delta_chi_raw(spark, sf):
    rows = compose.composition_wide(
        fx.type_counts(spark, sf, "part"),
        "tract20l",
        fx.TYPE_GROUPS,
        fx.PERIODS,
        "race",
        total="total_race",
        name=compose.joined,
    )
    return report(rows.select("unit", "total_race_1996", "total_race_2000", "delta_chi_race"))


@query
def composition_delta(spark, sf):
    rows = compose.composition_wide(
        fx.band_counts(spark, sf, "part"),
        "tract20l",
        fx.BAND_GROUPS,
        fx.PERIODS,
        "age",
        delta_total="delta_pop_age",
    )
    return report(rows.select("unit", *compose.delta_columns(fx.BAND_GROUPS), "delta_pop_age"))


@query
def demographics_join(spark, sf):
    rows = tract_rows(spark, sf)
    return report(
        rows.select(
            *SPEC.ids, "scenario", "change", "transition",
            *[c for c in demo(spark, sf).columns if c != "unit"],
        )
    )


@query
def unit_level_slice(spark, sf):
    rows = tract.one_per_unit(tract_rows(spark, sf), TRACT)
    return report(
        rows.select(
            "unit", "area_ha", "hu_1996", "hu_2000", "pop_1996", "pop_2000", "delta_hu", "delta_pop",
            *columns_matching(rows, ["pct_", "total_pop", "total_race"]),
        )
    )


@query
def growth_summary(spark, sf):
    return report(tract.growth_summary(tract.one_per_unit(tract_rows(spark, sf), TRACT), TRACT))


@query
def quantile_bins_global(spark, sf):
    units = tract.one_per_unit(tract_rows(spark, sf), TRACT)
    rows = tract.with_growth_quartile(units, digits=SPEC.label_digits)
    return report(rows.select("unit", "delta_hu", "growth_q"))


def _by_quartile(spark, sf):
    units = tract.one_per_unit(tract_rows(spark, sf), TRACT)
    return tract.composition_by_quartile(units, fx.BAND_GROUPS, fx.TYPE_GROUPS, TRACT)


@query
def composition_by_quartile(spark, sf):
    return report(_by_quartile(spark, sf))


@query
def composition_long(spark, sf):
    columns = [f"mean_{c}" for p in fx.PERIODS for c in compose.share_columns(fx.TYPE_GROUPS, p)]
    rows = chartdata.composition_long(_by_quartile(spark, sf), ["growth_q"], columns, fx.PERIODS)
    return report(rows)


# Shown names of the band groups.
BAND_LABELS = {"b1_3": "1-3", "b4_5": "4-5", "b6_8": "6-8", "b9_10": "9-10"}


@query
def composition_long_bands(spark, sf):
    columns = [f"mean_{c}" for p in fx.PERIODS for c in compose.share_columns(fx.BAND_GROUPS, p)]
    rows = chartdata.composition_long(
        _by_quartile(spark, sf), ["growth_q"], columns, fx.PERIODS, BAND_LABELS
    )
    return report(rows)


@query
def composition_summary(spark, sf):
    rows = materialize(demo(spark, sf), "demo")
    return report(tract.composition_summary(rows, fx.BAND_GROUPS, fx.TYPE_GROUPS, TRACT))


@query
def growth_demo_corr(spark, sf):
    units = tract.one_per_unit(tract_rows(spark, sf), TRACT)
    return report(
        tract.growth_correlations(
            units, tract.growth_variables(fx.BAND_GROUPS, fx.TYPE_GROUPS, TRACT)
        )
    )


@query
def growth_demo_corr_long(spark, sf):
    units = tract.one_per_unit(tract_rows(spark, sf), TRACT)
    return report(
        tract.growth_correlations_long(
            units, tract.growth_variables(fx.BAND_GROUPS, fx.TYPE_GROUPS, TRACT)
        )
    )


@query
def change_demo_corr(spark, sf):
    return report(
        tract.exposure_correlations(
            tract_rows(spark, sf), tract.exposure_variables(fx.BAND_GROUPS, fx.TYPE_GROUPS, TRACT)
        )
    )


@query
def corr_table_transposed(spark, sf):
    table = tract.exposure_correlations(
        tract_rows(spark, sf), tract.exposure_variables(fx.BAND_GROUPS, fx.TYPE_GROUPS, TRACT)
    ).drop("n")
    columns = [c for c in table.columns if c != "scenario"]
    return report(transpose(table, "scenario", ["Dormant 1000 m", "Growing 1000 m"], columns))


@query
def change_by_tercile(spark, sf):
    return report(
        tract.change_by_tercile(
            tercile_rows(spark, sf), "tercile", "pct_Standard_Type_2000", TRACT
        )
    )


@query
def change_by_tercile_b(spark, sf):
    rows = tract.with_tercile(
        tract_rows(spark, sf), "pct_b9_10_2000", "9-10", "tercile", SPEC.label_digits
    )
    return report(tract.change_by_tercile(rows, "tercile", "pct_b9_10_2000", TRACT))


@query
def transition_share_by_tercile(spark, sf):
    return report(tract.transition_share(tercile_rows(spark, sf), "tercile"))


@query
def levels_by_tercile(spark, sf):
    return report(tract.levels_by_tercile(tercile_rows(spark, sf), "tercile", TRACT))


# Tract grain, the tables of the block grain again ----------------------------------------------


@query
def tract_ols(spark, sf):
    fit = ols.with_slope_p(
        ols.ols_by_stratum(tract_rows(spark, sf), TRACT.y_base, TRACT.x_base, TRACT.strata)
    )
    columns = ["intercept", "slope", "slope_se", "r2"]
    return report(significant(fit, *columns).select(*TRACT.strata, *columns, "n", "slope_p"))


@query
def tract_change_summary(spark, sf):
    return report(block.change_summary(tract_rows(spark, sf), TRACT.strata, TRACT.label_digits))


@query
def tract_transitions(spark, sf):
    return block.transition_table(tract_rows(spark, sf), TRACT.strata)


@query
def tract_paired_t(spark, sf):
    rows = block.change_by_season(tract_rows(spark, sf), TRACT)
    return report(infer.with_t_p(infer.paired_t(rows, [SEASONS])).drop("alternative"))


# Ordered categories ----------------------------------------------------------------------------


def ordered_rows(spark: SparkSession, sf: str):
    """Tract rows whose scenario and tercile are categories."""
    joined = left_join(tract_wide(spark, sf), demo(spark, sf), ["unit"])
    rows = block.change_rows(materialize(joined, "tract"), TRACT, ordered=True)
    share = "pct_Standard_Type_2000"
    return tract.with_tercile(rows, share, "Standard", "tercile", SPEC.label_digits, ordered=True)


def numbered(df: DataFrame) -> DataFrame:
    """Labels in place of categories, and the place of each row in their order."""
    keys = categories.categories_of(df)
    place = F.row_number().over(Window.orderBy(*keys)).alias("place")
    return categories.plain(df.select(place, "*"), codes=True)


@query
def tercile_ordered(spark, sf):
    """Change by scenario and tercile: Low, Mid, High, the scenarios in their own order."""
    table = tract.change_by_tercile(ordered_rows(spark, sf), "tercile", "pct_Standard_Type_2000", TRACT)
    return report(numbered(table.select("scenario", "tercile", "n", "mean_change", "median_change")))


@query
def growth_ordered(spark, sf):
    """Growth quartiles as categories, pivoted by scenario, and bound to a total row per quartile."""
    units = tract.one_per_unit(tract_rows(spark, sf), TRACT)
    rows = tract.with_growth_quartile(units, digits=SPEC.label_digits, ordered=True)
    kinds = rows.groupBy("growth_q", "transition").agg(F.count("*").alias("n"))
    total = kinds.groupBy("growth_q").agg(F.lit("all").alias("transition"), F.sum("n").alias("n"))
    both = kinds.unionByName(total)
    levels = ["all", *TRANSITIONS]
    wide_table = spread(both, ["growth_q"], "transition", levels, ["n"], lambda _, level: level)
    return numbered(wide_table.fillna(0))


@query
def scenario_ordered(spark, sf):
    """Scenario categories on the columns of a pivot, by label, and down its rows, by code."""
    rows = block.change_rows(materialize(wide(spark, sf, "part"), "wide"), SPEC, ordered=True)
    table = rows.groupBy("scenario").agg(F.count("*").alias("n"), F.avg("change").alias("mean_change"))
    counts = count_table(rows, ["transition"], "scenario", SCENARIO_ORDER)
    top = counts.agg(*[F.max(s).alias(s) for s in SCENARIO_ORDER])
    most = top.unpivot([], list(SCENARIO_ORDER), "scenario", "most_common")
    most = categories.categorise(most, "scenario", SCENARIO_ORDER)
    return report(numbered(table.join(most, "scenario")))


# Chart data and geometry -----------------------------------------------------------------------


@query
def histogram(spark, sf):
    return report(chartdata.histogram(fx.table(spark, sf, "lineitem"), "l_extendedprice"))


@query
def histogram_log(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select(F.ln("l_extendedprice").alias("v"))
    return report(chartdata.histogram(rows, "v"))


@query
def histogram_log_density(spark, sf):
    """Log of a density that is 0 for many units: those are not finite and left out."""
    rows = fx.unit_panel(spark, sf, "part").select(F.ln("hu_density").alias("v"))
    return report(chartdata.histogram(rows, "v"))


@query
def histogram_even(spark, sf):
    rows = fx.unit_panel(spark, sf, "part").select("pop_density")
    return report(chartdata.histogram(rows, "pop_density", round_edges=False))


@query
def smooth_lm(spark, sf):
    rows = changes(spark, sf, "part").withColumn(
        "facet", scalars.scenario_name(F.col("season"), F.col("buffer"))
    )
    return report(chartdata.smooth_line(rows, "change", "delta_log_x", ["facet"]))


@query
def smooth_lm_band(spark, sf):
    line = chartdata.smooth_line(changes(spark, sf, "part"), "change", "delta_y", ["scenario"])
    return report(chartdata.smooth_band(line).select("scenario", "point", "x", "lo", "hi"))


@query
def smooth_facets(spark, sf):
    """A line with its band in every scenario and tercile, change by growth."""
    rows = tercile_rows(spark, sf).filter(F.col("tercile").isNotNull())
    line = chartdata.smooth_line(rows, "change", "delta_hu", ["scenario", "tercile"], 20, 0.95)
    return report(line.drop("df"))


@query
def boxplot_by_second_tercile(spark, sf):
    rows = tract.with_tercile(
        tract_rows(spark, sf), "pct_b9_10_2000", "9-10", "tercile", SPEC.label_digits
    )
    known = rows.filter(F.col("tercile").isNotNull())
    return report(chartdata.boxplot_stats(known, "change", ["scenario", "tercile"]))


@query
def boxplot_baseline(spark, sf):
    return report(chartdata.boxplot_stats(changes(spark, sf, "part"), "y_1996", ["scenario"]))


@query
def boxplot_stats(spark, sf):
    return report(chartdata.boxplot_stats(changes(spark, sf, "part"), "change", ["scenario"]))


@query
def boxplot_by_tercile(spark, sf):
    rows = tercile_rows(spark, sf).filter(F.col("tercile").isNotNull())
    return report(chartdata.boxplot_stats(rows, "y_1996", ["scenario", "tercile"]))


@query
def facet_long(spark, sf):
    rows = tract_rows(spark, sf).select(
        "unit", "scenario", "change", "delta_chi_race", *compose.delta_columns(fx.TYPE_GROUPS)
    )
    return report(
        chartdata.facet_long(
            rows,
            ["unit", "scenario", "change", "delta_chi_race"],
            compose.delta_columns(fx.TYPE_GROUPS),
            strip="delta_pct_",
            lead="Δ % ",
        )
    )


@query
def facet_long_chi(spark, sf):
    rows = tract_rows(spark, sf).select(
        "unit", "scenario", "change", "delta_chi_age", "delta_chi_race"
    )
    return report(
        chartdata.facet_long(
            rows,
            ["unit", "scenario", "change"],
            ["delta_chi_age", "delta_chi_race"],
            labels={"delta_chi_age": "Δχ² (Age)", "delta_chi_race": "Δχ² (Race)"},
        )
    )


@query
def polygon_area(spark, sf):
    rows = geometry.polygon_area(fx.rings(spark, sf), unit_in_m=geometry.US_SURVEY_FOOT)
    return report(rows, area_m2=9, area_ha=13)


@query
def polygon_area_vertices(spark, sf):
    rows = geometry.polygon_area_from_vertices(
        fx.vertices(spark, sf), unit_in_m=geometry.US_SURVEY_FOOT
    )
    return report(rows, area_m2=9, area_ha=13)
