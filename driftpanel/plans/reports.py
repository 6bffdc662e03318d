"""All result tables of one analysis by name, over a panel that is written once."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftpanel.functions.categories import categorise, plain
from driftpanel.operators import assoc, chartdata, compose, infer, ols, residual, sample
from driftpanel.operators.reshape import transpose
from driftpanel.plans import block, tract
from driftpanel.plans.spec import (
    ALL_SCENARIOS,
    BLOCK_SCENARIOS,
    BUFFERS,
    GROWTH_LABELS,
    QUARTILE_LABELS,
    SCENARIO_ORDER,
    SEASONS,
    PanelSpec,
    tercile_labels,
)
from driftpanel.session import commit, materialize, scope
from driftpanel.sources.tables import write_csv

Tables = dict[str, DataFrame]


#: Tables of a row per unit; the others are summaries, shown in the order of their categories.
_UNIT_ROWS = ("analysis", "demographics", "trajectories")


def _in_order(tables: Tables, levels: Mapping[str, Sequence[str]]) -> Tables:
    """Summaries sorted by the places of their labels in ``levels``, not by the alphabet."""
    out = {}
    for name, table in tables.items():
        own = [c for c in levels if c in table.columns]
        if own and name not in _UNIT_ROWS:
            for c in own:
                table = categorise(table, c, levels[c])
            table = plain(table, then=[c for c in ("point",) if c in table.columns])
        out[name] = table
    return out


def _baseline(wide: DataFrame, spec: PanelSpec) -> DataFrame:
    return ols.with_slope_p(ols.ols_by_stratum(wide, spec.y_base, spec.x_base, spec.strata))


def _season_test(rows: DataFrame, spec: PanelSpec, buffer: int) -> DataFrame:
    pairs = block.change_by_season(rows.filter(F.col(spec.buffer) == buffer), spec)
    return infer.with_t_p(infer.paired_t(pairs, [SEASONS]))


def _chart_data(rows: DataFrame, spec: PanelSpec, sample_size: int, dy: float, dx: float) -> Tables:
    moved = sample.moved_enough(rows, "delta_y", "delta_log_x", dy, dx)

    def line(y: str, x: str) -> DataFrame:
        return chartdata.smooth_line(rows, y, x, ["scenario"], confidence=0.95)

    return {
        "line_baseline": line(spec.y_base, spec.x_base),
        "line_change_by_density": line("change", "delta_log_x"),
        "line_change_by_level": line("change", "delta_y"),
        "trajectories": sample.group_sample(moved, ["scenario"], sample_size, 42, [spec.unit]),
        "box_change": chartdata.boxplot_stats(rows, "change", ["scenario"]),
        "mean_change_ci": infer.mean_ci(rows, "change", ["scenario", *spec.strata]),
    }


def block_tables(long: DataFrame, spec: PanelSpec) -> Tables:
    """Block-grain tables and chart data for the retained scenarios."""
    wide = materialize(block.wide_panel(long, spec, BLOCK_SCENARIOS), "block")
    rows = residual.interpret(block.change_rows(wide, spec))
    growing = rows.filter(F.col(spec.season) == SEASONS[1])
    by_buffer = block.change_by_buffer(growing, spec)
    differences = infer.tukey_differences(growing, "change", spec.buffer, BUFFERS)
    tables = {
        "regression_coefficients": _baseline(wide, spec),
        "change_summary": block.change_summary(rows, spec.strata, spec.label_digits),
        "transitions": block.transition_table(rows, spec.strata),
        "season_t_test": _season_test(rows, spec, 1000),
        "buffer_anova": infer.with_f_p(
            infer.anova_oneway(growing, "change", spec.buffer, BUFFERS)
        ),
        "buffer_tukey": infer.tukey_hsd(differences),
        "buffer_correlations": assoc.correlation_matrix(by_buffer, [f"b{b}" for b in BUFFERS]),
        "densification": ols.with_slope_p(block.densification(rows, ["scenario"])),
        "transition_risk": block.transition_risk(rows, spec),
        "analysis": rows,
        **_chart_data(rows, spec, 500, 0.01, 0.05),
    }
    return _in_order(tables, {"scenario": SCENARIO_ORDER, "dens_q": QUARTILE_LABELS})


def scenario_tables(long: DataFrame, spec: PanelSpec) -> Tables:
    """Are the season and buffer scenarios different? All six, side by side."""
    wide = materialize(block.wide_panel(long, spec, ALL_SCENARIOS), "scenarios")
    rows = block.change_rows(wide, spec)
    cells = block.scenario_cells(wide, spec)
    fit = _baseline(wide, spec)
    return {
        "season_correlations": block.cross_season_levels(wide, spec),
        "regression_coefficients": fit,
        "slope_intervals": ols.slope_interval(fit),
        "nested_season": infer.with_f_p(ols.nested_f(cells, [spec.buffer])),
        "nested_buffer": infer.with_f_p(ols.nested_f(cells, [spec.season])),
        "change_correlations": block.change_matrix(rows, spec),
        "season_change_correlations": block.cross_season_change(rows, spec),
        "buffer_change_correlations": block.cross_buffer_change(rows, spec),
        "model_selection": ols.model_selection(cells, spec.season, spec.buffer),
        "season_effect": block.season_effect(rows, spec),
        "buffer_effect": block.buffer_effect(rows, spec),
        "change_summary": block.change_summary(rows, spec.strata, spec.label_digits),
    }


def tract_tables(
    long: DataFrame,
    demo: DataFrame,
    spec: PanelSpec,
    age_groups: compose.Groups = compose.AGE_GROUPS,
    race_groups: compose.Groups = compose.RACE_GROUPS,
    share: str = "White",
    second_share: tuple[str, str] = ("60p", "60+"),
) -> Tables:
    """Tract-grain tables: change, growth by composition, and exposure by tercile.

    ``share`` is the race whose share forms the first terciles; ``second_share`` the age group
    and its label for the second.
    """
    demo = materialize(demo, "demographics")
    rows = tract.analysed_with_demographics(long, demo, spec)
    units = tract.one_per_unit(rows, spec)
    share_column = f"pct_{share}_{spec.target}"
    second, label = second_share
    second_column = f"pct_{second}_{spec.target}"
    first_bins = tract.with_tercile(
        rows, share_column, share, "tercile", spec.label_digits
    )
    second_bins = tract.with_tercile(rows, second_column, label, "tercile", spec.label_digits)
    exposure = tract.exposure_variables(age_groups, race_groups, spec)
    correlations = tract.exposure_correlations(rows, exposure)
    by_quartile = tract.composition_by_quartile(units, age_groups, race_groups, spec)

    def shown(groups: compose.Groups) -> DataFrame:
        columns = [f"mean_{c}" for p in spec.periods for c in compose.share_columns(groups, p)]
        return chartdata.composition_long(by_quartile, ["growth_q"], columns, spec.periods)

    faceted = ["scenario", "tercile"]
    in_first, in_second = (b.filter(F.col("tercile").isNotNull()) for b in (first_bins, second_bins))
    terciles = (*tercile_labels(share), *tercile_labels(label))
    tables = {
        "regression_coefficients": _baseline(rows, spec),
        "change_summary": block.change_summary(rows, spec.strata, spec.label_digits),
        "transitions": block.transition_table(rows, spec.strata),
        "season_t_test": _season_test(rows, spec, 1000),
        "demographics": demo,
        "growth_summary": tract.growth_summary(units, spec),
        "composition_by_growth": by_quartile,
        "growth_correlations": tract.growth_correlations_long(
            units, tract.growth_variables(age_groups, race_groups, spec)
        ),
        "change_by_tercile": tract.change_by_tercile(first_bins, "tercile", share_column, spec),
        "change_by_second_tercile": tract.change_by_tercile(
            second_bins, "tercile", second_column, spec
        ),
        "transitions_by_tercile": tract.transition_share(first_bins, "tercile"),
        "levels_by_tercile": tract.levels_by_tercile(first_bins, "tercile", spec),
        "exposure_correlations": transpose(
            correlations.drop("n"),
            "scenario",
            ["Dormant 1000 m", "Growing 1000 m"],
            [c for c in correlations.columns if c not in ("scenario", "n")],
        ),
        "composition_summary": tract.composition_summary(demo, age_groups, race_groups, spec),
        "race_by_growth": shown(race_groups),
        "age_by_growth": shown(age_groups),
        "box_change_by_tercile": chartdata.boxplot_stats(in_first, "change", faceted),
        "box_change_by_second_tercile": chartdata.boxplot_stats(in_second, "change", faceted),
        "box_baseline_by_tercile": chartdata.boxplot_stats(in_first, spec.y_base, faceted),
        "line_change_by_growth_and_tercile": chartdata.smooth_line(
            in_first, "change", "delta_hu", faceted, confidence=0.95
        ),
        "analysis": rows,
        **_chart_data(rows, spec, 400, 0.005, 0.02),
    }
    return _in_order(
        tables, {"scenario": SCENARIO_ORDER, "tercile": terciles, "growth_q": GROWTH_LABELS}
    )


def write_tables(tables: Mapping[str, DataFrame], folder: str) -> None:
    """One CSV folder per table, published together (see ``session.commit``)."""
    if not tables:
        return

    def write(staging: str) -> list[str]:
        for name, table in tables.items():
            write_csv(table, f"{staging}/{name}")
        return list(tables)

    commit(next(iter(tables.values())).sparkSession, folder, write)


def export(spark: SparkSession, build: Callable[[], Mapping[str, DataFrame]], folder: str) -> None:
    """Build the tables of an analysis, publish them in ``folder``, and remove all that was written on
    the way, also after an error."""
    with scope(spark):
        write_tables(build(), folder)
