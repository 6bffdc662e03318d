"""Block-grain analysis: wide panel, change, its tables, and the scenario comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftpanel.functions.scalars import percent_true
from driftpanel.operators import assoc, bins, infer, ols, panel, residual
from driftpanel.operators.joins import keep_scenarios, settle
from driftpanel.operators.reshape import count_table, spread
from driftpanel.plans.spec import (
    ALL_SCENARIOS,
    BUFFERS,
    QUARTILE_LABELS,
    SCENARIO_ORDER,
    SEASONS,
    TRANSITIONS,
    PanelSpec,
)
from driftpanel.session import materialize


def wide_panel(
    long: DataFrame,
    spec: PanelSpec,
    scenarios: Sequence[tuple[str, int]] | None = ALL_SCENARIOS,
    extra: Sequence[str] = (),
    keep: Sequence[str] = (),
    by_unit: bool = False,
) -> DataFrame:
    """Cleaned, pivoted and differenced panel, one row per unit and scenario.

    The scenario filter comes before the pivot: its keys are grouping keys, so rows it removes
    are never shuffled. ``extra`` values are pivoted too; ``keep`` columns are part of the id.
    ``by_unit`` leaves all rows of a unit together for a join or pivot that follows.
    """
    rows = panel.clean_panel(
        long, spec.y, spec.x, spec.periods, spec.period, [spec.buffer], spec.zero_policy
    )
    if scenarios is not None:
        rows = keep_scenarios(rows, scenarios, spec.strata)
    wide = panel.panel_wide(
        rows,
        [*spec.ids, *keep],
        [spec.log_x, spec.y, *extra],
        spec.periods,
        spec.period,
        spec.unit if by_unit else None,
    )
    return panel.panel_deltas(wide, {"delta_log_x": spec.log_x, "delta_y": spec.y}, spec.periods)


def change_rows(wide: DataFrame, spec: PanelSpec, ordered: bool = False) -> DataFrame:
    """Pseudo-residual change with states, transition, direction and scenario name, which is a
    category if ``ordered``."""
    rows = residual.pseudo_residual(wide, spec.y, spec.log_x, spec.periods, spec.strata)
    rows = residual.classify(rows, spec.periods, spec.label_digits)
    return residual.label_scenarios(rows, SCENARIO_ORDER, spec.season, spec.buffer, ordered)


def analysed(
    long: DataFrame,
    spec: PanelSpec,
    scenarios: Sequence[tuple[str, int]] | None = ALL_SCENARIOS,
) -> DataFrame:
    """``change_rows`` over a panel that is shuffled and written once."""
    return change_rows(materialize(wide_panel(long, spec, scenarios), "wide"), spec)


def change_summary(rows: DataFrame, by: Sequence[str], digits: int | None = None) -> DataFrame:
    """n, mean, sd, median and direction shares of change."""
    change = F.col("change") if digits is None else F.round("change", digits)
    aggregates = [
        F.count("*").alias("n"),
        F.avg("change").alias("mean_change"),
        F.stddev_samp("change").alias("sd_change"),
        percent_true(change > 0).alias("pct_brightened"),
        percent_true(change < 0).alias("pct_dimmed"),
    ]
    return bins.summarise(rows, by, aggregates, {"median_change": ("change", 0.5)})


def transition_table(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Transition counts, one column per transition."""
    return count_table(rows, by, "transition", TRANSITIONS)


def densification(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Line of change on the change in log density."""
    return ols.ols_by_stratum(rows, "change", "delta_log_x", by)


def bright_rows(rows: DataFrame, spec: PanelSpec) -> DataFrame:
    """Units above the line in the baseline, with a flag for those now below it."""
    bright = rows.filter(F.col(f"state_{spec.base}") == "Bright")
    return bright.withColumn(
        "went_dim", (F.col(f"state_{spec.target}") == "Dim").cast("int")
    )


def with_density_quartile(bright: DataFrame, spec: PanelSpec) -> DataFrame:
    return bins.quantile_bins(
        bright,
        "delta_log_x",
        bins.QUARTILES,
        QUARTILE_LABELS,
        ["scenario"],
        "dens_q",
        spec.label_digits,
    )


def transition_risk(rows: DataFrame, spec: PanelSpec) -> DataFrame:
    """Share of bright units that went dim, per scenario and densification quartile."""
    binned = with_density_quartile(bright_rows(rows, spec), spec)
    return binned.groupBy("scenario", "dens_q").agg(
        F.count("*").alias("n_bright"),
        F.sum("went_dim").alias("n_went_dim"),
        (F.avg("went_dim") * 100).alias("pct_went_dim"),
    )


# Scenario comparison ---------------------------------------------------------------------------


def season_wide(wide: DataFrame, spec: PanelSpec) -> DataFrame:
    """Both seasons of a unit and buffer side by side, complete rows only."""
    return spread(
        wide,
        [spec.unit, spec.buffer],
        spec.season,
        SEASONS,
        [spec.y_base, spec.y_target],
        name=lambda value, level: f"{value}_{level}",
        drop_incomplete=True,
    )


def cross_season_levels(wide: DataFrame, spec: PanelSpec) -> DataFrame:
    """Correlation between seasons of the level in each period, per buffer."""
    dormant, growing = SEASONS
    pairs = {
        f"r_{p}": (f"{spec.y}_{p}_{dormant}", f"{spec.y}_{p}_{growing}") for p in spec.periods
    }
    return assoc.correlate(season_wide(wide, spec), pairs, [spec.buffer])


def change_by_season(rows: DataFrame, spec: PanelSpec) -> DataFrame:
    return spread(
        rows,
        [spec.unit, spec.buffer],
        spec.season,
        SEASONS,
        ["change"],
        name=lambda _, level: level,
        drop_incomplete=True,
    )


def change_by_buffer(rows: DataFrame, spec: PanelSpec, levels: Sequence[int] = BUFFERS) -> DataFrame:
    return spread(
        rows,
        [spec.unit, spec.season],
        spec.buffer,
        levels,
        ["change"],
        name=lambda _, level: f"b{level}",
        drop_incomplete=True,
    )


def change_by_scenario(
    rows: DataFrame, spec: PanelSpec, scenarios: Sequence[tuple[str, int]] = ALL_SCENARIOS
) -> DataFrame:
    """One column of change per scenario, units complete in all of them."""
    keyed = rows.withColumn(
        "_scenario", F.concat_ws("_", F.col(spec.season), F.col(spec.buffer).cast("string"))
    )
    return spread(
        keyed,
        [spec.unit],
        "_scenario",
        [f"{s}_{b}" for s, b in scenarios],
        ["change"],
        name=lambda _, level: f"g_{level}",
        drop_incomplete=True,
        other="drop",
    )


def cross_season_change(rows: DataFrame, spec: PanelSpec) -> DataFrame:
    return assoc.correlate(
        change_by_season(rows, spec), {"r_change": SEASONS}, [spec.buffer]
    )


def cross_buffer_change(rows: DataFrame, spec: PanelSpec) -> DataFrame:
    pairs = {
        f"r_{a}_{b}": (f"b{a}", f"b{b}")
        for i, a in enumerate(BUFFERS)
        for b in BUFFERS[i + 1 :]
    }
    return assoc.correlate(change_by_buffer(rows, spec), pairs, [spec.season])


def change_matrix(rows: DataFrame, spec: PanelSpec) -> DataFrame:
    wide = change_by_scenario(rows, spec)
    return assoc.correlation_matrix(wide, [c for c in wide.columns if c != spec.unit])


def scenario_cells(wide: DataFrame, spec: PanelSpec) -> DataFrame:
    """Baseline moments per season and buffer: all the model comparisons need."""
    return settle(ols.moments(wide, spec.y_base, spec.x_base, spec.strata))


def season_effect(rows: DataFrame, spec: PanelSpec) -> DataFrame:
    return infer.cohens_d(rows, "change", spec.season, *SEASONS, by=[spec.buffer])


def buffer_effect(rows: DataFrame, spec: PanelSpec) -> DataFrame:
    return infer.cohens_d(rows, "change", spec.buffer, BUFFERS[0], BUFFERS[-1], by=[spec.season])
