"""Tract-grain analysis: change joined to composition, growth tables and exposure tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftpanel.functions.moments import correlation
from driftpanel.functions.scalars import percent_true
from driftpanel.operators import assoc, bins, compose, panel
from driftpanel.operators.joins import full_join, left_join
from driftpanel.plans import block
from driftpanel.plans.spec import GROWTH_LABELS, SEASONS, TRACT_SCENARIOS, PanelSpec, tercile_labels
from driftpanel.session import materialize


def tract_wide(long: DataFrame, spec: PanelSpec) -> DataFrame:
    """Wide panel with counts, their deltas and density per period."""
    wide = block.wide_panel(
        long, spec, TRACT_SCENARIOS, extra=["hu", "pop"], keep=["area_ha"], by_unit=True
    )
    wide = panel.panel_deltas(wide, {"delta_hu": "hu", "delta_pop": "pop"}, spec.periods)
    wide = wide.withColumns(
        {
            f"hu_density_{p}": F.try_divide(F.col(f"hu_{p}"), F.col("area_ha"))
            for p in spec.periods
        }
    )
    return panel.panel_deltas(wide, {"delta_hu_density": "hu_density"}, spec.periods)


def demographics(
    age: DataFrame,
    race: DataFrame,
    age_groups: compose.Groups,
    race_groups: compose.Groups,
    periods: Sequence[int],
    id_column: str = "tract20l",
    unit: str = "unit",
    race_name: compose.Namer = compose.joined,
    null_keys: str = "keep",
) -> DataFrame:
    """Age and race composition of both periods, one row per unit.

    The age-based population change is ``delta_pop_age``; ``delta_pop`` is the panel's own.
    """
    by_age = compose.composition_wide(
        age, id_column, age_groups, periods, "age", delta_total="delta_pop_age", unit=unit
    )
    by_race = compose.composition_wide(
        race,
        id_column,
        race_groups,
        periods,
        "race",
        total="total_race",
        name=race_name,
        unit=unit,
    )
    return full_join(by_age, by_race, unit, null_keys)


def analysed_with_demographics(
    long: DataFrame, demo: DataFrame, spec: PanelSpec
) -> DataFrame:
    """Change rows left-joined to composition.

    The wide panel and the composition meet in one written table; the baseline line and every
    table after it are passes over its columns, without another shuffle of units.
    """
    joined = left_join(tract_wide(long, spec), demo, [spec.unit])
    return block.change_rows(materialize(joined, "tract"), spec)


def one_per_unit(rows: DataFrame, spec: PanelSpec) -> DataFrame:
    """Unit-level measures repeat in every season: keep one."""
    return rows.filter(F.col(spec.season) == SEASONS[0])


def growth_summary(units: DataFrame, spec: PanelSpec) -> DataFrame:
    """Totals, shares and quartiles of growth over all units, one record."""
    base, target = spec.periods
    aggregates = [
        F.count("*").alias("n_units"),
        F.sum(f"hu_{base}").alias(f"total_hu_{base}"),
        F.sum(f"hu_{target}").alias(f"total_hu_{target}"),
        F.sum("delta_hu").alias("total_delta_hu"),
        percent_true(F.col("delta_hu") > 0).alias("pct_gained_hu"),
        percent_true(F.col("delta_hu") < 0).alias("pct_lost_hu"),
        F.avg("delta_hu").alias("mean_delta_hu"),
        F.sum(f"pop_{base}").alias(f"total_pop_{base}"),
        F.sum(f"pop_{target}").alias(f"total_pop_{target}"),
        F.sum("delta_pop").alias("total_delta_pop"),
    ]
    names = ["q25_delta_hu", "median_delta_hu", "q75_delta_hu"]
    quartiles = {name: ("delta_hu", p) for name, p in zip(names, (0.25, 0.5, 0.75), strict=True)}
    return bins.summarise(units, [], aggregates, quartiles)


def with_growth_quartile(
    units: DataFrame,
    labels: Sequence[str] = GROWTH_LABELS,
    digits: int | None = None,
    ordered: bool = False,
) -> DataFrame:
    return bins.quantile_bins(
        units, "delta_hu", bins.QUARTILES, labels, out="growth_q", digits=digits, ordered=ordered
    )


def composition_by_quartile(
    units: DataFrame,
    age_groups: compose.Groups,
    race_groups: compose.Groups,
    spec: PanelSpec,
) -> DataFrame:
    """Mean composition and its change per growth quartile."""
    binned = with_growth_quartile(units, digits=spec.label_digits)
    columns = []
    for groups in (race_groups, age_groups):
        for p in reversed(spec.periods):
            columns += compose.share_columns(groups, p)
        columns += compose.delta_columns(groups)
    aggregates = [
        F.count("*").alias("n_units"),
        F.avg("delta_hu").alias("mean_delta_hu"),
        F.avg("delta_pop_age").alias("mean_delta_pop_age"),
        *compose.mean_columns(columns),
    ]
    return bins.summarise(binned, ["growth_q"], aggregates, {"median_delta_hu": ("delta_hu", 0.5)})


def growth_variables(
    age_groups: compose.Groups, race_groups: compose.Groups, spec: PanelSpec
) -> list[str]:
    out = []
    for groups in (race_groups, age_groups):
        for p in spec.periods:
            out += compose.share_columns(groups, p)
        out += compose.delta_columns(groups)
    return [*out, "delta_chi_age", "delta_chi_race"]


def exposure_variables(
    age_groups: compose.Groups, race_groups: compose.Groups, spec: PanelSpec
) -> list[str]:
    out = []
    for groups in (race_groups, age_groups):
        out += compose.share_columns(groups, spec.target) + compose.delta_columns(groups)
    return [*out, "delta_chi_age", "delta_chi_race", "delta_hu", "delta_pop"]


def growth_correlations(units: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Growth against every composition variable, one record."""
    return units.agg(
        F.count("*").alias("n"),
        *[correlation("delta_hu", v).alias(f"cor_dhu_{v}") for v in variables],
    )


def growth_correlations_long(units: DataFrame, variables: Sequence[str]) -> DataFrame:
    return assoc.correlate_long(units, "delta_hu", variables)


def exposure_correlations(
    rows: DataFrame, variables: Sequence[str], by: Sequence[str] = ("scenario",)
) -> DataFrame:
    """Change against every variable, one record per scenario."""
    return rows.groupBy(*by).agg(
        F.count("change").alias("n"),
        *[correlation("change", v).alias(f"cor_dghi_{v}") for v in variables],
    )


def with_tercile(
    rows: DataFrame,
    column: str,
    label: str,
    out: str,
    digits: int | None = None,
    ordered: bool = False,
) -> DataFrame:
    """Tercile over all rows pooled, so a unit counts once per season it appears in."""
    return bins.quantile_bins(
        rows, column, bins.TERCILES, tercile_labels(label), out=out, digits=digits, ordered=ordered
    )


def change_by_tercile(
    binned: DataFrame, tercile: str, share: str, spec: PanelSpec
) -> DataFrame:
    """Change and levels per scenario and tercile."""
    known = binned.filter(F.col(tercile).isNotNull())
    keys = ["scenario", tercile]
    change = (
        F.col("change") if spec.label_digits is None else F.round("change", spec.label_digits)
    )
    aggregates = [
        F.count("*").alias("n"),
        F.avg("change").alias("mean_change"),
        F.stddev_samp("change").alias("sd_change"),
        percent_true(change > 0).alias("pct_brightened"),
        F.avg(share).alias(f"mean_{share}"),
        F.avg(spec.y_base).alias(f"mean_{spec.y_base}"),
        F.avg(spec.y_target).alias(f"mean_{spec.y_target}"),
        F.avg("delta_y").alias("mean_delta_y"),
    ]
    return bins.summarise(known, keys, aggregates, {"median_change": ("change", 0.5)})


def transition_share(binned: DataFrame, tercile: str) -> DataFrame:
    """Transitions as a percentage of their scenario and tercile.

    The window runs over the counted table, a few rows per tercile.
    """
    counts = (
        binned.filter(F.col(tercile).isNotNull())
        .groupBy("scenario", tercile, "transition")
        .agg(F.count("*").alias("n"))
    )
    whole = F.sum("n").over(Window.partitionBy("scenario", tercile))
    return counts.withColumn("pct", F.col("n") / whole * 100)


def levels_by_tercile(binned: DataFrame, tercile: str, spec: PanelSpec) -> DataFrame:
    """Levels and density per scenario and tercile."""
    base, target = spec.periods
    columns = [spec.y_base, spec.y_target, "delta_y", f"hu_density_{base}",
               f"hu_density_{target}", "delta_hu"]
    return (
        binned.filter(F.col(tercile).isNotNull())
        .groupBy("scenario", tercile)
        .agg(F.count("*").alias("n"), *compose.mean_columns(columns))
    )


def composition_summary(
    demo: DataFrame,
    age_groups: compose.Groups,
    race_groups: compose.Groups,
    spec: PanelSpec,
) -> DataFrame:
    """Mean composition of all units, and the median distance between periods."""
    columns = [
        c
        for groups in (age_groups, race_groups)
        for p in spec.periods
        for c in compose.share_columns(groups, p)
    ]
    medians = {f"median_delta_chi_{tag}": (f"delta_chi_{tag}", 0.5) for tag in ("age", "race")}
    return bins.summarise(demo, [], [F.count("*").alias("n_units"), *compose.mean_columns(columns)], medians)
