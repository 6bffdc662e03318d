"""From source tables to the panels and composition tables the analyses read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftpanel.functions.moments import correlation
from driftpanel.operators import compose, infer
from driftpanel.operators.joins import full_join, left_join
from driftpanel.operators.panel import add_density
from driftpanel.operators.reshape import add_suffix, gather_by_period, spread
from driftpanel.plans.spec import BUFFERS, PanelSpec
from driftpanel.sources.tables import TRACT_RENAMES

DENSITIES = {"POP_density": "POP", "HU_density": "HU"}


def block_panel(measures: DataFrame, areas: DataFrame, unit: str = "GEOID20") -> DataFrame:
    """Long block panel with area and densities."""
    rows = left_join(measures, areas.select(unit, "area_ha"), [unit])
    return add_density(rows, DENSITIES)


def tract_panel(measures: DataFrame, areas: DataFrame, unit: str = "tract") -> DataFrame:
    """Long tract panel: counts of the matching year, area and densities.

    ``areas`` holds one row per tract with a column per count and year.
    """
    units = areas.withColumn(unit, F.col("GEOID20").try_cast("bigint"))
    counts = gather_by_period(units, [unit, "area_ha"], r"(POP|HU)(\d{4})")
    rows = left_join(measures.withColumnsRenamed(TRACT_RENAMES), counts, [unit, "year"])
    return add_density(rows, DENSITIES)


def two_year_counts(
    before: DataFrame,
    after: DataFrame,
    periods: Sequence[int],
    bands: Sequence[str] | str,
    sep: str = "_",
    key: str = "tract20l",
    null_keys: str = "match",
) -> DataFrame:
    """One wide row per unit from two yearly count tables.

    ``bands`` is a name prefix or a list of names; those columns get the year as a suffix.
    """
    sides = []
    for df, p in zip((before, after), periods):
        df = df.drop("YEAR")
        if isinstance(bands, str):
            sides.append(add_suffix(df, f"{sep}{p}", bands))
        else:
            sides.append(df.withColumnsRenamed({b: f"{b}{sep}{p}" for b in bands}))
    return full_join(*sides, on=key, null_keys=null_keys)


def age_shares(
    age: DataFrame,
    periods: Sequence[int],
    unit: str = "tract",
    groups: compose.Groups = compose.AGE_GROUPS,
) -> DataFrame:
    """Share of each age group, one row per unit and year."""
    return compose.shares_long(age, "tract20l", groups, periods, unit=unit)


def race_shares(
    race: DataFrame,
    periods: Sequence[int],
    unit: str = "tract",
    groups: compose.Groups = compose.RACE_GROUPS,
) -> DataFrame:
    """Share of each race, one row per unit and year."""
    return compose.shares_long(race, "tract20l", groups, periods, compose.joined, unit)


def level_checks(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """Correlation of the two counts (NULL if any is missing) and of built share and outcome."""
    return panel.agg(
        F.count("*").alias("n"),
        correlation("POP", "HU", strict=True).alias("r_pop_hu"),
        correlation("PCT_BUILT", spec.y).alias("r_built_y"),
    )


def buffer_tests(panel: DataFrame, spec: PanelSpec, buffers: Sequence[int] = BUFFERS) -> DataFrame:
    """Paired t of the outcome between buffers of the same unit, period and season."""
    rows = spread(
        panel,
        [spec.unit, spec.period, spec.season],
        spec.buffer,
        buffers,
        [spec.y],
        name=lambda _, level: f"b{level}",
        drop_incomplete=True,
    )
    pairs = [
        (f"b{a}", f"b{b}") for i, a in enumerate(buffers) for b in buffers[i + 1 :]
    ]
    return infer.paired_t(rows, pairs)
