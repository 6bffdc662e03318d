"""Cleaning a long panel and turning it into one row per unit and stratum."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftpanel.functions.scalars import log_floored
from driftpanel.operators.reshape import spread


def cast_columns(
    df: DataFrame, doubles: Sequence[str] = (), ints: Sequence[str] = ()
) -> DataFrame:
    """Numeric coercion where unreadable text becomes NULL instead of an error."""
    kinds = {**dict.fromkeys(doubles, "double"), **dict.fromkeys(ints, "int")}
    return df.withColumns({c: F.col(c).try_cast(kind) for c, kind in kinds.items()})


def add_density(df: DataFrame, counts: Mapping[str, str], area: str = "area_ha") -> DataFrame:
    """``{out: count column}`` per unit of area; NULL where the area is 0."""
    return df.withColumns(
        {out: F.try_divide(F.col(c).cast("double"), F.col(area)) for out, c in counts.items()}
    )


def clean_panel(
    df: DataFrame,
    y: str,
    x: str,
    periods: Sequence[int],
    period: str = "year",
    ints: Sequence[str] = (),
    zero_policy: str = "floor",
    floor: float = 1e-10,
) -> DataFrame:
    """Coerce types, keep the two periods and complete rows, add ``log_{x}``.

    ``zero_policy="floor"`` logs zero densities at ``floor``; ``"drop"`` removes them.
    """
    out = cast_columns(df, [y, x], [period, *ints])
    out = out.filter(F.col(period).isin(list(periods)))
    out = out.filter(F.col(y).isNotNull() & F.col(x).isNotNull())
    if zero_policy == "drop":
        return out.filter(F.col(x) > 0).withColumn(f"log_{x}", F.ln(x))
    if zero_policy != "floor":
        raise ValueError("zero_policy must be 'floor' or 'drop'")
    return out.withColumn(f"log_{x}", log_floored(F.col(x), floor))


def panel_wide(
    df: DataFrame,
    ids: Sequence[str],
    values: Sequence[str],
    periods: Sequence[int],
    period: str = "year",
    colocate: str | None = None,
) -> DataFrame:
    """One row per id with ``{value}_{period}`` columns, complete rows only.

    A cell is one row per period, so combining before the shuffle saves nothing. ``colocate``
    therefore shuffles once by that id column alone: the pivot, and a later join or pivot by the
    same column, all run in place.
    """
    if colocate:
        df = df.repartition(colocate)
    return spread(df, ids, period, periods, values, drop_incomplete=True)


def panel_deltas(
    wide: DataFrame, deltas: Mapping[str, str], periods: Sequence[int]
) -> DataFrame:
    """``{out: value}``: target minus baseline for each value."""
    base, target = periods
    return wide.withColumns(
        {out: F.col(f"{v}_{target}") - F.col(f"{v}_{base}") for out, v in deltas.items()}
    )


def panel_counts(df: DataFrame, unit: str) -> DataFrame:
    """Rows and distinct units."""
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct(unit).alias("n_units"))


def duplicate_cells(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Cells with more than one row: what ``panel_wide`` would reject."""
    return df.groupBy(*ids).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")
