"""Pseudo-residual change: the baseline line carried forward to the target period."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftpanel.functions import scalars
from driftpanel.functions.categories import category
from driftpanel.operators.joins import attach
from driftpanel.operators.ols import ols_by_stratum


def pseudo_residual(
    wide: DataFrame, y: str, x: str, periods: Sequence[int], by: Sequence[str]
) -> DataFrame:
    """Add ``resid_{base}``, ``pred_{target}``, ``resid_{target}`` and ``change``.

    One line y_base ~ x_base per stratum; both periods are compared with that line. The
    coefficient table has one row per stratum and is joined under a size check.
    """
    base, target = periods
    fit = ols_by_stratum(wide, f"{y}_{base}", f"{x}_{base}", by).select(
        *by, F.col("intercept").alias("_a"), F.col("slope").alias("_b")
    )
    rows = attach(wide, fit, by, "left")
    line_base = F.col("_a") + F.col("_b") * F.col(f"{x}_{base}")
    line_target = F.col("_a") + F.col("_b") * F.col(f"{x}_{target}")
    rows = rows.withColumns(
        {f"resid_{base}": F.col(f"{y}_{base}") - line_base, f"pred_{target}": line_target}
    )
    rows = rows.withColumn(
        f"resid_{target}", F.col(f"{y}_{target}") - F.col(f"pred_{target}")
    )
    return rows.withColumn("change", F.col(f"resid_{target}") - F.col(f"resid_{base}")).drop(
        "_a", "_b"
    )


def classify(rows: DataFrame, periods: Sequence[int], digits: int | None = None) -> DataFrame:
    """Add state per period, transition and direction.

    ``digits`` rounds before comparing with 0, so noise in the last bits cannot flip a label.
    """
    base, target = periods
    rows = rows.withColumns(
        {f"state_{p}": scalars.state(F.col(f"resid_{p}"), digits) for p in (base, target)}
    )
    return rows.withColumns(
        {
            "transition": scalars.transition(F.col(f"state_{base}"), F.col(f"state_{target}")),
            "direction": scalars.direction(F.col("change"), digits),
        }
    )


def interpret(
    rows: DataFrame, labels: Mapping[tuple[str, str], str] = scalars.INTERPRETATION
) -> DataFrame:
    """Add the reading of transition and direction together."""
    return rows.withColumn(
        "interpretation",
        scalars.interpretation(F.col("transition"), F.col("direction"), labels),
    )


def label_scenarios(
    rows: DataFrame,
    levels: Sequence[str],
    season: str = "season",
    buffer: str = "buffer",
    ordered: bool = False,
) -> DataFrame:
    """Add the scenario name and its place in the fixed order, or, ``ordered``, both as a category."""
    name = scalars.scenario_name(F.col(season), F.col(buffer))
    if ordered:
        return rows.withColumn("scenario", category(name, levels, "scenario"))
    rows = rows.withColumn("scenario", name)
    return rows.withColumn("scenario_order", scalars.ordinal(F.col("scenario"), levels))
