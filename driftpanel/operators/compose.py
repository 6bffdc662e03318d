"""Composition of units: group totals, shares, their change and a distance between periods.

Input is one wide row per unit with a count column per (band, period). Everything here is a
projection of that row: no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftpanel.functions.scalars import normalize_id, quoted, row_sum, share

# Five-year age bands and the groups they form.
AGE_GROUPS = {
    "0_19": ["age0_4", "age5_9", "age10_14", "age15_19"],
    "20_29": ["age20_24", "age25_29"],
    "30_59": ["age30_34", "age35_39", "age40_44", "age45_49", "age50_54", "age55_59"],
    "60p": ["age60_64", "age65_69", "age70_74", "age75_79", "age80_84", "age85_up"],
}

# Race columns and their labels.
RACE_GROUPS = {
    "AIAN": ["AIAN"],
    "Asian": ["ASIAN"],
    "Black": ["Black"],
    "NHOPI": ["NHOPI"],
    "Two_or_More": ["Two"],
    "White": ["White"],
}

Groups = Mapping[str, Sequence[str]]
Namer = Callable[[str, int], str]


def underscore(band: str, period: int) -> str:
    return f"{band}_{period}"


def joined(band: str, period: int) -> str:
    return f"{band}{period}"


def _with_sums(
    df: DataFrame,
    id_column: str,
    groups: Groups,
    periods: Sequence[int],
    name: Namer,
    unit: str,
) -> DataFrame:
    """Unit, one sum per (group, period) and one total per period.

    Sums and totals are columns of their own, so later expressions refer to them instead of
    repeating the additions.
    """
    sums = [
        f"{row_sum([name(band, p) for band in groups[g]])} AS `_{g}_{p}`"
        for g in groups
        for p in periods
    ]
    totals = [f"{row_sum([f'_{g}_{p}' for g in groups])} AS `_total_{p}`" for p in periods]
    rows = df.withColumn("_unit", normalize_id(id_column))
    return rows.selectExpr(f"_unit AS {quoted(unit)}", *sums).selectExpr("*", *totals)


def shares_long(
    df: DataFrame,
    id_column: str,
    groups: Groups,
    periods: Sequence[int],
    name: Namer = underscore,
    unit: str = "unit",
) -> DataFrame:
    """One row per unit and period: total and percentage of each group.

    All periods come out of one scan of the wide table.
    """
    sums = _with_sums(df, id_column, groups, periods, name, unit)
    records = []
    for p in periods:
        fields = [f"'year', {p}", f"'total_pop', `_total_{p}`"]
        fields += [f"'pct_{g}', {share(f'_{g}_{p}', f'_total_{p}')}" for g in groups]
        records.append(f"named_struct({', '.join(fields)})")
    return sums.selectExpr(quoted(unit), f"inline(array({', '.join(records)}))")


def shares_by_union(
    df: DataFrame,
    id_column: str,
    groups: Groups,
    periods: Sequence[int],
    name: Namer = underscore,
    unit: str = "unit",
) -> DataFrame:
    """Same rows as ``shares_long``, row-bound period by period."""
    parts = [shares_long(df, id_column, groups, [p], name, unit) for p in periods]
    return reduce(DataFrame.unionByName, parts)


def delta_chi(before: Sequence[str], after: Sequence[str]) -> str:
    """Symmetric chi-square distance between two compositions given as proportion columns.

    SQL text. A missing proportion, as in a unit whose total is empty in one period, adds 0.
    """
    terms = []
    for b, a in zip(before, after):
        p1, p2 = quoted(b), quoted(a)
        terms.append(
            f"CASE WHEN {p1} + {p2} > 0 THEN ({p2} - {p1}) * ({p2} - {p1}) / (({p1} + {p2}) / 2) "
            "ELSE 0D END"
        )
    return " + ".join(terms)


def composition_wide(
    df: DataFrame,
    id_column: str,
    groups: Groups,
    periods: Sequence[int],
    tag: str,
    total: str = "total_pop",
    delta_total: str | None = None,
    name: Namer = underscore,
    unit: str = "unit",
    empty_as_null: bool = False,
) -> DataFrame:
    """Totals, shares of both periods, share changes and ``delta_chi_{tag}`` per unit.

    A unit whose total is empty in either period has no shares and distance 0, or NULL with
    ``empty_as_null``.
    """
    base, target = periods
    proportions = [
        f"try_divide(`_{g}_{p}`, `_total_{p}`) AS `_share_{g}_{p}`" for g in groups for p in periods
    ]
    level = _with_sums(df, id_column, groups, periods, name, unit).selectExpr("*", *proportions)
    chi = delta_chi(
        [f"_share_{g}_{base}" for g in groups], [f"_share_{g}_{target}" for g in groups]
    )
    if empty_as_null:
        chi = f"CASE WHEN `_total_{base}` > 0 AND `_total_{target}` > 0 THEN {chi} END"
    columns = [f"`_total_{p}` AS `{total}_{p}`" for p in periods]
    columns += [f"`_share_{g}_{p}` * 100 AS `pct_{g}_{p}`" for g in groups for p in periods]
    columns.append(f"{chi} AS `delta_chi_{tag}`")
    columns += [
        f"(`_share_{g}_{target}` - `_share_{g}_{base}`) * 100 AS `delta_pct_{g}`" for g in groups
    ]
    if delta_total:
        columns.append(f"`_total_{target}` - `_total_{base}` AS `{delta_total}`")
    return level.selectExpr(quoted(unit), *columns)


def share_columns(groups: Groups, period: int) -> list[str]:
    return [f"pct_{g}_{period}" for g in groups]


def delta_columns(groups: Groups) -> list[str]:
    return [f"delta_pct_{g}" for g in groups]


def mean_columns(columns: Sequence[str], prefix: str = "mean_") -> list[Column]:
    """One mean per column, named from it."""
    return [F.expr(f"avg({quoted(c)}) AS {quoted(prefix + c)}") for c in columns]
