"""Wide and long reshapes, each in one aggregate or one projection."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftpanel.functions.categories import categories_of, label_of
from driftpanel.functions.scalars import quoted
from driftpanel.operators.joins import all_present


def spread(
    df: DataFrame,
    ids: Sequence[str],
    names_from: str,
    levels: Sequence[object],
    values: Sequence[str],
    name: Callable[[str, str], str] = lambda value, level: f"{value}_{level}",
    drop_incomplete: bool = False,
    other: str = "raise",
) -> DataFrame:
    """Pivot wider: one row per id, one column per (value, level).

    The level list is fixed, so there is no extra pass to discover it, and one conditional
    aggregate needs one shuffle. Two rows for one cell are an error, raised by the plan itself, and
    so is a row of a level that is not listed, NULL included, unless ``other`` is "drop".
    """
    kept = df.select(*ids, label_of(df, names_from).alias(names_from), *values)
    listed = F.col(names_from).isin(list(levels))
    if other == "drop":
        kept = kept.filter(listed)
    else:
        level = F.coalesce(F.col(names_from).cast("string"), F.lit("NULL"))
        unlisted = F.raise_error(F.concat(F.lit(f"{names_from} has a level that is not listed: "), level))
        checked = F.when(listed, F.col(names_from)).otherwise(unlisted)
        kept = kept.withColumn(names_from, checked)
    ordered = categories_of(df)
    key_text = ", ".join(quoted(i) + (".label" if i in ordered else "") for i in ids)
    cells = []
    for level in levels:
        text = str(level).replace("'", "''")
        here = f"{quoted(names_from)} = " + (f"'{text}'" if isinstance(level, str) else text)
        message = f"concat_ws(' ', 'more than one row for {names_from} {text} at', {key_text})"
        for value in values:
            cells.append(
                f"CASE WHEN count_if({here}) > 1 THEN raise_error({message}) "
                f"ELSE max(CASE WHEN {here} THEN {quoted(value)} END) END "
                f"AS {quoted(name(value, str(level)))}"
            )
    wide = kept.groupBy(*ids).agg(*[F.expr(c) for c in cells])
    if drop_incomplete:
        wide = wide.filter(all_present([c for c in wide.columns if c not in ids]))
    return wide


def count_table(
    df: DataFrame, ids: Sequence[str], names_from: str, levels: Sequence[str]
) -> DataFrame:
    """Contingency table: count per id and level, 0 where none. NULL is no level and not counted; a
    level that is not listed is an error."""
    df = df.withColumn(names_from, label_of(df, names_from))
    unlisted = F.raise_error(
        F.concat(F.lit(f"{names_from} has a level that is not listed: "), F.col(names_from).cast("string"))
    )
    known = F.col(names_from).isin(list(levels)) | F.col(names_from).isNull()
    checked = df.withColumn(names_from, F.when(known, F.col(names_from)).otherwise(unlisted))
    return checked.groupBy(*ids).agg(
        *[F.count(F.when(F.col(names_from) == v, F.lit(1))).alias(v) for v in levels]
    )


def gather(
    df: DataFrame,
    ids: Sequence[str],
    columns: Sequence[str],
    names_to: str = "variable",
    values_to: str = "value",
) -> DataFrame:
    """Pivot longer."""
    return df.unpivot(list(ids), list(columns), names_to, values_to)


def gather_by_period(
    df: DataFrame,
    ids: Sequence[str],
    pattern: str,
    period: str = "year",
) -> DataFrame:
    """Pivot longer keeping one column per measure.

    ``pattern`` has two groups: the measure name and the period, e.g. ``(POP|HU)(\\d{4})``.
    Every row becomes one row per period in a single projection, without a shuffle.
    """
    found = {c: m for c in df.columns if (m := re.fullmatch(pattern, c))}
    periods = sorted({m.group(2) for m in found.values()})
    measures = list(dict.fromkeys(m.group(1) for m in found.values()))
    by_cell = {(m.group(1), m.group(2)): c for c, m in found.items()}

    def cell(measure: str, p: str) -> str:
        source = by_cell.get((measure, p))
        return f"'{measure}', " + (quoted(source) if source else "NULL")

    records = [
        f"named_struct('{period}', {int(p)}, {', '.join(cell(m, p) for m in measures)})"
        for p in periods
    ]
    return df.selectExpr(*[quoted(i) for i in ids], f"inline(array({', '.join(records)}))")


def transpose(
    df: DataFrame,
    label: str,
    levels: Sequence[str],
    columns: Sequence[str],
    names_to: str = "variable",
) -> DataFrame:
    """Swap rows and columns of a small table: one row per column, one column per label."""
    long = gather(df, [label], columns, names_to, "_value")
    return spread(long, [names_to], label, levels, ["_value"], name=lambda _, level: level)


def columns_matching(
    df: DataFrame,
    prefix: str | Sequence[str] = (),
    pattern: str | None = None,
    numeric: bool = False,
    exclude: Sequence[str] = (),
) -> list[str]:
    """Column names by prefix (case ignored), regular expression and type."""
    prefixes = (prefix,) if isinstance(prefix, str) else tuple(prefix)
    lowered = tuple(p.lower() for p in prefixes)
    numbers = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    out = []
    for field in df.schema.fields:
        if lowered and not field.name.lower().startswith(lowered):
            continue
        if pattern is not None and not re.search(pattern, field.name, re.IGNORECASE):
            continue
        if numeric and field.dataType.simpleString() not in numbers:
            continue
        if field.name not in exclude:
            out.append(field.name)
    return out


def add_suffix(df: DataFrame, suffix: str, prefix: str) -> DataFrame:
    """Rename the columns that start with ``prefix``."""
    return df.withColumnsRenamed({c: f"{c}{suffix}" for c in columns_matching(df, prefix)})


def round_columns(df: DataFrame, digits: int | dict[str, int]) -> DataFrame:
    """Round numeric columns for a report."""
    if isinstance(digits, int):
        digits = {
            f.name: digits for f in df.schema.fields if f.dataType.simpleString() == "double"
        }
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def format_columns(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """printf-style text for report columns."""
    return df.withColumns({c: F.format_string(f, F.col(c)) for c, f in formats.items()})
