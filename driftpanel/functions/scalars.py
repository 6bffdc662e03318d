"""Column functions: ids, logs, labels and guarded arithmetic."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Effect size limits and names.
EFFECT_SIZES = [(0.2, "negligible"), (0.5, "small"), (0.8, "medium")]
LARGEST_EFFECT = "large"

# Reading of each transition and direction.
INTERPRETATION = {
    ("Bright -> Bright", "Brightened"): "More bright",
    ("Bright -> Bright", "Dimmed"): "Still bright but declining",
    ("Bright -> Dim", "Dimmed"): "Bad transition",
    ("Dim -> Bright", "Brightened"): "Good transition",
    ("Dim -> Dim", "Brightened"): "Less dim",
    ("Dim -> Dim", "Dimmed"): "More dim",
}


def normalize_id(column: Column | str) -> Column:
    """Digits of an id as bigint; NULL when none are left. A fractional type counts as the whole
    number, not as the text that it prints as."""
    value = F.col(column) if isinstance(column, str) else column
    kind = F.typeof(value)
    number = kind.isin("double", "float") | kind.startswith("decimal")
    text = F.when(number, value.try_cast("decimal(38,0)").cast("string")).otherwise(value.cast("string"))
    return F.regexp_replace(text, "[^0-9]", "").try_cast("bigint")


def log_floored(x: Column, floor: float = 1e-10) -> Column:
    """ln(max(x, floor)); NULL stays NULL (``greatest`` alone would skip it)."""
    return F.when(x.isNotNull(), F.ln(F.greatest(x, F.lit(floor))))


def quoted(name: str) -> str:
    """Column name for use inside an SQL expression."""
    return "`" + name.replace("`", "``") + "`"


def row_sum(columns: Sequence[str]) -> str:
    """Sum across columns, as SQL text; any NULL makes the sum NULL."""
    return "(" + " + ".join(quoted(c) for c in columns) + ")"


def share(part: str, total: str) -> str:
    """Percentage of a total, as SQL text; NULL when the total is 0."""
    return f"try_divide({quoted(part)}, {quoted(total)}) * 100"


def rounded(column: Column, digits: int | None) -> Column:
    return column if digits is None else F.round(column, digits)


def state(residual: Column, digits: int | None = None) -> Column:
    """Bright at or above the line, Dim below it."""
    return F.when(rounded(residual, digits) >= 0, "Bright").when(residual.isNotNull(), "Dim")


def transition(before: Column, after: Column) -> Column:
    return F.concat(before, F.lit(" -> "), after)


def direction(change: Column, digits: int | None = None) -> Column:
    value = rounded(change, digits)
    return F.when(value > 0, "Brightened").when(value < 0, "Dimmed").otherwise("No change")


def interpretation(
    transition_col: Column,
    direction_col: Column,
    labels: Mapping[tuple[str, str], str] = INTERPRETATION,
) -> Column:
    """Label for each (transition, direction); NULL for combinations not listed."""
    out = F.lit(None).cast("string")
    for (moved, way), label in labels.items():
        out = F.when((transition_col == moved) & (direction_col == way), label).otherwise(out)
    return out


def effect_label(d: Column) -> Column:
    """Name for the size of a standardized difference."""
    out = F.when(d.isNull(), F.lit(None).cast("string"))
    for limit, label in EFFECT_SIZES:
        out = out.when(F.abs(d) < limit, label)
    return out.otherwise(LARGEST_EFFECT)


def recode(column: Column, labels: Mapping[str, str]) -> Column:
    """Replace listed values, keep the others."""
    out = column
    for old, new in labels.items():
        out = F.when(column == old, new).otherwise(out)
    return out


def scenario_name(season: Column, buffer: Column) -> Column:
    """'Dormant 1000 m' style label; NULL if either part is."""
    short = F.regexp_replace(season, "_Season$", "")
    return F.concat(short, F.lit(" "), buffer.cast("string"), F.lit(" m"))


def ordinal(column: Column, levels: Sequence[str]) -> Column:
    """1-based position in a fixed level order; NULL for other values."""
    place = F.array_position(F.array(*[F.lit(v) for v in levels]), column)
    return F.when(place > 0, place.cast("int"))


def percent_true(condition: Column) -> Column:
    """Percentage of rows where the condition holds, NULL conditions left out."""
    return F.avg(F.when(condition, 1.0).when(~condition, 0.0)) * 100
