"""Ordered categories: a value that carries its place in a fixed order along with its label.

A category is a struct of ``code`` (1-based) and ``label``. Spark compares structs field by field, so
categories sort, rank and take minima by code in any plan; joins, groups and unions treat them as
one value. ``plain`` turns them into label columns for sinks, ordered by code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FIELDS = ["code", "label"]


def category(label: Column, levels: Sequence[str], name: str = "category") -> Column:
    """The label with its place among ``levels``; NULL stays NULL, another label is an error."""
    place = F.array_position(F.array(*[F.lit(v) for v in levels]), label).cast("int")
    unlisted = F.raise_error(F.concat(F.lit(f"{name} has a level that is not listed: "), label))
    code = F.when(place > 0, place).otherwise(unlisted)
    return F.when(label.isNotNull(), F.struct(code.alias("code"), label.alias("label")))


def categorise(df: DataFrame, column: str, levels: Sequence[str]) -> DataFrame:
    """Replace a label column by the category of its labels."""
    return df.withColumn(column, category(F.col(column), levels, column))


def is_category(kind: T.DataType) -> bool:
    return (
        isinstance(kind, T.StructType)
        and kind.names == _FIELDS
        and isinstance(kind["code"].dataType, T.IntegerType)
        and isinstance(kind["label"].dataType, T.StringType)
    )


def categories_of(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_category(f.dataType)]


def label_of(df: DataFrame, column: str) -> Column:
    """The labels of a column, whether it is a category or holds plain values."""
    return F.col(column)["label"] if column in categories_of(df) else F.col(column)


def plain(df: DataFrame, codes: bool = False, then: Sequence[str] = ()) -> DataFrame:
    """Categories as label columns, rows sorted by them in the order of the columns, and by ``then``.

    ``codes`` keeps each code too, as ``{column}_code``. Without categories nothing changes.
    """
    found = categories_of(df)
    if not found:
        return df
    columns = []
    for c in df.columns:
        columns.append(F.col(c)["label"].alias(c) if c in found else F.col(c))
        if codes and c in found:
            columns.append(F.col(c)["code"].alias(f"{c}_code"))
    return df.orderBy(*found, *then).select(*columns)
