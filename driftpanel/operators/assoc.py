"""Correlations: pairs, one against many, and matrices, each from a single aggregate."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftpanel.functions.moments import correlation
from driftpanel.operators.joins import all_present


def correlate(
    df: DataFrame,
    pairs: dict[str, tuple[str, str]],
    by: Sequence[str] = (),
    strict: bool = False,
) -> DataFrame:
    """``{name: (y, x)}`` correlations per group, with the row count."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), *[correlation(y, x, strict).alias(k) for k, (y, x) in pairs.items()]
    )


def correlate_long(
    df: DataFrame, target: str, others: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """One row per (group, variable): r of ``target`` with each of the others, pairwise complete."""
    wide = df.groupBy(*by).agg(*[correlation(target, o).alias(o) for o in others])
    return wide.unpivot(list(by), list(others), "variable", "r")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlation of all column pairs over rows complete in every column, in long form.

    The pairs are columns of one aggregate record, so the cost is one pass; rows are never paired.
    """
    columns = list(columns)
    complete = df.filter(all_present(columns))
    pairs = list(combinations_with_replacement(range(len(columns)), 2))
    record = complete.agg(
        F.count("*").alias("n"),
        *[correlation(columns[i], columns[j]).alias(f"r{i}_{j}") for i, j in pairs],
    )
    cells = [
        f"named_struct('row', '{a}', 'column', '{b}', 'r', r{min(i, j)}_{max(i, j)})"
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
    ]
    return record.selectExpr("n", f"inline(array({', '.join(cells)}))")
