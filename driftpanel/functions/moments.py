"""Aggregate expressions over pairs: central moments and what follows from them.

All of these are built-in mergeable aggregates, so a group of any size is combined map-side
and each map task sends one row per group.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftpanel.functions.scalars import quoted


def pair_moments(y: str, x: str) -> list[Column]:
    """n, means and centred sums over rows where both are present."""
    return [
        F.regr_count(y, x).alias("n"),
        F.regr_avgx(y, x).alias("xbar"),
        F.regr_avgy(y, x).alias("ybar"),
        F.regr_sxx(y, x).alias("sxx"),
        F.regr_sxy(y, x).alias("sxy"),
        F.regr_syy(y, x).alias("syy"),
    ]


def correlation(y: str, x: str, strict: bool = False) -> Column:
    """Pearson r over complete pairs; NULL when either side is constant.

    ``strict`` gives NULL as soon as one pair is incomplete.
    """
    pair = f"({quoted(y)}, {quoted(x)})"
    r = f"try_divide(regr_sxy{pair}, sqrt(regr_sxx{pair} * regr_syy{pair}))"
    if strict:
        r = f"CASE WHEN count(*) = regr_count{pair} THEN {r} END"
    return F.expr(r)


def level_stats(y: str, factor: str, level: object, tag: str) -> list[Column]:
    """n, mean and variance of ``y`` in one level of a factor."""
    value = F.when(F.col(factor) == level, F.col(y))
    return [
        F.count(value).alias(f"n_{tag}"),
        F.avg(value).alias(f"mean_{tag}"),
        F.var_samp(value).alias(f"var_{tag}"),
    ]
