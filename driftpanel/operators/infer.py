"""Tests, intervals and effect sizes from one aggregate per table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftpanel.functions.moments import level_stats
from driftpanel.functions.scalars import effect_label
from driftpanel.functions.tails import (
    f_upper,
    t_half_width,
    t_two_sided,
    tukey_half_width,
    tukey_upper,
)


def paired_t(wide: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """Paired t statistics of ``a - b`` over complete pairs: one row per (group, pair)."""
    stats = []
    for i, (a, b) in enumerate(pairs):
        d = F.col(a) - F.col(b)
        stats += [
            F.count(d).alias(f"n{i}"),
            F.avg(d).alias(f"mean{i}"),
            F.stddev_samp(d).alias(f"sd{i}"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("first"),
                F.lit(b).alias("second"),
                F.col(f"n{i}").alias("n"),
                F.col(f"mean{i}").alias("mean_diff"),
                F.col(f"sd{i}").alias("sd_diff"),
            )
            for i, (a, b) in enumerate(pairs)
        ]
    )
    table = wide.groupBy(*by).agg(*stats).select(*by, F.inline(rows))
    table = table.withColumns(
        {"df": F.col("n") - 1, "se": F.try_divide(F.col("sd_diff"), F.sqrt("n"))}
    )
    return table.withColumn("t", F.try_divide("mean_diff", "se"))


def with_t_p(table: DataFrame, confidence: float = 0.95) -> DataFrame:
    """p value and confidence interval of a paired t table."""
    df = F.col("df").cast("double")
    half = t_half_width(F.lit(confidence), df) * F.col("se")
    return table.withColumns(
        {
            "p": t_two_sided(F.col("t"), df),
            "lo": F.col("mean_diff") - half,
            "hi": F.col("mean_diff") + half,
        }
    )


def _levels_record(df: DataFrame, y: str, factor: str, levels: Sequence[object]) -> DataFrame:
    stats = [c for i, v in enumerate(levels) for c in level_stats(y, factor, v, str(i))]
    listed = F.col(factor).isin(list(levels))
    unlisted = F.raise_error(
        F.concat(F.lit(f"{factor} has a level that is not listed: "), F.col(factor).cast("string"))
    )
    # A row without a level belongs to no group.
    known = F.when(listed, F.col(y)).when(F.col(factor).isNotNull(), unlisted)
    record = df.agg(F.count(known).alias("n"), F.avg(known).alias("mean"), *stats)
    k = len(levels)
    within = reduce(
        add,
        [
            F.coalesce((F.col(f"n_{i}") - 1) * F.col(f"var_{i}"), F.lit(0.0))
            for i in range(k)
        ],
    )
    between = reduce(
        add,
        [
            F.coalesce(
                F.col(f"n_{i}") * F.pow(F.col(f"mean_{i}") - F.col("mean"), F.lit(2.0)),
                F.lit(0.0),
            )
            for i in range(k)
        ],
    )
    filled = reduce(add, [F.when(F.col(f"n_{i}") > 0, 1).otherwise(0) for i in range(k)])
    return record.withColumns(
        {"ss_between": between, "ss_within": within, "groups": filled}
    ).withColumns({"df1": F.col("groups") - 1, "df2": F.col("n") - F.col("groups")})


def anova_oneway(df: DataFrame, y: str, factor: str, levels: Sequence[object]) -> DataFrame:
    """One-way analysis of variance over fixed factor levels."""
    record = _levels_record(df, y, factor, levels).withColumns(
        {
            "ms_between": F.try_divide("ss_between", "df1"),
            "ms_within": F.try_divide("ss_within", "df2"),
        }
    )
    return record.withColumn("f", F.try_divide("ms_between", "ms_within")).select(
        "n", "df1", "df2", "ss_between", "ss_within", "ms_between", "ms_within", "f"
    )


def with_f_p(table: DataFrame) -> DataFrame:
    return table.withColumn(
        "p", f_upper(F.col("f"), F.col("df1").cast("double"), F.col("df2").cast("double"))
    )


def tukey_differences(df: DataFrame, y: str, factor: str, levels: Sequence[object]) -> DataFrame:
    """Difference of means and studentized q for each pair of levels, later minus earlier."""
    record = _levels_record(df, y, factor, levels).withColumn(
        "msw", F.try_divide("ss_within", "df2")
    )

    def pair(i: int, j: int) -> Column:
        spread = (
            F.col("msw")
            / 2
            * (F.try_divide(F.lit(1.0), F.col(f"n_{i}")) + F.try_divide(F.lit(1.0), F.col(f"n_{j}")))
        )
        return F.struct(
            F.lit(f"{levels[j]}-{levels[i]}").alias("pair"),
            (F.col(f"mean_{j}") - F.col(f"mean_{i}")).alias("diff"),
            F.sqrt(spread).alias("se"),
        )

    pairs = F.array(*[pair(i, j) for i, j in combinations(range(len(levels)), 2)])
    table = record.select("groups", "df2", F.inline(pairs))
    return table.withColumn("q", F.try_divide(F.abs("diff"), F.col("se")))


def tukey_hsd(table: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Adjusted p values and simultaneous intervals for ``tukey_differences``."""
    k, df = F.col("groups").cast("double"), F.col("df2").cast("double")
    half = tukey_half_width(F.lit(confidence), k, df) * F.col("se")
    return table.withColumns(
        {
            "p_adj": tukey_upper(F.col("q"), k, df),
            "lwr": F.col("diff") - half,
            "upr": F.col("diff") + half,
        }
    )


def cohens_d(
    df: DataFrame,
    y: str,
    factor: str,
    first: object,
    second: object,
    by: Sequence[str] = (),
) -> DataFrame:
    """Standardized difference of two levels with pooled spread, and its size label."""
    stats = df.groupBy(*by).agg(
        *level_stats(y, factor, first, "a"), *level_stats(y, factor, second, "b")
    )
    n_a, n_b = F.col("n_a"), F.col("n_b")
    pooled = F.try_divide(
        (n_a - 1) * F.col("var_a") + (n_b - 1) * F.col("var_b"), n_a + n_b - 2
    )
    out = stats.withColumn(
        "d", F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(pooled))
    )
    return out.withColumn("magnitude", effect_label(F.col("d"))).select(
        *by, "n_a", "n_b", "mean_a", "mean_b", "d", "magnitude"
    )


def mean_ci(df: DataFrame, y: str, by: Sequence[str] = (), z: float = 1.96) -> DataFrame:
    """Mean with a normal interval."""
    table = df.groupBy(*by).agg(
        F.count(y).alias("n"),
        F.avg(y).alias("mean"),
        F.try_divide(F.stddev_samp(y), F.sqrt(F.count(y))).alias("se"),
    )
    return table.withColumns(
        {"lo": F.col("mean") - z * F.col("se"), "hi": F.col("mean") + z * F.col("se")}
    )
