"""Least squares lines per group, nested comparisons and information criteria.

One pass over the rows gathers centred moments per stratum; everything after works on that
small table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftpanel.functions.moments import pair_moments
from driftpanel.functions.tails import t_two_sided
from driftpanel.operators.joins import join_groups

# Levels of the larger factor that are eliminated at once.
_LEVELS = 512


def moments(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*pair_moments(y, x))


def line_from_moments(m: DataFrame) -> DataFrame:
    """Add intercept, slope, slope_se, t, r2, rss and residual df."""
    slope = F.try_divide("sxy", "sxx")
    m = m.withColumn("slope", slope)
    m = m.withColumns(
        {
            "intercept": F.col("ybar") - F.col("slope") * F.col("xbar"),
            "rss": F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0)),
            "r2": F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx") * F.col("syy")),
            "df": F.col("n") - 2,
        }
    )
    m = m.withColumn(
        "slope_se",
        F.when(
            F.col("df") > 0, F.sqrt(F.try_divide(F.try_divide("rss", F.col("df")), F.col("sxx")))
        ),
    )
    return m.withColumn("t", F.try_divide("slope", "slope_se"))


def ols_by_stratum(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Intercept, slope, standard error, R² and n of y ~ x in each stratum."""
    fit = line_from_moments(moments(df, y, x, by))
    return fit.select(*by, "intercept", "slope", "slope_se", "r2", "n", "t", "df")


def with_slope_p(fit: DataFrame) -> DataFrame:
    """Two-sided p value of the slope, on the fitted table."""
    return fit.withColumn("slope_p", t_two_sided(F.col("t"), F.col("df").cast("double")))


def combine(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Moments of coarser groups from those of disjoint cells.

    Centred sums gain the between-cell part around the merged means, so nothing cancels. Also
    keeps, per merged group, what separate and parallel lines in its cells leave unexplained.
    The window runs over one row per cell, not over data rows.
    """
    w = Window.partitionBy(*(by or [F.lit(0)]))
    weight = F.sum("n").over(w)
    centred = cells.withColumns(
        {
            "_x": F.sum(F.col("n") * F.col("xbar")).over(w) / weight,
            "_y": F.sum(F.col("n") * F.col("ybar")).over(w) / weight,
        }
    )
    dx = F.col("xbar") - F.col("_x")
    dy = F.col("ybar") - F.col("_y")
    within_line = F.try_divide(F.sum("sxy") * F.sum("sxy"), F.sum("sxx"))
    return centred.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.first("_x").alias("xbar"),
        F.first("_y").alias("ybar"),
        F.sum(F.col("sxx") + F.col("n") * dx * dx).alias("sxx"),
        F.sum(F.col("sxy") + F.col("n") * dx * dy).alias("sxy"),
        F.sum(F.col("syy") + F.col("n") * dy * dy).alias("syy"),
        F.count("*").alias("levels"),
        F.sum(_rss_of_line()).alias("rss_split"),
        (F.sum("syy") - F.coalesce(within_line, F.lit(0.0))).alias("rss_parallel"),
    )


def _rss_of_line() -> Column:
    explained = F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx"))
    return F.col("syy") - F.coalesce(explained, F.lit(0.0))


def nested_f(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One common line against a line per cell, within each ``by`` group.

    ``cells`` holds moments per (by, factor level).
    """
    table = combine(cells, by).withColumns(
        {
            "rss_pooled": _rss_of_line(),
            "df1": 2 * F.col("levels") - 2,
            "df2": F.col("n") - 2 * F.col("levels"),
        }
    )
    gain = F.try_divide(F.col("rss_pooled") - F.col("rss_split"), F.col("df1"))
    noise = F.try_divide(F.col("rss_split"), F.col("df2"))
    return table.withColumn("f", F.try_divide(gain, noise)).select(
        *by, "n", "df1", "df2", "rss_pooled", "rss_split", "f"
    )


def _criteria(rss: Column, n: Column, terms: Column) -> dict[str, Column]:
    loglik = n * (math.log(2 * math.pi) + F.ln(rss / n) + 1)
    return {
        "aic": loglik + 2 * (terms + 1),
        "bic": loglik + F.ln(n) * (terms + 1),
    }


def model_selection(cells: DataFrame, first: str, second: str) -> DataFrame:
    """AIC, BIC and R² of the line models over two factors, with distance to the best.

    ``cells`` is the small table of moments per (first, second). All models but the additive
    two-factor one have their residual sum of squares in closed form from cell moments; that one
    solves its normal equations on the cell table.
    """

    def entry(table: DataFrame, place: int, name: str, terms: Column, rss: Column) -> DataFrame:
        return table.select(
            F.lit(place).alias("position"),
            F.lit(name).alias("model"),
            terms.cast("int").alias("k"),
            F.col("n").cast("bigint").alias("n"),
            F.col("syy"),
            rss.alias("rss"),
        )

    whole = combine(cells)
    by_first = combine(combine(cells, [first]))
    by_second = combine(combine(cells, [second]))
    additive = additive_fit(cells, first, second)
    levels = F.col("levels")
    table = entry(whole, 1, "pooled", F.lit(2), _rss_of_line())
    for part in (
        entry(by_first, 2, f"+{first}", levels + 1, F.col("rss_parallel")),
        entry(by_second, 3, f"+{second}", levels + 1, F.col("rss_parallel")),
        entry(additive, 4, f"+{first}+{second}", F.col("terms"), F.col("rss")),
        entry(by_first, 5, f"*{first}", 2 * levels, F.col("rss_split")),
        entry(by_second, 6, f"*{second}", 2 * levels, F.col("rss_split")),
        entry(whole, 7, f"*{first}*{second}", 2 * levels, F.col("rss_split")),
    ):
        table = table.unionByName(part)
    table = table.withColumns(_criteria(F.col("rss"), F.col("n"), F.col("k")))
    table = table.withColumn("r2", 1 - F.try_divide("rss", "syy"))
    every = Window.partitionBy("n")
    return table.withColumns(
        {
            "delta_aic": F.col("aic") - F.min("aic").over(every),
            "delta_bic": F.col("bic") - F.min("bic").over(every),
        }
    ).select("position", "model", "k", "n", "r2", "aic", "bic", "delta_aic", "delta_bic")


def additive_fit(cells: DataFrame, first: str, second: str) -> DataFrame:
    """n, terms, syy and rss of the model with x and both factors, from moments per (first, second)."""
    names = {"a": first, "b": second}
    cells = cells.where("n > 0")
    level = {a: F.to_json(F.struct(F.col(c).alias("v"))) for a, c in names.items()}
    sizes = cells.agg(*[F.count_distinct(c).alias(a) for a, c in level.items()]).first()
    task, outer = _additive(sizes["a"], sizes["b"])
    inner = "b" if outer == "a" else "a"
    columns = ["n", "xbar", "ybar", "sxx", "sxy", "syy"]
    coded = cells.select(level[outer].alias(outer), level[inner].alias("_level"), *columns)
    levels = coded.select("_level").distinct()
    levels = levels.withColumn(inner, F.row_number().over(Window.orderBy("_level")) - 1)
    coded = join_groups(coded, levels, ["_level"], "inner").select(outer, inner, *columns)
    ordered = coded.coalesce(1).sortWithinPartitions(outer)
    return ordered.mapInPandas(task, "n long, terms long, syy double, rss double")


def _additive(first: int, second: int):
    """RSS of y ~ x + a + b from cell moments in the order of the larger factor.

    The normal equations are sparse: a level of one factor meets only the levels of the other that
    share a cell. The larger factor is eliminated level by level, as its cells arrive, which leaves
    centred cross-moments of x, y and the smaller factor's levels; nothing else is held, and
    cells of the same level may come in any number of batches.
    """
    k = min(first, second)
    inner, outer = ("a", "b") if first == k else ("b", "a")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Cross-moments within levels of the larger factor: smaller factor's k levels, x and y.
        gram = np.zeros((k + 2, k + 2))
        waiting: list[pd.DataFrame] = []
        total = np.zeros(4)  # n, sum of y, of y squared about 0 by cell means, within cells
        shift, levels = None, 0

        def eliminate(cells: pd.DataFrame) -> None:
            nonlocal levels
            codes, _ = pd.factorize(cells[outer])
            count = codes.max() + 1
            levels += count
            n = cells["n"].to_numpy(float)
            j = cells[inner].to_numpy()
            x, y = (cells[c].to_numpy(float) - shift[i] for i, c in enumerate(("xbar", "ybar")))
            size = np.bincount(codes, n, count)
            for at in range(0, count, _LEVELS):
                here = (codes >= at) & (codes < at + _LEVELS)
                rows = codes[here] - at
                wide = np.zeros((min(_LEVELS, count - at), k + 2))
                np.add.at(wide, (rows, j[here]), n[here])
                np.add.at(wide, (rows, k), (n * x)[here])
                np.add.at(wide, (rows, k + 1), (n * y)[here])
                gram[:, :] -= wide.T @ (wide / size[at : at + len(wide), None])
            np.add.at(gram, (j, j), n)
            for c, values in ((k, x), (k + 1, y)):
                np.add.at(gram, (j, c), n * values)
                np.add.at(gram, (c, j), n * values)
            gram[k, k] += (n * x * x).sum() + cells["sxx"].sum()
            gram[k, k + 1] += (n * x * y).sum() + cells["sxy"].sum()
            gram[k + 1, k] = gram[k, k + 1]
            gram[k + 1, k + 1] += (n * y * y).sum() + cells["syy"].sum()
            total[:] += [n.sum(), (n * y).sum(), (n * y * y).sum(), cells["syy"].sum()]

        for batch in batches:
            if shift is None and len(batch):
                shift = [float(np.average(batch[c], weights=batch["n"])) for c in ("xbar", "ybar")]
            if len(batch):
                waiting.append(batch)
                held = pd.concat(waiting, ignore_index=True)
                open_ = held[outer] == held[outer].iloc[-1]
                if not open_.all():
                    eliminate(held[~open_])
                    waiting = [held[open_]]
                else:
                    waiting = [held]
        if not waiting:
            return
        eliminate(waiting[0])
        # One level of the smaller factor follows from the others within every level of the larger.
        left, right = gram[1 : k + 1, 1 : k + 1], gram[1 : k + 1, k + 1]
        try:
            beta = np.linalg.solve(left, right)
            if not np.allclose(left @ beta, right, rtol=1e-9, atol=1e-9 * max(1.0, np.abs(right).max())):
                raise np.linalg.LinAlgError
        except np.linalg.LinAlgError:
            beta, *_ = np.linalg.lstsq(left, right, rcond=None)
        count, mean = total[0], total[1] / total[0]
        yield pd.DataFrame(
            {
                "n": [int(round(count))],
                "terms": [levels + k],
                "syy": [float(total[2] - count * mean * mean + total[3])],
                "rss": [float(gram[k + 1, k + 1] - right @ beta)],
            }
        )

    return task, outer


def slope_interval(fit: DataFrame, z: float = 1.96) -> DataFrame:
    """Normal interval around each slope."""
    return fit.withColumns(
        {
            "lo": F.col("slope") - z * F.col("slope_se"),
            "hi": F.col("slope") + z * F.col("slope_se"),
        }
    )
