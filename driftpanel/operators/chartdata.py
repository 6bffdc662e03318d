"""The numbers behind charts: histograms, fitted lines, boxes and stacked shares."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftpanel.functions.moments import pair_moments
from driftpanel.functions.scalars import recode
from driftpanel.functions.tails import t_half_width
from driftpanel.operators.bins import exact_quantiles
from driftpanel.operators.joins import attach
from driftpanel.operators.ols import line_from_moments
from driftpanel.operators.reshape import gather
from driftpanel.session import settled

_NOT_FINITE = [float("inf"), float("-inf"), float("nan")]


def sturges(n: int) -> int:
    """Bin count for n values."""
    return math.ceil(math.log2(n) + 1) if n > 0 else 1


def round_breaks(low: float, high: float, bins: int) -> tuple[float, float, int]:
    """Start, step and count of equal bins with round edges (steps of 1, 2, 5 or 10 times a
    power of ten) covering [low, high] in about ``bins`` steps."""
    if high == low:
        return math.floor(low), 1.0, 1
    rough = (high - low) / bins
    unit = 10.0 ** math.floor(math.log10(rough))
    # Preference for the smaller step.
    bias, five_bias = 1.5, 0.5 + 1.5 * 1.5
    step = unit
    if 2 * unit - rough < bias * (rough - step):
        step = 2 * unit
        if 5 * unit - rough < five_bias * (rough - step):
            step = 5 * unit
            if 10 * unit - rough < bias * (rough - step):
                step = 10 * unit
    first = math.floor(low / step + 1e-10)
    last = math.ceil(high / step - 1e-10)
    return first * step, step, max(int(last - first), 1)


def histogram(
    df: DataFrame, value: str, bins: int | None = None, round_edges: bool = True
) -> DataFrame:
    """Counts in right-closed equal-width bins; the first bin also holds its lower edge.

    ``bins`` defaults to Sturges' rule. ``round_edges`` moves the edges to round numbers;
    otherwise they split [min, max] evenly. Non-finite values are left out. Range and count come
    back as one record; rows are then counted per bin, so the shuffle holds one row per task and
    bin. Empty bins are listed with 0.
    """
    v = F.col(value).cast("double")
    rows = df.select(v.alias("_v")).filter(
        F.col("_v").isNotNull() & ~F.col("_v").isin(_NOT_FINITE)
    )
    low, high, n = rows.agg(F.min("_v"), F.max("_v"), F.count("*")).first()
    schema = "bin int, lower double, upper double"
    if not n:
        return df.sparkSession.createDataFrame([], f"{schema}, n long")
    wanted = bins or sturges(n)
    if round_edges:
        start, step, count = round_breaks(low, high, wanted)
    else:
        count = wanted if high > low else 1
        start, step = low, (high - low) / count if high > low else 1.0
    # A value within this of an edge counts as on the edge, so it stays in the lower bin.
    slack = 1e-7 * step
    place = F.ceil((F.col("_v") - F.lit(start) - F.lit(slack)) / F.lit(step)).cast("int")
    index = F.greatest(F.least(place, F.lit(count)), F.lit(1))
    counted = rows.groupBy(index.alias("bin")).agg(F.count("*").alias("n"))
    edges = df.sparkSession.createDataFrame(
        [(i + 1, start + i * step, start + (i + 1) * step) for i in range(count)], schema
    )
    return edges.join(counted, "bin", "left").fillna(0, ["n"])


def smooth_line(
    df: DataFrame,
    y: str,
    x: str,
    by: Sequence[str] = (),
    points: int = 80,
    confidence: float | None = None,
) -> DataFrame:
    """Fitted line and its standard error on an even grid of x per group.

    ``confidence`` adds the band ``lo`` to ``hi``; its width is found once per line, before the
    line becomes a grid.
    """
    stats = df.filter(F.col(y).isNotNull()).groupBy(*by).agg(
        *pair_moments(y, x), F.min(x).alias("_low"), F.max(x).alias("_high")
    )
    fit = line_from_moments(stats)
    band = confidence is not None
    if band:
        fit = fit.withColumn("_t", t_half_width(F.lit(confidence), F.col("df").cast("double")))
    step = (F.col("_high") - F.col("_low")) / F.lit(points - 1)
    grid = fit.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    grid = grid.withColumn("x", F.col("_low") + F.col("point") * step)
    off = F.col("x") - F.col("xbar")
    noise = F.sqrt(F.try_divide(F.col("rss"), F.col("df")))
    lever = F.sqrt(
        F.try_divide(F.lit(1.0), F.col("n").cast("double")) + F.try_divide(off * off, F.col("sxx"))
    )
    grid = grid.withColumns(
        {"fit": F.col("intercept") + F.col("slope") * F.col("x"), "se": noise * lever}
    )
    if band:
        half = F.col("_t") * F.col("se")
        grid = grid.withColumns({"lo": F.col("fit") - half, "hi": F.col("fit") + half})
    return grid.select(*by, "point", "x", "fit", "se", "df", *(["lo", "hi"] if band else []))


def smooth_band(smooth: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Confidence band of a smoothed line that was made without one."""
    half = t_half_width(F.lit(confidence), F.col("df").cast("double")) * F.col("se")
    return smooth.withColumns({"lo": F.col("fit") - half, "hi": F.col("fit") + half})


def boxplot_stats(df: DataFrame, y: str, by: Sequence[str]) -> DataFrame:
    """Box, whisker ends (furthest values within 1.5 box lengths) and outlier count per group."""
    quartiles = exact_quantiles(df, y, [0.25, 0.5, 0.75], by)
    quartiles = settled(quartiles.select(*by, F.col("quantiles").alias("_q")))
    rows = attach(df.select(*by, y).filter(F.col(y).isNotNull()), quartiles, by, "inner")
    low, middle, high = F.col("_q")[0], F.col("_q")[1], F.col("_q")[2]
    reach = (high - low) * 1.5
    within = F.col(y).between(low - reach, high + reach)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        # A whisker never ends inside the box.
        F.least(F.min(F.when(within, F.col(y))), F.min(low)).alias("whisker_low"),
        F.min(low).alias("q1"),
        F.min(middle).alias("median"),
        F.min(high).alias("q3"),
        F.greatest(F.max(F.when(within, F.col(y))), F.max(high)).alias("whisker_high"),
        F.count(F.when(~within, F.lit(1))).alias("n_outliers"),
    )


def composition_long(
    table: DataFrame,
    ids: Sequence[str],
    columns: Sequence[str],
    periods: Sequence[int],
    labels: Mapping[str, str] | None = None,
) -> DataFrame:
    """``mean_pct_{group}_{period}`` columns to rows with period and group label.

    Without ``labels`` the group name is shown with spaces for underscores.
    """
    base, target = (str(p) for p in periods)
    long = gather(table, ids, columns, "variable", "value")
    year = F.when(F.col("variable").rlike(base), base).otherwise(target)
    pattern = f"mean_pct_(.+)_({base}|{target})"
    group = F.regexp_replace("variable", pattern, "$1")
    shown = recode(group, labels) if labels else F.regexp_replace(group, "_", " ")
    return long.select(*ids, year.alias("year"), shown.alias("group"), "value")


def facet_long(
    df: DataFrame,
    ids: Sequence[str],
    columns: Sequence[str],
    labels: Mapping[str, str] | None = None,
    strip: str | None = None,
    lead: str = "",
) -> DataFrame:
    """Columns to rows for faceted charts, with readable facet names."""
    long = gather(df, ids, columns, "facet", "value")
    shown: Column = F.col("facet")
    if strip:
        shown = F.regexp_replace(F.regexp_replace(shown, strip, lead), "_", " ")
    if labels:
        shown = recode(shown, labels)
    return long.withColumn("facet", shown)
