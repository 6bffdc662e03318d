"""Exact quantiles of groups of any size, and interval bins from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from driftpanel.functions.categories import category
from driftpanel.functions.scalars import rounded
from driftpanel.operators.joins import attach, beside, join_groups
from driftpanel.session import materialize, settled

QUARTILES = [0.0, 0.25, 0.5, 0.75, 1.0]
TERCILES = [0.0, 1 / 3, 2 / 3, 1.0]

#: Rows that a bracket may hold, equal values aside, when its rank is read.
RANKED = 4096
#: Buckets in which the rows of a larger bracket are counted.
BUCKETS = 1024
ACCURACY = 10_000
# Ranks that a bracket reaches to either side at least; the sketch may be off by a third of them.
_SPAN = 6
_LARGEST = 1.7976931348623157e308


def summarise(
    df: DataFrame,
    by: Sequence[str],
    aggregates: Sequence[Column] = (),
    quantiles: Mapping[str, tuple[str, float]] | None = None,
    accuracy: int = ACCURACY,
    ranked: int = RANKED,
) -> DataFrame:
    """Aggregates and exact quantiles, one row per group.

    ``quantiles`` maps an output column to a value column and a probability; linear interpolation, NULL
    and NaN left out. The quantiles of all columns are found by the same passes over ``df``:

    1. one aggregate takes ``aggregates``, counts, extremes, and per column a mergeable sketch that
       brackets the wanted ranks within a few parts in ``accuracy``;
    2. while a bracket may hold more than ``ranked`` rows of different values, its rows are counted in
       ``BUCKETS`` buckets and it narrows to the bucket of its rank. A rank outside moves the bracket
       to that side, so no answer depends on the sketch;
    3. rows below a bracket are counted, distinct values inside are counted and ranked.

    Equal values, and rows outside a bracket, are one count per task, so no task receives a share of a
    group. Most often passes 1 and 3 are all.
    """
    by, wanted = list(by), dict(quantiles or {})
    values = list(dict.fromkeys(v for v, _ in wanted.values()))
    clean = {v: f"_v{i or ''}" for i, v in enumerate(values)}
    places = list(dict.fromkeys((v, p) for v, p in wanted.values() if 0.0 < p < 1.0))
    margins = [m for m in (3.0 / accuracy * 10**i for i in range(4)) if m < 0.5]

    numbers = {clean[v]: F.col(v).cast("double") for v in values}
    rows = df.withColumns({c: F.when(~F.isnan(x), x) for c, x in numbers.items()}) if values else df
    sketches: list[Column] = []
    for v in values:
        c = F.col(clean[v])
        sketches += [F.count(c).alias(f"_n{clean[v]}"), F.min(c).alias(f"_min{clean[v]}")]
        sketches.append(F.max(c).alias(f"_max{clean[v]}"))
        edges = [e for w, p in places if w == v for m in margins for e in (max(p - m, 0.0), min(p + m, 1.0))]
        if edges:
            sketches.append(F.percentile_approx(c, edges, accuracy).alias(f"_edges{clean[v]}"))
    table = rows.groupBy(*by).agg(*aggregates, *sketches)
    own = [c for c in table.columns if not c.startswith(("_n_v", "_min_v", "_max_v", "_edges_v"))]
    if places:
        sizes = Observation()
        count = F.greatest(*[F.col(f"_n{clean[v]}") for v in values], F.lit(0))
        table = materialize(table.observe(sizes, F.max(count).alias("n")), "summary")
        # By the sketch's bound a bracket holds two margins and its error, or a few hundred ranks.
        most = (sizes.get["n"] or 0) * 8 / accuracy + 40 * _SPAN
        brackets = _first_brackets(table, by, places, clean, margins)
        table = _located(rows, by, [clean[v] for v, _ in places], brackets, table, most, ranked)
    out = []
    for name, (v, p) in wanted.items():
        end = "_min" if p <= 0.0 else "_max"
        inner = 0.0 < p < 1.0
        out.append(F.col(f"_found{places.index((v, p))}" if inner else end + clean[v]).alias(name))
    table = table.select(*own, *out)
    return settled(table) if places else table


def _first_brackets(
    table: DataFrame, by: list[str], places: list, clean: Mapping[str, str], margins: list[float]
) -> DataFrame:
    """Per group and quantile k: rank ``_place{k}`` (a fraction), and its bracket ``_low{k}`` to
    ``_high{k}``, from the narrowest edges that span enough ranks."""
    out = []
    seen: dict[str, int] = {}
    for k, (v, p) in enumerate(places):
        n, low, high = (F.col(f"{c}{clean[v]}") for c in ("_n", "_min", "_max"))
        edges, at = F.col(f"_edges{clean[v]}"), seen.get(v, 0)
        seen[v] = at + 2 * len(margins)
        smallest, largest = low, high
        for m in reversed(range(len(margins))):
            spans = n * margins[m] >= _SPAN
            low = F.when(spans, edges[at + 2 * m] if p > margins[m] else smallest).otherwise(low)
            high = F.when(spans, edges[at + 2 * m + 1] if p < 1 - margins[m] else largest).otherwise(high)
        out += [F.when(n > 0, (n - 1) * F.lit(p)).alias(f"_place{k}"), low.alias(f"_low{k}"), high.alias(f"_high{k}")]
    return settled(table.select(*by, *out))


def _located(
    rows: DataFrame,
    by: list[str],
    columns: list[str],
    brackets: DataFrame,
    table: DataFrame,
    most: float,
    ranked: int,
) -> DataFrame:
    """``table`` with ``_found{k}``, once every rank lies in a bracket that is small enough."""
    rows = rows.select(*dict.fromkeys([*by, *columns]))
    while True:
        while most > ranked:
            brackets, most = _narrowed(rows, by, columns, brackets)
        found, missed = _ranked(rows, by, columns, brackets, table)
        if not missed:
            return found
        brackets, most = _narrowed(rows, by, columns, brackets)


def _parts(rows: DataFrame, by: list[str], columns: list[str], brackets: DataFrame, inside) -> DataFrame:
    """A row per value and quantile: k, place, v, and its part: -1 below the bracket, what ``inside``
    says of (v, low, high), or ``BUCKETS`` above."""
    marked = attach(rows, brackets, by, "inner")
    pieces = []
    for k, c in enumerate(columns):
        v, low, high = F.col(c), F.col(f"_low{k}"), F.col(f"_high{k}")
        part = F.when(v < low, -1).when(v > high, BUCKETS).otherwise(inside(v, low, high)).cast("int")
        pieces.append(
            F.struct(F.lit(k).alias("k"), F.col(f"_place{k}").alias("place"), v.alias("v"), part.alias("part"))
        )
    return marked.select(*by, F.explode(F.array(*pieces)).alias("_s")).select(*by, "_s.*").where("v IS NOT NULL")


def _with_ranks(counted: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds the rank of the first and after the last row of each line; a few thousand lines a window.

    The lines of a group move once, for the ranks of each quantile and for the group's record.
    """
    counted = counted.repartition(*by) if by else counted.repartition(1)
    line = Window.partitionBy(*by, "k").orderBy(*order)
    ends = F.sum("c").over(line.rowsBetween(Window.unboundedPreceding, 0))
    counted = counted.withColumns({"end": ends, "next": F.lead("low").over(line)})
    return counted.withColumn("start", F.col("end") - F.col("c"))


def _share(v: Column, low: Column, high: Column) -> Column:
    """Bucket of v between low and high; halves and clamps keep differences finite."""
    v, low, high = (F.least(F.greatest(x, F.lit(-_LARGEST)), F.lit(_LARGEST)) / 2 for x in (v, low, high))
    share = F.when(high > low, (v - low) / (high - low)).otherwise(0.0)
    return F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))


def _narrowed(
    rows: DataFrame, by: list[str], columns: list[str], brackets: DataFrame
) -> tuple[DataFrame, int]:
    """Brackets cut to the bucket of their rank, and the most rows of different values in one."""
    parts = _parts(rows, by, columns, brackets, _share)
    counted = parts.groupBy(*by, "k", "place", "part").agg(
        F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high")
    )
    rank = F.floor("place")
    hit = _with_ranks(counted, by, ["part"]).where((F.col("start") <= rank) & (rank < F.col("end")))

    def of(k: int, c: str) -> Column:
        return F.max(F.when(F.col("k") == k, F.col(c))).alias(f"_{c}{k}")

    picks = [of(k, c) for k in range(len(columns)) for c in ("place", "low", "high")]
    held = F.max(F.when(F.col("low") < F.col("high"), F.col("c"))).alias("_held")
    sizes = Observation()
    cut = hit.groupBy(*by).agg(*picks, held).observe(sizes, F.max("_held").alias("n"))
    return settled(materialize(cut, "brackets").drop("_held")), sizes.get["n"] or 0


def _ranked(
    rows: DataFrame, by: list[str], columns: list[str], brackets: DataFrame, table: DataFrame
) -> tuple[DataFrame, int]:
    """``table`` with quantiles from the distinct values inside the brackets, written, and how many
    ranks lie outside."""
    parts = _parts(rows, by, columns, brackets, lambda v, low, high: F.lit(0))
    value = F.when(F.col("part") == 0, F.col("v")).alias("inside")
    counted = parts.groupBy(*by, "k", "place", "part", value).agg(F.count("*").alias("c"), F.min("v").alias("low"))
    rank = F.floor("place")
    hit = _with_ranks(counted, by, ["part", "low"]).where((F.col("start") <= rank) & (rank < F.col("end")))
    a = F.col("low")
    b = F.when((rank + 1 < F.col("end")) | F.col("next").isNull(), a).otherwise(F.col("next"))
    hit = hit.withColumn("found", F.when((a == b) | (F.col("place") == rank), a).otherwise(a + (F.col("place") - rank) * (b - a)))
    picks = [F.max(F.when(F.col("k") == k, F.col("found"))).alias(f"_found{k}") for k in range(len(columns))]
    misses = Observation()
    found = hit.groupBy(*by).agg(*picks, F.count_if(F.col("part") != 0).alias("_missed"))
    table = join_groups(table, found, by) if by else beside(table, found)
    table = materialize(table.observe(misses, F.sum("_missed").alias("n")), "quantiles")
    return table.drop("_missed"), misses.get["n"] or 0


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int = ACCURACY,
    out: str = "quantiles",
    ranked: int = RANKED,
) -> DataFrame:
    """Linear-interpolation quantiles per group: ``by``, ``n`` and an array in ``probs`` order.

    See ``summarise``. Groups without any value are left out.
    """
    number = F.col(value).cast("double")
    rows = df.where(number.isNotNull() & ~F.isnan(number))
    wanted = {f"_q{i}": (value, p) for i, p in enumerate(probs)}
    table = summarise(rows, by, [F.count("*").alias("n")], wanted, accuracy, ranked)
    return settled(table.select(*by, "n", F.array(*wanted).alias(out)))


def approximate_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int = 10_000,
    out: str = "quantiles",
) -> DataFrame:
    """One-pass sketch answer, within ``1 / accuracy`` of the rank. Opt-in."""
    return df.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.percentile_approx(F.col(value).cast("double"), list(probs), accuracy).alias(out),
    )


def with_median(
    summary: DataFrame, rows: DataFrame, value: str, by: Sequence[str], out: str
) -> DataFrame:
    """Add a group's exact median to a summary made elsewhere; ``summarise`` makes both at once."""
    median = exact_quantiles(rows, value, [0.5], by)
    if not by:
        return attach(summary, median.select(F.col("quantiles")[0].alias(out)), [])
    return join_groups(summary, median.select(*by, F.col("quantiles")[0].alias(out)), list(by))


def cut(value: Column, breaks: Column, labels: Sequence[str]) -> Column:
    """Label of the interval holding ``value``: (a, b], the first one closed on both sides.

    Equal values always share a bin. Breaks that are not distinct have no bins and are an error.
    """
    distinct = F.size(F.array_distinct(breaks)) == len(labels) + 1
    out = F.when(
        ~distinct,
        F.raise_error(
            F.concat(F.lit("breaks are not unique: "), F.array_join(breaks.cast("array<string>"), ", "))
        ),
    ).when(value.isNull() | (value < breaks[0]), F.lit(None).cast("string"))
    for i, label in enumerate(labels):
        out = out.when(value <= breaks[i + 1], label)
    return out


def quantile_bins(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    labels: Sequence[str],
    by: Sequence[str] = (),
    out: str = "bin",
    digits: int | None = None,
    ordered: bool = False,
) -> DataFrame:
    """Add the quantile bin of ``value``, from breaks of its group or of all rows.

    ``digits`` rounds the value before breaks and comparison. ``ordered`` makes the bin a category
    that sorts in the order of ``labels``.
    """
    rows = df.withColumn("_value", rounded(F.col(value), digits))
    breaks = exact_quantiles(rows, "_value", probs, by)
    breaks = settled(breaks.select(*by, F.col("quantiles").alias("_breaks")))
    rows = attach(rows, breaks, by, "left")
    label = F.when(F.col("_breaks").isNotNull(), cut(F.col("_value"), F.col("_breaks"), labels))
    if ordered:
        label = category(label, labels, out)
    return rows.withColumn(out, label).drop("_value", "_breaks")
