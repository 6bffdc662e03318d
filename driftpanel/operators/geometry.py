"""Planar polygon areas from vertices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# US survey foot in metres, square metres per hectare.
US_SURVEY_FOOT = 1200 / 3937
M2_PER_HA = 10_000.0

#: Consecutive positions of a ring that one task sums up.
STRETCH = 8192


def signed_ring_area(ring: Column) -> Column:
    """Shoelace sum over an array of (x, y) structs; the closing edge is implied.

    Coordinates are taken relative to the first vertex, so large offsets lose no digits.
    """
    n = F.size(ring)
    x0, y0 = ring[0]["x"], ring[0]["y"]
    follow = F.concat(F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1))
    cross = F.zip_with(
        ring,
        follow,
        lambda a, b: (a["x"] - x0) * (b["y"] - y0) - (b["x"] - x0) * (a["y"] - y0),
    )
    return F.aggregate(cross, F.lit(0.0), lambda acc, c: acc + c) / 2


def polygon_area(df: DataFrame, ring: str = "ring", unit_in_m: float = 1.0) -> DataFrame:
    """Replace a ring column by ``area_m2`` and ``area_ha``."""
    area = F.abs(signed_ring_area(F.col(ring))) * F.lit(unit_in_m * unit_in_m)
    return df.withColumn("area_m2", area).withColumn(
        "area_ha", F.col("area_m2") / M2_PER_HA
    ).drop(ring)


def polygon_area_from_vertices(
    vertices: DataFrame,
    ids: Sequence[str] = ("unit",),
    ring: str = "ring",
    seq: str = "seq",
    unit_in_m: float = 1.0,
) -> DataFrame:
    """Area per unit from a vertex table, holes and parts by ring orientation.

    Positions in a ring are consecutive; a gap is an error. Vertices move once, to stretches of
    ``STRETCH`` positions: a stretch becomes one record of its partial sum, its ends and its gaps,
    and the records of a ring are joined end to end in order. So a ring with very many vertices
    is spread over all tasks, and only its records meet.
    """
    keys = [*ids, ring]
    within = Window.partitionBy(*keys, "_stretch").orderBy(seq)
    here = F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    rows = vertices.select(
        *keys, seq, here.alias("_at"), F.floor(F.col(seq) / F.lit(STRETCH)).alias("_stretch")
    ).withColumns({"_to": F.lead("_at").over(within), "_next": F.lead(seq).over(within)})

    def strip(a: Column, b: Column) -> Column:
        return (b["x"] - a["x"]) * (a["y"] + b["y"]) / 2

    def breaks(after: Column, before: Column) -> Column:
        return F.coalesce((after != before + 1).cast("int"), F.lit(0))

    stretches = rows.groupBy(*keys, "_stretch").agg(
        F.sum(strip(F.col("_at"), F.col("_to"))).alias("_open"),
        F.sum(breaks(F.col("_next"), F.col(seq))).alias("_gaps"),
        F.min(seq).alias("_first"),
        F.max(seq).alias("_last"),
        F.min_by("_at", seq).alias("_head"),
        F.max_by("_at", seq).alias("_tail"),
    )
    along = Window.partitionBy(*keys).orderBy("_stretch")
    stretches = stretches.withColumns(
        {"_bridge": strip(F.col("_tail"), F.lead("_head").over(along)), "_resume": F.lead("_first").over(along)}
    )
    rings = stretches.groupBy(*keys).agg(
        F.sum(F.coalesce("_open", F.lit(0.0)) + F.coalesce("_bridge", F.lit(0.0))).alias("_open"),
        F.sum(F.col("_gaps") + breaks(F.col("_resume"), F.col("_last"))).alias("_gaps"),
        F.min_by("_head", "_stretch").alias("_head"),
        F.max_by("_tail", "_stretch").alias("_tail"),
    )
    gap = F.raise_error(F.concat_ws(" ", F.lit("vertex positions have gaps in ring"), *keys))
    signed = F.when(F.col("_gaps") > 0, gap).otherwise(
        F.col("_open") + strip(F.col("_tail"), F.col("_head"))
    )
    area = F.abs(F.sum(signed)) * F.lit(unit_in_m * unit_in_m)
    return rings.groupBy(*ids).agg(area.alias("area_m2")).withColumn(
        "area_ha", F.col("area_m2") / M2_PER_HA
    )
