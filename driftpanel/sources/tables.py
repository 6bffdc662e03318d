"""Declared schemas and CSV / Parquet readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from driftpanel.functions.categories import plain
from driftpanel.operators.compose import AGE_GROUPS, RACE_GROUPS, joined, underscore

NULL_TEXT = "NA"

BLOCK_PANEL = (
    "GEOID20 bigint, year int, season string, buffer int, NDVI double, PCT_BUILT double, "
    "POP double, HU double"
)
TRACT_PANEL = (
    "tract bigint, year int, season string, buffer int, weighted_nvdi double, "
    "weighted_built double"
)
# Source spelling of the tract measures and the names used after reading.
TRACT_RENAMES = {"weighted_nvdi": "NDVI", "weighted_built": "PCT_BUILT"}
TRACT_AREA = (
    "GEOID20 bigint, area_ha double, POP2010 double, POP2020 double, HU2010 double, HU2020 double"
)


def band_schema(groups: dict[str, list[str]], periods: Sequence[int], name) -> str:
    """Schema of a wide count table: id text and one column per band and period."""
    bands = [name(b, p) for p in periods for bs in groups.values() for b in bs]
    return ", ".join(["tract20l string", *[f"`{b}` double" for b in bands]])


def age_schema(periods: Sequence[int] = (2010, 2020)) -> str:
    return band_schema(AGE_GROUPS, periods, underscore)


def race_schema(periods: Sequence[int] = (2010, 2020)) -> str:
    return band_schema(RACE_GROUPS, periods, joined)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header and a declared schema, so no inference pass over the files.

    Columns follow the schema's order; ``enforceSchema`` off makes Spark check the header names.
    """
    return spark.read.csv(
        path, schema=schema, header=True, nullValue=NULL_TEXT, enforceSchema=False
    )


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV part per task, each with a header; categories as labels, in their order."""
    plain(df).write.mode("overwrite").csv(path, header=True, nullValue=NULL_TEXT)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
