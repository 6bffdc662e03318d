"""Star-schema tables seen as a unit panel, compositions and polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driftpanel.operators.joins import left_join
from driftpanel.operators.reshape import gather_by_period, spread
from driftpanel.plans import prepare
from driftpanel.plans.spec import PanelSpec

BASE, TARGET = 1996, 2000
PERIODS = (BASE, TARGET)

# Quantity bands (as age bands) and part types (as race columns).
BAND_GROUPS = {
    "b1_3": ["band1", "band2", "band3"],
    "b4_5": ["band4", "band5"],
    "b6_8": ["band6", "band7", "band8"],
    "b9_10": ["band9", "band10"],
}
BANDS = [f"band{i}" for i in range(1, 11)]
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
TYPE_GROUPS = {
    "Economy": ["ECONOMY"],
    "Large": ["LARGE"],
    "Medium": ["MEDIUM"],
    "Promo": ["PROMO"],
    "Small": ["SMALL"],
    "Standard_Type": ["STANDARD"],
}

# Labels and bins come from values rounded to 9 places, so both engines agree on ties.
SPEC = PanelSpec(y="y", x="hu_density", base=BASE, target=TARGET, label_digits=9)
TRACT_SPEC = PanelSpec(
    y="y", x="hu_density", base=BASE, target=TARGET, zero_policy="drop", label_digits=9
)

_UNIT_KEYS = {"supplier": "l_suppkey", "part": "l_partkey"}


# Schema per path, so a table's footer is read once.
_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def shipped_in(years: tuple[int, ...]) -> Column:
    """Ship date within the years, as ranges the Parquet scan can use."""
    return F.expr(
        " OR ".join(
            f"(l_shipdate >= TIMESTAMP'{y}-01-01' AND l_shipdate < TIMESTAMP'{y + 1}-01-01')"
            for y in years
        )
    )


def _season() -> Column:
    return F.when(F.col("l_linestatus") == "F", "Dormant_Season").otherwise("Growing_Season")


def _buffer() -> Column:
    flag = F.col("l_returnflag")
    return F.when(flag == "A", 500).when(flag == "N", 1000).otherwise(2000)


def cells(
    spark: SparkSession, sf_dir: str, unit: str, years: tuple[int, ...] | None = PERIODS
) -> DataFrame:
    """Lines counted per unit, season, buffer and year, combined map-side."""
    lines = table(spark, sf_dir, "lineitem")
    if years:
        lines = lines.filter(shipped_in(years))
    return lines.groupBy(
        F.col(_UNIT_KEYS[unit]).alias("unit"),
        _season().alias("season"),
        _buffer().alias("buffer"),
        F.year("l_shipdate").alias("year"),
    ).agg(
        F.avg("l_discount").alias("y"),
        F.count(F.when(F.col("l_quantity") > 45, F.lit(1))).cast("double").alias("hu"),
        F.sum("l_quantity").alias("pop"),
        F.count("*").cast("double").alias("lines"),
        F.avg("l_tax").alias("built"),
    )


# Names of the source files for the columns of ``cells``, and of the densities they get.
SOURCE_NAMES = {"unit": "GEOID20", "y": "NDVI", "built": "PCT_BUILT", "pop": "POP", "hu": "HU"}
OWN_NAMES = {
    **{source: own for own, source in SOURCE_NAMES.items()},
    "POP_density": "pop_density",
    "HU_density": "hu_density",
}


def areas(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    if unit == "supplier":
        return table(spark, sf_dir, "supplier").select(
            F.col("s_suppkey").alias("unit"),
            (1 + F.abs("s_acctbal") / 100).alias("area_ha"),
        )
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("unit"), F.col("p_size").cast("double").alias("area_ha")
    )


def unit_panel(
    spark: SparkSession,
    sf_dir: str,
    unit: str = "supplier",
    years: tuple[int, ...] | None = PERIODS,
) -> DataFrame:
    """Long panel: one row per unit, season, buffer and year, with densities."""
    rows = source_panel(spark, sf_dir, unit, years).withColumnsRenamed(OWN_NAMES)
    return rows.drop("built")


def source_panel(
    spark: SparkSession,
    sf_dir: str,
    unit: str = "supplier",
    years: tuple[int, ...] | None = PERIODS,
) -> DataFrame:
    """The same panel under the names of the source files."""
    measures = cells(spark, sf_dir, unit, years).drop("lines").withColumnsRenamed(SOURCE_NAMES)
    return prepare.block_panel(measures, areas(spark, sf_dir, unit).withColumnRenamed("unit", "GEOID20"))


def unit_totals_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier counts per year in wide form: POP1996, POP2000, HU1996, HU2000, area_ha."""
    lines = table(spark, sf_dir, "lineitem").filter(shipped_in(PERIODS))
    per_year = lines.groupBy(
        F.col("l_suppkey").alias("unit"), F.year("l_shipdate").alias("year")
    ).agg(F.sum("l_quantity").alias("POP"), F.count("*").cast("double").alias("HU"))
    wide = spread(
        per_year, ["unit"], "year", PERIODS, ["POP", "HU"], name=lambda v, p: f"{v}{p}"
    )
    return left_join(wide, areas(spark, sf_dir, "supplier"), ["unit"])


def unit_totals_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = gather_by_period(
        unit_totals_wide(spark, sf_dir), ["unit", "area_ha"], r"(POP|HU)(\d{4})"
    )
    return long.withColumnsRenamed({"POP": "pop", "HU": "hu"})


def tract_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier panel whose counts are per unit and year, repeated in each season."""
    rows = cells(spark, sf_dir, "supplier").filter(F.col("buffer") == 1000)
    measures = rows.select(
        F.col("unit").alias("tract"),
        "season",
        "buffer",
        "year",
        F.col("y").alias("weighted_nvdi"),
        F.col("built").alias("weighted_built"),
    )
    units = unit_totals_wide(spark, sf_dir).withColumnRenamed("unit", "GEOID20")
    joined = prepare.tract_panel(measures, units.withColumn("GEOID20", F.col("GEOID20").cast("string")))
    return joined.withColumnsRenamed({**OWN_NAMES, "tract": "unit"}).drop("built")


def _label(unit: str) -> tuple[str, Column, Column]:
    """Dimension table, its key, and a text id with letters around the digits."""
    if unit == "supplier":
        return "supplier", F.col("s_suppkey"), F.col("s_name")
    return "part", F.col("p_partkey"), F.concat(F.lit("Part#"), F.col("p_partkey").cast("string"))


def _banded(lines: DataFrame, key: str, years: tuple[int, ...]) -> DataFrame:
    """Key, year, band number and quantity of the lines shipped in the years."""
    return lines.filter(shipped_in(years)).select(
        F.col(key).alias("_key"),
        F.year("l_shipdate").alias("year"),
        F.ceil(F.col("l_quantity") / 5).cast("int").alias("band"),
        "l_quantity",
    )


def band_counts(spark: SparkSession, sf_dir: str, unit: str = "supplier") -> DataFrame:
    """Wide quantity per band and year, ``band1_1996`` style; 0 where a unit has none."""
    name, key, text = _label(unit)
    lines = _banded(table(spark, sf_dir, "lineitem"), _UNIT_KEYS[unit], PERIODS)
    sums = [
        F.expr(f"sum(CASE WHEN year = {p} AND band = {i} THEN l_quantity END) AS {b}_{p}")
        for p in PERIODS
        for i, b in enumerate(BANDS, 1)
    ]
    counted = lines.groupBy("_key").agg(*sums)
    units = table(spark, sf_dir, name).select(key.alias("_key"), text.alias("tract20l"))
    return left_join(units, counted, ["_key"]).fillna(0.0).drop("_key")


def type_counts(spark: SparkSession, sf_dir: str, unit: str = "supplier") -> DataFrame:
    """Wide quantity per part type and year, ``ECONOMY1996`` style.

    Lines are summed per (unit, part, year) before they meet the part table, so a part that holds
    very many lines reaches the join as one row per unit and year.
    """
    name, key, text = _label(unit)
    lines = table(spark, sf_dir, "lineitem").filter(shipped_in(PERIODS))
    summed = lines.groupBy(
        F.col(_UNIT_KEYS[unit]).alias("_key"),
        F.col("l_partkey").alias("p_partkey"),
        F.year("l_shipdate").alias("year"),
    ).agg(F.sum("l_quantity").alias("quantity"))
    kinds = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    typed = summed.join(kinds, "p_partkey")
    sums = [
        F.expr(f"sum(CASE WHEN year = {p} AND p_type = '{t}' THEN quantity END) AS {t}{p}")
        for p in PERIODS
        for t in TYPES
    ]
    counted = typed.groupBy("_key").agg(*sums)
    units = table(spark, sf_dir, name).select(key.alias("_key"), text.alias("tract20l"))
    return left_join(units, counted, ["_key"]).fillna(0.0).drop("_key")


def year_bands(spark: SparkSession, sf_dir: str, year: int) -> DataFrame:
    """One year's band table as a source file would hold it: id, YEAR and bands."""
    lines = _banded(table(spark, sf_dir, "lineitem"), "l_partkey", (year,))
    return lines.groupBy(F.col("_key").alias("tract20l")).agg(
        F.first("year").alias("YEAR"),
        *[
            F.expr(f"coalesce(sum(CASE WHEN band = {i} THEN l_quantity END), 0D) AS {b}")
            for i, b in enumerate(BANDS, 1)
        ],
    )


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as a ring, a vertex per two numbers: even positions x, odd positions y."""
    e = F.col("embedding")
    ring = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(e) / 2).cast("int") - 1),
        lambda i: F.struct(
            F.get(e, 2 * i).cast("double").alias("x"), F.get(e, 2 * i + 1).cast("double").alias("y")
        ),
    )
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("unit"), ring.alias("ring"))


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rings as one row per vertex."""
    return rings(spark, sf_dir).select("unit", F.posexplode("ring").alias("seq", "v")).select(
        "unit", F.lit(1).alias("ring"), "seq", F.col("v.x").alias("x"), F.col("v.y").alias("y")
    )
