"""Joins: dimension and full joins, scenario filters, and joins to small per-group tables."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftpanel.functions.scalars import quoted
from driftpanel.session import is_settled, materialize, settled

# Records of a per-group table (coefficients, breaks) beyond which the row side is salted.
SMALL_ROWS = 10_000
# Pairs of rows without a key that a full join makes at most.
PAIRS = 1_000_000
# Levels of one factor that a grid takes from the data at most.
LEVELS = 10_000
_SALTS = 32


def settle(df: DataFrame, name: str = "groups") -> DataFrame:
    """Compute a per-group table once, as a written table."""
    return settled(materialize(df, name))


def attach(
    rows: DataFrame,
    per_group: DataFrame,
    on: Sequence[str],
    how: str = "left",
    limit: int = SMALL_ROWS,
) -> DataFrame:
    """Join rows to one record per group.

    A group table that is not ``settled`` is written first, and counted on the way. Its files then
    tell Spark whether to broadcast it: rows are not shuffled and a group holding most of them
    costs nothing extra. Beyond ``limit`` records the join is shuffled with the row side salted,
    so no group lands in one task. Without keys ``per_group`` is one record, read as a scalar
    subquery.
    """
    on = list(on)
    if not on:
        return beside(rows, per_group)
    large = False
    if not is_settled(per_group):
        size = Observation()
        per_group = settle(per_group.observe(size, F.count(F.lit(1)).alias("n")))
        large = size.get["n"] > limit
    joined = (salted_join if large else join_groups)(rows, per_group, on, how)
    added = [c for c in per_group.columns if c not in on]
    return joined.select(*rows.columns, *added)


def beside(rows: DataFrame, record: DataFrame) -> DataFrame:
    """Every row with the columns of a table of one record, read as a scalar subquery."""
    whole = record.select(F.struct(*record.columns).alias("_record")).scalar()
    return rows.withColumn("_record", whole).select(*rows.columns, *[f"_record.{c}" for c in record.columns])


def join_groups(
    rows: DataFrame, per_group: DataFrame, on: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join on group keys where NULL is a group like any other."""
    other = per_group.withColumnsRenamed({c: f"_of_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in on]
    return rows.join(other, same, how).drop(*[f"_of_{c}" for c in on])


def salted_join(
    rows: DataFrame, per_group: DataFrame, on: Sequence[str], how: str = "left", salts: int = _SALTS
) -> DataFrame:
    """Shuffled join that spreads every key of ``rows`` over ``salts`` tasks.

    The salt is a hash of the row and of the number of its partition, so equal rows spread too and
    a retried task assigns the same salt again.
    """
    mixed = F.xxhash64(*rows.columns, F.spark_partition_id())
    salted = rows.withColumn("_salt", F.pmod(mixed, F.lit(salts)).cast("int"))
    copies = per_group.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return join_groups(salted, copies, [*on, "_salt"], how).drop("_salt")


def scenario_table(
    spark: SparkSession, scenarios: Sequence[tuple[str, int]], keys: Sequence[str]
) -> DataFrame:
    """Inline table of (season, buffer) pairs."""
    columns = {
        keys[0]: pa.array([s for s, _ in scenarios], pa.string()),
        keys[1]: pa.array([b for _, b in scenarios], pa.int32()),
    }
    return spark.createDataFrame(pa.table(columns))


def grid_of(df: DataFrame, factors: Sequence[str], most: int = LEVELS) -> DataFrame:
    """Every combination of the factors' levels in the data, sorted; NULL is no level.

    One aggregate finds the levels of all factors. More than ``most`` levels of one are an error,
    raised before they would be gathered.
    """
    level = [F.struct(F.lit(f).alias("factor"), F.to_json(F.struct(F.col(f).alias("v"))).alias("level")) for f in factors]
    seen = df.select(F.explode(F.array(*level)).alias("_s")).select("_s.*").distinct().where("level <> '{}'")
    place = F.row_number().over(Window.partitionBy("factor").orderBy("level"))
    text = F.concat(F.lit(f"more than {most} levels of "), F.col("factor"))
    seen = seen.withColumn("level", F.when(place > most, F.raise_error(text)).otherwise(F.col("level")))
    sets = [F.collect_list(F.when(F.col("factor") == f, F.col("level"))).alias(f) for f in factors]
    grid = seen.agg(*sets)
    for f in factors:
        kind = df.schema[f].dataType
        grid = grid.withColumn(f, F.explode(f))
        grid = grid.withColumn(f, F.from_json(f, T.StructType([T.StructField("v", kind)]))["v"])
    return grid.orderBy(*factors)


def keep_matching(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left semi join to a key table; its size statistics and AQE choose how."""
    return df.join(table, list(keys), "left_semi").select(*df.columns)


def keep_scenarios(
    df: DataFrame, scenarios: Sequence[tuple[str, int]], keys: Sequence[str] = ("season", "buffer")
) -> DataFrame:
    """Semi join on a literal list of scenarios, as a predicate the scan can use."""
    season, buffer = keys
    match = F.lit(False)
    for s, b in scenarios:
        match = match | ((F.col(season) == s) & (F.col(buffer) == b))
    return df.filter(match)


def left_join(rows: DataFrame, dimension: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join to a dimension of unknown size: Spark's own size statistics pick the strategy."""
    return rows.join(dimension, list(on), "left")


def full_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    null_keys: str = "match",
    most_pairs: int = PAIRS,
) -> DataFrame:
    """Full outer join with one coalesced key column.

    Rows without a key, by ``null_keys``:

    * ``"match"``: each left one meets each right one, as if NULL were a key like any other. Both sides
      are counted first, and more than ``most_pairs`` pairs are an error, so the one task where they
      meet is bounded. Where only one side has such rows they are spread over all tasks;
    * ``"keep"``: kept unmatched, spread over all tasks, without the counts;
    * ``"drop"``: removed.
    """
    if null_keys not in ("match", "keep", "drop"):
        raise ValueError("null_keys must be 'match', 'keep' or 'drop'")
    missing = F.col(on).isNull()
    if null_keys == "drop":
        return left.filter(~missing).join(right.filter(~missing), on, "full")

    def slotted(df: DataFrame, spread: Column) -> DataFrame:
        slot = F.pmod(F.xxhash64(*df.columns), F.lit(_SALTS))
        return df.withColumn("_slot", F.when(missing & spread, slot).otherwise(F.lit(0).cast("long")))

    if null_keys == "keep":
        spread = F.lit(True)
        return slotted(left, spread).join(slotted(right, spread), [on, "_slot"], "full").drop("_slot")
    on_left, on_right = (
        df.filter(missing).agg(F.count(F.lit(1)).alias("n")).scalar() for df in (left, right)
    )
    pairs = on_left * on_right
    text = F.concat(
        F.lit(f"rows without {on} would make "), pairs.cast("string"), F.lit(f" pairs, over {most_pairs}")
    )
    bounded = F.when(pairs > F.lit(most_pairs), F.raise_error(text)).otherwise(on_right == 0)
    a = slotted(left, bounded)
    b = slotted(right, on_left == 0).withColumnsRenamed({on: "_right_key", "_slot": "_right_slot"})
    same = F.col(on).eqNullSafe(F.col("_right_key")) & (F.col("_slot") == F.col("_right_slot"))
    joined = a.join(b, same, "full").withColumn(on, F.coalesce(on, "_right_key"))
    return joined.drop("_right_key", "_slot", "_right_slot")


def all_present(columns: Sequence[str]) -> Column:
    """True where none of the columns is NULL."""
    return F.expr(" AND ".join(f"{quoted(c)} IS NOT NULL" for c in columns) or "true")
