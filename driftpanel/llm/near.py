"""Links and components from shared buckets, without listing all pairs of a bucket.

Nodes are 64-bit ids, buckets are rows ``(key, id)``. A bucket's members are first compared with
one hub; whatever that joins needs no further comparison. Only buckets that still hold several
components are compared inside tasks, in blocks of bounded size, and only pairs across components
leave the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftpanel.session import scratch_path

Pairs = Callable[[DataFrame], DataFrame]


def drop(spark, path: str) -> None:
    """Remove a written table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def shared_buckets(items: DataFrame) -> DataFrame:
    """``(key, id)`` of the buckets with two ids or more; items: ``id``, ``keys`` (may be null).

    Rows move once, by key, where the least and the greatest id of a bucket tell whether it has several.
    """
    rows = items.select("id", F.explode("keys").alias("key"))
    bucket = Window.partitionBy("key")
    rows = rows.select("key", "id", F.min("id").over(bucket).alias("lo"), F.max("id").over(bucket).alias("hi"))
    return packed(rows.where("lo < hi").select("key", "id").distinct(), "buckets")


def packed(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder, more tightly than usual; for tables near the input's size.
    ``release`` removes it."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._path = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove ``packed`` tables that nothing reads any more."""
    for table in tables:
        drop(table.sparkSession, table._path)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(id, comp)`` for every node of an edge ``(a, b)``: comp is the smallest id reachable.

    Large-star and small-star rounds, each written to the shared folder, until nothing changes.
    """
    spark = edges.sparkSession
    links = _written(edges.select(*pair("a", "b")).distinct(), name)
    before = None
    while True:
        both = links[0].union(links[0].select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        star = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        star = star.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        low = star.groupBy("a").agg(F.min("b").alias("low"))
        small = star.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        small = small.union(low.select("a", F.col("low").alias("b"))).where("a <> b")
        after = _written(small.distinct(), name)
        state = after[0].agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        drop(spark, links[1])
        links = after
        if state == before:
            break
        before = state
    roots = links[0].select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct()
    return links[0].select(F.col("a").alias("id"), F.col("b").alias("comp")).union(roots)


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def link(buckets: DataFrame, verify: Pairs, compare: Pairs) -> DataFrame:
    """Components ``(id, comp)`` of the verified links among members of the same bucket.

    ``verify`` keeps the linked ones of ``(a, b)``. ``compare`` gets ``(key, id, comp, n)`` of
    buckets with several components and returns the verified pairs across components.
    The hub of a bucket is the member that shares most buckets with most others.
    """
    spark = buckets.sparkSession
    sizes = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    mass = buckets.join(sizes, "key").groupBy("id").agg(F.sum("n").alias("mass"))
    hubs = buckets.join(mass, "id").groupBy("key").agg(
        F.max(F.struct("mass", "id")).getField("id").alias("hub"), F.count(F.lit(1)).alias("n")
    )
    members, members_at = _written(buckets.join(hubs, "key"), "members")
    first, first_at = _written(verify(members.where("id <> hub").select(*pair("id", "hub")).distinct()), "links")
    labels = components(first)
    drop(spark, first_at)
    left = members.where("n > 2").join(labels, "id", "left")
    left = left.select("key", "id", F.coalesce("comp", "id").alias("comp"), "n")
    mixed = left.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    left = left.join(mixed.where("lo < hi").select("key"), "key")
    second = compare(left)
    # A star per component stands for all links found so far.
    joined = components(labels.select(F.col("id").alias("a"), F.col("comp").alias("b")).where("a <> b").union(second))
    drop(spark, members_at)
    return joined


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Deal a bucket's rows to cells of two blocks of about ``size`` rows, each pair of blocks once.

    Adds ``cell`` and ``side`` (0 first block, 1 second, 2 both are the same).
    """
    count = F.ceil(F.col("n") / size).cast("long")
    rows = rows.withColumn("of", count).withColumn("mine", F.pmod(F.xxhash64("id"), count))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)))
    cell = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
    side = F.when(F.col("mine") == F.col("other"), 2).otherwise((F.col("mine") > F.col("other")).cast("int"))
    return rows.withColumn("cell", cell).withColumn("side", side).drop("of", "mine", "other")


def by_cell(batches: Iterator[pa.RecordBatch], column: str = "cell") -> Iterator[pa.Table]:
    """Tables of equal ``column`` from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False)
        cuts = [0, *((values[1:] != values[:-1]).nonzero()[0] + 1).tolist(), len(values)]
        for i in range(len(cuts) - 1):
            part = batch.slice(cuts[i], cuts[i + 1] - cuts[i])
            if held and held[-1].column(batch.schema.get_field_index(column))[0] != part.column(batch.schema.get_field_index(column))[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)
