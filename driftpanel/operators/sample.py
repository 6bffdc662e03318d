"""Repeatable samples and ordered heads."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_SLICES = 64
#: Rows that a task gathers before it cuts its groups again.
_WAITING = 50_000


def group_sample(
    df: DataFrame, by: Sequence[str], k: int, seed: int, ids: Sequence[str]
) -> DataFrame:
    """``min(k, n)`` rows of each group, without replacement.

    Rows are drawn in the order of a seeded hash of their id, so reruns, retries and other
    partitionings draw the same rows. One plan for every ``k``: each task keeps the first ``k``
    rows of its groups and sends no others; hashed slices of each group merge them to ``k`` again,
    and the slices of a group meet last. So no task sorts a group, or all tasks' rows of one.
    """
    key = F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids])
    group = F.to_json(F.struct(*by)) if by else F.lit("")
    drawn = df.withColumns({"_draw": F.md5(key), "_group": group})
    first = _first_of_groups(k, ["_draw", *ids])
    drawn = drawn.mapInArrow(first, drawn.schema)
    drawn = drawn.withColumn("_slice", F.pmod(F.xxhash64(*ids), F.lit(_SLICES)))
    drawn = drawn.repartition("_group", "_slice").mapInArrow(first, drawn.schema)
    place = F.row_number().over(Window.partitionBy(*by).orderBy("_draw", *ids))
    return drawn.withColumn("_place", place).filter(F.col("_place") <= k).select(*df.columns)


def _first_of_groups(k: int, order: Sequence[str]):
    """A task's first ``k`` rows of each ``_group``, in the given order."""

    def cut(parts: list[pa.Table]) -> pa.Table:
        table = pa.concat_tables(parts)
        keys = table.select(["_group", *order])
        table = table.take(pc.sort_indices(keys, sort_keys=[(c, "ascending") for c in keys.column_names]))
        group = table["_group"].combine_chunks()
        starts = np.ones(len(group), bool)
        if len(group) > 1:
            starts[1:] = pc.not_equal(group[1:], group[:-1]).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(starts)
        place = np.arange(len(group)) - np.repeat(at, np.diff([*at, len(group)]))
        return table.filter(pa.array(place < k))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        kept = waiting = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            waiting += batch.num_rows
            # Cutting again only after as many rows as are kept costs each row a few sorts.
            if waiting >= max(_WAITING, kept):
                held = [cut(held)]
                kept, waiting = len(held[0]), 0
        if held:
            yield from cut(held).to_batches(max_chunksize=10_000)

    return task


def moved_enough(
    df: DataFrame, dy: str, dx: str, least_dy: float, least_dx: float
) -> DataFrame:
    """Rows that moved visibly in either direction."""
    return df.filter((F.abs(F.col(dy)) > least_dy) | (F.abs(F.col(dx)) > least_dx))


def head_by(df: DataFrame, order: Sequence[str], n: int = 3) -> DataFrame:
    """First rows in key order: each partition keeps ``n``, then one merge."""
    return df.orderBy(*order).limit(n)


def distinct_sorted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct().orderBy(*columns)
