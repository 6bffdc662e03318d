"""Near duplicates of embeddings: tiles of vectors compared along their principal axes.

Vectors are scaled to unit length and turned into the axes of their second moments, strongest first,
which leaves every cosine as it is. Two vectors at the wanted cosine lie at most ``sqrt(2 - 2 cosine)``
apart, so on each of the two leading axes their slabs of that width are the same or adjacent; only such
slabs of one label are compared, in tiles of bounded bytes. In a tile pair the products are summed over
leading axes first; what the remaining axes can add is at most the product of the two suffix norms, and
pairs that cannot reach the cosine are dropped before the next axes are read. Sums are in single
precision with a margin for their error; a pair inside the margin is decided by its cosine in double
precision on the given axes, so no link is lost or gained.

Equal vectors of a label are one node from the start and are counted, not compared. A tile pair sends on
one row per linked node: how many vectors it links there, and one node that it is connected with.

Edge cases: a null label, and a vector that is null, empty, zero or holds a null or non-finite component,
links with nothing (n_links 0, component_id its own vec_id, kept). Vectors of different lengths are not
linked. Rows that repeat a vec_id are vectors of their own; all rows with the smallest id are kept. Rows
without a vec_id take the smallest id of their component and are kept only if it has none. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftpanel.llm import near
from driftpanel.session import scratch_path

#: Bytes of a tile's vectors in single precision.
TILE_BYTES = 32 << 20
#: Rows of the blocks in which a tile pair is multiplied.
STRIP = 1024
#: Shares of the axes after which hopeless pairs are dropped.
STAGES = (0.25, 0.5, 1.0)
#: Beyond this share of pairs left, a block goes on as a whole matrix.
DENSE = 0.05
#: Bound on the error of a product of unit vectors of 64 axes in single precision.
CLOSE = 1e-5


def usable(embedding: str) -> F.Column:
    """Whether a vector has a direction: components all finite, one at least not zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def unit(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of unit length from lists of ``dim`` finite numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column(batch.schema.get_field_index("dim")).to_numpy(zero_copy_only=False)
    for dim in np.unique(dims).tolist():
        yield dim, batch.take(pa.array(np.flatnonzero(dims == dim)))


def axes(nodes: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length its principal axes as columns, strongest first, from all nodes.

    Each task sends half a matrix of sums; the driver gets one such matrix for each length.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, part in _by_dim(batch):
                x = unit(part.column(1), dim)
                sums[dim] = sums.get(dim, 0) + x.T @ x
        for dim, total in sums.items():
            i, j = np.triu_indices(dim)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), dim, np.int32)), pa.array(i.astype(np.int32)),
                 pa.array(j.astype(np.int32)), pa.array(total[i, j])],
                ["dim", "i", "j", "v"],
            )

    parts = nodes.select("dim", "embedding").mapInArrow(task, "dim int, i int, j int, v double")
    found = parts.groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).toArrow()
    dims, i, j, v = (found.column(c).to_numpy() for c in ("dim", "i", "j", "v"))
    out = {}
    for dim in np.unique(dims).tolist():
        here = dims == dim
        whole = np.zeros((dim, dim))
        whole[i[here], j[here]] = v[here]
        whole[j[here], i[here]] = v[here]
        out[dim] = np.ascontiguousarray(np.linalg.eigh(whole)[1][:, ::-1])
    return out


def _placing(turns: dict[int, np.ndarray], width: float):
    """Adds the slabs on the two leading axes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("embedding")
            for dim, part in _by_dim(batch):
                lead = unit(part.column(at), dim) @ turns[dim][:, :2]
                slabs = np.zeros((len(lead), 2), np.int32)
                slabs[:, : lead.shape[1]] = np.floor(lead / width)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(slabs[:, 0].copy()), pa.array(slabs[:, 1].copy())],
                    [*part.schema.names, "s1", "s2"],
                )

    return task


def connect(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the classes of linked places; ``labels`` holds the smallest place of each class."""
    while len(i):
        a, b = labels[i], labels[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = labels[labels]
            if (further == labels).all():
                break
            labels[:] = further


def linked(
    x: tuple, y: tuple, cuts: list[int], cosine: float, upper: bool, exact: Callable
) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the rows of x and y whose cosine reaches the threshold; ``upper``: i < j only.

    x and y hold rows along the principal axes and their norms after each of ``cuts``; ``exact`` gives the
    cosines of places (i, j) in double precision.
    """
    (tx, left_x), (ty, left_y) = x, y
    close = CLOSE * max(1.0, cuts[-1] / 64)
    done = cuts[0]
    total = tx[:, :done] @ ty[:, :done].T
    for stage, cut in enumerate(cuts):
        if stage:
            total += tx[:, done:cut] @ ty[:, done:cut].T
            done = cut
        hopeful = total >= (cosine - close) - left_x[:, stage, None] * left_y[None, :, stage]
        if upper:
            hopeful = np.triu(hopeful, 1)
        if done == cuts[-1] or np.count_nonzero(hopeful) <= DENSE * hopeful.size:
            break
    i, j = np.nonzero(hopeful)
    sums = total[i, j]
    for later, cut in enumerate(cuts[stage + 1 :], stage + 1):
        sums = sums + np.einsum("ij,ij->i", tx[i, done:cut], ty[j, done:cut])
        done = cut
        keep = sums >= (cosine - close) - left_x[i, later] * left_y[j, later]
        i, j, sums = i[keep], j[keep], sums[keep]
    sums = sums.astype(np.float64)
    unsure = np.flatnonzero(np.abs(sums - cosine) <= close)
    if len(unsure):
        sums[unsure] = exact(i[unsure], j[unsure])
    keep = sums >= cosine
    return i[keep], j[keep]


def _cosines(given: pa.Array, dim: int, p: int, q: int) -> Callable:
    """Cosines of rows p + i and q + j of the vectors as given, in double precision."""

    def exact(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i))
        for at in range(0, len(i), STRIP):
            x, y = (unit(given.take(pa.array(k[at : at + STRIP] + s)), dim) for k, s in ((i, p), (j, q)))
            out[at : at + STRIP] = np.einsum("ij,ij->i", x, y)
        return out

    return exact


def _comparing(turns: dict[int, np.ndarray], cosine: float):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in near.by_cell(batches):
            sides = cell["side"].to_numpy()
            order = np.argsort(sides, kind="stable")
            sides = sides[order]
            dim = cell["dim"][0].as_py()
            given = cell["embedding"].combine_chunks().take(pa.array(order))
            nodes, sizes = cell["node"].to_numpy()[order], cell["size"].to_numpy()[order]
            alone = sides[0] == 2
            middle = len(sides) if alone else int(np.searchsorted(sides, 1))
            if not alone and middle in (0, len(sides)):
                continue
            tx = np.empty((len(sides), dim), np.float32)
            cuts = sorted({max(1, round(dim * s)) for s in STAGES})
            left = np.empty((len(sides), len(cuts)), np.float32)
            for p in range(0, len(sides), STRIP):
                part = unit(given.slice(p, STRIP), dim) @ turns[dim]
                tx[p : p + STRIP] = part
                left[p : p + STRIP] = np.stack([np.sqrt((part[:, c:] ** 2).sum(axis=1)) for c in cuts], axis=1)
            links = np.zeros(len(tx), np.int64)
            classes = np.arange(len(tx))
            first, second = (range(0, middle, STRIP), range(0 if alone else middle, len(tx), STRIP))
            for p in first:
                a = slice(p, min(p + STRIP, middle))
                for q in second:
                    if alone and q < p:
                        continue
                    b = slice(q, min(q + STRIP, len(tx)))
                    exact = _cosines(given, dim, p, q)
                    i, j = linked((tx[a], left[a]), (tx[b], left[b]), cuts, cosine, alone and p == q, exact)
                    links[a] += np.bincount(i, sizes[b][j], a.stop - a.start).astype(np.int64)
                    links[b] += np.bincount(j, sizes[a][i], b.stop - b.start).astype(np.int64)
                    connect(classes, i + p, j + q)
            found = np.flatnonzero(links)
            if len(found):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[found]), pa.array(links[found]), pa.array(nodes[classes[found]])],
                    ["node", "links", "root"],
                )

    return task


def near_vectors(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    cosine: float = 0.93,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Links vectors of one label whose cosine, in double precision, is ``cosine`` or more (above 0).
    """
    spark = vectors.sparkSession
    written = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        written.append(scratch_path(spark, name))
        df.write.parquet(written[-1])
        return spark.read.schema(df.schema).parquet(written[-1])

    kind = vectors.schema[embedding].dataType.elementType
    as_is = isinstance(kind, (T.FloatType, T.DoubleType))
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.col(label).alias("label"),
        (F.col(embedding) if as_is else F.col(embedding).cast("array<double>")).alias("embedding"),
    )
    fit = F.col("label").isNotNull() & usable("embedding")
    # Two hashes of 64 bits stand for the vector wherever it need not move itself.
    marks = [F.xxhash64("embedding").alias("m1"), F.xxhash64(F.lit(1), "embedding").alias("m2")]
    marked = rows.where(fit).select("vec_id", "label", "embedding", *marks)
    nodes = marked.groupBy("label", "m1", "m2").agg(
        F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("size"), F.first("embedding").alias("embedding")
    )
    nodes = nodes.withColumn("dim", F.size("embedding"))
    nodes = kept(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    turns = axes(nodes)
    width = (2 - 2 * cosine) ** 0.5 + CLOSE
    group = ["label", "dim"]
    bare = nodes.select("node", "label", "dim", "size", "embedding")
    places = T.StructType([*bare.schema.fields, *(T.StructField(c, T.IntegerType()) for c in ("s1", "s2"))])
    placed = bare.mapInArrow(_placing(turns, width), places)

    room = F.greatest(F.lit(STRIP), F.floor(F.lit(TILE_BYTES / 4) / F.col("dim")))
    slabs = placed.groupBy(*group, "s1", "s2").agg(F.count(F.lit(1)).alias("n"))
    # A label that fits into one tile has one slab.
    single = F.sum("n").over(Window.partitionBy(*group)) <= room
    slabs = slabs.select(
        *group, "s1", "s2", F.ceil(F.col("n") / room).cast("int").alias("tiles"), single.alias("single")
    )
    slabs = kept(slabs, "slabs")
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    around = slabs.where("not single").withColumn("t1", F.explode(F.transform(steps, lambda d: F.col("s1") + d)))
    around = around.withColumn("t2", F.explode(F.transform(steps, lambda d: F.col("s2") + d)))
    others = slabs.select(*group, F.col("s1").alias("t1"), F.col("s2").alias("t2"), F.col("tiles").alias("of"))
    around = around.join(others, [*group, "t1", "t2"]).groupBy(*group, "s1", "s2", "tiles")
    around = around.agg(F.collect_list(F.struct("t1", "t2", "of")).alias("around"))
    around = around.withColumn("at", F.struct("s1", "s2"))
    alone = F.array(F.struct(F.lit(0).alias("t1"), F.lit(0).alias("t2"), F.lit(1).alias("of")))
    singles = slabs.where("single").select(
        *group, "s1", "s2", F.lit(1).alias("tiles"), alone.alias("around"),
        F.struct(F.lit(0).alias("s1"), F.lit(0).alias("s2")).alias("at"),
    )
    around = around.unionByName(singles)

    tile = F.struct(F.col("at.s1").alias("s1"), F.col("at.s2").alias("s2"), F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int").alias("part"))
    pairs = placed.join(around, [*group, "s1", "s2"]).withColumn("own", tile)
    every = F.flatten(
        F.transform(
            "around",
            lambda a: F.transform(
                F.sequence(F.lit(0), a.getField("of") - 1),
                lambda k: F.struct(a.getField("t1").alias("s1"), a.getField("t2").alias("s2"), k.alias("part")),
            ),
        )
    )
    pairs = pairs.withColumn("other", F.explode(every))
    side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int"))
    cell = F.xxhash64("label", "dim", F.least("own", "other"), F.greatest("own", "other"))
    pairs = pairs.select(cell.alias("cell"), side.cast("int").alias("side"), "dim", "node", "size", "embedding")
    pairs = pairs.repartition("cell").sortWithinPartitions("cell")
    links = kept(pairs.mapInArrow(_comparing(turns, cosine), "node long, links long, root long"), "links")

    comps = kept(near.components(links.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b")), "comps")
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    found = nodes.select("node", "label", "m1", "m2", "low", "size").join(counts, "node", "left")
    found = found.join(comps.withColumnRenamed("id", "node"), "node", "left")
    found = found.withColumn("comp", F.coalesce("comp", "node"))
    lowest = found.groupBy("comp").agg(F.min("low").alias("component_id"))
    found = found.join(lowest, "comp").select(
        "label", "m1", "m2", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id"
    )
    result = marked.select("vec_id", "label", "m1", "m2").join(found, ["label", "m1", "m2"])
    result = result.select("vec_id", "n_links", "component_id")
    single = rows.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return result.unionByName(single).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
