"""Hard negatives by threshold joins over an inverted index of dimensions.

Every anchor asks for the rows of largest inner product inside a window of scores: first for its
positives (same label, no bounds), then, under each positive's score, for negatives (other labels,
between a share and a larger share of that score). A request starts with a threshold just below the top of
its window; requests that are not full come again with a lower one, until they are full or the
threshold is the window's lower end. So a result never depends on how the threshold was guessed.

Rows are dealt to tiles of bounded bytes. A tile indexes its rows by blocks of dimensions, those with
most weight over all rows first, and rows with the heaviest tails first in every block. A row is left
out of the blocks where its suffix norm times the anchors' cannot reach their thresholds. Partial
scores are accumulated block by block; what is left of a pair is at most the product of the
remaining norms, and pairs below the threshold with it are dropped; the rest get whole scores. A tile
answers a request with at most as many rows as it asks for, merged by rank afterwards.

Components become ``floor(scale * x)``, held to 24 bits and a sign (``LARGEST``), so all scores are exact
integers: beyond float64's exact range they are computed in 64-bit integers.

Edge cases: rows with a null label, a null vector or a null or non-finite component take no part. Vectors
of different lengths never meet. A row without a vec_id is no anchor and comes last among equal scores.
Rows that repeat a vec_id are rows of their own, each an anchor if the id is one. An anchor without
other rows of its label, or whose window is empty or upside down (negative scores), returns nothing for
it. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftpanel.llm import near
from driftpanel.session import scratch_path

TILE_BYTES = 16 << 20
#: Anchors and rows that are multiplied at once.
ANCHORS, STRIP = 256, 4096
#: Blocks of dimensions in the index.
BLOCKS = 8
#: Beyond this share of pairs left after half the blocks, a strip goes on as a whole matrix.
DENSE = 0.05
LARGEST = (1 << 24) - 1
#: Rows from which the first thresholds are guessed; they change the work, not the result.
SAMPLE = 2048
#: How many times the wanted rows a threshold should let in, round by round; then the window's end.
GENEROUS = (4, 64)
LOWEST, HIGHEST = -(1 << 60), 1 << 60


def packed(x: np.ndarray) -> bytes:
    return x.astype(np.int16 if np.abs(x).max(initial=0) < 1 << 15 else np.int32).tobytes()


def unpacked(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of integers as float64, from ``packed`` values."""
    raw = column.to_pylist()
    if not dim:
        return np.zeros((len(raw), 0))
    out = np.empty((len(raw), dim))
    sizes = np.array([len(r) for r in raw])
    for size, kind in ((2 * dim, np.int16), (4 * dim, np.int32)):
        at = np.flatnonzero(sizes == size)
        if len(at):
            joined = b"".join(raw[i] for i in at.tolist())
            out[at] = np.frombuffer(joined, kind).reshape(len(at), dim)
    return out


def _scaled(scale: float):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            flat = np.clip(np.floor(scale * flat), -LARGEST, LARGEST)
            dims = batch.column(3).value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
            ends = np.cumsum(dims, dtype=np.int64).tolist()
            out = [packed(flat[end - dim : end]) for end, dim in zip(ends, dims.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(dims), pa.array(out, pa.binary())],
                ["row", "vec_id", "label", "dim", "x"],
            )

    return task


def _weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of squares per dimension, for each vector length."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        dims = batch.column(0).to_numpy(zero_copy_only=False)
        for dim in np.unique(dims).tolist():
            x = unpacked(batch.column(1).take(pa.array(np.flatnonzero(dims == dim))), dim)
            sums[dim] = sums.get(dim, 0) + (x * x).sum(axis=0)
    for dim, total in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(dim, dim, np.int32)), pa.array(np.arange(dim, dtype=np.int32)), pa.array(total)],
            ["dim", "i", "v"],
        )


def _orders(rows: DataFrame) -> dict[int, np.ndarray]:
    found = rows.select("dim", "x").mapInArrow(_weights, "dim int, i int, v double")
    found = found.groupBy("dim", "i").agg(F.sum("v").alias("v")).toArrow()
    dims, i, v = (found.column(c).to_numpy() for c in ("dim", "i", "v"))
    return {d: i[dims == d][np.lexsort((i[dims == d], -v[dims == d]))] for d in np.unique(dims).tolist()}


def _tails(x: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Norms from each cut on."""
    return np.stack([np.sqrt((x[:, c:] ** 2).sum(axis=1)) for c in cuts], axis=1)


class Tile:
    """Rows of one tile, indexed by blocks of dimensions."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, ids: np.ndarray, rows: np.ndarray, order: np.ndarray):
        dim = x.shape[1]
        self.order = order
        self.cuts = sorted({round(dim * i / BLOCKS) for i in range(BLOCKS)})
        tails = _tails(x[:, order], self.cuts)
        by_tail = np.argsort(-tails[:, len(self.cuts) // 2], kind="stable")
        self.x, self.tails = x[by_tail][:, order], tails[by_tail]
        self.labels, self.ids, self.rows = labels[by_tail], ids[by_tail], rows[by_tail]
        self.largest = self.tails[:, 0].max(initial=0)

    def answers(
        self, q: np.ndarray, labels: np.ndarray, rows: np.ndarray, least: np.ndarray, most: np.ndarray, same: bool, k: int
    ) -> tuple[np.ndarray, ...]:
        """The best ``k`` rows of each window (anchor, window) with scores from least to most, as
        arrays (anchor, window, score, place)."""
        q = q[:, self.order]
        tails = _tails(q, self.cuts)
        lowest = least.min(axis=1).astype(np.float64)
        top = self.largest * tails[:, 0].max(initial=0)
        exact, slack = top < 1 << 53, 1e-6 + 1e-12 * top
        # A row stays in the block if for some anchor its tail and the anchor's reach the threshold.
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = np.where(tails > 0, lowest[:, None] / tails, np.where(lowest[:, None] > 0, np.inf, -np.inf))
        need = reach.min(axis=0) * (1 - 1e-9)
        kept = []
        for start in range(0, len(self.x), STRIP):
            x, left = self.x[start : start + STRIP], self.tails[start : start + STRIP]
            i, j, score = self._scores(q, tails, x, left, lowest - slack, need, exact)
            fits = (labels[i] == self.labels[start + j]) == same
            fits &= rows[i] != self.rows[start + j]
            i, j, score = i[fits], j[fits] + start, score[fits]
            for w in range(least.shape[1]):
                inside = (score >= least[i, w]) & (score <= most[i, w])
                kept.append(self._best(i[inside], np.full(inside.sum(), w), score[inside], j[inside], k))
        if not kept:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        return self._best(*(np.concatenate(part) for part in zip(*kept, strict=True)), k)

    def _scores(self, q, tails, x, left, lowest, need, exact):
        indexed = []
        for block in range(len(self.cuts)):
            reaching = np.flatnonzero(left[:, block] >= need[block])
            indexed.append(int(reaching[-1]) + 1 if len(reaching) else 0)
        total = np.zeros((len(q), len(x)))
        ends = [*self.cuts[1:], q.shape[1]]
        bound = np.zeros_like(total)
        for block, (a, b, n) in enumerate(zip(self.cuts, ends, indexed, strict=True)):
            before = indexed[block - 1] if block else len(x)
            # Rows that the index holds up to this block: the rest of their score is bounded here.
            bound[:, n:before] = tails[:, block, None] * left[None, n:before, block]
            total[:, :n] += q[:, a:b] @ x[:n, a:b].T
            if block == len(ends) // 2 and block + 1 < len(ends):
                rest = tails[:, block + 1, None] * left[None, :n, block + 1]
                bound[:, :n] = rest
                hopeful = total + bound >= lowest[:, None]
                if np.count_nonzero(hopeful) <= DENSE * hopeful.size:
                    break
                bound[:, :n] = 0
        else:
            hopeful = total + bound >= lowest[:, None]
        i, j = np.nonzero(hopeful)
        whole = indexed[-1]
        if not exact:
            score = np.einsum("ij,ij->i", q[i].astype(np.int64), x[j].astype(np.int64))
        elif block + 1 < len(ends) or whole < len(x):
            score = np.concatenate(
                [np.einsum("ij,ij->i", q[i[s : s + 65536]], x[j[s : s + 65536]]) for s in range(0, len(i), 65536)]
                or [np.zeros(0)]
            )
        else:
            score = total[i, j]
        score = np.rint(score).astype(np.int64) if exact else score
        keep = score >= lowest[i]
        return i[keep], j[keep], score[keep]

    def _best(self, i, w, score, j, k):
        order = np.lexsort((self.rows[j], self.ids[j], -score, w, i))
        i, w, score, j = i[order], w[order], score[order], j[order]
        new = np.ones(len(i), bool)
        new[1:] = (i[1:] != i[:-1]) | (w[1:] != w[:-1])
        starts = np.flatnonzero(new)
        rank = np.arange(len(i)) - np.repeat(starts, np.diff([*starts, len(i)]))
        keep = rank < k
        return i[keep], w[keep], score[keep], j[keep]


_NO_ID = np.iinfo(np.int64).max


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_NO_ID).to_numpy(zero_copy_only=False)


def _answering(orders: dict[int, np.ndarray], same: bool, k: int):
    """Rows sorted by cell and side: tile rows first, then requests, answered in batches."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, parts, tile = None, [], None
        for whole in batches:
            if not whole.num_rows:
                continue
            cells = whole.column("cell").to_numpy(zero_copy_only=False)
            asking = whole.column("asking").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (asking[1:] != asking[:-1])) + 1
            cuts = [0, *cuts.tolist(), len(cells)]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if name != cells[start]:
                    name, parts, tile = cells[start], [], None
                batch = whole.slice(start, end - start)
                if not asking[start]:
                    parts.append(batch)
                    continue
                if not parts and tile is None:
                    continue
                dim = batch.column("dim")[0].as_py()
                if tile is None:
                    table = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                    parts = []
                    tile = Tile(
                        unpacked(table.column("x"), dim), table.column("label").to_numpy(), _ids(table.column("vec_id")),
                        table.column("row").to_numpy(), orders.get(dim, np.arange(dim)),
                    )
                for at in range(0, batch.num_rows, ANCHORS):
                    yield _answered(tile, batch.slice(at, ANCHORS), dim, same, k)

    return task


def _answered(tile: Tile, batch: pa.RecordBatch, dim: int, same: bool, k: int) -> pa.RecordBatch:
    sizes = batch.column("least").value_lengths().to_numpy(zero_copy_only=False)
    width = int(sizes.max())
    filled = np.arange(width)[None] < sizes[:, None]
    least = np.full((len(sizes), width), HIGHEST, np.int64)
    most = np.full((len(sizes), width), LOWEST, np.int64)
    places = np.full((len(sizes), width), -1, np.int64)
    for table, column in ((least, "least"), (most, "most"), (places, "window")):
        table[filled] = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    anchors = batch.column("row").to_numpy()
    i, w, score, j = tile.answers(
        unpacked(batch.column("x"), dim), batch.column("label").to_numpy(), anchors, least, most, same, k
    )
    ids = tile.ids[j]
    return pa.RecordBatch.from_arrays(
        [pa.array(anchors[i]), pa.array(places[i, w]), pa.array(score), pa.array(tile.rows[j]), pa.array(ids, mask=ids == _NO_ID)],
        ["anchor", "window", "score", "row", "vec_id"],
    )


def _guessing(sample: dict[int, tuple], share: float, same: bool, k: int, generous: int):
    """Adds ``least``: thresholds that should let in ``generous * k`` rows, from the sample's scores;
    ``share`` is the sample's share of all rows."""
    want = generous * k * share

    def guess(scores: np.ndarray, low: int, high: int) -> int:
        if same:
            if len(scores) < 16 or want >= len(scores):
                return low
            top = scores.mean() + scores.std() * NormalDist().inv_cdf(1 - want / len(scores))
            return max(low, int(np.clip(top, LOWEST, HIGHEST)))
        below = np.sort(scores[scores <= high])[::-1]
        at = max(16, int(np.ceil(want)))
        if len(below) < at:
            return low
        return max(low, int(high - (high - below[at - 1]) * want / at) - 1)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ANCHORS):
                batch = whole.slice(at, ANCHORS)
                out = []
                for row in range(batch.num_rows):
                    dim = batch.column("dim")[row].as_py()
                    x, labels = sample.get(dim, (np.zeros((0, dim)), np.zeros(0, np.int64)))
                    q = unpacked(batch.column("x").slice(row, 1), dim)[0]
                    picked = (labels == batch.column("label")[row].as_py()) == same
                    scores = x[picked] @ q
                    lows, highs = batch.column("low")[row].as_py(), batch.column("most")[row].as_py()
                    out.append([guess(scores, a, b) for a, b in zip(lows, highs, strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(out, pa.list_(pa.int64()))], [*batch.schema.names, "least"]
                )

    return task


class _Search:
    """Requests against one written table of rows."""

    def __init__(self, rows: DataFrame, anchors: DataFrame, keep) -> None:
        self.rows, self.anchors, self.keep = rows, anchors, keep
        self.orders = _orders(rows)
        sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
        room = F.greatest(F.lit(STRIP), F.floor(F.lit(TILE_BYTES / 8) / F.greatest("dim", F.lit(1))))
        self.tiles = keep(sizes.select("dim", F.ceil(F.col("n") / room).cast("int").alias("tiles"), "n"), "tiles")
        total = self.tiles.agg(F.sum("n")).first()[0] or 0
        picked = rows.select("dim", "label", "x").orderBy(F.xxhash64("row")).limit(SAMPLE).toArrow()
        self.share = len(picked) / max(total, 1)
        dims = picked.column("dim").to_numpy()
        self.sample = {
            d: (unpacked(picked.column("x").take(np.flatnonzero(dims == d)), d), picked.column("label").to_numpy()[dims == d])
            for d in np.unique(dims).tolist()
        }

    def _ask(self, requests: DataFrame, same: bool, k: int) -> DataFrame:
        empty = F.lit(None).cast("array<long>")
        tile = F.pmod(F.xxhash64("row"), F.col("tiles")).cast("int")
        sizes = F.broadcast(self.tiles.select("dim", "tiles")) if len(self.orders) <= 1000 else self.tiles
        rows = self.rows.join(sizes, "dim").select(
            tile.alias("tile"), F.lit(0).alias("asking"), "row", "vec_id", "label", "dim", "x",
            *[empty.alias(c) for c in ("window", "least", "most")],
        )
        asked = requests.join(sizes, "dim").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        asked = asked.select(
            "tile", F.lit(1).alias("asking"), "row", "vec_id", "label", "dim", "x", "window", "least", "most"
        )
        both = rows.unionByName(asked).withColumn("cell", F.xxhash64("dim", "tile")).drop("tile")
        both = both.repartition("cell").sortWithinPartitions("cell", "asking")
        found = both.mapInArrow(
            _answering(self.orders, same, k), "anchor long, window long, score long, row long, vec_id long"
        )
        order = Window.partitionBy("anchor", "window").orderBy(
            F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row"
        )
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def best(self, windows: DataFrame, same: bool, k: int, name: str) -> DataFrame:
        """The first ``k`` rows of each window ``(anchor, window, low, most)``: anchor, window, score, row,
        vec_id, rank. Rounds with lower thresholds, each for the windows that are not full yet."""
        done = None
        for turn in range(len(GENEROUS) + 1):
            last = turn == len(GENEROUS)
            columns = [F.collect_list(c).alias(c) for c in ("window", "low", "most")]
            grouped = windows.groupBy("anchor").agg(*columns).withColumnRenamed("anchor", "row")
            requests = self.anchors.join(grouped, "row")
            if last:
                requests = requests.withColumn("least", F.col("low"))
            else:
                schema = "row long, vec_id long, label long, dim int, x binary, window array<long>, low array<long>, most array<long>, least array<long>"
                guessed = _guessing(self.sample, self.share, same, k, GENEROUS[turn])
                requests = requests.select("row", "vec_id", "label", "dim", "x", "window", "low", "most")
                requests = self.keep(requests.mapInArrow(guessed, schema), f"{name}-requests")
            found = self.keep(self._ask(requests, same, k), f"{name}-found")
            if last:
                return found if done is None else done.unionByName(found)
            counts = found.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("found"))
            asked = requests.select(
                F.col("row").alias("anchor"), F.explode(F.arrays_zip("window", "low", "most", "least")).alias("z")
            ).select("anchor", "z.*")
            state = asked.join(counts, ["anchor", "window"], "left")
            full = (F.coalesce("found", F.lit(0)) >= k) | (F.col("least") <= F.col("low"))
            state = self.keep(state.withColumn("full", full), f"{name}-state")
            whole = found.join(state.where("full").select("anchor", "window"), ["anchor", "window"], "left_semi")
            done = whole if done is None else done.unionByName(whole)
            windows = state.where("not full").select("anchor", "window", "low", "most")
            if windows.isEmpty():
                return done


def _floor_share(score: Column, percent: int) -> Column:
    """floor(percent * score / 100) in integers."""
    times = score * F.lit(percent).cast("long")
    return ((times - F.pmod(times, F.lit(100).cast("long"))) / 100).cast("long")


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    scale: float = 256,
    positives: int = 5,
    negatives: int = 10,
    least_percent: int = 30,
    most_percent: int = 90,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on the column ``vec_id``. For each anchor and each of its first
    ``positives`` rows of the same label: the first ``negatives`` rows of other labels with
    ``least_percent * positive_score <= 100 * negative_score <= most_percent * positive_score``.
    """
    spark = vectors.sparkSession
    passing: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        passing.append(scratch_path(spark, name))
        df.write.parquet(passing[-1])
        return spark.read.schema(df.schema).parquet(passing[-1])

    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(label).isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.monotonically_increasing_id().alias("row"),
        F.col(vec_id).cast("long").alias("vec_id"),
        F.xxhash64(label).alias("label"),
        F.col(embedding).alias("embedding"),
    )
    rows = keep(rows.mapInArrow(_scaled(scale), "row long, vec_id long, label long, dim int, x binary"), "rows")
    anchors = keep(rows.where(is_anchor), "anchors")
    search = _Search(rows, anchors, keep)

    asked = anchors.select(
        F.col("row").alias("anchor"), F.lit(0).cast("long").alias("window"),
        F.lit(LOWEST).alias("low"), F.lit(HIGHEST).alias("most"),
    )
    first = search.best(asked, True, positives, "positives")
    first = keep(
        first.select("anchor", F.col("rank").cast("long").alias("window"), F.col("vec_id").alias("positive_id"),
                     F.col("score").alias("positive_score")),
        "positives",
    )
    score = F.col("positive_score")
    asked = first.select(
        "anchor", "window", (-_floor_share(-score, least_percent)).alias("low"), _floor_share(score, most_percent).alias("most")
    )
    second = keep(search.best(asked.where("low <= most"), False, negatives, "negatives"), "negatives")
    names = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    result = keep(
        second.join(first, ["anchor", "window"]).join(names, "anchor").select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"),
        ),
        "mined",
    )
    for path in passing[:-1]:
        near.drop(spark, path)
    return result
