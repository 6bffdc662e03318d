"""Near duplicates by b-bit MinHash.

A document is the set of its distinct word shingles. ``hashes`` minima are taken of the set; rows
of ``BAND_ROWS`` minima make bands that name candidates; four low bits of each minimum are packed
into a signature, whose agreeing positions, corrected for chance agreement, estimate the
similarity. Pairs that the estimate leaves possible are confirmed on the full sets.

Documents with the same set are one class from the start, so copies never meet in pairs, and a
component is found through hubs (see ``near``). At similarity 0.85 a pair shares no band with
probability 2e-7, and the estimate falls below its cut with probability 4e-6.

Edge cases: null or wordless text has an empty set and is linked with nothing (component_id is its
own doc_id, kept). Fewer words than a shingle make one shingle of them all. Rows that repeat a
doc_id are separate documents; equal ones share a component. Rows without doc_id take the smallest
id of their component and are not kept unless the whole component has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftpanel.llm import near, words
from driftpanel.session import materialize

HASHES, BANDS, BAND_ROWS = 512, 48, 8
LOW_BITS = 4
#: Standard errors that the estimate may fall short of the wanted similarity.
SLACK = 4.5
BLOCK = 2048

_SCALE = words.constants(HASHES, 11).astype(np.uint32) | np.uint32(1)
_SHIFT = (words.constants(HASHES, 12) >> np.uint64(32)).astype(np.uint32)
_BAND = words.constants(BAND_ROWS, 13)
_PLACE = words.constants(BANDS, 14)


def shingle_sets(found: words.Words, size: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each row, sorted."""
    grams, at = found.grams(size)
    cuts = np.searchsorted(found.row[at], np.arange(found.rows + 1))
    first = found.bounds()
    out = []
    for i in range(found.rows):
        if cuts[i] < cuts[i + 1]:
            out.append(np.unique(grams[cuts[i] : cuts[i + 1]]))
        elif first[i] < first[i + 1]:
            out.append(words.gram_of(found.hash[first[i] : first[i + 1]])[None])
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(shingles: np.ndarray) -> int:
    """One 64-bit id of a set."""
    total = words.mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(words.mix(np.array([total + np.uint64(len(shingles))]))[0].astype(np.int64))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The minima of the set under ``HASHES`` linear maps of 32-bit shingle hashes."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        table = _SCALE[:, None] * x[None, at : at + 512]
        table += _SHIFT[:, None]
        np.minimum(best, table.min(axis=1), out=best)
    return best


def band_keys(best: np.ndarray) -> np.ndarray:
    rows = best[: BANDS * BAND_ROWS].astype(np.uint64).reshape(BANDS, BAND_ROWS)
    return words.mix((rows * _BAND).sum(axis=1, dtype=np.uint64) + _PLACE).view(np.int64)


def packed(best: np.ndarray) -> np.ndarray:
    """The low bits of the minima, two to a byte."""
    low = (words.mix(best) & np.uint64((1 << LOW_BITS) - 1)).astype(np.uint8)
    return low[0::2] | (low[1::2] << 4)


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of packed signatures (as rows of uint64): the share of agreeing
    positions, less what agrees by chance."""
    x = a ^ b
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    x &= np.uint64(0x1111111111111111)
    agree = 1 - np.bitwise_count(x).sum(axis=-1, dtype=np.int64) / HASHES
    chance = 2.0**-LOW_BITS
    return (agree - chance) / (1 - chance)


def estimate_cut(threshold: float) -> float:
    chance = 2.0**-LOW_BITS
    agree = threshold + (1 - threshold) * chance
    return threshold - SLACK * (agree * (1 - agree) / HASHES) ** 0.5 / (1 - chance)


def signatures(documents: DataFrame, shingle: int) -> DataFrame:
    """Per row: doc_id, tkey, n, id (null without words), and, at the first row of the id in a
    slab, its band keys and packed bits."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in words.slabs(batches):
            sets = shingle_sets(words.words(slab.column(2), words.WHITE), shingle)
            ids = [set_id(s) if len(s) else None for s in sets]
            seen, keys, bits = set(), [], []
            for s, i in zip(sets, ids, strict=True):
                new = i is not None and i not in seen
                seen.add(i)
                best = minima(s) if new else None
                keys.append(band_keys(best) if new else None)
                bits.append(packed(best).tobytes() if new else None)
            yield pa.RecordBatch.from_arrays(
                [
                    slab.column(0),
                    slab.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(ids, pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(bits, pa.binary()),
                ],
                ["doc_id", "tkey", "n", "id", "keys", "bits"],
            )

    return documents.mapInArrow(
        task, "doc_id long, tkey long, n long, id long, keys array<long>, bits binary"
    )


def _estimated(cut: float):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (
                np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(
                    batch.num_rows, -1
                )
                for i in (2, 3)
            )
            keep = pa.array(similarity(a, b) >= cut)
            yield batch.select([0, 1]).filter(keep)

    return task


def _across(cut: float):
    """Pairs of a cell, across components, whose estimate reaches the cut; a pair that shares
    several bands comes from the first of them alone."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in near.by_cell(batches):
            ids, comp, side = (cell[c].to_numpy() for c in ("id", "comp", "side"))
            mark = np.int64(cell["key"][0].as_py()).astype(np.uint32)
            bits = np.frombuffer(b"".join(cell["bits"].to_pylist()), np.uint64).reshape(len(ids), -1)
            marks = np.frombuffer(b"".join(cell["marks"].to_pylist()), np.uint32).reshape(len(ids), -1)
            names, where = np.unique(comp, return_inverse=True)
            major = where == np.bincount(where).argmax()
            order = np.argsort(major, kind="stable")
            ids, comp, side, major = ids[order], comp[order], side[order], major[order]
            bits, marks = bits[order], marks[order]
            found = []
            for i in range(int((~major).sum())):
                j = np.arange(i + 1, len(ids))
                j = j[(comp[j] != comp[i]) & ((side[j] == 2) | (side[j] != side[i]))]
                if not len(j):
                    continue
                j = j[similarity(bits[i][None], bits[j]) >= cut]
                same = marks[i][None] == marks[j]
                first = marks[i][same.argmax(axis=1)]
                j = j[same.any(axis=1) & (first == mark)]
                found.append(np.stack([np.full(len(j), ids[i]), ids[j]]))
            if found:
                a, b = np.concatenate(found, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"]
                )

    return task


def _confirmed(percent: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return task


def near_duplicates(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    percent: int = 85,
    shingle: int = 5,
    keep_key: bool = False,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept; with ``keep_key`` the hash of
    the text (tkey) and the node that stands for the component too.

    Links pairs with ``100 * intersection >= percent * union`` of their shingle sets.
    """
    documents = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    keyed = documents.select("doc_id", F.xxhash64("text").alias("tkey"), "text")
    signed = materialize(signatures(keyed, shingle), "signatures")
    buckets = near.shared_buckets(signed.select("id", "keys"))

    wanted = signed.join(buckets.select("id").distinct(), "id")
    rep = wanted.groupBy("id").agg(F.min(F.struct("doc_id", "tkey")).alias("rep"))
    nodes = wanted.where("bits is not null").dropDuplicates(["id"])
    nodes = near.packed(
        nodes.select(
            "id",
            "bits",
            F.transform("keys", lambda k: k.bitwiseAND(0xFFFFFFFF)).alias("keys"),
        ),
        "nodes",
    )
    rep = rep.select(F.col("rep.doc_id").alias("rep_id"), F.col("rep.tkey").alias("rep_key"))
    chosen = keyed.join(
        rep, keyed.doc_id.eqNullSafe(rep.rep_id) & (keyed.tkey == rep.rep_key), "left_semi"
    )

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in words.slabs(batches):
            sets = shingle_sets(words.words(slab.column(0), words.WHITE), shingle)
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()), words.binaries(sets)],
                ["id", "members"],
            )

    sets = chosen.select("text").mapInArrow(sets_of, "id long, members binary")
    sets = near.packed(sets.where("id is not null"), "sets")
    cut = estimate_cut(percent / 100)

    def side(table: DataFrame, name: str, value: str, to: str) -> DataFrame:
        return table.select(F.col("id").alias(name), F.col(value).alias(to))

    def confirm(pairs: DataFrame) -> DataFrame:
        both = pairs.join(side(sets, "a", "members", "x"), "a").join(side(sets, "b", "members", "y"), "b")
        return both.select("a", "b", "x", "y").mapInArrow(_confirmed(percent), "a long, b long").distinct()

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(side(nodes, "a", "bits", "x"), "a").join(side(nodes, "b", "bits", "y"), "b")
        return confirm(both.select("a", "b", "x", "y").mapInArrow(_estimated(cut), "a long, b long"))

    marked = nodes.mapInArrow(_marks, "id long, bits binary, marks binary")

    def compare(rows: DataFrame) -> DataFrame:
        rows = near.blocks(rows, BLOCK).join(marked, "id")
        rows = rows.select("cell", "side", "key", "id", "comp", "bits", "marks")
        rows = rows.repartition("cell").sortWithinPartitions("cell")
        return confirm(rows.mapInArrow(_across(cut), "a long, b long").distinct())

    comps = near.link(buckets, verify, compare)
    near.release(buckets, nodes, sets)
    classes = signed.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("low"))
    classes = classes.join(comps, "id", "left").select("id", "low", F.coalesce("comp", "id").alias("comp"))
    lowest = classes.groupBy("comp").agg(F.min("low").alias("component_id"))
    classes = classes.join(lowest, "comp")
    classes = classes.select(F.col("id").alias("set_id"), "component_id", F.col("comp").alias("component"))
    rows = signed.select("doc_id", "tkey", F.col("n").alias("n_shingles"), F.col("id").alias("own"))
    rows = rows.join(classes, F.col("own") == F.col("set_id"), "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        (F.col("doc_id").eqNullSafe(component)).alias("kept"),
        *(["tkey", "component"] if keep_key else []),
    )


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            marks = [np.array(k, np.int64).astype(np.uint32) for k in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), words.binaries(marks)], ["id", "bits", "marks"]
            )


def keep_one(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85, shingle: int = 5
) -> DataFrame:
    """The documents with one row of each component, the one with the smallest id; of several such
    rows, and in components without any id, the one with the smallest text hash. Rows without words
    all stay. The decision is joined by the hash of the text, so the texts move once."""
    found = near_duplicates(documents, doc_id, text, percent, shingle, keep_key=True)
    first = found.where("n_shingles > 0").groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tkey")).alias("first"),
    )
    keep = first.select(F.col("first.doc_id").alias("keep_id"), F.col("first.tkey").alias("keep_key"))
    keep = keep.unionByName(
        found.where("n_shingles = 0").select(F.col("doc_id").alias("keep_id"), F.col("tkey").alias("keep_key")).distinct()
    )
    copies = found.where("n_shingles > 0").groupBy("doc_id", "tkey").agg(F.count(F.lit(1)).alias("rows"))
    copies = copies.select(F.col("doc_id").alias("c_id"), F.col("tkey").alias("c_key"), "rows")
    keep = keep.join(
        copies, F.col("keep_id").eqNullSafe(F.col("c_id")) & (F.col("keep_key") == F.col("c_key")), "left"
    ).select("keep_id", "keep_key", F.coalesce("rows", F.lit(1)).alias("keep_rows"))
    # All columns of a document travel in one, so none of their names can clash with these.
    keyed = documents.select(
        F.struct(*documents.columns).alias("row"), F.xxhash64(text).alias("own_key"), F.col(doc_id).cast("long").alias("own_id")
    )
    kept = keyed.join(keep, (F.col("own_key") == F.col("keep_key")) & F.col("own_id").eqNullSafe(F.col("keep_id")))
    once = kept.where("keep_rows = 1").select("row")
    again = kept.where("keep_rows > 1").dropDuplicates(["keep_id", "keep_key"]).select("row")
    return once.union(again).select(*[F.col("row").getField(c).alias(c) for c in documents.columns])
