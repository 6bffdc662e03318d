"""Spelling variants by blocked Gram matrices of letter counts.

Words one edit apart have letter-count vectors at squared distance 2 at most and lengths that differ by
one at most. Words are dealt to blocks by how many of their letters fall into each of ``CLASSES`` letter
classes, so a block has one length; a word visits its own block, the blocks one letter longer and the
blocks of its length that one replaced letter leads to. In a block the squared distances of visitors and
residents come from one matrix product; pairs at two or less are verified letter by letter.

Blocks beyond ``CELL_WORDS`` words are dealt to cells; each keeps its residents in memory and streams
the visitors, so no task holds a whole block. Every pair of near words meets in exactly one cell.

Edge cases: null text has no words; a null doc_id counts as the empty text in the damage rule; rows that
repeat a doc_id or a whole row count again. Equal counts are decided by the word in code-point order.
Words of any length take part. No words give an empty table. Columns besides id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftpanel.llm import words
from driftpanel.llm.near import drop
from driftpanel.session import scratch_path

CLASSES = 8
CELL_WORDS, CELL_LETTERS = 4096, 1 << 20
#: Visitors compared with a cell at once.
STRIP = 1024
#: Distinct words that a counting task holds before it sends them on.
HELD = 200_000

_RUN = "A-Za-zÀ-ÿ"
#: a to z, then U+00C0 to U+00FF.
_LETTERS = 26 + 64
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def damaged(doc_id: str, run: str, one_in: int) -> str:
    """The run, without one letter where the checksum of id and run says so."""
    mark = zlib.crc32(f"{doc_id}:{run}".encode())
    at = mark % len(run)
    return run[:at] + run[at + 1 :] if mark % one_in == 0 else run


def _counting(least: int, one_in: int):
    runs = re.compile(f"[{_RUN}]{{{least},}}")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for slab in words.slabs(batches):
            for doc_id, text in zip(slab.column(0).to_pylist(), slab.column(1).to_pylist(), strict=True):
                if text is None:
                    continue
                before = zlib.crc32(f"{doc_id or ''}:".encode())
                lowered = text.encode().translate(_LOWER).decode()
                for run, n in Counter(runs.findall(lowered)).items():
                    mark = zlib.crc32(run.encode(), before)
                    if mark % one_in == 0:
                        at = mark % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < least:
                            continue
                    seen[run] += n
            if len(seen) > HELD:
                yield _counted(seen)
                seen = Counter()
        if seen:
            yield _counted(seen)

    return task


def _counted(seen: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"]
    )


def count_words(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 7, one_in: int = 31
) -> DataFrame:
    """``(word, n)`` of all runs of letters with ``least`` code points or more, after the damage rule."""
    rows = documents.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    counted = rows.mapInArrow(_counting(least, one_in), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _codes(texts: list[str], length: int) -> np.ndarray:
    """One row of letter numbers per word; all words have the given length."""
    raw = np.frombuffer("".join(texts).encode("latin-1"), np.uint8).reshape(len(texts), length)
    return np.where(raw < 128, raw - np.uint8(97), raw - np.uint8(0xC0 - 26)).astype(np.uint8)


def _letter_counts(codes: np.ndarray, of: int) -> np.ndarray:
    rows = np.arange(len(codes))[:, None] * of
    return np.bincount((rows + codes).ravel(), minlength=len(codes) * of).reshape(len(codes), of)


def _keys(counts: np.ndarray) -> list[bytes]:
    """The class counts as bytes: one byte a class, or four where a count needs more."""
    narrow, wide = counts.astype("<u1"), counts.astype("<u4")
    big = counts.max(axis=1, initial=0) > 255
    return [wide[i].tobytes() if b else narrow[i].tobytes() for i, b in enumerate(big.tolist())]


def _visits() -> list[np.ndarray]:
    """How class counts change under one insertion, or under one replacement across classes; of the
    two directions of a replacement, the one that takes from a later class."""
    steps = []
    for i in range(CLASSES):
        step = np.zeros(CLASSES, np.int64)
        step[i] = 1
        steps.append(step)
        for j in range(i + 1, CLASSES):
            both = step.copy()
            both[j] = -1
            steps.append(both)
    return steps


#: What a row is to its block: a resident, a visitor from another block, or one from the same block.
RESIDENT, VISITOR, FELLOW = 0, 1, 2


def _dealt(visits: bool):
    steps = _visits()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, STRIP):
                batch = whole.slice(at, STRIP)
                texts, n = batch.column(0).to_pylist(), batch.column(1)
                flat = np.frombuffer("".join(texts).encode("latin-1"), np.uint8).astype(np.int64)
                row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
                counts = np.bincount(row * CLASSES + flat % CLASSES, minlength=len(texts) * CLASSES)
                counts = counts.reshape(len(texts), CLASSES)
                yield _roles(_keys(counts), batch.column(0), n, RESIDENT)
                if not visits:
                    continue
                yield _roles(_keys(counts), batch.column(0), n, FELLOW)
                for step in steps:
                    there = counts + step
                    fits = np.flatnonzero((there >= 0).all(axis=1))
                    if len(fits):
                        places = pa.array(fits)
                        yield _roles(_keys(there[fits]), batch.column(0).take(places), n.take(places), VISITOR)

    return task


def _roles(keys: list[bytes], texts: pa.Array, n: pa.Array, role: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.binary()), texts, n, pa.array(np.full(len(keys), role, np.int8))],
        ["key", "word", "n", "role"],
    )


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ by one replaced letter, or ``b`` by one inserted."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    front, back = a != b[:, :-1], a != b[:, 1:]
    length = a.shape[1]
    same = np.where(front.any(axis=1), front.argmax(axis=1), length)
    tail = np.where(back.any(axis=1), back[:, ::-1].argmax(axis=1), length)
    return same + tail >= length


class _Cell:
    """Residents of one cell, by length, and what has been found for them."""

    def __init__(self, name: int) -> None:
        self.name, self.best, self.near = name, {}, Counter()
        self.texts: dict[int, list[str]] = {}
        self.sizes: dict[int, list[int]] = {}
        self.tables: dict[int, tuple] = {}

    def settle(self, texts: list[str], n: list[int]) -> None:
        for text, size in zip(texts, n, strict=True):
            self.texts.setdefault(len(text), []).append(text)
            self.sizes.setdefault(len(text), []).append(size)

    def _table(self, length: int):
        if length not in self.tables:
            codes = _codes(self.texts[length], length)
            kind = np.float32 if length < 2048 else np.float64
            counts = _letter_counts(codes, _LETTERS).astype(kind)
            self.tables[length] = codes, counts, (counts * counts).sum(axis=1)
        return self.tables[length]

    def _note(self, word: str, other: str, n: int) -> None:
        self.near[word] += 1
        rank = (-n, other)
        if word not in self.best or rank < self.best[word]:
            self.best[word] = rank

    def meet(self, texts: list[str], n: list[int], fellows: bool) -> None:
        by_length: dict[int, list[int]] = {}
        for i, text in enumerate(texts):
            by_length.setdefault(len(text), []).append(i)
        for length, picked in by_length.items():
            for other in (length, length + 1):
                if other in self.texts and (other == length or not fellows):
                    self._compare([texts[i] for i in picked], [n[i] for i in picked], length, other, fellows)

    def _compare(self, texts, n, length, other, fellows) -> None:
        here, counts, squares = self._table(other)
        codes = _codes(texts, length)
        mine = _letter_counts(codes, _LETTERS).astype(counts.dtype)
        distance = mine @ counts.T
        distance *= -2
        distance += (mine * mine).sum(axis=1)[:, None]
        distance += squares[None]
        i, j = np.nonzero(distance <= 2)
        step = max(1, CELL_LETTERS // other)
        for at in range(0, len(i), step):
            x, y = i[at : at + step], j[at : at + step]
            hit = one_edit(codes[x], here[y])
            for a, b in zip(x[hit].tolist(), y[hit].tolist(), strict=True):
                visitor, resident = texts[a], self.texts[other][b]
                if fellows and visitor >= resident:
                    continue
                self._note(visitor, resident, self.sizes[other][b])
                self._note(resident, visitor, n[a])

    def rows(self) -> pa.RecordBatch:
        found = list(self.near)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(found, pa.string()),
                pa.array([self.near[w] for w in found], pa.int64()),
                pa.array([-self.best[w][0] for w in found], pa.int64()),
                pa.array([self.best[w][1] for w in found], pa.string()),
            ],
            ["word", "n_near", "best_n", "best"],
        )


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, role, word, n), sorted by cell and role: near words found in each cell."""
    cell = None
    for whole in batches:
        for at in range(0, whole.num_rows, STRIP):
            batch = whole.slice(at, STRIP)
            cells = batch.column(0).to_numpy(zero_copy_only=False)
            roles = batch.column(1).to_numpy(zero_copy_only=False)
            texts, n = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            new = (cells[1:] != cells[:-1]) | (roles[1:] != roles[:-1])
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(cells)]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if cell is None or cell.name != cells[start]:
                    if cell is not None and cell.near:
                        yield cell.rows()
                    cell = _Cell(cells[start])
                part = texts[start:end], n[start:end]
                if roles[start] == RESIDENT:
                    cell.settle(*part)
                elif cell.texts:
                    cell.meet(*part, fellows=roles[start] == FELLOW)
            if cell is not None and len(cell.near) > HELD:
                yield cell.rows()
                cell.near, cell.best = Counter(), {}
    if cell is not None and cell.near:
        yield cell.rows()


def near_words(vocabulary: DataFrame) -> DataFrame:
    """``(word, n_near, best_n, best)`` for the words of ``(word, n)`` with a near word: how many there
    are, and the one of largest n (ties: smallest)."""
    kind = "key binary, word string, n long, role byte"
    room = F.greatest(F.lit(1), F.least(F.lit(CELL_WORDS), F.floor(F.lit(CELL_LETTERS) / F.max(F.length("word")))))
    blocks = vocabulary.mapInArrow(_dealt(False), kind).groupBy("key")
    blocks = blocks.agg(F.ceil(F.count(F.lit(1)) / room).cast("int").alias("cells"))
    rows = vocabulary.mapInArrow(_dealt(True), kind).join(blocks, "key")
    own = F.array(F.pmod(F.xxhash64("word"), F.col("cells")).cast("int"))
    every = F.sequence(F.lit(0), F.col("cells") - 1)
    rows = rows.withColumn("part", F.explode(F.when(F.col("role") == RESIDENT, own).otherwise(every)))
    rows = rows.select(F.xxhash64("key", "part").alias("cell"), "role", "word", "n")
    rows = rows.repartition("cell").sortWithinPartitions("cell", "role")
    found = rows.mapInArrow(_compared, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("top"))
    return found.select(
        "word", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.best").alias("best")
    )


def variants(vocabulary: DataFrame, ratio: int = 10) -> DataFrame:
    """For each row of ``(word, n)``: form, the near word of largest n if that is ``ratio`` times the
    word's n or more; root, the end of the chain of forms; n_near; form_n.

    Counts grow by ``ratio`` with every form, so the largest count bounds the length of a chain.
    """
    spark = vocabulary.sparkSession
    used = []

    def written(df: DataFrame) -> DataFrame:
        used.append(scratch_path(spark, "variants"))
        df.write.parquet(used[-1])
        return spark.read.schema(df.schema).parquet(used[-1])

    table = written(vocabulary.select("word", "n"))
    rows = table.join(near_words(table), "word", "left")
    better = F.col("best_n") >= ratio * F.col("n")
    rows = written(
        rows.select(
            "word",
            F.when(better, F.col("best")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(better, F.col("best_n")).alias("form_n"),
        )
    )
    drop(spark, used.pop(0))
    most = rows.agg(F.max("n")).first()[0] or 0
    chain, reach = 0, 1
    while ratio > 1 and most >= ratio:
        most, chain = most // ratio, chain + 1
    roots = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while reach < chain:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = written(roots.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
        reach *= 2
    return rows.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def group_spellings(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The words of a corpus that occur twice or more, each with its form and root."""
    return variants(count_words(documents, doc_id, text).where("n >= 2"))
