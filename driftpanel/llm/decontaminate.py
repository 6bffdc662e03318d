"""Benchmark decontamination by an FM-index per training shard.

A shard is a slab of whole documents inside a task. Its words are numbered by the phrases'
vocabulary; runs of known words that are long enough to hold a phrase are laid out one after
another, each closed by a separator, and a word outside the vocabulary ends a run, since no phrase
can cross it. The shard's index is the suffix order of that layout, its Burrows-Wheeler transform
in a wavelet matrix with ranks, and the suffix positions sampled at run starts and every
``SAMPLE`` words. All phrases are searched backwards together; occurrences are located by walking
to a sampled position, and the words they cover are merged into removal spans.

Phrases are the windows of ``WINDOW`` consecutive words of an item; an item of fewer words is one
window. Items are taken in blocks of about ``BLOCK_BYTES`` of text, each block in one pass, so what
a task holds of the benchmark is bounded.

Edge cases: null or wordless text has no words, spans or items. Items without words match nothing;
items without an item_id cover words but are not listed. Repeated rows, ties and extra columns are
kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftpanel.llm import words
from driftpanel.session import materialize

WINDOW, SAMPLE = 10, 16
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 4 << 20


class Phrases:
    """Distinct windows of a block of items, over a sorted vocabulary of word hashes."""

    def __init__(self, item_ids: list, texts: pa.Array, size: int = WINDOW):
        found = words.words(texts, words.NOT_ALNUM)
        self.vocabulary, numbers = np.unique(found.hash, return_inverse=True)
        bounds, held = found.bounds(), {}
        for i in range(found.rows):
            own = numbers[bounds[i] : bounds[i + 1]]
            for at in range(max(1, len(own) - size + 1) if len(own) else 0):
                held.setdefault(own[at : at + size].tobytes(), set()).add(item_ids[i])
        windows = [np.frombuffer(w, numbers.dtype) for w in held]
        self.length = np.array([len(w) for w in windows], np.int64)
        #: Numbers from the last word back, -1 beyond the first word.
        self.back = np.full((len(windows), size), -1, np.int64)
        for i, w in enumerate(windows):
            self.back[i, : len(w)] = w[::-1]
        self.items = [sorted(x for x in ids if x is not None) for ids in held.values()]


def suffix_order(symbols: np.ndarray, closes: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling. Every separator is a symbol of its own, so comparisons end
    at the end of a run."""
    n = len(symbols)
    rank = symbols + int(closes.sum())
    rank[closes] = np.arange(int(closes.sum()))
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + int(symbols.max(initial=0)) + 2) + after
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        step *= 2
        if rank[order[-1]] == n - 1 or step >= n:
            return order


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector per bit of the symbols, with a count before
    each 64-bit word."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.n = len(sequence)
        self.levels = max(1, int(symbols - 1).bit_length())
        self.bits, self.before, self.zeros = [], [], []
        for level in reversed(range(self.levels)):
            bit = ((sequence >> level) & 1).astype(bool)
            padded = np.zeros((self.n // 64 + 1) * 64, bool)
            padded[: self.n] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=before[1:])
            self.bits.append(packed)
            self.before.append(before)
            self.zeros.append(self.n - int(bit.sum()))
            sequence = np.concatenate([sequence[~bit], sequence[bit]])
        self.begin = self._descend(np.arange(symbols), np.zeros(symbols, np.int64))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][at >> 6] + np.bitwise_count(self.bits[level][at >> 6] & mask)

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            ones = self._ones(level, at)
            high = (symbol >> (self.levels - 1 - level)) & 1
            at = np.where(high == 1, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often the symbol stands before ``at``."""
        return self._descend(symbol, at) - self.begin[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at a place and how often it stands before."""
        symbol = np.zeros(len(at), np.int64)
        for level in range(self.levels):
            high = (self.bits[level][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            ones = self._ones(level, at)
            symbol = symbol * 2 + high.astype(np.int64)
            at = np.where(high == 1, self.zeros[level] + ones, at - ones)
        return symbol, at - self.begin[symbol]


class FMIndex:
    """Index of a sequence of symbols from 1 up, with 0 for separators; the last is a separator."""

    def __init__(self, sequence: np.ndarray, offset: np.ndarray, symbols: int):
        """``offset``: place of each symbol in its run."""
        order = suffix_order(sequence, sequence == 0)
        self.wavelet = WaveletMatrix(sequence[order - 1], symbols)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=symbols))])
        kept = (offset[order] % SAMPLE == 0) & (sequence[order] != 0)
        self.kept = kept
        self.sampled = order[kept]
        self.sample_no = np.cumsum(kept) - 1

    def search(self, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases given from the last symbol back, -1 beyond the first."""
        low = np.zeros(len(back), np.int64)
        high = np.full(len(back), self.wavelet.n, np.int64)
        live = np.arange(len(back))
        for j in range(back.shape[1]):
            live = live[(back[live, j] >= 0) & (low[live] < high[live])]
            symbol = back[live, j]
            low[live] = self.smaller[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.smaller[symbol] + self.wavelet.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row, by steps back to a sampled one."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        live = np.flatnonzero(~self.kept[at])
        while len(live):
            symbol, before = self.wavelet.access(at[live])
            at[live] = self.smaller[symbol] + before
            steps[live] += 1
            live = live[~self.kept[at[live]]]
        return self.sampled[self.sample_no[at]] + steps


def occurrences(found: words.Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """First word and phrase number of every occurrence of a phrase in the slab."""
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(phrases.length) or not len(found.hash):
        return nothing
    number = np.searchsorted(phrases.vocabulary, found.hash)
    number[number == len(phrases.vocabulary)] = 0
    known = phrases.vocabulary[number] == found.hash
    fresh = np.ones(len(known), bool)
    fresh[1:] = ~known[:-1] | (found.row[1:] != found.row[:-1])
    starts = np.flatnonzero(known & fresh)
    last = np.ones(len(known), bool)
    last[:-1] = ~known[1:] | (found.row[1:] != found.row[:-1])
    ends = np.flatnonzero(known & last) + 1
    long = ends - starts >= phrases.length.min()
    starts, sizes = starts[long], (ends - starts)[long]
    if not len(starts):
        return nothing
    # Run after run, each followed by a separator.
    heads = np.cumsum(sizes + 1) - sizes - 1
    offset = np.arange(int(sizes.sum()) + len(sizes)) - np.repeat(heads, sizes + 1)
    place = np.repeat(starts, sizes + 1) + offset
    inside = offset < np.repeat(sizes, sizes + 1)
    used, dense = np.unique(number[place[inside]], return_inverse=True)
    sequence = np.zeros(len(place), np.int64)
    sequence[inside] = dense + 1
    to = np.full(len(phrases.vocabulary) + 1, -2, np.int64)
    to[used] = np.arange(1, len(used) + 1)
    to[-1] = -1
    back = to[phrases.back]
    possible = np.flatnonzero((back != -2).all(axis=1))
    if not len(possible):
        return nothing
    index = FMIndex(sequence, offset, len(used) + 1)
    low, high = index.search(back[possible])
    times = high - low
    if not times.sum():
        return nothing
    first = np.cumsum(times) - times
    rows = np.repeat(low - first, times) + np.arange(int(times.sum()))
    return place[index.locate(rows)], np.repeat(possible, times)


def _pass(phrases: Phrases):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in words.slabs(batches, SHARD_BYTES):
            found = words.words(slab.column(1), words.NOT_ALNUM)
            at, phrase = occurrences(found, phrases)
            bounds, points = found.bounds(), found.code_points()
            base = points[found.offsets[:-1]]
            change = np.zeros(len(found.hash) + 1, np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + phrases.length[phrase], -1)
            items: list[set] = [set(x or ()) for x in slab.column(6).to_pylist()]
            for row, p in np.unique(np.stack([found.row[at], phrase], axis=1), axis=0).tolist():
                items[row].update(phrases.items[p])
            for row, spans in enumerate(zip(slab.column(4).to_pylist(), slab.column(5).to_pylist(), strict=True)):
                if spans[0]:  # of earlier blocks
                    own = points[found.start[bounds[row] : bounds[row + 1]]] - base[row]
                    np.add.at(change, bounds[row] + np.searchsorted(own, spans[0]), 1)
                    np.add.at(change, bounds[row] + np.searchsorted(own, spans[1]), -1)
            hit = np.cumsum(change[:-1]) > 0
            fresh = hit.copy()
            fresh[1:] &= ~hit[:-1] | (found.row[1:] != found.row[:-1])
            last = hit.copy()
            last[:-1] &= ~hit[1:] | (found.row[1:] != found.row[:-1])
            fresh, last = np.flatnonzero(fresh), np.flatnonzero(last)
            counts = np.bincount(found.row[fresh], minlength=found.rows)
            shift = base[found.row[fresh]]
            yield pa.RecordBatch.from_arrays(
                [
                    slab.column(0),
                    slab.column(1),
                    pa.array(np.diff(bounds)),
                    pa.array(np.bincount(found.row[hit], minlength=found.rows)),
                    words.ragged(points[found.start[fresh]] - shift, counts, pa.int64()),
                    words.ragged(points[found.end[last]] - shift, counts, pa.int64()),
                    pa.array([sorted(x) for x in items], pa.list_(pa.int64())),
                ],
                ["row", "text", "n_words", "n_hit", "starts", "ends", "items"],
            )

    return task


def find_overlaps(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id"
) -> DataFrame:
    """Per document: ``row`` (all its columns), ``text``, ``n_words``, ``n_hit`` (words inside an
    occurrence), ``starts`` and ``ends`` of the removal spans in code points, and ``items``."""
    nothing = F.array().cast("array<long>")
    out = documents.select(
        F.struct(*documents.columns).alias("row"),
        F.col(text).alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.lit(0).cast("long").alias("n_hit"),
        nothing.alias("starts"),
        nothing.alias("ends"),
        nothing.alias("items"),
    )
    items = benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(text).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES) or 1
    schema = out.schema
    for block in range(blocks):
        held = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).toArrow()
        own = held.column("text").combine_chunks()
        phrases = Phrases(held.column("item").to_pylist(), own)
        out = out.mapInArrow(_pass(phrases), schema)
        if block + 1 < blocks:
            out = materialize(out, "overlaps")
    return out


def cut_spans(found: DataFrame, columns: list[str], text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The documents with their removal spans cut out, a line break in place of each."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in words.slabs(batches):
            texts = slab.column(1).to_pylist()
            starts, ends = slab.column(2).to_pylist(), slab.column(3).to_pylist()
            for i, value in enumerate(texts):
                if starts[i]:
                    edges = [0, *[x for pair in zip(starts[i], ends[i], strict=True) for x in pair], len(value)]
                    texts[i] = "\n".join(value[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            yield pa.RecordBatch.from_arrays([slab.column(0), pa.array(texts, pa.string())], ["row", "text"])

    plain = found.select("row", "text", "starts", "ends")
    done = plain.mapInArrow(task, plain.select("row", "text").schema)
    return words.with_text(done, columns, text, length)
