"""Words of Arrow text columns as numpy arrays: places and 64-bit hashes, without Python strings.

Used inside ``mapInArrow`` tasks. A word is a maximal run of bytes outside a separator set; all
separators are ASCII, so a word never splits a UTF-8 sequence. Two words are taken as equal if
their 64-bit hashes are.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_AS_IS = bytes(range(256))


def _separators(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: ``[^\x20\x09-\x0D]+`` are the words.
WHITE = _separators((0x20, 0x20), (0x09, 0x0D))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` are the words, after lower-casing.
NOT_ALNUM = _separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit constants."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)


_BYTE = constants(256, 1)
_GRAM = constants(16, 2)
_tables: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, at least ``n`` of each."""
    if "p" not in _tables or len(_tables["p"]) < n:
        size = max(n, 1 << 18) + 1
        for name, base in (("p", _MULTIPLIER), ("i", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.multiply.accumulate(steps)
    return _tables["p"], _tables["i"]


@dataclass
class Words:
    """Words of a text column, in order. ``data`` holds the column's bytes, ``offsets`` its rows."""

    data: np.ndarray
    offsets: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    prefix: dict[int, np.ndarray]

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def bounds(self) -> np.ndarray:
        """Index of each row's first word, and the number of words at the end."""
        return np.searchsorted(self.row, np.arange(self.rows + 1))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``n`` words from each place where so many follow in the row, and the places."""
        count = len(self.hash) - n + 1
        if count <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.row[:count] == self.row[n - 1 :])
        total = np.zeros(len(at), np.uint64)
        for j in range(n):
            total += self.hash[at + j] * _GRAM[j]
        return mix(total + np.uint64(n)), at

    def code_points(self) -> np.ndarray:
        """Code points before each byte, over the whole column; one entry more than bytes."""
        out = np.zeros(len(self.data) + 1, np.int32 if len(self.data) < 1 << 31 else np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=out[1:])
        return out


def gram_of(hashes: np.ndarray) -> np.uint64:
    """The hash that ``Words.grams(len(hashes))`` gives these words."""
    n = len(hashes)
    return mix(np.array([(hashes * _GRAM[:n]).sum(dtype=np.uint64) + np.uint64(n)]))[0]


def words(
    text: pa.Array, separators: np.ndarray, fold: bool = True, prefixes: tuple[int, ...] = ()
) -> Words:
    """Words of a string column; a null has none. ``prefixes``: hashes of so many first bytes too
    (0 for shorter words)."""
    text = pc.fill_null(text, "")
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    _, places, raw = text.buffers()
    n = len(text)
    offsets = np.zeros(n + 1, np.int64)
    if n and places is not None:
        offsets = np.frombuffer(places, kind, n + 1, text.offset * np.dtype(kind).itemsize)
        offsets = offsets.astype(np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    held = memoryview(raw)[first:last] if raw is not None else b""
    data = np.frombuffer(bytes(held).translate(_FOLD if fold else _AS_IS), np.uint8)
    offsets -= first

    inside = ~separators[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    starts[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    hashes, shorter = _hashes(data, start, end, prefixes)
    return Words(data, offsets, row, start, end, hashes, shorter)


def _hashes(data, start, end, prefixes):
    out = np.empty(len(start), np.uint64)
    shorter = {k: np.zeros(len(start), np.uint64) for k in prefixes}
    i = 0
    while i < len(start):
        base = start[i]
        j = max(i + 1, int(np.searchsorted(end, base + (1 << 17), "right")))
        part = data[base : end[j - 1]]
        power, inverse = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * power[: len(part)], out=sums[1:])
        s, e = start[i:j] - base, end[i:j] - base
        before = sums[s]
        out[i:j] = (sums[e] - before) * inverse[s]
        for k, held in shorter.items():
            long = e - s >= k
            held[i:j][long] = (sums[s[long] + k] - before[long]) * inverse[s[long]]
        i = j
    for k, held in shorter.items():
        found = held != 0
        held[found] = mix(held[found] + np.uint64(k << 8))
    return mix(out), shorter


def slabs(batches: Iterator[pa.RecordBatch], size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``size`` bytes in their ``text`` column, one row at least.

    Between batches, freed memory goes back to the system: Spark keeps a worker for later tasks.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index("text"))
        ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
            yield batch.slice(at, to - at)
            at = to
        del batch, text, ends
        give_back()


@functools.lru_cache(1)
def _trim() -> Callable[[int], int] | None:
    """The C library's call that returns free pages, where there is one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if _trim() is not None:
        _trim()(0)


def binaries(parts: list[np.ndarray]) -> pa.Array:
    """One binary value for each array."""
    return pa.array([np.ascontiguousarray(p).tobytes() for p in parts], pa.binary())


def ragged(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Lists of the given sizes, cut from ``values`` in order."""
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def with_text(done: DataFrame, columns: list[str], text: str, length: str | None) -> DataFrame:
    """The columns of ``row`` again, with the new ``text`` and, where it changed, its length."""
    changed = ~F.col("text").eqNullSafe(F.col("row").getField(text))
    new = {text: F.col("text")}
    if length in columns:
        old = F.col("row").getField(length)
        new[length] = F.when(changed, F.length("text")).otherwise(old)
    return done.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in columns])
