"""SentencePiece encoding and decoding with the tokenizers library.

The model file's protobuf is parsed here: pieces with scores and kinds, the trainer's model kind
and byte fallback, the normaliser's character map, dummy prefix and white-space rules. From these a
tokenizer is rebuilt: BPE merges ordered by score, or unigram scores; byte fallback; metaspace
marker. Texts are normalised, marked and cut before each run of spaces; no piece of the model
crosses such a place (a model with one that does is not cut), so the pieces of a text are those of
its cuts in order. Each task encodes, decodes and compares every distinct cut once, in batches on
several threads, and puts the texts together from them. ``parity`` tells whether the sentencepiece
library gives the same ids for all cuts of the text, ``round_trip`` whether the decoded ids are the
text again.

Edge cases: null gives null ids and 0 tokens, the empty text gives no ids; both count as equal.
A text that itself holds the marker decodes to a space there and is no round trip. Special pieces'
names inside texts are ordinary text. The model's bytes travel with the task.
"""

from __future__ import annotations

import functools
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftpanel.llm import words

MARK = "▁"
#: Kinds of pieces and of models in the protobuf (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Distinct cuts that a task remembers.
CACHE = 500_000
THREADS = 2


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, varint()
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            yield tag >> 3, data[at : at + size]
            at += size
        elif wire == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            raise ValueError(f"wire type {wire}")


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unknown: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim_spaces: bool = True
    escape_spaces: bool = True


def parse_model(data: bytes) -> Model:
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            score = struct.unpack("<f", own.get(2, bytes(4)))[0]
            model.pieces.append((own.get(1, b"").decode(), score, own.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
            model.kind = trainer.get(3, UNIGRAM)
            model.byte_fallback = bool(trainer.get(35, 0))
        elif number == 3:
            rules = dict(_fields(value))
            model.charsmap = rules.get(2, b"")
            model.dummy_prefix = bool(rules.get(3, 1))
            model.trim_spaces = bool(rules.get(4, 1))
            model.escape_spaces = bool(rules.get(5, 1))
    model.unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), 0)
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that join to a piece, best score first."""
    number = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    found = []
    for piece, score, kind in model.pieces:
        if kind == NORMAL:
            for k in range(1, len(piece)):
                a, b = piece[:k], piece[k:]
                if a in number and b in number:
                    found.append((-score, number[a], number[b], a, b))
    # Stable, so that pairs of one piece follow the order of their parts.
    return [(a, b) for *_, a, b in sorted(found, key=lambda x: x[:3])]


class Codec:
    def __init__(self, data: bytes):
        import sentencepiece
        import tokenizers
        from tokenizers import decoders, models, normalizers

        self.model = model = parse_model(data)
        if any(kind == USER_DEFINED for *_, kind in model.pieces):
            raise ValueError("user-defined pieces are not supported")
        if not model.escape_spaces or model.kind not in (UNIGRAM, BPE):
            raise ValueError("only BPE and unigram models with escaped spaces are supported")
        names = [p for p, *_ in model.pieces]
        if model.kind == BPE:
            core = models.BPE(
                {p: i for i, p in enumerate(names)},
                merges(model),
                unk_token=names[model.unknown],
                fuse_unk=True,
                byte_fallback=model.byte_fallback,
            )
        else:
            core = models.Unigram(
                [(p, s) for p, s, _ in model.pieces], model.unknown, model.byte_fallback
            )
        self.tokenizer = tokenizers.Tokenizer(core)
        steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        self.tokenizer.decoder = decoders.Sequence(steps)
        self.charsmap = normalizers.Precompiled(model.charsmap) if model.charsmap else None
        self.separable = not any(re.search(f"[^{MARK}]{MARK}", p) for p in names)
        self.checker = sentencepiece.SentencePieceProcessor(model_proto=data)

    def clean(self, text: str) -> str:
        if self.charsmap is not None:
            text = self.charsmap.normalize_str(text)
        return re.sub(" +", " ", text.strip(" ")) if self.model.trim_spaces else text

    def normalise(self, text: str) -> str:
        text = self.clean(text).replace(" ", MARK)
        return MARK + text if self.model.dummy_prefix and text else text

    def encode(self, normal: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(normal, add_special_tokens=False)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts with the marker of the dummy prefix still in front."""
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)

    def plain(self, decoded: str) -> str:
        return decoded[1:] if self.model.dummy_prefix and decoded[:1] == " " else decoded

    def checked(self, normal: list[str]) -> list[list[int]]:
        """What the sentencepiece library gives for normalised cuts."""
        plain = [n.replace(MARK, " ") for n in normal]
        if not self.model.dummy_prefix:
            return self.checker.encode(plain, num_threads=1)
        # The library puts the marker before the text again; a lone one has to follow a letter.
        lone = self.checker.encode("a ")[len(self.checker.encode("a")) :]
        found = self.checker.encode([p[1:] for p in plain], num_threads=1)
        return [lone if p == " " else f for p, f in zip(plain, found, strict=True)]


@functools.lru_cache(1)
def codec(data: bytes) -> Codec:
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
    return Codec(data)


#: Ordinary cuts that are encoded as one text.
JOINED = 500
#: Texts that are encoded in one call; their pieces are held as objects until it ends.
AT_ONCE = 64


class _Cuts:
    """Distinct cuts, by key, with their ids."""

    def __init__(self, own: Codec):
        self.own = own
        self.key = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.ids, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.same, self.back = np.zeros(0, bool), np.zeros(0, bool)
        self.opens = np.array([p.startswith(MARK) for p, *_ in own.model.pieces])

    def missing(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.ones(len(keys), bool)
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        return self.key[at] != keys

    def number(self, keys: np.ndarray) -> np.ndarray:
        return self.place[np.searchsorted(self.key, keys)]

    def add(self, keys: np.ndarray, cuts: list[str]) -> None:
        # A cut of one marker and a word starts at the only piece that opens with the marker, so
        # many of them are encoded as one text.
        plain = np.array([c[:1] == MARK and c.count(MARK) == 1 and len(c) > 1 for c in cuts], bool)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        cuts = [cuts[i] for i in order]
        count = int(plain.sum()) if self.own.separable else 0
        texts = ["".join(cuts[i : min(i + JOINED, count)]) for i in range(0, count, JOINED)]
        groups = [min(JOINED, count - i) for i in range(0, count, JOINED)] + [1] * (len(cuts) - count)
        texts += cuts[count:]
        flats, sizes, same, back = [], [], [], []
        for i in range(0, len(texts), AT_ONCE):
            part = texts[i : i + AT_ONCE]
            ids = self.own.encode(part)
            same += [a == b for a, b in zip(ids, self.own.checked(part), strict=True)]
            back += [a == t.replace(MARK, " ") for a, t in zip(self.own.decode(ids), part, strict=True)]
            flats.append(np.fromiter((x for one in ids for x in one), np.int32))
            sizes += [len(one) for one in ids]
        flat = np.concatenate([*flats, np.zeros(0, np.int32)])
        lengths = np.array(sizes, np.int64)
        opens = np.zeros(len(flat), bool)
        opens[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        grouped = np.repeat(np.array(groups) > 1, lengths)
        opens |= grouped & self.opens[flat]
        if len(cuts) != int(opens.sum()):
            raise ValueError("a cut has no piece of its own")
        sizes = np.diff(np.append(np.flatnonzero(opens), len(flat)))
        self.place = np.append(self.place, order.argsort() + len(self.size))
        self.key = np.append(self.key, keys)
        by = np.argsort(self.key, kind="stable")
        self.key, self.place = self.key[by], self.place[by]
        self.size = np.append(self.size, sizes)
        self.ids = np.append(self.ids, flat)
        self.same = np.append(self.same, np.repeat(np.array(same, bool), groups))
        self.back = np.append(self.back, np.repeat(np.array(back, bool), groups))


_GAP = words.constants(2, 21)
_SPACE = np.arange(256) == 0x20


def _cut_keys(own: Codec, text: pa.Array) -> tuple[np.ndarray, np.ndarray, callable]:
    """Row and key of every cut of the column, and what gives a cut's string."""
    prefix = int(own.model.dummy_prefix)
    text = pc.replace_substring(text, MARK, " ")  # the same after normalising
    if not own.separable:
        whole = words.words(text, np.zeros(256, bool), fold=False)
        return whole.row, whole.hash, lambda i: own.normalise(text[int(whole.row[i])].as_py())
    found = words.words(text, _SPACE, fold=False)
    first = np.ones(len(found.start), bool)
    first[1:] = found.row[1:] != found.row[:-1]
    before = np.concatenate([[0], found.end[:-1]])[: len(found.start)]
    gap = found.start - np.where(first, found.offsets[found.row], before) + first * prefix
    bounds = found.bounds()
    rows = np.flatnonzero(np.diff(found.offsets) > 0)
    none = bounds[rows] == bounds[rows + 1]
    ends = np.append(found.end, 0)[bounds[rows + 1] - 1]
    rest = found.offsets[rows + 1] - np.where(none, found.offsets[rows], ends) + none * prefix
    rows, rest = rows[rest > 0], rest[rest > 0]
    at = bounds[rows + 1]  # runs of spaces at the end of a row
    key = words.mix(found.hash + gap.astype(np.uint64) * _GAP[0])
    key = np.insert(key, at, words.mix(rest.astype(np.uint64) * _GAP[1]))
    row = np.insert(found.row, at, rows)
    gap = np.insert(gap, at, rest)
    start, end = np.insert(found.start, at, 0), np.insert(found.end, at, 0)

    def cut(i: int) -> str:
        return MARK * int(gap[i]) + found.data[start[i] : end[i]].tobytes().decode()

    return row, key, cut


def encode_pieces(documents: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, ids, n_tokens, parity, round_trip."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        known = _Cuts(own)
        for slab in words.slabs(batches, 2 << 20):
            texts = slab.column(1)
            rows = len(texts)
            if own.model.trim_spaces or own.charsmap is not None:
                texts = pa.array([own.clean(t) if t else t for t in texts.to_pylist()], pa.string())
            row, key, cut = _cut_keys(own, texts)
            if len(known.key) > CACHE:
                known = _Cuts(own)
            distinct, first = np.unique(key, return_index=True)
            new = known.missing(distinct)
            if new.any():
                known.add(distinct[new], [cut(i) for i in first[new]])
            number = known.number(key)
            size = known.size[number]
            begins = np.cumsum(known.size) - known.size
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            ids = known.ids[np.repeat(begins[number] - (ends - size), size) + np.arange(total)]
            tokens = np.bincount(row, weights=size, minlength=rows).astype(np.int64)
            differ = np.bincount(row, weights=~known.same[number], minlength=rows)
            lost = np.bincount(row, weights=~known.back[number], minlength=rows) > 0
            marked = pc.fill_null(pc.match_substring(texts, MARK), False).to_numpy(zero_copy_only=False)
            changed = ~pc.fill_null(pc.equal(texts, slab.column(1)), True).to_numpy(zero_copy_only=False)
            lists = words.ragged(ids, tokens, pa.int32())
            if texts.null_count:
                empty = pc.is_null(texts).to_pylist()
                lists = pa.array([None if e else x for e, x in zip(empty, lists.to_pylist(), strict=True)], lists.type)
            yield pa.RecordBatch.from_arrays(
                [slab.column(0), lists, pa.array(tokens), pa.array(differ == 0), pa.array(~(lost | marked | changed))],
                ["doc_id", "ids", "n_tokens", "parity", "round_trip"],
            )

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(
        task, "doc_id long, ids array<int>, n_tokens long, parity boolean, round_trip boolean"
    )


def decode_pieces(encoded: DataFrame, model: bytes, ids: str = "ids") -> DataFrame:
    """``encoded`` with the decoded ``text`` beside its columns (as ``row``); null ids give null."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                values = part.column(1).to_pylist()
                texts = own.decode([v or [] for v in values])
                texts = [None if v is None else own.plain(t) for v, t in zip(values, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["row", "text"])

    rows = encoded.select(F.struct(*encoded.columns).alias("row"), F.col(ids).alias("ids"))
    return rows.mapInArrow(task, rows.select("row").schema.add("text", "string"))
