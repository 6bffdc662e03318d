"""Toxicity by a counterfactually regularised linear classifier.

Features of a text are hashed: its distinct words and the first bytes of its words, so that forms
of one stem share a feature. A logistic model is fitted on labelled texts; for a text that names a
group, the same text with the group's name swapped for another one is scored too, and the squared
difference of the two scores is a penalty of strength ``SWAP_PENALTY``. So a group's name alone
cannot raise a score, and neutral mentions are left alone.

The model is fitted on a bounded sample: of each class at most ``FIT_ROWS / 2`` labelled training
rows, the ones with the smallest hashes of their ids, however many there are. What reaches the
driver is their hashed features. Scoring covers every whole text, in tasks, with the fitted table of
``2 ** BITS`` weights.

Edge cases: null and empty texts get the score of a text without features. Labels that are null or
disagree are left out; without labels of both classes every score is the share of toxic labels (0
without any). Rows that repeat a doc_id are scored each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftpanel.llm import words

BITS = 20
PREFIXES = (4, 5, 7)
FIT_ROWS = 8_000
SWAP_PENALTY = 2.0
#: A feature is used if the fitting rows show it in so many texts and with so large a chi-square.
LEAST_TEXTS, LEAST_CHI2 = 4, 15.0
ROUNDS, RIDGE = 300, 1e-4

#: Names of groups, each followed by the name it is swapped with (fixed values).
IDENTITY = [
    ("women", "men"), ("woman", "man"), ("girl", "boy"), ("female", "male"), ("she", "he"),
    ("muslim", "christian"), ("muslims", "christians"), ("jewish", "buddhist"), ("hindu", "atheist"),
    ("black", "white"), ("african", "european"), ("asian", "american"), ("gay", "straight"),
    ("lesbian", "heterosexual"), ("transgender", "cisgender"), ("immigrant", "citizen"),
    ("immigrants", "citizens"), ("disabled", "able"), ("old", "young"),
]
SWAP = {a: b for x, y in IDENTITY for a, b in ((x, y), (y, x))}
_NAMED = re.compile(r"\b(" + "|".join(sorted(SWAP, key=len, reverse=True)) + r")\b", re.IGNORECASE)


def swapped(text: str) -> str | None:
    """The text with every group's name swapped; None if it names none."""
    new, count = _NAMED.subn(lambda m: SWAP[m.group().lower()], text)
    return new if count else None


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature number of every distinct feature of each text."""
    found = words.words(text, words.NOT_ALNUM, prefixes=PREFIXES)
    rows, hashes = [found.row], [found.hash]
    for held in found.prefix.values():
        there = held != 0
        rows.append(found.row[there])
        hashes.append(held[there])
    key = (np.concatenate(rows).astype(np.uint64) << np.uint64(BITS)) | (
        np.concatenate(hashes) >> np.uint64(64 - BITS)
    )
    key = np.unique(key)
    return (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for slab in words.slabs(batches):
        texts = slab.column(1).to_pylist()
        other = [swapped(t or "") for t in texts]
        lists = []
        for column in (slab.column(1), pa.array(other, pa.string())):
            row, number = features(column)
            lists.append(words.ragged(number.astype(np.int32), np.bincount(row, minlength=len(texts)), pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [slab.column(0), lists[0], lists[1], pa.array([o is not None for o in other])],
            ["label", "own", "other", "named"],
        )


class Classifier:
    """Weights by feature number and a constant."""

    def __init__(self, weights: np.ndarray, constant: float):
        self.weights, self.constant = weights.astype(np.float32), float(constant)

    def score(self, text: pa.Array) -> np.ndarray:
        row, number = features(text)
        total = np.bincount(row, weights=self.weights[number], minlength=len(text)) + self.constant
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(
    label: np.ndarray,
    own: list[np.ndarray],
    other: list[np.ndarray],
    named: np.ndarray,
    stands_for: np.ndarray | None = None,
) -> Classifier:
    """Gradient descent with momentum on the weighted log loss plus the swap penalty; stands_for:
    how many rows each one weighs, by default one."""
    weights = np.zeros(1 << BITS)
    stands_for = np.ones(len(label)) if stands_for is None else stands_for
    positive = int(label.sum())
    if not 0 < positive < len(label):
        share = min(max(positive / max(len(label), 1), 1e-6), 1 - 1e-6)
        return Classifier(weights, np.log(share / (1 - share)))

    def flat(lists):
        sizes = np.array([len(x) for x in lists])
        return np.repeat(np.arange(len(lists)), sizes), np.concatenate([*lists, np.zeros(0, np.int32)])

    row, number = flat(own)
    times = np.bincount(number, minlength=1 << BITS).astype(float)
    toxic = np.bincount(number[label[row] == 1], minlength=1 << BITS).astype(float)
    rate, n = positive / len(label), len(label)
    expected = times * rate
    with np.errstate(divide="ignore", invalid="ignore"):
        chi2 = (toxic - expected) ** 2 / (expected * (1 - rate) * (1 - times / n))
    used = np.flatnonzero((times >= LEAST_TEXTS) & (np.nan_to_num(chi2, posinf=1e9) >= LEAST_CHI2))
    # The largest arrays of the fit; they must not stand beside those of the next lines.
    del row, number, times, toxic, expected, chi2
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used))

    def kept(lists):
        r, k = flat(lists)
        k = place[k]
        return r[k >= 0], k[k >= 0]

    row, number = kept(own)
    swap_row, swap_number = kept([o if m else s for o, s, m in zip(other, own, named, strict=True)])
    # Both classes weigh as in the labels, so 0.5 is the point of equal odds. Which features are used
    # is a test of the sampled rows as they are.
    weight = stands_for / stands_for.sum()
    rate = weight @ label
    w, b = np.zeros(len(used)), np.log(rate / (1 - rate))
    speed_w, speed_b = np.zeros(len(used)), 0.0
    square_w, square_b = np.full(len(used), 1e-8), 1e-8
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, ROUNDS + 1):
        z = np.bincount(row, weights=w[number], minlength=n) + b
        zs = np.bincount(swap_row, weights=w[swap_number], minlength=n) + b
        p, ps = sigmoid(z), sigmoid(zs)
        gap = 2 * SWAP_PENALTY * (p - ps) * named
        g = (p - label + gap * p * (1 - p)) * weight
        gs = -gap * ps * (1 - ps) * weight
        slope = np.bincount(number, weights=g[row], minlength=len(used)) + RIDGE * w
        slope += np.bincount(swap_number, weights=gs[swap_row], minlength=len(used))
        slope_b = g.sum() + gs.sum()
        # Adam steps.
        speed_w, speed_b = 0.9 * speed_w + 0.1 * slope, 0.9 * speed_b + 0.1 * slope_b
        square_w, square_b = 0.99 * square_w + 0.01 * slope**2, 0.99 * square_b + 0.01 * slope_b**2
        rate_m, rate_s = 1 - 0.9**step, 1 - 0.99**step
        w -= 0.05 * (speed_w / rate_m) / (np.sqrt(square_w / rate_s) + 1e-8)
        b -= 0.05 * (speed_b / rate_m) / (np.sqrt(square_b / rate_s) + 1e-8)
    weights[used] = w
    return Classifier(weights, b)


def is_held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def learn(
    documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic"
) -> Classifier:
    """Fit on labelled rows that are not held out."""
    own = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    own = own.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id")
    own = own.agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most")
    own = own.where(~is_held_out()).select("doc_id", "label")
    # At most FIT_ROWS rows of two numbers, so the broadcast is bounded.
    sample = [
        own.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS // 2)
        for k in (0, 1)
    ]
    count = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}  # two rows at most
    sample = F.broadcast(sample[0].unionByName(sample[1]).withColumnRenamed("doc_id", "of"))
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.join(sample, F.col("doc_id") == F.col("of")).select("label", "text", "doc_id")
    held = rows.mapInArrow(_featured, "label int, own array<int>, other array<int>, named boolean")
    # Rows that repeat an id could make it more; the bound holds for them too.
    held = held.limit(2 * FIT_ROWS).toArrow().combine_chunks()
    if not held.num_rows:
        return Classifier(np.zeros(1 << BITS), -30.0)
    take = lambda name: [x.values.to_numpy() for x in held.column(name).combine_chunks()]
    label = held.column("label").to_numpy().astype(float)
    share = [max(1.0, count.get(k, 0) / (FIT_ROWS // 2)) for k in (0, 1)]
    named = held.column("named").to_numpy().astype(float)
    model = fit(label, take("own"), take("other"), named, np.where(label == 1, share[1], share[0]))
    del held
    words.give_back()
    return model


def score(documents: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """Per document: ``row`` (all its columns) and ``score``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in words.slabs(batches):
            yield pa.RecordBatch.from_arrays(
                [slab.column(0), pa.array(model.score(slab.column(1)))], ["row", "score"]
            )

    rows = documents.select(F.struct(*documents.columns).alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(task, rows.select("row").schema.add("score", "double"))
