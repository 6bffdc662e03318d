"""Quality rules with risk-controlled thresholds.

Every rule rejects a document whose measure passes a cutoff. The cutoffs come from labelled
documents: in each stratum, every cutoff of a rule's grid is tested for rejecting a share of
``RISK`` or more of the good documents. The exact binomial tail is the p-value, Bonferroni over all
strata, rules and cutoffs makes the tests hold together, and the strictest cutoff that passes is
used. A rule without one is not applied in that stratum, so few labels mean few rejections. The
wrongly rejected share is below ``RISK`` for every rule and stratum at confidence ``1 - DELTA``.

Edge cases: null text has no words (all measures 0, failed by the base rule). A null stratum is a
stratum of its own; labels that are null or disagree are left out. Rows that repeat a doc_id are
judged each; labels of an id count once per such row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftpanel.functions.tails import beta_inc
from driftpanel.llm import words
from driftpanel.session import materialize

RISK, DELTA = 0.01, 0.05
LEAST_WORDS, MOST_REPEATED = 50, 50

#: Measure, its cutoffs from the strictest on; a document is rejected above (+1) or below (-1).
RULES = {
    "symbol_share": ("n_symbols / n_words", 1, (0.02, 0.05, 0.1, 0.2, 0.5, 1.0)),
    "repeat_share": ("n_repeat_words / n_words", 1, (0.05, 0.1, 0.2, 0.3, 0.4)),
    "dup_line_share": ("n_dup_lines / greatest(n_lines, 1)", 1, (0.05, 0.1, 0.2, 0.3, 0.5)),
    "long_words": ("word_chars / n_words", 1, (7.0, 8.0, 9.0, 10.0, 12.0, 15.0)),
    "short_words": ("word_chars / n_words", -1, (4.0, 3.5, 3.0, 2.5, 2.0)),
}

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_LINE = np.arange(256) == 0x0A
_ROW = words.constants(1, 31)[0]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for slab in words.slabs(batches):
        text = slab.column(3)
        found = words.words(text, words.WHITE, fold=False)
        lines = words.words(text, _LINE, fold=False)
        rows = found.rows
        count = lambda row: np.bincount(row, minlength=rows).astype(np.int64)
        points = found.code_points()
        chars = np.bincount(found.row, weights=points[found.end] - points[found.start], minlength=rows)
        symbols = np.zeros(len(found.data) + 1, np.int64)
        np.cumsum(_SYMBOL[found.data], out=symbols[1:])
        worded = np.searchsorted(found.start, lines.end) > np.searchsorted(found.start, lines.start)
        row = lines.row[worded]
        own = words.mix(lines.hash[worded] + row.astype(np.uint64) * _ROW)
        _, first = np.unique(own, return_index=True)
        grams, at = found.grams(3)
        grams = words.mix(grams + found.row[at].astype(np.uint64) * _ROW)
        _, inverse, times = np.unique(grams, return_inverse=True, return_counts=True)
        at = at[times[inverse] > 1]
        repeated = np.zeros(len(found.hash), bool)
        for k in range(3):
            repeated[at + k] = True
        values = [
            count(found.row),
            chars.astype(np.int64),
            symbols[found.offsets[1:]] - symbols[found.offsets[:-1]],
            count(row),
            count(row) - count(row[first]),
            count(found.row[repeated]),
        ]
        yield pa.RecordBatch.from_arrays([*slab.columns[:3], *map(pa.array, values)], _COLUMNS)


_COLUMNS = [
    "doc_id", "stratum", "quality", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
]


def _tail(good: pd.Series, lost: pd.Series) -> pd.Series:
    """Chance of so few rejections of good documents if the true share were ``RISK``."""
    values = [
        1.0 if k >= n else float(beta_inc(n - k, k + 1, 1 - RISK))
        for n, k in zip(good, lost, strict=True)
    ]
    return pd.Series(values, dtype="float64")


def _rejects(measure: str, sign: int, cutoff) -> F.Column:
    value = F.expr(measure)
    return value > cutoff if sign > 0 else value < cutoff


def thresholds(measured: DataFrame) -> DataFrame:
    """``(stratum, rule, cutoff)`` of the rules that can be certified."""
    good = measured.where("quality = 1 and n_words > 0")
    sums = []
    for name, (measure, sign, cutoffs) in RULES.items():
        for i, cutoff in enumerate(cutoffs):
            sums.append(F.sum(_rejects(measure, sign, F.lit(cutoff)).cast("long")).alias(f"{name}_{i}"))
    counts = good.groupBy("stratum").agg(F.count(F.lit(1)).alias("good"), *sums)
    tests = [
        F.struct(
            F.lit(name).alias("rule"),
            F.lit(i).alias("strictness"),
            F.lit(float(cutoff)).alias("cutoff"),
            F.col(f"{name}_{i}").alias("lost"),
        )
        for name, (_, _, cutoffs) in RULES.items()
        for i, cutoff in enumerate(cutoffs)
    ]
    counts = counts.select("stratum", "good", F.explode(F.array(*tests)).alias("t")).select("stratum", "good", "t.*")
    counts = materialize(counts, "risk-counts")
    number = counts.count() or 1
    tail = F.pandas_udf(_tail, "double")
    passed = counts.where(tail("good", "lost") <= DELTA / number)
    best = passed.groupBy("stratum", "rule").agg(F.min(F.struct("strictness", "cutoff")).alias("best"))
    return best.select("stratum", "rule", F.col("best.cutoff").alias("cutoff"))


def judge(
    documents: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    quality: str = "quality",
) -> DataFrame:
    """Per document: doc_id, stratum, the measures, base_failed, rejected_by, kept."""
    own = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(quality).cast("int").alias("quality"))
    own = own.where("quality is not null").groupBy("doc_id")
    own = own.agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    own = own.where("quality = most").select(F.col("doc_id").alias("own"), "quality")
    rows = documents.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(stratum).cast("string").alias("stratum"),
        F.lit(None).cast("int").alias("quality"),
        F.col(text).alias("text"),
    )
    kinds = "doc_id long, stratum string, quality int, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
    measured = rows.mapInArrow(_measured, kinds).drop("quality")
    measured = materialize(measured.join(own, F.col("doc_id") == F.col("own"), "left").drop("own"), "measures")
    cutoffs = thresholds(measured).groupBy("stratum").agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs")
    )
    cutoffs = cutoffs.withColumnRenamed("stratum", "of")
    judged = measured.join(cutoffs, F.col("stratum").eqNullSafe(F.col("of")), "left")
    failing = [
        F.when(_rejects(measure, sign, F.col("cutoffs").getItem(name)), F.lit(name))
        for name, (measure, sign, _) in RULES.items()
    ]
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rejected = F.when(F.col("n_words") > 0, F.array_compact(F.array(*failing)))
    judged = judged.withColumn("rejected_by", F.coalesce(rejected, F.array().cast("array<string>")))
    judged = judged.withColumn("base_failed", base)
    kept = ~F.col("base_failed") & (F.size("rejected_by") == 0)
    return judged.withColumn("kept", kept).drop("cutoffs", "of", "quality")
