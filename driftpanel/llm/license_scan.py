"""License scan: Dice coefficient over word bigrams against licence templates.

The units compared are the lines of a text and, in lines of several sentences, the sentences.
A unit is lower-cased, everything but letters and digits becomes a space, and its distinct word
bigrams are compared with those of each template by ``2 * common / (own + template's)``. A template
is a candidate only if the two counts allow the threshold at all: with threshold t, a count below
t / (2 - t) or above (2 - t) / t of the template's cannot reach it. The best template of a unit wins,
the first by name on ties. Texts and units without any of the words that a match must hold (see ``markers``)
are passed over first. Plain column expressions throughout; nothing is shuffled.

Notices that are wrapped over lines, or are some of the sentences of a line, and whole licence texts
(``WHOLE``) are found in windows of consecutive sentences and pieces of sentences, a line break being
an end of a piece. A text is cut into windows for a template only if it holds ``t / (2 - t)`` of the
template's bigrams at all. A window that could be a match starts and ends with a piece that shares
some; among windows that overlap and match templates of like size (up to twice) the best stays, and
one that is just a unit is the unit's own row. Windows of over twice the words that the bounds allow
(bigrams repeated) are not looked at. Comment marks are no letters, so they do not count.

Edge cases: null, empty and one-word units have no bigrams and match nothing. Repeated rows and
repeated units are reported each.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Licence notices (fixed values).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT license.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


#: Whole licence texts, by file name.
WHOLE = {f"{f.stem}-text": f.read_text() for f in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}


def template_bigrams(text: str) -> list[str]:
    found = re.sub(r"[\W_]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(found, found[1:], strict=False)})


def markers(held: dict[str, list[str]], low: float, taken: list[str] | None = None) -> list[str]:
    """Words of which every match must hold one.

    A match shares at least ``need`` of a template's n bigrams, so of any n - need + 1 of them it
    has one. Words are taken, those in most open templates first, until each template has so many
    bigrams with a taken word. ``taken``: words to start with, which are not returned.
    """
    open_ = {k: (set(v), len(v) - math.ceil(len(v) * low - 1e-9) + 1) for k, v in held.items()}
    open_ = {k: ({g for g in v if not set(taken or []) & set(g.split())}, n) for k, (v, n) in open_.items()}
    open_ = {k: (v, n - len(held[k]) + len(v)) for k, (v, n) in open_.items()}
    open_ = {k: (v, n) for k, (v, n) in open_.items() if n > 0}
    taken = []
    while open_:
        use = Counter(w for grams, _ in open_.values() for g in grams for w in set(g.split()) if len(w) > 3)
        use = use or Counter(w for grams, _ in open_.values() for g in grams for w in set(g.split()))
        word = max(sorted(use), key=lambda w: use[w])
        taken.append(word)
        left = {}
        for k, (grams, demand) in open_.items():
            rest = {g for g in grams if word not in g.split()}
            demand -= len(grams) - len(rest)
            if demand > 0:
                left[k] = (rest, demand)
        open_ = left
    return taken


def units(text: Column) -> Column:
    """Lines, and the sentences of lines that have several."""
    lines = F.split(text, "\n")
    parts = F.flatten(
        F.transform(lines, lambda line: F.array_distinct(F.concat(F.array(line), F.split(line, r"(?<=[.!?])\s+"))))
    )
    return parts


def scan(
    documents: DataFrame,
    templates: dict[str, str] | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per matching unit or window: doc_id, unit (its number among those with a marker; for a
    window, less than 0, that of its first piece), license, dice, matched (its text)."""
    short = templates or TEMPLATES
    whole = {} if templates else WHOLE
    wrapped = windows(documents, short, whole, doc_id, text, threshold)
    held = {k: template_bigrams(v) for k, v in sorted((templates or TEMPLATES).items())}
    held = {k: v for k, v in held.items() if v}
    table = F.array(
        *[
            F.struct(F.lit(-i).alias("order"), F.lit(k).alias("license"), F.array(*map(F.lit, v)).alias("grams"))
            for i, (k, v) in enumerate(held.items())
        ]
    )
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    least, most = min(map(len, held.values())) * low, max(map(len, held.values())) * high
    normal = lambda u: F.trim(F.regexp_replace(F.lower(u), r"[^\p{L}\p{N}]+", " "))
    has_marker = lambda c: F.lower(c).rlike("|".join(markers(held, low)))
    documents = documents.where(has_marker(F.col(text)))
    # Each explode also keeps what it makes from being written out again in later expressions.
    rows = documents.select(
        F.col(doc_id).alias("doc_id"),
        F.posexplode(
            F.transform(F.filter(units(F.col(text)), has_marker), lambda u: F.struct(u.alias("matched"), normal(u).alias("normal")))
        ).alias("unit", "u"),
    )
    rows = rows.select("doc_id", "unit", "u.matched", "u.normal")
    # The number of words bounds the number of distinct bigrams from above.
    spaces = F.length("normal") - F.length(F.translate("normal", " ", ""))
    rows = rows.where(spaces >= least).withColumn("words", F.split("normal", " "))
    grams = F.expr("array_distinct(transform(slice(words, 2, size(words)), (w, i) -> concat(words[i], ' ', w)))")
    rows = rows.select("doc_id", "unit", "matched", F.explode(F.array(grams)).alias("own"))
    rows = rows.where(F.size("own").between(least, most))

    def scored(t: Column) -> Column:
        common = F.size(F.array_intersect(F.col("own"), t["grams"]))
        # Rounded, so that ties are ties.
        dice = F.round(2.0 * common / (F.size("own") + F.size(t["grams"])), 12)
        return F.struct(dice.alias("dice"), t["order"].alias("order"), t["license"].alias("license"))

    fits = F.filter(
        table, lambda t: F.size("own").between(F.size(t["grams"]) * low, F.size(t["grams"]) * high)
    )
    best = F.array_max(F.transform(fits, scored))
    rows = rows.select("doc_id", "unit", "matched", F.explode(F.array(best)).alias("best"))
    rows = rows.where(F.col("best.dice") >= threshold)
    rows = rows.select("doc_id", "unit", "best.license", "best.dice", "matched")
    return rows.unionByName(wrapped)


_PAIRS = "transform(slice({0}, 2, size({0})), (w, i) -> concat({0}[i], ' ', w))"
_NORMAL = "trim(regexp_replace(lower({0}), '[^\\\\p{{L}}\\\\p{{N}}]+', ' '))"
_PIECES = f"""filter(flatten(transform(split(text, '\\n'), (line, l) ->
    transform(split(line, '(?<=[.!?])\\\\s+'), (p, k) -> struct(
        p as raw, l as line, k as part, split({_NORMAL.format("p")}, ' ') as words
    )))), x -> x.words[0] <> '')"""
_SUMS = "aggregate({0}, array(0), (a, x) -> concat(a, array(element_at(a, -1) + {1})))"
#: Bigram p joins words p and p + 1. Equal ones stand side by side once sorted, so each finds the place
#: of the one before it (-1: none); a window from word a holds as many distinct bigrams as it has
#: places whose ``prev`` is less than a.
_SORTED = "array_sort(transform({0}, (g, p) -> struct(g, p)))".format(_PAIRS.format("words"))
_PREVS = """array_sort(transform(sorted, (x, k) -> struct(x.p as p,
    if(k > 0 and get(sorted, k - 1).g = x.g, get(sorted, k - 1).p, -1) as prev,
    get(filter(get(known, cast(pmod(crc32(encode(x.g, 'UTF-8')), {0}) as int)), y -> y.gram = x.g), 0).ids as ids)))"""
#: Bigrams of each piece, the one that joins it with the piece before first.
_BLOCKS = """transform(pieces, (x, k) ->
    slice(prevs, greatest(sums[k], 1), sums[k + 1] - greatest(sums[k], 1)))"""
_HELD = """transform(transform(fits, t -> struct(t, transform(blocks, b ->
    filter(b, x -> array_contains(x.ids, t.order))) as held)), x -> struct(x.t, x.held, {0} as total))""".format(
    _SUMS.format("x.held", "size(x)").replace("(a, x)", "(a, h)").replace("size(x)", "size(h)")
)
#: For each template and first piece the best last piece, the nearest on ties: running counts of distinct
#: bigrams, and of those that the template holds, give the score of every last piece.
_SCORED = """filter(flatten(transform(held, h -> transform(
    filter(sequence(0, size(pieces) - 1), i -> size(h.held[i]) > 0
        and h.total[least(size(pieces), i + h.t.most + 1)] - h.total[i] >= h.t.need),
    i -> transform(array(aggregate(
        transform(
            filter(sequence(i, cast(least(size(pieces) - 1, i + h.t.most) as int)),
                k -> sums[k + 1] - sums[i] - 1 <= h.t.most),
            k -> struct(k,
                size(filter(blocks[k], x -> x.p >= sums[i] and x.prev < sums[i])) as own,
                size(filter(h.held[k], x -> x.p >= sums[i] and x.prev < sums[i])) as common,
                size(h.held[k]) > 0 and sums[k + 1] - sums[i] - 1 >= h.t.need as ends)),
        struct(0 as own, 0 as common, 1.0D as cost, i as j),
        (s, x) -> struct(
            s.own + x.own as own,
            s.common + x.common as common,
            if(x.ends, least(s.cost, round(-2.0D * (s.common + x.common) / (s.own + x.own + h.t.n), 12)), s.cost) as cost,
            if(x.ends and round(-2.0D * (s.common + x.common) / (s.own + x.own + h.t.n), 12) < s.cost, x.k, s.j) as j)
    )), s -> struct(s.cost, s.j - i as more, h.t.order, i, s.j as j, h.t.n, h.t.license))[0]
))), x -> x.cost <= -{0}D)"""
_BEST = """aggregate(slice(scored, 2, size(scored)), slice(scored, 1, 1), (kept, x) -> if(
    exists(kept, k -> k.i <= x.j and x.i <= k.j and greatest(k.n, x.n) <= 2 * least(k.n, x.n)),
    kept, concat(kept, array(x))))"""
#: Lists of known bigrams by the remainder of their checksum.
_LISTS = 1024
#: Whether a window is a unit: one piece, or all pieces of one line.
_UNIT = """best.more = 0 or (pieces[best.i].line = pieces[best.j].line
    and (best.i = 0 or get(pieces, best.i - 1).line <> pieces[best.i].line)
    and (best.j = size(pieces) - 1 or get(pieces, best.j + 1).line <> pieces[best.j].line))"""
_MATCHED = """array_join(transform(slice(pieces, best.i + 1, best.more + 1), (p, k) ->
    concat(if(k = 0, '', if(p.part = 0, '\\n', ' ')), p.raw)), '')"""


def windows(
    documents: DataFrame, short: dict[str, str], whole: dict[str, str], doc_id: str, text: str, threshold: float
) -> DataFrame:
    """The windows that match and are not units; whole texts also in one unit."""
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    held = {k: v for k, v in ((k, template_bigrams(t)) for k, t in sorted((short | whole).items())) if v}
    some = markers({k: v for k, v in held.items() if k in short}, low)
    some += markers(held, low, some)
    table = F.array(
        *[
            F.struct(
                F.lit(i).alias("order"),
                F.lit(k).alias("license"),
                F.array(*map(F.lit, v)).alias("grams"),
                F.lit(math.ceil(len(v) * low - 1e-9)).alias("need"),
                F.lit(math.ceil(2 * len(v) * high)).alias("most"),
                F.lit(len(v)).alias("n"),
            )
            for i, (k, v) in enumerate(held.items())
        ]
    )
    known = sorted({g for v in held.values() for g in v})
    lists: list[list[Column]] = [[] for _ in range(_LISTS)]
    for gram in known:
        ids = F.array(*[F.lit(i) for i, v in enumerate(held.values()) if gram in v])
        lists[zlib.crc32(gram.encode()) % _LISTS].append(F.struct(F.lit(gram).alias("gram"), ids.alias("ids")))
    nothing = F.array().cast("array<struct<gram:string,ids:array<int>>>")
    table_of_known = F.array(*[F.array(*x) if x else nothing for x in lists])
    known = F.array(*map(F.lit, known))
    least = min(math.ceil(len(v) * low - 1e-9) for v in held.values())
    rows = documents.where(F.lower(F.col(text)).rlike("|".join(some)))
    rows = rows.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def step(rows: DataFrame, **made) -> DataFrame:
        # Made by explode, so it is not written out again in later expressions.
        for name, column in made.items():
            column = F.expr(column) if isinstance(column, str) else column
            rows = rows.select("*", F.explode(F.array(column)).alias(name))
        return rows

    rows = step(rows, words=f"split({_NORMAL.format('text')}, ' ')")
    rows = step(rows, hits=F.array_intersect(known, F.expr(_PAIRS.format("words")))).drop("words")
    rows = rows.where(F.size("hits") >= least)
    rows = step(rows, fits=F.filter(table, lambda t: F.size(F.array_intersect(t["grams"], F.col("hits"))) >= t["need"]))
    rows = rows.where(F.size("fits") > 0).select(
        "doc_id", "text", F.transform("fits", lambda t: t.dropFields("grams")).alias("fits")
    )
    rows = step(rows, pieces=_PIECES).drop("text")
    rows = step(rows, sums=_SUMS.format("pieces", "size(x.words)"), words="flatten(pieces.words)")
    rows = step(rows.withColumn("pieces", F.transform("pieces", lambda p: p.dropFields("words"))), sorted=_SORTED).drop("words")
    rows = step(rows.withColumn("known", table_of_known), prevs=_PREVS.format(_LISTS)).drop("sorted", "known")
    rows = step(rows, blocks=_BLOCKS).drop("prevs")
    rows = step(rows, held=_HELD)
    rows = step(rows, scored="array_sort(" + _SCORED.format(threshold) + ")").drop("held", "blocks").where(F.size("scored") > 0)
    rows = rows.select("doc_id", "pieces", F.explode(F.expr(_BEST)).alias("best"))
    rows = rows.where(~F.expr(_UNIT) | F.col("best.license").isin(*whole))
    return rows.select(
        "doc_id",
        (-F.col("best.i") - 1).alias("unit"),
        "best.license",
        (-F.col("best.cost")).alias("dice"),
        F.expr(_MATCHED).alias("matched"),
    )
