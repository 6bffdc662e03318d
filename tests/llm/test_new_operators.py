"""Spelling variants, tiled vectors and hard negatives: SQL, brute force, and every edge case."""

import itertools
import math
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftpanel.llm import hard_negatives, oracle, queries, spelling_variants, vector_dedup

SF = "/root/testdata/sf0.01"


def plain(rows):
    return sorted((tuple(r) for r in rows), key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, duck, name):
    want = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF).select(*columns).collect()
    assert plain(got) == plain(want.fetchall())


# Spelling variants -----------------------------------------------------------------------------


def variants_by_force(rows, least=7, ratio=10):
    count = Counter()
    for doc_id, text in rows:
        for run in spelling_variants.re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            mark = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = mark % len(run)
            count[run[:at] + run[at + 1 :] if mark % 31 == 0 else run] += 1
    count = {w: n for w, n in count.items() if len(w) >= least and n >= 2}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    around = {w: [x for x in count if near(w, x)] for w in count}
    form = {}
    for w, others in around.items():
        best = min(others, key=lambda x: (-count[x], x), default=None)
        form[w] = best if best is not None and count[best] >= ratio * count[w] else None
    out = []
    for w in count:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, count[w], len(around[w]), count.get(form[w])))
    return out


def spelled(spark, rows):
    return spelling_variants.group_spellings(spark.createDataFrame(rows, "doc_id long, text string"))


def test_variants_by_force(spark, monkeypatch):
    """Chains, ties, accents, capitals, long words and cells of three words."""
    rng = np.random.default_rng(5)
    letters = list("abcxyzàéÿÀ×÷")
    base = ["".join(rng.choice(letters, rng.integers(7, 11))) for _ in range(12)] + ["a" * 300, "ab" * 150]
    rows = [(1, None), (2, ""), (None, "seventh seventh Seventh"), (3, "short")]
    for i, word in enumerate(base):
        rows.append((10 + i, " ".join([word] * 300)))
        for j in range(25):
            at, letter = rng.integers(len(word)), rng.choice(letters)
            other = [word[:at] + word[at + 1 :], word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :]][j % 3]
            rows.append((100 + i, f"{other}, " * int(rng.choice([1, 2, 3, 30]))))
    rows.append((999, "alpha beta alphabets alphabetz ALPHABETS alphabetz"))
    rows.append((999, "alpha beta alphabets alphabetz ALPHABETS alphabetz"))
    want = variants_by_force(rows)
    assert plain(spelled(spark, rows).collect()) == plain(want)
    monkeypatch.setattr(spelling_variants, "CELL_WORDS", 3)
    monkeypatch.setattr(spelling_variants, "STRIP", 5)
    assert plain(spelled(spark, rows).collect()) == plain(want)
    assert any(r[1] and r[1] != r[2] for r in want)


def test_variants_without_words(spark):
    rows = [(1, None), (2, ""), (3, "no long word here"), (4, "1234567 ____")]
    assert spelled(spark, rows).collect() == []
    frame = spelled(spark, rows[:0])
    assert frame.columns == ["word", "form", "root", "n", "n_near", "form_n"] and frame.collect() == []


def test_variants_of_one_very_long_text(spark):
    words = ["".join(p) for p in itertools.islice(itertools.product("abcdefgh", repeat=8), 0, 200_000, 7)]
    text = " ".join(words + words)
    df = spark.createDataFrame([(1, text, "x")], "doc_id long, text string, word string").withColumn("n", F.lit(1))
    got = {r.word: r.n_near for r in spelling_variants.group_spellings(df, "doc_id", "text").collect()}
    count = spelling_variants.count_words(df).where("n >= 2").collect()
    assert set(got) == {r.word for r in count} and len(got) > 25_000
    cuts = Counter(w[:i] + "_" + w[i + 1 :] for w in got for i in range(len(w)))
    shorter = Counter(w[:i] + w[i + 1 :] for w in got for i in range(len(w)))
    for w in list(got)[::977]:
        same = sum(cuts[w[:i] + "_" + w[i + 1 :]] - 1 for i in range(len(w)))
        if len(w) == 8 and not any(x in got for x in {w[:i] + w[i + 1 :] for i in range(8)}) and not shorter[w]:
            assert got[w] == same


@pytest.mark.parametrize("a,b,want", [("abcdefg", "abXdefg", True), ("abcdefg", "abcdefgh", True), ("abcdefg", "Xabcdefg", True), ("abcdefg", "abcdegf", False), ("abcdefg", "abcdXfgX", False), ("aaaaaaa", "aaaaaaaa", True)])
def test_one_edit(a, b, want):
    to = lambda s: np.frombuffer(s.encode("latin-1"), np.uint8)[None]
    assert bool(spelling_variants.one_edit(to(a), to(b))[0]) is want


# Vectors ---------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def planted(rng, n=600, dim=24):
    """Random vectors, a hot label, exact copies, chains of near copies, pairs at the threshold."""
    x = rng.normal(size=(n, dim)).astype(np.float32)
    for i in range(0, n, 6):
        x[i + 1] = x[i]
        x[i + 2] = x[i] * np.float32(3)
        x[i + 3] = x[i] + rng.normal(size=dim) * 0.25
        x[i + 4] = x[i + 3] + rng.normal(size=dim) * 0.25
    x[:60] = x[0] + rng.normal(size=(60, dim)) * 0.1
    labels = np.where(rng.random(n) < 0.5, 1, rng.integers(0, 4, n))
    labels[:60] = 2
    return x, labels


def linked_by_force(rows, cosine=0.93):
    def fits(r):
        return r[2] is not None and r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1]) and any(r[1])

    links = [[] for _ in rows]
    unit = [np.array(r[1], float) / np.abs(r[1]).max() if fits(r) else None for r in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = unit[i], unit[j]
        if a is None or b is None or rows[i][2] != rows[j][2] or len(a) != len(b):
            continue
        if a @ b / math.sqrt((a @ a) * (b @ b)) >= cosine:
            links[i].append(j)
            links[j].append(i)
    out = []
    for i in range(len(rows)):
        reach, open_ = {i}, [i]
        while open_:
            for k in links[open_.pop()]:
                if k not in reach:
                    reach.add(k)
                    open_.append(k)
        component = min((rows[k][0] for k in reach if rows[k][0] is not None), default=None)
        out.append((rows[i][0], len(links[i]), component, rows[i][0] == component))
    return out


def test_vectors_by_force(spark, monkeypatch):
    x, labels = planted(np.random.default_rng(3))
    rows = [(i, [float(v) for v in x[i]], int(labels[i])) for i in range(len(x))]
    df = spark.createDataFrame(rows, VECTORS)
    want = plain(linked_by_force(rows))
    assert plain(vector_dedup.near_vectors(df).collect()) == want
    # Tiles of 16 rows, strips of 8: every tile pair of a slab, and both ways through a block.
    monkeypatch.setattr(vector_dedup, "STRIP", 8)
    monkeypatch.setattr(vector_dedup, "TILE_BYTES", 16 * 24 * 8)
    for dense in (0.0, 1.0):
        monkeypatch.setattr(vector_dedup, "DENSE", dense)
        assert plain(vector_dedup.near_vectors(df.repartition(3)).collect()) == want
    duck = duckdb.connect()
    duck.register("embeddings", pa.table({"vec_id": [r[0] for r in rows], "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "label": [r[2] for r in rows]}))
    assert plain(duck.execute(oracle.VECTORS).fetchall()) == want


EDGES = [
    (None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (3, [2.0, 0.1], 1), (4, [1.0, 0.0], 2),
    (5, [0.0, 0.0], 1), (6, None, 1), (7, [1.0, None], 1), (8, [float("nan"), 1.0], 1), (9, [], 1),
    (10, [1.0, 0.0], None), (11, [1.0, 0.0, 0.0], 1), (12, [float("inf"), 1.0], 1), (13, [3e38, 1e30], 1),
    (14, [1e-38, 0.0], 1), (None, [0.0, 1.0], 1), (None, [0.0, 1.0], 1), (15, [1.0], 1), (16, [-1.0], 1),
]


def test_vector_edges(spark):
    extra = ["node", "size", "m1", "low", "dim", "cell", "side", "s1", "n_links", "comp", "row", "x", "tile"]
    df = spark.createDataFrame(EDGES, VECTORS).withColumns({c: F.lit(1) for c in extra})
    rows = vector_dedup.near_vectors(df).collect()
    assert plain((r.vec_id, r.n_links, r.component_id) for r in rows) == plain(r[:3] for r in linked_by_force(EDGES))
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)
    assert vector_dedup.near_vectors(df.limit(0)).collect() == []


def test_hot_near_copies_leave_one_row_per_vector_and_tile(spark):
    rng = np.random.default_rng(8)
    x = 1 + rng.normal(size=(3000, 8)) * 0.05
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], VECTORS)
    rows = vector_dedup.near_vectors(df).collect()
    assert {(r.n_links, r.component_id) for r in rows} == {(2999, 0)} and len(rows) == 3000


# Hard negatives --------------------------------------------------------------------------------


def mined_by_force(rows, every, positives=5, negatives=10):
    used = [r for r in rows if r[2] is not None and r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    whole = [[max(-hard_negatives.LARGEST, min(hard_negatives.LARGEST, math.floor(256 * float(v)))) for v in r[1]] for r in used]
    last = lambda i: (used[i][0] is None, used[i][0] or 0)
    out = []
    for a, row in enumerate(used):
        if row[0] is None or row[0] % every:
            continue
        score = {i: sum(p * q for p, q in zip(whole[a], whole[i], strict=True)) for i in range(len(used)) if len(whole[i]) == len(whole[a])}
        same = sorted((i for i in score if i != a and used[i][2] == row[2]), key=lambda i: (-score[i], last(i)))
        other = sorted((i for i in score if used[i][2] != row[2]), key=lambda i: (-score[i], last(i)))
        for p in same[:positives]:
            inside = [i for i in other if 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out += [(row[0], used[p][0], k, used[i][0], score[p], score[i]) for k, i in enumerate(inside[:negatives], 1)]
    return out


def mined(df, every):
    return hard_negatives.mine(df, F.col("vec_id") % every == 0).collect()


def test_negatives_by_force(spark, monkeypatch):
    x, labels = planted(np.random.default_rng(4), 900, 16)
    x = np.round(x, 1)
    rows = [(i, [float(v) for v in x[i]], int(labels[i])) for i in range(len(x))]
    df = spark.createDataFrame(rows, VECTORS)
    want = plain(mined_by_force([(a, [float(np.float32(v)) for v in b], c) for a, b, c in rows], 50))
    assert plain(mined(df, 50)) == want
    # Small tiles and strips, and thresholds guessed far too high: rounds go down until windows fill.
    monkeypatch.setattr(hard_negatives, "TILE_BYTES", 64 * 16 * 8)
    monkeypatch.setattr(hard_negatives, "STRIP", 32)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4)
    monkeypatch.setattr(hard_negatives, "GENEROUS", (0.01, 0.5))
    for dense in (0.0, 1.0):
        monkeypatch.setattr(hard_negatives, "DENSE", dense)
        assert plain(mined(df.repartition(3), 50)) == want


def test_index_leaves_out_covered_blocks():
    """With a high threshold the tails of light rows are not accumulated, and nothing is lost."""
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(500, 32)) * np.linspace(100, 1, 32))
    order = np.arange(32)
    tile = hard_negatives.Tile(x, np.zeros(500, np.int64), np.arange(500), np.arange(500), order)
    q = x[:20]
    least = np.full((20, 1), 20_000, np.int64)
    most = np.full((20, 1), 1 << 60, np.int64)
    i, _, score, j = tile.answers(q, np.ones(20, np.int64), np.full(20, -1), least, most, False, 1000)
    got = {(int(a), int(tile.rows[b]), int(s)) for a, b, s in zip(i, j, score, strict=True)}
    whole = (q @ x.T).astype(np.int64)
    assert got == {(a, b, int(whole[a, b])) for a, b in zip(*np.nonzero(whole >= 20_000), strict=True)}
    tails = hard_negatives._tails(q, tile.cuts)
    assert ((20_000 / tails).min(axis=0)[-1] > tile.tails[:, -1]).any()


def test_negative_edges(spark):
    rows = [(100 * i, e, c) for i, (_, e, c) in enumerate(EDGES)] + [
        (None, [1.0, 0.5], 1), (None, [0.9, 0.1], 3), (100, [1.0, 0.1], 1), (7, [1.0, 0.2], 3), (8, [1.0, 0.2], 3),
        (9, [0.8, 0.0], 3), (10, [0.5, 0.5], 1), (11, [], 3), (12, [], 1), (200, [-1.0, -1.0], 1), (13, [1e30, 1e30], 3),
    ]
    extra = ["row", "dim", "x", "tile", "cell", "asking", "window", "least", "most", "low", "anchor", "rank", "score"]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(1) for c in extra})
    rounded = [(a, b and [None if v is None else float(np.float32(v)) for v in b], c) for a, b, c in rows]
    assert plain(mined(df, 100)) == plain(mined_by_force(rounded, 100))
    assert mined(df.limit(0), 100) == []
