"""Queries against plain Python on the small tables, and properties of their parts."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from driftpanel.llm import decontaminate, license_scan, link_graph, minhash_dedup, piece_codec
from driftpanel.llm import quality_rules, queries, secret_scan, substring_dedup, toxicity, words

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def white(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text for r in rows}


def by_id(frame):
    return {r.doc_id: r for r in frame.collect()}


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t-9ß ")), max_size=8))
def test_words(texts):
    for table, pattern in (
        (words.WHITE, r"[^\x20\x09-\x0D]+"),
        (words.NOT_ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"),
    ):
        found = words.words(pa.array(texts, pa.string()), table)
        got = [
            (int(r), found.data[a:b].tobytes().decode())
            for r, a, b in zip(found.row, found.start, found.end, strict=True)
        ]
        assert got == [
            (i, w) for i, t in enumerate(texts) for w in re.findall(pattern, (t or "").translate(LOWER))
        ]
        names = {}
        for (_, word), h in zip(got, found.hash.tolist(), strict=True):
            assert names.setdefault(word, h) == h
        assert len(set(names.values())) == len(names)


@settings(max_examples=60)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=120), st.lists(st.integers(1, 4), min_size=1, max_size=4))
def test_fm_index(symbols, phrase):
    sequence = np.array([*symbols, 0], np.int64)
    offset = np.zeros(len(sequence), np.int64)
    for i in range(1, len(sequence)):
        offset[i] = 0 if sequence[i - 1] == 0 else offset[i - 1] + 1
    index = decontaminate.FMIndex(sequence, offset, 5)
    back = np.full((1, 4), -1, np.int64)
    back[0, : len(phrase)] = phrase[::-1]
    low, high = index.search(back)
    want = [i for i in range(len(symbols)) if symbols[i : i + len(phrase)] == phrase]
    assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want


def test_op1_finds_copied_passages(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(5000)]

    def prose(n):
        out = []
        while len(out) < n:
            sentence = rng.choice(vocabulary, rng.integers(4, 20)).tolist()
            sentence[-1] += "."
            out += sentence
        return " ".join(out)

    passages = [prose(60) for _ in range(20)]
    rows = [(i, f"{prose(80)} cut {passages[i % 20]} {prose(80)}") for i in range(60)]
    rows += [(100 + i, prose(200)) for i in range(60)]
    found = substring_dedup.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} == set(range(60))
    spans = defaultdict(list)
    for r in found:
        spans[r.doc_id].append((r.start, r.end))
        assert r.keep_doc == r.doc_id % 20 and r.removed == (r.doc_id >= 20)
        assert rows[r.doc_id][1][r.start : r.end].replace("cut ", "") in passages[r.doc_id % 20]
    covered = sum(e - s for own in spans.values() for s, e in own)
    assert covered > 0.6 * sum(len(passages[i % 20]) for i in range(60))


def test_op1_links_within_hot_buckets():
    base = [f"b{i}" for i in range(40)]
    lists = [[*base[:k], f"x{k}", *base[k + 1 :]] for k in range(30)]
    columns = [np.array([zlib.crc32(w.encode()) for w in own], np.uint32).tobytes() for own in lists]
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array([1] * 30, pa.int64()),
            pa.array([2] * 30, pa.int32()),
            pa.array(range(30), pa.int64()),
            pa.array(range(30), pa.int64()),
            pa.array(columns, pa.binary()),
        ],
        ["cell", "side", "id", "comp", "words"],
    )
    got = {tuple(p.values()) for b in substring_dedup._across(iter([batch])) for p in b.to_pylist()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in lists]
    want = {
        (i, j)
        for i in range(30)
        for j in range(i + 1, 30)
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    }
    assert got == want


def test_op2(spark, texts):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        own = word(r.text)
        for k in range(max(1, len(own) - 9) if own else 0):
            windows[tuple(own[k : k + 10])].add(r.item_id)
    sizes = {len(w) for w in windows}
    got = by_id(queries.op2_benchmark_decontamination(spark, SF))
    for i, text in texts.items():
        own, hit, items = word(text), set(), set()
        for n in sizes:
            for k in range(len(own) - n + 1):
                if tuple(own[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    items |= windows[tuple(own[k : k + n])]
        digest = hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
        row = got[i]
        assert (row.n_words, row.n_hit, row.n_items) == (len(own), len(hit), len(items))
        assert row.items_sha256 == digest and row.contaminated == bool(hit)


def test_op2_in_blocks(spark, monkeypatch):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    columns = ["row.doc_id", "n_hit", "starts", "ends", "items"]
    whole = sorted(map(str, decontaminate.find_overlaps(documents, benchmark).select(*columns).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 3000)
    blocks = sorted(map(str, decontaminate.find_overlaps(documents, benchmark).select(*columns).collect()))
    assert blocks == whole


def components_of(texts, percent=85):
    sets, parent = {}, {}
    for i, t in texts.items():
        own = white((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))) if own else frozenset()

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            holders[s].append(i)
    common = Counter((a, b) for own in holders.values() for k, a in enumerate(own) for b in own[k + 1 :])
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return sets, {i: root(i) for i in sets}


def test_op3(spark, texts):
    sets, comp = components_of(texts)
    for i, row in by_id(queries.op3_minhash_near_dedup(spark, SF)).items():
        assert (row.n_shingles, row.component_id, row.kept) == (len(sets[i]), comp[i], comp[i] == i)


def test_op3_hot_group(spark):
    """Many copies with some words changed: no link is lost and no bucket is listed in pairs."""
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in range(150)]
    texts = {}
    for i in range(400):
        own = list(base)
        for at in rng.choice(150, rng.integers(0, 6), replace=False):
            own[at] = f"e{rng.integers(10**6)}"
        texts[i] = " ".join(own)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = by_id(minhash_dedup.near_duplicates(frame))
    _, comp = components_of(texts)
    assert {i: r.component_id for i, r in got.items()} == comp
    assert 1 < len(set(comp.values())) < 400


def test_bbit_estimate():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.85, 0.95):
        both = rng.integers(0, 2**63, int(2000 * share)).astype(np.uint64)
        rest = rng.integers(0, 2**63, 2000 - len(both)).astype(np.uint64)
        half = len(rest) // 2
        a, b = (np.concatenate([both, r]) for r in (rest[:half], rest[half:]))
        bits = [minhash_dedup.packed(minhash_dedup.minima(x)).view(np.uint64)[None] for x in (a, b)]
        true = len(both) / (len(both) + len(rest))
        assert abs(minhash_dedup.similarity(*bits)[0] - true) < 0.08


def test_op4_ranks(spark):
    """Against dense personalised PageRank."""
    rows = [
        (1, "http://a.org/x", '<a href="http://b.net/"><a href="http://c.net/1"><a href="/own">'),
        (2, "http://b.net/", '<a href="//c.net/">'),
        (3, "http://c.net/", '<a href="http://spam.com/">'),
        (4, "http://spam.com/de/1", '<a href="http://b.net/">'),
        (5, "http://lonely.net/", ""),
        (6, "http://farm.net/", '<a href="http://spam.com/">'),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.host: r for r in link_graph.judge_urls(pages).collect()}
    hosts = ["a.org", "b.net", "c.net", "spam.com", "farm.net"]
    links = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 1), (4, 3)]

    def rank(pairs, seed):
        move = np.zeros((5, 5))
        for a, b in pairs:
            move[b, a] = 1 / sum(x == a for x, _ in pairs)
        mass = seed.copy()
        for _ in range(400):
            went = move @ mass
            mass = 0.85 * went + (0.15 + 0.85 * (1 - went.sum() / seed.sum())) * seed
        return mass

    trust = rank(links, np.array([0.5, 0, 0, 0, 0]))
    distrust = rank([(b, a) for a, b in links], np.array([0, 0, 0, 0.5, 0]))
    for i, host in enumerate(hosts):
        assert got[host].trust == pytest.approx(trust[i], abs=2e-3)
        assert got[host].distrust == pytest.approx(distrust[i], abs=2e-3)
    assert got["farm.net"].verdict == "block" and got["lonely.net"].verdict == "allow"


def test_op4_rules(spark):
    for r in queries.op4_link_graph_urls(spark, SF).collect():
        fits = [
            (len(h + p), h + p, v)
            for h, p, v in link_graph.RULES
            if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)
        ]
        assert r.rule == (max(fits)[1] if fits else None)
        if fits:
            assert r.verdict == max(fits)[2]


def test_op5(spark, texts):
    tokens = {i: [*white((t or "").translate(LOWER)), "\n"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    counts = Counter(t for i, own in tokens.items() if not held[i] for t in own)
    n, v = sum(counts.values()), len(counts)
    got = by_id(queries.op5_context_mixing_lm(spark, SF))
    for i, own in tokens.items():
        row = got[i]
        assert (row.held_out, row.n_tokens, row.train_tokens) == (held[i], len(own), n)
        assert row.n_known == sum(t in counts for t in own)
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)
        assert row.base_score == pytest.approx(base, rel=1e-9)
        assert row.n_bytes == sum(len(t.encode()) + 1 for t in own[:-1]) + 1
    out = [r for i, r in got.items() if held[i]]
    bits = -sum(r.score for r in out) / math.log10(2) / sum(r.n_bytes for r in out)
    assert 1.0 < bits < 3.0


def test_op6(spark, texts):
    import sentencepiece

    checker = sentencepiece.SentencePieceProcessor(model_proto=queries.piece_model())
    encoded = queries.op6_sentencepiece_codec(spark, SF).cache()
    for i, row in by_id(encoded).items():
        assert row.ids == checker.encode(texts[i] or "") and row.parity and row.round_trip
    back = piece_codec.decode_pieces(encoded, queries.piece_model())
    assert {r.row.doc_id: r.text for r in back.collect()} == texts


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab ▁\n\té日🙂<s>/", max_size=40))
def test_op6_any_text(text):
    codec = piece_codec.codec(queries.piece_model())
    row, key, cut = piece_codec._cut_keys(codec, pa.array([text], pa.string()))
    cuts = [cut(i) for i in range(len(key))]
    assert "".join(cuts) == codec.normalise(text)
    ids = [x for own in codec.encode(cuts) for x in own]
    assert ids == codec.checker.encode(text)


def test_op7_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in queries.op7_counterfactual_toxicity(spark, SF).collect()]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)
    judged = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in judged]) > 0.9


def test_op7_swap_penalty():
    """A group's name that only toxic texts mention must not raise a neutral text's score."""
    toxic = [f"filler{i % 7} the muslim neighbour is an idiot row{i}" for i in range(60)]
    clean = [f"filler{i % 7} the christian neighbour is kind row{i}" for i in range(60)]
    texts = toxic + clean
    label = np.array([1.0] * 60 + [0.0] * 60)

    def lists(column):
        row, number = toxicity.features(pa.array(column, pa.string()))
        return [number[row == i].astype(np.int32) for i in range(len(column))]

    other = [toxicity.swapped(t) or "" for t in texts]
    named = np.array([toxicity.swapped(t) is not None for t in texts], float)
    neutral = pa.array(["the muslim neighbour", "the christian neighbour"], pa.string())
    plain = toxicity.fit(label, lists(texts), lists(other), np.zeros(120)).score(neutral)
    fair = toxicity.fit(label, lists(texts), lists(other), named).score(neutral)
    assert abs(fair[0] - fair[1]) < 0.5 * abs(plain[0] - plain[1])


BASE = [
    (0, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    (1, r"AKIA[A-Z0-9]+"),
    (2, r"[0-9a-f]+"),
]


def plain_spans(text):
    found = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text, re.I | re.A if kind == 0 else re.A):
            size = len(m.group(2)) if kind == 0 else m.end() - m.start()
            if size >= (6, 20, 24)[kind]:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def test_op8(spark, texts):
    names = ("assign", "access", "hex")
    for i, row in by_id(queries.op8_assignment_secrets(spark, SF)).items():
        base = plain_spans(texts[i] or "")
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(k == n for _, k, _ in base) for n in range(3))
        joined = [f"{names[k]}:{s}:{e}" for s, k, e in base]
        assert row.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert set(joined) <= set(row.spans.split(","))


@settings(max_examples=150)
@given(st.text(alphabet="tokenTOKENAKIA=: \"'0123456789abcdefß\n", max_size=80))
def test_op8_base_patterns(text):
    assert secret_scan.base_spans(text) == plain_spans(text)


def test_op8_lexer():
    text = 'part = "Zx81kPq02"\nwhole = part + "Lm"\ndb_password = whole\nuser: bob\n"apiKey": "tr55GGh2k0"\nnote: see above'
    assert [text[a:b] for a, b in secret_scan.literals(text)] == ["Zx81kPq02", "Lm", "tr55GGh2k0"]
    assert secret_scan.literals('password = "changeme"\ntoken = ${TOKEN}\ncolour = "Zx81kPq02"') == []


def test_op9(spark, texts):
    templates = {k: set(license_scan.template_bigrams(v)) for k, v in license_scan.TEMPLATES.items()}
    want = []
    for i, text in texts.items():
        for line in (text or "").split("\n"):
            for unit in dict.fromkeys([line, *re.split(r"(?<=[.!?])\s+", line)]):
                own = re.sub(r"[\W_]+", " ", unit.lower()).split()
                grams = {f"{a} {b}" for a, b in zip(own, own[1:], strict=False)}
                best = max(
                    ((2 * len(grams & t) / (len(grams) + len(t)), k) for k, t in templates.items() if grams),
                    default=(0, ""),
                )
                if best[0] >= license_scan.THRESHOLD:
                    want.append((i, best[1], round(best[0], 9), unit))
    got = [(r.doc_id, r.license, round(r.dice, 9), r.matched) for r in queries.op9_license_scan(spark, SF).collect()]
    assert sorted(got) == sorted(want) and want


def test_op9_templates_match_themselves(spark):
    rows = [(i, f"Some prose.\n{v}\nMore prose.") for i, v in enumerate(license_scan.TEMPLATES.values())]
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("dice = 1").collect()
    assert {(r.doc_id, r.license) for r in found} >= set(enumerate(license_scan.TEMPLATES))


def plain_measures(text):
    own = white(text)
    grams = Counter(tuple(own[i : i + 3]) for i in range(len(own) - 2))
    hit = {i + j for i in range(len(own) - 2) if grams[tuple(own[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if white(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(own), sum(map(len, own)), symbols, len(lines) - len(set(lines)), len(hit)


def test_op10(spark, texts):
    got = by_id(queries.op10_quality_rules(spark, SF))
    for i, text in texts.items():
        row, want = got[i], plain_measures(text)
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want
        assert row.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert row.kept == (not row.base_failed and not row.rejected_by)


def test_op10_thresholds(spark):
    """The exact binomial tail decides: against a plain sum, on counts around the limit."""

    def tail(n, k):
        return sum(
            math.exp(
                math.lgamma(n + 1)
                - math.lgamma(j + 1)
                - math.lgamma(n - j + 1)
                + j * math.log(quality_rules.RISK)
                + (n - j) * math.log(1 - quality_rules.RISK)
            )
            for j in range(k + 1)
        )

    import pandas as pd

    good, lost = pd.Series([500, 1000, 3000, 3000, 20]), pd.Series([0, 2, 10, 29, 20])
    got = quality_rules._tail(good, lost)
    for n, k, p in zip(good, lost, got, strict=True):
        assert p == pytest.approx(tail(n, min(k, n)), rel=1e-6)
    rows = [("en", 1, 100, 500, s, 5, 0, 0) for s in [0] * 2990 + [30] * 10]
    kinds = "stratum string, quality int, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
    found = {r.rule: r.cutoff for r in quality_rules.thresholds(spark.createDataFrame(rows, kinds)).collect()}
    tests = sum(len(c) for _, _, c in quality_rules.RULES.values())
    assert tail(3000, 10) <= quality_rules.DELTA / tests and found["symbol_share"] == 0.02


def test_pipeline(spark, texts):
    held = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        held = stage(spark, held, SF).cache()
        kept[name] = {r.doc_id: r for r in held.collect()}
    toxic = {r.doc_id for r in queries.op7_counterfactual_toxicity(spark, SF).where("predicted = 1").collect()}
    assert set(kept["toxicity"]) == set(texts) - toxic
    _, comp = components_of({i: texts[i] for i in kept["toxicity"]})
    assert set(kept["minhash_near_dedup"]) == {i for i, c in comp.items() if i == c}
    dirty = by_id(queries.op2_benchmark_decontamination(spark, SF))
    for i, row in kept["benchmark_decontamination"].items():
        assert (row.text != texts[i]) == dirty[i].contaminated
        assert row.n_chars == (len(row.text) if dirty[i].contaminated else row.n_chars)
    for row in kept["secret_scan"].values():
        assert not plain_spans(row.text or "")
    assert all(r.parity for r in kept["sentencepiece"].values())
    assert corpus_pipeline.run(spark, SF).count() == len(kept["sentencepiece"])
