"""Whole results: what a bound, a cut or a unit must not leave out."""

import textwrap
import time

import numpy as np
import pytest

from driftpanel.llm import license_scan, link_graph, secret_scan, substring_dedup, toxicity


def test_op4_many_seeds(spark):
    """Masses of 5e-5: hosts some links from a seed are reached all the same."""
    chain = [f"n{i}.net" for i in range(6)]
    rows = [(i, f"http://h{i}.com/de/", "") for i in range(20_000)]
    rows += [
        (50_000 + i, f"http://{host}/", f'<a href="http://{to}/">')
        for i, (host, to) in enumerate(zip(chain, [*chain[1:], "h0.com"], strict=True))
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.host: r for r in link_graph.judge_urls(pages).where("page_id >= 50000").collect()}
    assert {found[h].verdict for h in chain} == {"block"}
    masses = [found[h].distrust for h in reversed(chain)]
    assert np.array(masses[1:]) / masses[:-1] == pytest.approx(np.full(5, 0.85), rel=1e-3)


def test_op7_capped_classes(spark, monkeypatch):
    """A bounded sample of equal classes still scores as all labels do."""
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(3000):
        toxic = int(i % 10 == 0)
        sign = "nasty" if rng.random() < (0.7 if toxic else 0.1) else "plain"
        rows.append((i, f"{sign} words of row{i}"))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    scores = lambda: np.array([r.score for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()])
    whole = scores()
    monkeypatch.setattr(toxicity, "FIT_ROWS", 300)
    capped = scores()
    assert abs(whole.mean() - 0.1) < 0.02 and abs(capped.mean() - 0.1) < 0.03
    assert ((whole >= 0.5) == (capped >= 0.5)).mean() > 0.95


KEY = "MIIEpAIBAAKCAQEAx7Zq\nT9vKpL3mW0sYbRkE2dQn"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('API_KEY = (\n    "Zx81kPq02"\n    "Lm44Rt"\n)\nx = "Qw12Er34Ty"', ["Zx81kPq02", "Lm44Rt"]),
        ('password = "Zx81k" +\n  "Pq02Lm"\nother', ["Zx81k", "Pq02Lm"]),
        ('password = "Zx81k"\n  + "Pq02Lm";', ["Zx81k", "Pq02Lm"]),
        ('{\n "password":\n   "Zx81kPq02Lm",\n "user": "Qw12Er34Ty"\n}', ["Zx81kPq02Lm"]),
        ('secret = """Zx81kPq02Lm"""', ["Zx81kPq02Lm"]),
        ('pw = 1\npassword = os.getenv("PW", "Zx81kPq02Lm")', ["Zx81kPq02Lm"]),
        ('token = [\n  "Zx81kPq02Lm",\n  "Yy72jRw13Kn"\n]\nother = ["Qw12Er34Ty"]', ["Zx81kPq02Lm", "Yy72jRw13Kn"]),
        ('password = {"db": "Zx81kPq02Lm"}', ["Zx81kPq02Lm"]),
        ('private_key: |\n  Zx81kPq02Lm\n  Yy72jRw13Kn\nuser: bob', ["Zx81kPq02Lm\n  Yy72jRw13Kn"]),
        (f'PRIVATE_KEY="-----BEGIN KEY-----\n{KEY}\n-----END KEY-----"', [f"-----BEGIN KEY-----\n{KEY}\n-----END KEY-----"]),
        (f"PRIVATE_KEY=-----BEGIN KEY-----\n{KEY}\n-----END KEY-----\n", [f"-----BEGIN KEY-----\n{KEY}\n-----END KEY-----"]),
        ("password:\n  Zx81kPq02Lm\nuser: bob", ["Zx81kPq02Lm"]),
        ('const char *password =\n  "Zx81k"\n  "Pq02Lm";', ["Zx81k", "Pq02Lm"]),
        ('password = "" # none\n"Zx81kPq02Lm" is text', []),
        ('the secret: (see below\n\nsaid "Zx81kPq02Lm" once', []),
        ('secrets:\n  user: bob\nname = "Qw12Er34Ty"', []),
        ('x = dict(password="Zx81kPq02Lm", user="Qw12Er34Ty")', ["Zx81kPq02Lm"]),
    ],
)
def test_op8_values_over_lines(text, want):
    assert [text[a:b] for a, b in secret_scan.literals(text)] == want


def test_op8_linear():
    for text in ("token = (" * 30_000, 'token = "' * 30_000, "a:(\n" * 30_000, "password = [\n" * 20_000 + "]" * 20_000):
        began = time.process_time()
        secret_scan.literals(text)
        assert time.process_time() - began < 5


def test_op9_wrapped(spark):
    marks = ["", "# ", " * ", "// "]
    rows, want = [], set()
    notices = {k: v for k, v in license_scan.TEMPLATES.items() if len(v) > 120}
    for i, (name, notice) in enumerate([*notices.items(), *license_scan.WHOLE.items()]):
        lines = textwrap.wrap(" ".join(notice.split()), 60)
        mark = marks[i % 4]
        rows.append((i, "\n".join([f"{mark}Some prose before it.", *[mark + x for x in lines], f"{mark}And words after."])))
        want.add((i, name))
    rows.append((100, f"Some prose here. {license_scan.WHOLE['MIT'+'-text']} Some more.".replace("\n", " ")))
    rows.append((101, "Prose, and more of it.\nReleased under the MIT License.\nYes"))
    want |= {(100, "MIT-text")}
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r.doc_id, r.license) for r in found if r.dice >= 0.95}
    assert got >= want
    assert [(r.license, r.dice) for r in found if r.doc_id == 101] == [("MIT", 1.0)]


@pytest.mark.parametrize(
    "text",
    [
        "x = y\n" * 100_000,
        "password = abcdefgh1Z\n" * 50_000,
        "key = -----BEGIN RSA-----\n" * 100_000,
        "key = -----BEGIN RSA-----\n-----END foo\n" * 50_000,
        "k = v + " * 150_000,
        "token = token + 'aB3'\n" * 100_000,
        "password = " + "'aB3dEf' + " * 100_000,
        "(" * 500_000 + "]" * 500_000,
        "token = [" * 150_000 + " 'Zx81kPq02Lm' " + "]" * 150_000,
        "[ password = 'Zx81kPq02Lm'\n" * 70_000,
    ],
    ids=["equals", "assign", "begin", "ends", "plus", "grow", "chain", "brackets", "deep", "open"],
)
def test_op8_hostile_texts_take_linear_time(text):
    began = time.process_time()
    secret_scan.literals(text[: len(text) // 4])
    quarter = time.process_time() - began
    began = time.process_time()
    secret_scan.literals(text)
    assert time.process_time() - began < 8 * quarter + 1


def test_op8_constants_of_constants():
    """Sixty doublings: the value is never written out, and its only place is found once."""
    text = "a = 'Zx81kPq02Lm'\n" + "b = a + a\na = b + b\n" * 30 + "password = a\n"
    assert [text[i:j] for i, j in secret_scan.literals(text)] == ["Zx81kPq02Lm"]
    many = "".join(f"c{i} = 'Zx8{i}kPq'\n" for i in range(300))
    many += "password = " + " + ".join(f"c{i}" for i in range(300)) + "\n"
    assert len(secret_scan.literals(many)) == 300


def test_op8_joined_values_score_as_written_in_one():
    for pieces in (["Zx81", "kPq02Lm"], ["ab ", "cd efgh"], [" x1Y", "z2Wq "], ["chan", "geme"], ["${", "ABC}def"], ["a", "b", "c", "dE1", "f2"]):
        value = secret_scan._Value()
        for piece in pieces:
            value = value.join(secret_scan._Value(piece, 0, 1))
        assert value.score() == pytest.approx(secret_scan.value_score("".join(pieces)))


def test_op9_repeated_licences(spark):
    """Twelve copies of one whole text, and three of another, in one document, apart from each other."""
    texts = {k: license_scan.WHOLE[k] for k in ("Apache-2.0-text", "MIT-text")}
    parts = [texts["Apache-2.0-text"]] * 12 + [texts["MIT-text"]] * 3
    text = "\nSome words that are not a licence at all.\n".join(parts)
    found = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    whole = [r for r in found if r.license in texts]
    assert sorted(r.license for r in whole) == ["Apache-2.0-text"] * 12 + ["MIT-text"] * 3
    assert min(r.dice for r in whole) >= 0.99 and len({r.unit for r in whole}) == 15


@pytest.mark.parametrize("kind", ["prose", "lines", "flat"])
def test_op1_recall_of_copied_passages(spark, kind):
    """Passages of 51 to 100 words in prose, in lines of six words, and without any punctuation: nine
    tenths of the words are found (four fifths without punctuation), and nothing far outside of them."""
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(6000)]

    def make(n):
        if kind == "flat":
            return " ".join(rng.choice(vocabulary, n))
        if kind == "lines":
            return "\n" + "\n".join(" ".join(rng.choice(vocabulary, 6)) for _ in range(n // 6)) + "\n"
        out = []
        while len(out) < n:
            out += rng.choice(vocabulary, rng.integers(5, 22)).tolist()
            out[-1] += "."
        return " ".join(out)

    rows, spans = [], []
    for i in range(40):
        passage = make([51, 60, 72, 100][i % 4])
        for k in (0, 1):
            before = make(120)
            rows.append((2 * i + k, f"{before} {passage} {make(120)}"))
            spans.append((len(before) + 1, len(before) + 1 + len(passage)))
    found = [set() for _ in rows]
    for r in substring_dedup.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found[r.doc_id].update(range(r.start, r.end))
    inside = [len(f & set(range(*s))) for f, s in zip(found, spans, strict=True)]
    assert sum(inside) >= (0.8 if kind == "flat" else 0.9) * sum(b - a for a, b in spans)
    assert sum(x > 0 for x in inside) >= 0.95 * len(rows)
    assert sum(map(len, found)) - sum(inside) <= 0.02 * sum(inside)
