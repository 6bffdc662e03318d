"""Nulls, empty and very long texts, ties, repeated rows, empty tables, extra columns: every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftpanel.llm import decontaminate, license_scan, link_graph, minhash_dedup, mixing_lm
from driftpanel.llm import piece_codec, quality_rules, queries, secret_scan, substring_dedup, toxicity

LONG = " ".join(f"word{i % 9973}" for i in range(200_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60)) + "."
ROWS = [
    (1, None, None, None, None, "x"),
    (2, "", "en", "s", 0, "x"),
    (3, LONG, "en", "s", len(LONG), "x"),
    (4, "alpha beta gamma delta epsilon zeta", "en", None, 35, None),
    (4, "alpha beta gamma delta epsilon zeta", "en", None, 35, None),
    (5, "alpha beta gamma delta epsilon zeta", None, "s", 35, "x"),
    (None, PASSAGE, "en", "s", len(PASSAGE), "x"),
    (7, "before it " + PASSAGE + " after it", "en", "s", 1, "x"),
    (8, "   \n\t ", "en", "s", 6, "x"),
]
#: Extra columns whose names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string"
EXTRA = ["key", "n", "comp", "row", "score", "starts", "items", "words"]
LABELS = [(1, 1, 0), (2, None, None), (3, 1, 0), (4, 0, 1), (4, 1, 0), (5, 1, 0), (None, 1, 1), (7, 0, 1)]


def extended(df):
    return df.withColumns({c: F.lit(i) for i, c in enumerate(EXTRA)})


@pytest.fixture(scope="module")
def docs(spark):
    return extended(spark.createDataFrame(ROWS, SCHEMA))


@pytest.fixture(scope="module")
def labels(spark):
    return extended(spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"))


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, PASSAGE), (2, None), (3, ""), (None, "zeta"), (4, PASSAGE)]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("number", F.lit(1))


def test_substring_dedup(docs):
    rows = substring_dedup.repeated_paragraphs(docs).collect()
    assert {r.doc_id for r in rows} == {None, 7}
    assert [r.removed for r in sorted(rows, key=lambda r: r.doc_id or -1)] == [False, True]
    assert substring_dedup.repeated_paragraphs(docs.limit(0)).collect() == []


def test_decontamination(docs, benchmark):
    rows = decontaminate.find_overlaps(docs, benchmark).select("row.doc_id", "n_words", "n_hit", "items").collect()
    assert len(rows) == len(ROWS)
    found = {r.doc_id: r for r in rows}
    assert (found[1].n_words, found[1].n_hit, found[1]["items"]) == (0, 0, [])
    assert (found[3].n_words, found[3].n_hit) == (200_000, 0)
    assert (found[7].n_hit, found[7]["items"]) == (60, [1, 4])
    assert (found[4].n_hit, found[4]["items"]) == (1, [])  # the item without an id
    empty = decontaminate.find_overlaps(docs, benchmark.limit(0)).agg(F.sum("n_hit")).first()[0]
    assert empty == 0
    assert decontaminate.find_overlaps(docs.limit(0), benchmark).collect() == []
    cut = decontaminate.cut_spans(decontaminate.find_overlaps(docs, benchmark), docs.columns)
    assert cut.columns == docs.columns
    texts = {r.doc_id: (r.text, r.n_chars) for r in cut.select("doc_id", "text", "n_chars").collect()}
    assert texts[7] == ("before it \n. after it", 21)
    assert texts[3] == (LONG, len(LONG)) and texts[1] == (None, None)


def test_near_duplicates(docs):
    rows = minhash_dedup.near_duplicates(docs).collect()
    found = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in rows)
    assert [f for f in found if f[0] in (4, 5)] == [(4, 2, 4, True), (4, 2, 4, True), (5, 2, 4, False)]
    assert {f[0]: f[1:] for f in found}[1] == (0, 1, True)
    assert {f[0]: f[1:] for f in found}[8] == (0, 8, True)
    assert {f[0]: f[1:] for f in found}[-1][1:] == (7, False)
    assert minhash_dedup.near_duplicates(docs.limit(0)).collect() == []
    kept = minhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [1, 2, 3, 4, 7, 8]


def test_link_graph(spark):
    rows = [
        (1, None, None),
        (2, "no scheme", ""),
        (3, "http://A.Example.ORG/es/x?q", "<a href='//b.net/'>"),
        (3, "http://A.Example.ORG/es/x?q", "<a href='//b.net/'>"),
        (4, "x://b.net", None),
        (5, "http://c.com/fr/#a", "<a href=https://d.net/z>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {c: F.lit(1) for c in ("host", "path", "rule", "mass")}
    )
    found = {r.page_id: r for r in link_graph.judge_urls(pages).collect()}
    assert (found[1].host, found[1].path, found[1].rule, found[1].verdict) == ("", "", None, "allow")
    assert (found[2].host, found[2].path) == ("", "")
    assert (found[3].host, found[3].rule, found[3].verdict) == ("a.example.org", "example.org/es/", "block")
    assert (found[5].path, found[5].rule, found[5].verdict) == ("/fr/", "com/fr/", "allow")
    assert link_graph.judge_urls(pages).count() == len(rows)
    assert link_graph.judge_urls(pages.limit(0)).collect() == []


def test_language_model(docs):
    rows = mixing_lm.score_documents(docs).collect()
    assert len(rows) == len(ROWS)
    found = {r.doc_id: r for r in rows}
    assert (found[1].n_tokens, found[2].n_tokens, found[3].n_tokens) == (1, 1, 200_001)
    assert found[1].score == found[2].score == found[8].score < 0
    assert not found[None].held_out
    assert mixing_lm.score_documents(docs.limit(0)).collect() == []


def test_codec(docs):
    rows = {r.doc_id: r for r in piece_codec.encode_pieces(docs, queries.piece_model()).collect()}
    assert (rows[1].ids, rows[1].n_tokens) == (None, 0) and rows[2].ids == []
    assert all(r.parity and r.round_trip for r in rows.values())
    assert piece_codec.encode_pieces(docs.limit(0), queries.piece_model()).collect() == []


def test_toxicity(docs, labels):
    model = toxicity.learn(docs, labels)
    scored = {r.row.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert scored[1] == scored[2] and all(0 <= s <= 1 for s in scored.values())
    assert toxicity.score(docs.limit(0), toxicity.learn(docs.limit(0), labels)).collect() == []
    assert toxicity.learn(docs, labels.limit(0)).score is not None


def test_secrets(docs):
    rows = secret_scan.find_secrets(docs).collect()
    assert len(rows) == len(ROWS) and all(r.spans == "" and r.base == "" for r in rows)
    assert secret_scan.redact(secret_scan.find_secrets(docs), docs.columns).columns == docs.columns
    assert secret_scan.find_secrets(docs.limit(0)).collect() == []


def test_licenses(docs):
    assert license_scan.scan(docs).collect() == []
    assert license_scan.scan(docs.limit(0)).collect() == []


def test_quality(docs, labels):
    rows = quality_rules.judge(docs, labels).collect()
    assert len(rows) == len(ROWS)
    found = {r.doc_id: r for r in rows}
    assert (found[1].n_words, found[1].base_failed, found[1].kept) == (0, True, False)
    assert (found[3].n_words, found[3].rejected_by) == (200_000, [])
    assert quality_rules.judge(docs.limit(0), labels).collect() == []
    assert quality_rules.judge(docs, labels.limit(0)).count() == len(ROWS)


def test_pipeline_stages(spark, docs, labels, benchmark, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for source in (docs, docs.limit(0)):
        held = source
        for name, stage in corpus_pipeline.STAGES:
            before, held = held, stage(spark, held, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert held.columns == before.columns
        assert held.count() <= source.count()


def test_keep_one_with_its_own_names_as_columns(spark):
    """A documents table whose columns are named as the operator names its own."""
    names = ["keep_id", "keep_key", "keep_rows", "own_key", "own_id", "row", "__key", "tkey", "component", "rep_id", "rep_key"]
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "other words altogether here now")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in names})
    kept = minhash_dedup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.keep_id, r.row) for r in kept.collect()) == [(1, "keep_id", "row"), (3, "keep_id", "row")]
