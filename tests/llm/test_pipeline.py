"""The pipeline on a small corpus."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

DOC = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def prose(seed, letters, words=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(words))


def test_stages_keep_clean_documents_and_take_effect(spark, tables):
    rows = []
    for k in range(200):
        lang = "en" if k % 2 else "fr"
        mail = f" ab.c{k}@bad.example.com" if k % 5 == 0 else ""
        rows.append((k, prose(k, "abcdefg" if k % 2 else "mnopqré") + mail, lang))
    rows += [(1000 + k, " ".join(f"{w}###" for w in prose(k, "abcdefg").split()), "en") for k in range(100)]
    rows += [(2000, rows[1][1], "en"), (2001, rows[3][1] + " extra", "en"), (2002, None, "en"), (2003, "", "en"), (2004, prose(7777, "abcdefg") + " ab.de@bad.example.com", "en")]
    full = [(i, t, la, "s", len(t or ""), "mine") for i, t, la in rows]
    sf = tables("documents", full, DOC)
    tables("labels", [(i, int(i < 1000), 0) for i, _, _ in rows if i < 2000], "doc_id long, quality int, toxic int")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), DOC)
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    assert sum(k < 200 for k in seen["quality rules"]) >= 195
    assert not any(1000 <= k < 1100 or k in (2002, 2003) for k in seen["quality rules"])
    assert len(seen["language ID"]) >= len(seen["quality rules"]) - 3
    assert 2000 not in seen["n-gram Jaccard join"] and 2001 not in seen["n-gram Jaccard join"] and 1 in seen["n-gram Jaccard join"]
    assert "ab.de@" not in seen["PII"][2004]["text"] and seen["PII"][1]["text"] == rows[1][1]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in packed} == set(seen["PII"])
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()} == set(seen["PII"])


def test_near_copies_lose_no_text(spark, tmp_path):
    a, b, c = prose(1, "abcdefg"), prose(2, "hijklmn"), prose(3, "opqrstu")
    rows = [(5, a, "en", "s", 1, "k"), (5, b, "en", "s", 1, "k"), (5, b, "fr", "t", 1, "k"), (9, a + " more", "en", "s", 1, "k"), (None, c, "en", "s", 1, "k"), (None, c, "en", "s", 1, "k"), (3, c + " end", "en", "s", 1, "k"), (8, None, "en", "s", 1, "k"), (8, None, "en", "s", 1, "k"), (6, "", "en", "s", 1, "k")]
    docs = spark.createDataFrame(rows, DOC)
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_copies(spark, docs, "").collect()), key=str)
    assert got == sorted([(5, a), (5, b), (3, c + " end"), (8, None), (8, None), (6, "")], key=str)


def test_the_key_of_the_pseudonyms_is_the_callers(spark):
    docs = spark.createDataFrame([(1, "write to ann.lee@mail.com", "en", "s", 25, "k"), (2, None, "en", "s", 0, "k")], DOC)
    text = lambda key: {r["doc_id"]: r["text"] for r in corpus_pipeline.pseudonyms(spark, docs, "", key).collect()}
    assert text(b"one") != text(b"two") and text(None)[2] is None
    spark.conf.set(corpus_pipeline.KEY, "one")
    try:
        assert text(None) == text(b"one")
    finally:
        spark.conf.unset(corpus_pipeline.KEY)


def test_stages_of_empty_and_odd_tables(spark, tables):
    odd = DOC + ", n_words string, score double, label long, `a.b` int"
    sf = tables("labels", [(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    rows = [(1, prose(1, "abcdefg"), "en", "s", 9, "k", "w", 0.5, 7, 3), (None, None, None, None, None, None, None, None, None, None), (2, "", None, "s", 0, "k", "w", 0.5, 7, 3), (3, "one word " * 30_000, "en", None, 9, "k", "w", 0.5, 7, 3)]
    for some in ([], rows):
        docs = spark.createDataFrame(some, odd)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert out.count() <= max(len(some), 1) or name == "packing"
            if name != "packing":
                assert out.columns == docs.columns
