"""Odd rows that the other tests of the operators leave out: empty tables, very long texts and urls, clashing columns."""

import math

from quillstone.llm import langid, lmscore, toxicity, urlfilter

DOCS = "doc_id long, text string, score string, lang string"


def test_toxicity_of_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    rows = [(1, "vile words", "x", "en"), (2, "kind words", "x", "en"), (3, "word " * 200_000, "x", None), (4, None, None, None)]
    docs = spark.createDataFrame(rows + rows[:1], DOCS)
    assert toxicity.classify(docs.limit(0), labels).count() == 0 and toxicity.classify(docs.limit(0), labels.limit(0)).count() == 0
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 1}) == 1  # repeated rows are scored alike


def test_language_of_odd_tables(spark):
    rows = [(i, text, "clash", lang) for i, (text, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 10)]
    docs = spark.createDataFrame([*rows, (90, "the " * 100_000, "clash", None), (91, "q" * 30_000, "clash", None), (92, "12 34", "clash", None)], DOCS)
    got = {r.doc_id: r for r in langid.identify(docs, docs.filter("lang IS NOT NULL")).collect()}
    assert len(got) == 23 and got[0].lang_pred == "en" and got[1].lang_pred == "fr" and got[90].lang_pred == "en" and got[92].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(docs.limit(0), docs).count() == 0


def test_language_model_of_odd_tables(spark):
    rows = [(1, "a b c a b", "clash", "en"), (2, "a b " * 60_000, "clash", "en"), (3, "w" * 100_000, "clash", "en"), (None, "a b", "clash", "en")]
    docs = spark.createDataFrame(rows + rows[:1], DOCS)
    got = lmscore.cross_entropy_difference(docs, spark.createDataFrame([(2,)], "doc_id long")).collect()
    assert sorted(r.n_tokens for r in got) == [1, 2, 5, 5, 120_000] and all(math.isfinite(r.score) for r in got)


def test_very_long_urls(spark):
    path, host = "/es/" + "x" * 200_000, ".".join(["a"] * 2000) + ".example.org"
    pages = spark.createDataFrame([(1, f"http://example.org{path}", "clash"), (2, f"http://{host}/es/", "clash"), (3, "http://" + "b" * 100_000, "clash")],
        "page_id long, url string, rule string")
    got = {r.page_id: r for r in urlfilter.url_filter(pages, urlfilter.rules_frame(spark, urlfilter.RULES)).collect()}
    assert (got[1].rule, got[1].verdict, got[1].path) == ("example.org/es/", "block", path) and (got[2].rule, got[2].host) == ("example.org/es/", host)
    assert got[3].rule is None and got[3].verdict == "allow"
