from quillstone.operators import digest, sources

SOURCES = "source_id long, source_name string, external_id string, ticker string, company string, collection_status string, extraction_status string, discovered_seq long"
SCREENINGS = "screening_id long, source_id long, created_at string, taste_version int, overall_prediction string"


def source(i, ext, ticker=None, company=None, status="COLLECTED", extraction="EXTRACTED"):
    return (i, "s", ext, ticker, company, status, extraction, i)


def observed(spark, *rows):
    return spark.createDataFrame([(i, "s", e, n) for i, e, n in rows],
        "source_id long, source_name string, external_id string, observed_seq long")


def ids(df):
    return sorted(r.source_id for r in df.select("source_id").collect())


def test_current_is_last_observed_and_incomplete_hides_older(spark):
    s = spark.createDataFrame([source(1, "a"), source(2, "a", status="INCOMPLETE_CONTENT"), source(3, "b"), source(4, "b")], SOURCES)
    o = observed(spark, (1, "a", 1), (2, "a", 2), (3, "b", 1), (4, "b", 2), (3, "b", 3))
    assert ids(sources.current_sources(s, o)) == [2, 3]
    assert ids(sources.ready_sources(s, o)) == [3]


def test_missing_screening_ignores_prompt_version(spark):
    s = spark.createDataFrame([source(1, "a"), source(2, "b")], SOURCES)
    o = observed(spark, (1, "a", 1), (2, "b", 1))
    sc = spark.createDataFrame([(9, 1, "x", 2, "PASS")], SCREENINGS)
    assert ids(sources.missing_screening(s, o, sc, 2)) == [2] and ids(sources.missing_screening(s, o, sc, 1)) == [1, 2]


def test_version_resolution(spark):
    stored = spark.createDataFrame([(1, "s", "a", "h1", "COLLECTED"), (2, "s", "b", "h2", "INCOMPLETE_CONTENT")],
        "source_id long, source_name string, external_id string, content_hash string, collection_status string")
    o = observed(spark, (1, "a", 1), (2, "b", 1))
    fetched = spark.createDataFrame([("s", "a", "h1", True), ("s", "a", "h9", True), ("s", "b", "h2", True), ("s", "c", "h3", False)],
        "source_name string, external_id string, content_hash string, content_complete boolean")
    got = {(r.external_id, r.content_hash): (r.action, r.previous_version) for r in sources.resolve_fetched(fetched, stored, o).collect()}
    assert got == {("a", "h1"): ("known_complete", 1), ("a", "h9"): ("insert", 1), ("b", "h2"): ("promote", 2),
        ("c", "h3"): ("insert", None)}


def pool(spark):
    s = spark.createDataFrame([source(1, "a", " $ab "), source(2, "b", None, "Foo, Inc."), source(3, "c", "CD", "Foo Inc"),
        source(4, "d", "EF"), source(5, "e", "GH")], SOURCES)
    o = observed(spark, *[(i, e, 1) for i, e in zip(range(1, 6), "abcde", strict=True)])
    sc = spark.createDataFrame([(1, 1, "t1", 2, "WATCH"), (2, 2, "t2", 2, "WATCH"), (3, 3, "t3", 2, "WATCH"), (4, 4, "t4", 2, "WATCH"),
        (5, 4, "t5", 2, "PASS"), (6, 5, "t9", 2, "INVESTIGATE_NOW")], SCREENINGS)
    return digest.digest_pool(s, o, sc, spark.createDataFrame([], "source_id long"), 2)


def test_newer_pass_hides_older_watch(spark):
    assert ids(pool(spark)) == [1, 2, 3, 5]


def test_suppression_is_ticker_first_and_order_holds(spark):
    f = spark.createDataFrame([(1, "m", "AB", "foo inc", False)],
        "feedback_id long, message_id string, ticker string, company string, excluded_from_learning boolean")
    m = spark.createDataFrame([("m", "PARSED")], "message_id string, feedback_parse_status string")
    judged = digest.judged_pool(pool(spark), f, m)
    assert {r.source_id for r in judged.filter("judged").collect()} == {1, 2}  # 3 has another ticker, so its company doesn't count
    assert [(r.position, r.source_id) for r in digest.select_digest(judged).orderBy("position").collect()] == [(1, 5), (2, 3)]
    assert tuple(digest.suppression_counters(judged).first()) == (4, 2, 0)


def test_greedy_assignment_depends_on_earlier_choices(spark):
    s = spark.createDataFrame([source(1, "a", "AA", "X"), source(2, "b", "BB", "X"), source(3, "c", "BB", "Y"), source(4, "d", None, None),
        source(5, "e", "ZZ", "Q")], SOURCES)
    known = digest.identities(spark.createDataFrame([("zz", None)], "ticker string, company string"))
    assert [r.source_id for r in digest.greedy_assignments(s, known, 10).orderBy("position").collect()] == [1, 3, 4]
    assert digest.greedy_assignments(s, known, 1).count() == 1


def test_blank_thread_has_no_delivery(spark):
    d = spark.createDataFrame([(1, "t"), (2, "t"), (3, ""), (4, None)], "delivery_id long, provider_thread_id string")
    assert [tuple(r) for r in digest.delivery_by_thread(d).collect()] == [(2, "t")]
