from pyspark.sql import functions as F

from quillstone.functions import exprs, html, text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_normalisers(spark):
    assert one(spark, "\n $tk7\t", exprs.norm_ticker) == "TK7" and one(spark, " $ ", exprs.norm_ticker) is None and one(spark, None,
        exprs.norm_ticker) is None
    assert one(spark, "  Café,   Inc. ", exprs.norm_company) == "café inc" and one(spark, "...", exprs.norm_company) is None


def test_categorical_match_is_null_when_unmapped(spark):
    r = spark.createDataFrame([("LIKE", "INVESTIGATE_NOW"), ("LIKE", "PASS"), ("LIKE", "INSUFFICIENT_INFORMATION")],
        "v string, p string").select(exprs.categorical_match(F.col("v"), F.col("p")).alias("m")).collect()
    assert [x.m for x in r] == [True, False, None]


def test_body_and_sender(spark):
    df = spark.createDataFrame([("", "<p>", "Joe <JOE@X.org>")], "t string, h string, s string")
    r = df.select(exprs.body_of(F.col("t"), F.col("h")).alias("b"), exprs.sender_address(F.col("s")).alias("a")).first()
    assert tuple(r.b) == ("<p>", "html") and r.a == "joe@x.org"


def isolate(spark, body):
    return tuple(one(spark, body, text.isolate_reply))


def test_reply_isolation(spark):
    assert isolate(spark, "LIKE\nGood one\n\nOn Mon, Joe wrote:\n> old") == (True, "LIKE\nGood one", None)
    assert isolate(spark, "LIKE\n> old\n> older\n\n") == (True, "LIKE", None)
    assert isolate(spark, "LIKE\n> old\nmore") == (False, None, "INTERLEAVED_QUOTES")
    assert isolate(spark, "PASS\n-- \nJoe") == (True, "PASS", None)
    assert isolate(spark, "PASS\nSent from my iPhone.") == (True, "PASS", None)
    assert isolate(spark, "---- Forwarded message ----\nx") == (False, None, "NOTHING_LEFT")
    assert isolate(spark, "From: a\nSent: b\nSubject: c\n") == (False, None, "NOTHING_LEFT")
    assert isolate(spark, " \n") == (False, None, "EMPTY_BODY") and isolate(spark, None) == (False, None, "EMPTY_BODY")


def blocks(spark, body, n):
    r = one(spark, body, lambda c: text.reply_blocks(c, F.lit(n)))
    return (r.ok, [tuple(b) for b in r.blocks or []], r.reason)


def test_reply_blocks(spark):
    assert blocks(spark, "\nStrong  like!\nbecause\nof it", 1) == (True, [(None, "STRONG_LIKE", "because\nof it")], None)
    assert blocks(spark, "ABC - pass", 1) == (True, [("ABC", "PASS", "")], None)
    assert blocks(spark, "hello", 1) == (False, [], "NO_VERDICT_LINE")
    assert blocks(spark, "ABC — LIKE\nfine\nDEF: maybe\nhm\nhm", 2) == (True, [("ABC", "LIKE", "fine"), ("DEF", "MAYBE", "hm\nhm")], None)
    assert blocks(spark, "LIKE", 2) == (False, [], "NO_LABELLED_HEADER") and blocks(spark, "LIKE", 0) == (False, [], "NO_DELIVERED_ITEMS")


def headers(spark, body):
    r = one(spark, body, lambda c: text.review_headers(c, "BR"))
    return (r.ok, [tuple(b) for b in r.blocks or []], r.reason)


def test_review_headers_fail_closed(spark):
    assert headers(spark, "br-12 — like\nwhy\n\nBR-3: strong pass.") == (True, [(12, "LIKE", "why"), (3, "STRONG_PASS", "")], None)
    assert headers(spark, "BR-12 — great")[2] == "UNKNOWN_VERDICT" and headers(spark, "BR-12 like")[2] == "MALFORMED_REFERENCE"
    assert headers(spark, "BR-1: like\nABC: like")[2] == "VERDICT_WITHOUT_REFERENCE" and headers(spark, "nothing")[2] == "NO_HEADER"
    assert headers(spark, "BR-1: like\nBR-1: pass")[2] == "REPEATED_REFERENCE"


def test_narratives(spark):
    df = spark.createDataFrame([(["", " N/A.", "ok", "...", None], [], None)], "a array<string>, b array<string>, c array<string>")
    r = df.select(text.substantive(F.col("a")).alias("s"), text.narrative_gaps(F.lit("WATCH"), F.col("a"), F.col("b"),
        F.col("c")).alias("g"),
                  text.narrative_gaps(F.lit("PASS"), F.col("a"), F.col("b"), F.col("c")).alias("p"),
                  text.merged_narrative(F.col("b"), F.col("a")).alias("m")).first()
    assert r.s == ["ok"] and r.g == ["key_concerns", "critical_questions"] and r.p == [] and r.m == ["ok"]


def test_threshold_conflicts(spark):
    def found(t, percents=(), multiples=()):
        a = lambda v: F.array(*[F.lit(float(x)) for x in v]).cast("array<double>")
        return [(c.line, c.reason) for c in one(spark, t, lambda c: text.threshold_conflicts(c, a(percents), a(multiples)))]

    assert found("We require 3x here") == [(1, text.HARD_THRESHOLDS[0][0])]
    assert found("It does not require 3x") == [] and found("ok\nan effective hurdle") == [(2, text.HARD_THRESHOLDS[2][0])]
    assert found("must be 100% or more", percents=(100,)) == [] and len(found("must be 90% or more", percents=(100,))) == 1


def test_thresholds_are_walked_match_by_match(spark):
    a = lambda xs: F.array(*[F.lit(float(x)) for x in xs]) if xs else F.array().cast("array<double>")
    found = lambda t, multiples=(): [(c.line, c.reason) for c in one(spark, t, lambda c: text.threshold_conflicts(c, a(()), a(multiples)))]
    assert found("amust reach 3x; we do not say it must reach 3x") == []  # the first one is no match, the second is denied
    assert found("must reach 3x; we do not say it must reach 3x") == [(1, "MULTIPLE_REQUIRED")]
    assert found("we do not say it must reach 3x, although for us in all of these many cases it must reach 3x") == [(1, "MULTIPLE_REQUIRED")]
    assert found("must reach 3x; must reach 4x", (3,)) == [(1, "MULTIPLE_REQUIRED")] and found("must reach 3x; must reach 3x", (3,)) == []


PAGE = "<html><head><title>A &amp; B</title><style>x</style></head><body><nav>menu</nav><p>Hello   world</p><script>var a;</script><p>Share this pitch!</p><a href='/sp/12/share'><b>Twelve</b></a><a href='/sp/12'>again</a><a href='/x'>no</a></body></html>"


def test_html(spark):
    df = spark.createDataFrame([(PAGE,), ("",), (None,)], "h string").withColumn("p", html.parsed_page("h"))
    r = df.select(F.col("p.title").alias("t"), html.canonical_text(F.col("p.plain")).alias("c"),
        html.pitch_links(F.col("p.links")).alias("l")).collect()
    assert r[0].t == "A & B" and r[0].c == "A & B\nHello world\nTwelve\nagain\nno" and [tuple(x) for x in r[0].l] == [("12", "/sp/12/share",
        "Twelve")]
    assert r[1].c == "" and r[2].c == ""
    problems = spark.createDataFrame([("page NOT found " * 9, "x"), ("short", "x"), ("y" * 60, " Yellowbrick Investing"),
        ("y" * 60, "Foo")], "c string, t string").select(html.page_problem(F.col("c"), F.col("t")).alias("p")).collect()
    assert [x.p for x in problems] == ["PAGE_NOT_FOUND", "NO_PITCH_CONTENT", "NO_PITCH_CONTENT", None]


FEED = """<ul><li class="x"><h2>Acme does <b>well</b></h2><div>Acme Corp (ACM)</div><p>By Jane Doe Added to YB Jan 5, 2026</p><img src=x><a href="/sp/7/share?t=1">Share this pitch</a></li>
<li><div>Pitch date: 2026-01-02 Source: Value Club</div><p>$ZED up<p><a href="/sp/8">Read full article</a></li></ul>
<div class="big Card"><article><h3>Share this pitch!</h3>Other & Sons (OTH)<a href="/sp/9">x</a></article> outer (ZZZ) <a href="/sp/7">again</a></div>
<span>loose (LOO) <a href="/sp/10">l</a></span><li>never closed (NEV)<a href="/sp/11">n</a>"""


def test_pitches_come_with_their_own_cards(spark):
    df = spark.createDataFrame([(1, FEED), (2, None), (3, "<p>nothing")], "k long, h string").withColumn("p", html.parsed_page("h"))
    rows = html.discovered_pitches(df, "p", ["k"]).orderBy("k", "position").collect()
    want = [
        (1, 0, "7", "Acme does \n well", "Jane Doe", None, "Jan 5, 2026", "ACM", "Acme Corp"),
        (1, 1, "8", "ZED", "Value Club", "2026-01-02", None, "ZED", None),
        (1, 2, "9", "OTH — Other & Sons", None, None, None, "OTH", "Other & Sons"),
        (1, 3, "10", None, None, None, None, None, None), (1, 4, "11", None, None, None, None, None, None),
    ]
    assert [(r.k, r.position, r.external_id, r.title, r.author, r.published_at, r.added_at, r.ticker, r.company) for r in rows] == [(*w[:3],
        w[3] and w[3].strip(), *w[4:]) for w in want]
    assert rows[0].canonical_url.endswith("/sp/7") and html.discovered_pitches(df, "p", ["k"], limit=2).count() == 2


def test_switches_decide_completeness(spark):
    one = "<span>Show full summary:</span><button role='switch' id='a' aria-checked='{}' data-state='{}'>x</button>"
    pages = [("", True), (one.format("true", ""), True), (one.format("false", ""), False), (one.format("", "checked"), True),
        (one.format("", ""), False),
             (one.format("true", "") + one.format("false", ""), True), (one.format("true",
             "") + "<i role=switch id=full-summary-switch aria-checked=false>", False),
             ("<i role=switch aria-checked=false></i>" + one.format("true", ""), True)]
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(pages)], "i long, h string").withColumn("p", html.parsed_page("h"))
    got = {r.i: r.c for r in df.select("i", html.content_complete(F.col("p")).alias("c")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(pages)}


def test_documents_and_diagnostics(spark):
    import hashlib

    body = "<title>T &mdash; B&nbsp;&#8364;5</title><p>" + "content " * 20 + "</p>"
    df = spark.createDataFrame([(1, body, "t", "d1"), (2, body + "<script>x</script>", None, None),
        (3, "<title>Yellowbrick Investing</title>gone", "kept?", "d3")], "id long, html string, title string, published_at string")
    r = {x.id: x for x in html.pitch_documents(df).collect()}
    assert r[1].title == "T — B\u00a0€5" and r[1].content_hash == r[2].content_hash and r[1].raw_capture_hash != r[2].raw_capture_hash == hashlib.sha256((body + "<script>x</script>").encode()).hexdigest()
    assert r[1].published_at == "d1" and r[1].content_complete and r[1].invalid_reason is None and r[3].invalid_reason == "NO_PITCH_CONTENT"
    page = '<script id="n" type="application/json">window.__INITIAL_STATE__ = "ACM"</script><script>x</script><script>ACM</script>'
    d = spark.createDataFrame([(page, "https://x.org/a?t=1#f", '<a href="/x?t=1" onclick="f()">Go</a>',
        "Please LOG IN\nShow full summary:\n show full summary")], "h string, u string, m string, t string")
    x = d.select(html.hidden_blocks(F.col("h"), F.array(F.lit("ACM"))).alias("b"), html.bare_url(F.col("u")).alias("u"),
        html.bare_markup(F.col("m")).alias("m"), html.gating_signals(F.col("t")).alias("g"),
        html.collapsed_lines(F.col("t")).alias("n")).first()
    assert [(b.block, b.type, b.markers, b.terms) for b in x.b] == [("n", "application/json", ["window.__INITIAL_STATE__"], ["ACM"]),
        ("script#2", None, [], ["ACM"])]
    assert (x.u, x.m, x.g, x.n) == ("https://x.org/a", '<a href="/x">Go</a>', ["log in"], 2)
    login = spark.createDataFrame([("https://x/login?a", ""), ("https://x/feed", "<input type='a'>"),
        ("https://x", '<input type="password">'), (None, '<input type="password"><a href="/sp/1">')], "u string, h string")
    assert [y.b for y in login.select(html.looks_blocked(F.col("u"), F.col("h")).alias("b")).collect()] == [True, False, True, False]


def test_clicks_are_never_guessed(spark):
    node = "struct<tag:string,role:string,tabindex:string,has_onclick:boolean,cursor:string>"
    rows = [(1, ("span", None, None, True, "pointer")), (1, ("BUTTON", None, None, None, None)), (2, ("div", "button", None, None, None)),
        (2, ("i", "Button", None, None, None)), (3, ("p", None, "", False, "auto"))]
    got = {r.k: (r.tier, r.resolved and r.resolved.tag, r.n_equal) for r in html.resolved_click(spark.createDataFrame(rows,
        f"k long, n {node}"), ["k"], "n").collect()}
    assert got == {1: ("button_tag", "BUTTON", 1), 2: ("role_button", None, 2)}


def test_keys_and_paths(spark):
    import hashlib

    df = spark.createDataFrame([([10, 9, 100],)], "ids array<long>")
    assert df.select(exprs.idempotency_key(F.lit("2026-01-02"),
        F.col("ids")).alias("k")).first().k == hashlib.sha256(b"2026-01-02|9-10-100").hexdigest()[:32]
    assert one(spark, "a/b.c", exprs.safe_component) == "a_b_c" and one(spark, "", exprs.safe_component) == "unknown"
    assert one(spark, "br-12", lambda c: exprs.parse_review_ref("BR", c)) == 12 and one(spark, "x",
        lambda c: exprs.parse_review_ref("BR", c)) is None


def test_a_page_is_parsed_once(spark):
    from quillstone.plans.queries import QUERIES

    for name in ("page_links", "discover_pitches", "html_canonical_text", "page_validity", "pitch_documents"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1, (name, plan)


def test_pages_of_a_small_file_are_parsed_by_many_tasks(spark):
    """The feed is made of one small file: its pages are dealt out, and a batch of them stays small."""
    from quillstone.plans.queries import QUERIES

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for query in ("page_links", "discover_pitches", "html_canonical_text", "page_validity", "pitch_documents"):
            spark.conf.set(name, "10000")
            found = QUERIES[query](spark, "/root/testdata/sf0.01")
            assert found.select(F.spark_partition_id().alias("i")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions")), query
            assert int(spark.conf.get(name)) == html.PAGES_AT_ONCE, query
    finally:
        spark.conf.set(name, before)


def test_fields_of_a_page_are_those_of_the_whole(spark):
    for page in (PAGE, FEED, "", None):
        whole = dict(zip(html.PAGE.names, html.read_page(page), strict=True))
        for fields in (("plain", "title"), ("links",), ("cards",), ("plain", "title", "switches", "label_at")):
            assert html.read_page(page, fields) == tuple(whole[f] for f in fields)
    df = spark.createDataFrame([(PAGE,), (None,)], "h string").select(html.parsed_page("h", "title", "label_at").alias("p"))
    assert df.schema["p"].dataType.names == ["title", "label_at"] and [r.p.title for r in df.collect()] == ["A & B", None]
