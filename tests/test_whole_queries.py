"""The registered queries over small hand-made tables, against brute force over all of their rows."""

from quillstone.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def norm(ticker):
    return ticker and ticker.strip().removeprefix("$").upper() or None


def company(name):
    return name and " ".join("".join(c for c in name if c.isalnum() or c in "_ ").lower().split()) or None


def keys_of(spark):
    """feedback_id -> [(level, value)] of documents, tickers and companies, the source's before the feedback's own."""
    from quillstone.plans.queries import Views

    v = Views(spark, SF)
    of = {r.source_id: r for r in v.sources.collect()}
    out = {}
    for r in v.feedback.collect():
        s = of.get(r.source_id)
        found = [("D", (s.source_name, s.external_id))] if s else []
        found += [(k, x) for k, x in (("E", norm((s and s.ticker) or r.ticker)), ("F", company((s and s.company) or r.company))) if x]
        out[r.feedback_id] = found
    return out


def test_groups_and_overlap_take_all_feedback(spark):
    keys = keys_of(spark)
    least = {k: min(i for i in keys if k in keys[i]) for k in {k for ks in keys.values() for k in ks}}
    root = {i: i for i in keys}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, ks in keys.items():
        for k in ks:
            a, b = sorted((find(i), find(least[k])))
            root[b] = a
    assert {r.feedback_id: r.component for r in QUERIES["duplicate_groups"](spark, SF).collect()} == {i: find(i) for i in keys}


def test_overlap_takes_all_training_rows(spark, monkeypatch):
    from quillstone.plans import queries

    keys = keys_of(spark)
    middle = sorted(keys)[len(keys) // 2]
    monkeypatch.setattr(queries, "CHECKPOINT", middle)
    first = {}
    for i in sorted(keys):
        if i <= middle:
            for k in keys[i]:
                first.setdefault(k, i)
    want = {i: next(((k[0], first[k]) for k in ks if k in first), None) for i, ks in keys.items() if i > middle}
    got = {r.feedback_id: (r.level, r.training_feedback_id) for r in QUERIES["training_overlap"](spark, SF).collect()}
    assert got == {i: w for i, w in want.items() if w}


class Tables:
    """Hand-made views."""

    def __init__(self, spark, **rows):
        for name, (data, schema) in rows.items():
            setattr(self, name, spark.createDataFrame(data, schema))


SOURCES = "source_id long, source_name string, external_id long, ticker string, company string, collection_status string, extraction_status string, discovered_seq long"


def sources_of(*named):
    return [(i, "s", i, t, f"Firm {i}", "COLLECTED", "EXTRACTED", i) for i, t in named], SOURCES


TOLD = ", ".join(f"{c} array<string>" for c in ("key_reasons", "key_concerns", "critical_questions"))


def test_any_eligible_judgment_suppresses(spark, monkeypatch):
    from quillstone.plans import queries

    named = [(1, "AA"), (2, "BB"), (3, "CC"), (4, "DD"), (5, "EE")]
    v = Tables(
        spark, sources=sources_of(*named), observations=([(i, "s", i, 1) for i, _ in named],
        "source_id long, source_name string, external_id long, observed_seq long"),
        screenings=([(i, i, "t", queries.TASTE, "WATCH") for i, _ in named],
        "screening_id long, source_id long, created_at string, taste_version int, overall_prediction string"),
        shown=([], "source_id long"), messages=([("m", "PARSED"), ("n", "UNPARSED")], "message_id string, feedback_parse_status string"),
        feedback=([(1, "m", 1, "aa", "DIRECT", 0), (2, "m", 45, "bb", "BLIND_REVIEW", 0), (3, "n", 3, "cc", "DIRECT", 0)],
                  "feedback_id long, message_id string, source_id long, ticker string, feedback_origin string, excluded_from_learning int"),
    )
    v.feedback = v.feedback.selectExpr("*", "cast(null as string) AS company")
    v.narratives = spark.createDataFrame([(i, ["r"], ["n/a"] if i > 3 else ["c"], ["q"]) for i, _ in named], f"screening_id long, {TOLD}")
    v.repairs = spark.createDataFrame([(1, 4, "REPAIRED", [], ["c"], []), (2, 5, "FAILED", [], ["c"], [])],
        f"repair_id long, screening_id long, status string, {TOLD}")
    monkeypatch.setattr(queries, "Views", lambda *_: v)
    assert [(r.position, r.source_id) for r in QUERIES["digest_selection_top5"](spark, SF).orderBy("position").collect()] == [(1,
        3), (2, 4)]
    assert tuple(QUERIES["digest_suppression_counters"](spark, SF).first()) == (5, 2, 1)  # 5's narrative stayed incomplete


def test_every_assignment_blocks_its_identities(spark, monkeypatch):
    from quillstone.plans import queries

    named = [(1, "AA", 0), (2, "BB", 0), (3, "CC", 0), (45, "BB", 1), (55, "AA", 1)]
    v = Tables(spark, prospects=([(i, t, None, i, a) for i, t, a in named],
        "source_id long, ticker string, company string, discovered_seq long, assigned int"))
    monkeypatch.setattr(queries, "Views", lambda *_: v)
    assert [tuple(r) for r in QUERIES["greedy_blind_assignment"](spark, SF).collect()] == [(1, 3)]  # 45's ticker is assigned, as is 55's


def audited(spark):
    """Rows 1 and 2 are training; 11 and 12 share a company, 13 is superseded, 14 of another role."""
    named = [(i, t) for i, t in ((1, "AA"), (2, "BB"), (3, "CC"), (4, "DD"), (5, "XYZ"), (6, "EE"))]
    rows, schema = sources_of(*named)
    rows = [(*r[:4], "Same Ltd" if r[0] in (3, 4) else r[4], *r[5:]) for r in rows]
    f = [(1, 1), (2, 2), (11, 3), (12, 4), (13, 5), (14, 6), (15, 1), (16, 5), (17, 5)]
    return Tables(
        spark, sources=(rows, schema), messages=([("m", "PARSED", "2020-01-05")],
        "message_id string, feedback_parse_status string, received_at string"),
        feedback=([(i, "m", s, None, None, "DIRECT" if i == 14 else "BLIND_REVIEW", 0 if i == 14 else 1, 1 if i == 13 else 0) for i,
        s in f],
                  "feedback_id long, message_id string, source_id long, ticker string, company string, feedback_origin string, holdout_eligible int, excluded_from_learning int"),
        assignments=([(i, i, 50) for i in (1, 3, 4, 5)], "assignment_id long, source_id long, judged_seq long"),
        shown=([(3, 40), (4, 60)], "source_id long, shown_seq long"),
        screenings=([(i, i, "2020-01-09" if i == 4 else "2020-01-01") for i in range(1, 7)],
        "screening_id long, source_id long, created_at string"),
        exposures=([(10, 9, 6), (13, 3, 3)], "feedback_id long, source_id long, screened_source_id long"),
    )


def test_audit_sees_all_roles_components_and_problems(spark, monkeypatch):
    from quillstone.plans import queries

    v = audited(spark)
    monkeypatch.setattr(queries, "Views", lambda *_: v)
    monkeypatch.setattr(queries, "CHECKPOINT", 10)
    monkeypatch.setattr(queries, "_roles", lambda v: queries.audit.roles(v.feedback, v.messages, 10,
        v.feedback.filter("feedback_id = 13").select("feedback_id")))
    got = {r.feedback_id: r.problems for r in QUERIES["validity_problems"](spark, SF).collect()}
    assert got == {11: "SHOWN_BEFORE", 12: "SCREENED_LATER", 15: "USABLE_JUDGMENTS,TRAINING_OVERLAP", 16: "USABLE_JUDGMENTS,SMOKE_TICKER",
        17: "USABLE_JUDGMENTS,SMOKE_TICKER"}
    r = QUERIES["audit_summary"](spark, SF).first()
    assert (r.n_official, r.n_candidates, r.n_superseded, r.n_other, r.n_unique, r.n_valid_unique, r.n_problem_rows,
        r.n_questionable) == (5, 0, 1, 1, 3, 0, 5, 5)


def test_audit_leaves_no_shuffles_of_its_steps_on_disk(spark):
    """The steps are written, so what the disk holds is the shuffles of one step, not of all."""
    import time

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}

    before = shuffles()
    summary = QUERIES["audit_summary"](spark, SF)
    for _ in range(50):  # removed in the background
        if not (left := shuffles() - before):
            break
        time.sleep(0.2)
    assert not left and summary.count() == 1


def test_links_and_texts_of_pages_match_a_plain_parser(spark):
    import re
    from html import unescape
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.hidden, self.texts, self.hrefs = 0, [], []

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style", "nav", "footer", "header")
            self.hrefs += [dict(attrs).get("href") or ""] * (tag == "a")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style", "nav", "footer", "header") and self.hidden > 0

        def handle_data(self, data):
            self.texts += [data] * (not self.hidden)

    want = {}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        p = Plain()
        p.feed(r.html)
        lines = [re.sub(r"[ \t]+", " ", x).strip() for t in p.texts for x in t.splitlines()]
        title = re.search(r"(?is)<title[^>]*>(.*?)</title>", r.html)
        want[r.page_id] = ("\n".join(x for x in lines if x), title and unescape(title[1]).strip() or None, p.hrefs)
    assert {r.page_id: (r.canonical, r.title) for r in QUERIES["html_canonical_text"](spark, SF).collect()} == {k: v[:2] for k,
        v in want.items()}
    hrefs = {}
    for r in QUERIES["page_links"](spark, SF).orderBy("page_id", "position").collect():
        hrefs.setdefault(r.page_id, []).append(r.href)
    assert hrefs == {k: v[2] for k, v in want.items() if v[2]}
    problems = {r.page_id: (r.problem, r.n_chars) for r in QUERIES["page_validity"](spark, SF).collect()}
    assert problems == {k: (None if len(v[0]) >= 50 else "NO_PITCH_CONTENT", len(v[0])) for k, v in want.items()}
