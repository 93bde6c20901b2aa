from pyspark.sql import functions as F

from quillstone.operators import audit, evaluation
from quillstone.operators.joins import asof_join, connected_components


def test_asof_is_inclusive_and_takes_the_newest(spark):
    left = spark.createDataFrame([(1, "k", 5), (2, "k", 10), (3, "x", 1), (4, "k", 20)], "id long, k string, t int")
    right = spark.createDataFrame([("k", 5, 100), ("k", 5, 101), ("k", 11, 102)], "k string, at int, rid long")
    got = {r.id: r.r_rid for r in asof_join(left, right, ["k"], "t", "at", ["rid"]).collect()}
    assert got == {1: 101, 2: 101, 3: None, 4: 102}


def rows(spark, pairs):
    df = spark.createDataFrame([(i, v, p) for i, (v, p) in enumerate(pairs)], "feedback_id long, verdict string, overall_prediction string")
    return evaluation.evaluation_rows(df)


def test_metrics_by_hand(spark):
    r = rows(spark, [("LIKE", "INVESTIGATE_NOW"), ("STRONG_LIKE", "PASS"), ("MAYBE", "WATCH"), ("PASS", "PASS"), ("STRONG_PASS", "WATCH"),
        ("LIKE", "INSUFFICIENT_INFORMATION"), (None, "PASS"), ("LIKE", None)])
    m = evaluation.metrics(r).first()
    assert (m.n, m.exact_correct, m.n_scored, m.tp, m.fp, m.tn, m.fn) == (6, 3, 5, 2, 1, 1, 1)
    assert (m.hc_actual, m.hc_hit) == (3, 1) and abs(m.precision - 2 / 3) < 1e-12 and m.specificity == 0.5
    kinds = {x.feedback_id: (x.kind, x.bucket) for x in r.collect()}
    assert kinds == {0: ("correct", 8), 1: ("false_negative", 1), 2: ("correct", 8), 3: ("correct", 8), 4: ("false_positive", 6),
        5: ("unscored", 7)}


def test_ratios_are_null_without_rows(spark):
    m = evaluation.metrics(rows(spark, [("LIKE", "PASS")]).limit(0)).first()
    assert m.n == 0 and m.precision is None and m.balanced_accuracy is None and m.f1 is None


def test_balance_warnings(spark):
    m = evaluation.metrics(rows(spark, [("PASS", "PASS")] * 5))
    assert sorted(r.warning for r in evaluation.balance_warnings(m).collect()) == ["ALMOST_ALL_PASS", "FEW_POSITIVES"]


def test_components_of_a_chain_and_a_star(spark):
    n = 40
    chain = [(i, i + 1) for i in range(1, n)] + [(100, i) for i in range(101, 140)]
    nodes = spark.createDataFrame([(i,) for i in [*range(1, n + 1), *range(100, 140), 500]], "id long")
    got = {r.id: r.component for r in connected_components(nodes, "id", spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, n + 1)) and all(got[i] == 100 for i in range(100, 140)) and got[500] == 500


def test_duplicate_groups_and_strongest_identity(spark):
    rows_ = spark.createDataFrame([(1, "s", "9", "AB", None), (2, "s", "9", None, None), (3, None, None, " $ab", "Foo, Inc."),
        (4, None, None, None, "foo inc"), (5, "s", "8", None, None)],
                                  "feedback_id long, source_name string, external_id string, ticker string, company string")
    groups = audit.duplicate_groups(rows_)
    assert {r.feedback_id: r.component for r in groups.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}
    r = audit.group_report(groups, audit.identity_keys(rows_)).collect()
    assert [(x.component, x.n_members, x.level, x.value) for x in r] == [(1, 4, "D", "s:9")]


def test_training_overlap_takes_the_strongest_level(spark):
    schema = "feedback_id long, source_name string, external_id string, ticker string, company string"
    training = spark.createDataFrame([(1, "s", "9", "AB", None), (2, "s", "9", None, "foo")], schema)
    holdout = spark.createDataFrame([(11, "s", "9", "AB", None), (12, None, None, "ab", "foo"), (13, None, None, "zz", None)], schema)
    assert {tuple(r) for r in audit.training_overlap(holdout, training).collect()} == {(11, "D", 1), (12, "E", 1)}


def test_exposure_counts_agree_with_the_pairs(spark):
    j = spark.createDataFrame([(1, 7, 5), (2, 7, 9), (3, 8, 1)], "feedback_id long, source_id long, at int")
    e = spark.createDataFrame([(10, 7, 4), (11, 7, 5), (12, 7, 8), (13, 8, 1)], "feedback_id long, source_id long, at int")
    counts = {r.feedback_id: r.n_exposures or 0 for r in audit.exposure_counts(j, e, "at").collect()}
    pairs = audit.prior_exposure(j, e, "at").groupBy("feedback_id").count().collect()
    assert counts == {1: 1, 2: 3, 3: 0} and {r[0]: r[1] for r in pairs} == {1: 1, 2: 3}


def test_problems_come_in_order(spark):
    r = spark.createDataFrame([(1, "official", "DIRECT", 0, 1, "ERROR", "xyz")],
        "feedback_id long, role string, feedback_origin string, holdout_eligible int, excluded_from_learning int, feedback_parse_status string, ticker string")
    assert audit.validity_problems(r).first().problems == ["OFFICIAL_NOT_BLIND", "NOT_HOLDOUT_ELIGIBLE", "EXCLUDED", "NOT_PARSED",
        "NO_SOURCE", "SMOKE_TICKER"]


def test_text_items_themes_and_hurdles_by_place(spark):
    told = "id long, key_reasons array<string>, key_concerns array<string>, critical_questions array<string>"
    rows = spark.createDataFrame([
        (1, ["fine", " "], ["a three bagger; A 3x return; no edge"], ["three-bagger at 100 %"]), (2, ["large-cap, CYCLICAL"], None, [None, ""]),
        (3, ["13x", "3xy"], [], ["an effective  hurdle", "about 3x, effective hurdle", "three bagger"]), (4, None, None, None)], told)
    items = evaluation.text_items(rows, "id")
    assert sorted((r.id, r.field, r.field_no, r.item_no) for r in items.collect()) == [(1, "critical_questions", 2, 0), (1, "key_concerns", 1, 0),
        (1, "key_reasons", 0, 0), (2, "key_reasons", 0, 0), (3, "critical_questions", 2, 0), (3, "critical_questions", 2, 1),
        (3, "critical_questions", 2, 2), (3, "key_reasons", 0, 0), (3, "key_reasons", 0, 1)]
    h = {r.id: r for r in evaluation.hurdle_hits(items, "id").collect()}
    # In the order in which they are met: by field, by item, and of one text by pattern.
    assert (h[1].categories, h[1].field, h[1].permanent_framing) == ("3x-style multiple, three-bagger", "key_concerns", True)
    assert (h[3].categories, h[3].field, h[3].excerpt) == ("effective hurdle, 3x-style multiple, three-bagger", "critical_questions", "an effective hurdle")
    assert set(h) == {1, 3} and not h[3].permanent_framing
    themes = {r.theme: (r.n_rows, r.refs) for r in evaluation.theme_report(items, "id").collect()}
    assert themes["no edge"] == (1, "1") and themes["cyclical"] == (1, "2") and themes["relative value"] == (0, "") and len(themes) == 8
    many = evaluation.text_items(spark.range(50).selectExpr("id", "array('cyclical', 'Cyclical') AS a", "array('x') AS b"), "id", ("a", "b"))
    assert {r.theme: (r.n_rows, r.refs) for r in evaluation.theme_report(many, "id", named=3).collect()}["cyclical"] == (50, "0, 1, 2")
    one = evaluation.theme_counts(spark.createDataFrame([(1, "no edge"), (2, "CYCLICAL"), (3, None)], "id long, t string"), "id", "t")
    assert {r.theme for r in one.filter("n_rows = 1").collect()} == {"no edge", "cyclical"}
    assert rows.select(evaluation.rule_excerpts(F.lit("a\n 5 % b \n\n7% c")).alias("x")).first().x == ["5 % b", "7% c"]


def test_counts_before_in_slices_agree_with_a_plain_count(spark, monkeypatch):
    import random

    from quillstone.operators import joins

    rng = random.Random(4)
    key = lambda: rng.choice(["a", "a", "a", "b", "b", "c", None])
    rows, events = [(i, key(), rng.randint(0, 60)) for i in range(200)], [(key(), rng.randint(0, 60)) for _ in range(300)]
    want = {i: sum(k is not None and e == k and u < t for e, u in events) for i, k, t in rows}
    r, e = spark.createDataFrame(rows, "id long, k string, t int"), spark.createDataFrame(events, "k string, t int")
    for hot in (10**9, 40):  # two hot keys at different times, each cut where its own rows are
        monkeypatch.setattr(joins, "HOT_ROWS", hot)
        assert {x.id: x.n for x in joins.counts_before(r, e, ["k"], "t").collect()} == want
    stream, cut = joins.in_slices(spark.range(4000).selectExpr("CAST(id % 2 AS STRING) AS k", "id AS t"), ["k"], "t")
    sizes = [x["count"] for x in stream.groupBy("k", "__slice").count().collect()]
    assert cut and sum(sizes) == 4000 and max(sizes) < 1500


def test_greedy_rounds_choose_what_a_scan_does(spark):
    import random

    from quillstone.operators.joins import greedy_distinct

    rng = random.Random(7)
    for n, keys, limit in ((60, 8, 100), (200, 60, 15), (300, 300, 40), (40, 3, 2), (30, 1000, 0)):
        key = lambda: rng.choice([None, *(f"k{rng.randint(0, keys)}" for _ in range(6))])  # noqa: B023, E731
        rows = [(rng.randint(0, 20), i, key(), key()) for i in range(n)]
        seen, want = ({}, {}), []
        for at, i, t, c in sorted(rows):
            if len(want) < limit and not (t is not None and t in seen[0] or c is not None and c in seen[1]):
                want.append(i)
                seen[0][t] = seen[1][c] = True
        df = spark.createDataFrame(rows, "at int, id long, t string, c string")
        assert [r.id for r in greedy_distinct(df, ["at", "id"], ["t", "c"], limit).orderBy("position").collect()] == want
    chain = spark.createDataFrame([(i, f"t{i // 2}", f"c{(i + 1) // 2}") for i in range(40)], "id long, t string, c string")  # each blocks the next
    assert [r.id for r in greedy_distinct(chain, ["id"], ["t", "c"], 9).orderBy("position").collect()] == list(range(0, 18, 2))


def test_remediation_names_what_stays_and_what_goes(spark):
    schema = "feedback_id long, role string, verdict string, assignment_id long, ticker string, company string, source_name string, external_id string"
    rows = spark.createDataFrame([(5, "candidate", "LIKE", 1, "AB", None, None, None), (6, "official", "PASS", 2, "$ab", "x", None, None),
        (7, "official", "PASS", None, None, "X", None, None), (8, "official", "LIKE", 3, None, None, "web", "a:1"), (9, "official", "LIKE", 4, None, None, "web", "a:1"),
        (10, "official", None, 5, "ZZ", None, None, None)], schema)
    bad = rows.withColumn("problems", F.when(F.col("feedback_id") == 8, F.array(F.lit("NO_SOURCE"))).otherwise(F.array().cast("array<string>")))
    groups = audit.duplicate_groups(bad)
    plan = audit.remediation(bad, groups, audit.group_report(groups, audit.identity_keys(bad)))
    got = {r.component: r for r in plan.collect()}
    assert set(got) == {5, 8}
    assert (got[5].retained, got[5].n_to_go, got[5].n_official, got[5].shared, got[5].refs) == (6, 2, 2, "ticker AB", "BR-2 / FB 7 / BR-1")
    assert got[5].labels == "LIKE, PASS" and got[5].labels_differ and not got[8].labels_differ
    assert (got[8].retained, got[8].shared, got[8].refs) == (9, "source web/a:1", "BR-4 / BR-3")  # 8 has a problem
    lines = audit.remediation_plan(audit.audit_summary(bad, groups).first(), plan, bad, at_most=1)
    assert lines[0] == "15 more blind judgments are needed" and lines[1].startswith("one idea (ticker AB): keep FB 6, exclude the other 2") and lines[
        2] == "... and 1 more groups" and lines[3] == "FB 8 (official): NO_SOURCE; decide by hand"


def test_asof_in_slices_gives_the_same_rows(spark, monkeypatch):
    import random

    from quillstone.operators import joins

    rng = random.Random(3)
    left = spark.createDataFrame([(rng.choice("aaaab"), f"2026-01-{rng.randint(1, 28):02d}", i) for i in range(300)],
        "k string, t string, id long")
    right = spark.createDataFrame([(rng.choice("aaab"), f"2026-01-{rng.randint(5, 28):02d}", i) for i in range(60)],
        "k string, at string, rid long")
    for l, r in ((left, right), (left.withColumn("t", F.col("t").cast("timestamp")), right.withColumn("at", F.col("at").cast("timestamp"))),
            (left, right.limit(0))):
        monkeypatch.setattr(joins, "HOT_ROWS", 10**9)
        want = sorted(map(tuple, joins.asof_join(l, r, ["k"], "t", "at", ["rid"]).collect()), key=str)
        monkeypatch.setattr(joins, "HOT_ROWS", 50)
        assert sorted(map(tuple, joins.asof_join(l, r, ["k"], "t", "at", ["rid"]).collect()), key=str) == want


def test_a_screening_exposes_its_source(spark):
    j = spark.createDataFrame([(10, 1), (11, 2), (12, 3)], "feedback_id long, source_id long").withColumn("at", F.col("feedback_id"))
    e = spark.createDataFrame([(5, 1, 1), (6, 9, 1), (7, 2, None), (20, 3, 3)],
        "feedback_id long, source_id long, screened_source_id long").withColumn("at", F.col("feedback_id"))
    got = {r.feedback_id: r.n_exposures for r in audit.exposure_counts(j, e, "at").collect()}
    assert {k: v or 0 for k, v in got.items()} == {10: 2, 11: 1, 12: 0}
    assert {(r.feedback_id, r.exposed_feedback_id) for r in audit.prior_exposure(j, e, "at").collect()} == {(10, 5), (10, 6), (11, 7)}


def test_reconciliation_sees_rows_on_one_side_only(spark):
    rows = spark.createDataFrame([(11, "official"), (12, "official"), (13, "candidate"), (14, "other")], "feedback_id long, role string")
    feedback = spark.createDataFrame([(i,) for i in (1, 11, 12, 13, 14)], "feedback_id long")
    same = audit.reconciliation(rows, feedback.filter("feedback_id IN (11, 12)"), feedback, 10).first()
    assert (same.reconciles, same.reconciles_total, same.n_after) == (True, True, 4)
    other = audit.reconciliation(rows, feedback.filter("feedback_id IN (11, 13)"), feedback, 1).first()
    assert (other.reconciles, other.n_different) == (False, 2)
    assert not audit.reconciliation(rows, feedback.limit(0), feedback, 0).first().reconciles_total


def shares(df):
    """How many rows each task has of df, with every shuffle as it falls."""
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_rows_without_a_key_are_spread_by_their_join(spark):
    from quillstone.operators.joins import left_join_known

    left = spark.range(4000).select("id", F.when(F.col("id") % 40 == 0, F.col("id")).alias("k"))
    right = spark.createDataFrame([(0, "a"), (40, "b"), (1, "c"), (None, "d")], "k long, v string")
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {c: spark.conf.get(c) for c in conf}
    try:
        for c, x in conf.items():
            spark.conf.set(c, x)
        got = left_join_known(left, right, "k")
        assert sorted(got.columns) == ["id", "k", "v"] and {(r.id, r.v) for r in got.filter("v IS NOT NULL").collect()} == {(0, "a"), (40, "b")}
        each = shares(got)
        assert sum(each) == 4000 and max(each) < 2000
    finally:
        for c, x in before.items():
            spark.conf.set(c, x)


def test_summary_gathers_no_group_in_one_task(spark):
    """Most rows are one idea: they are counted, not sent to one task, and a lone row is still told from them."""
    problems = "CASE WHEN id % 7 = 0 THEN array('EXCLUDED') ELSE cast(array() AS array<string>) END AS problems"
    held = spark.range(3000).selectExpr("id AS feedback_id", "CASE WHEN id % 3 = 0 THEN 'candidate' ELSE 'official' END AS role", problems)
    groups = spark.range(3000).selectExpr("id AS feedback_id", "CASE WHEN id < 2990 THEN 0 ELSE id END AS component")
    other = spark.createDataFrame([(9000, "other", [])], "feedback_id long, role string, problems array<string>")
    out = audit.audit_summary(held.unionByName(other), groups)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    r, own = out.first(), [i for i in range(3000) if i % 3]
    assert (r.n_official, r.n_candidates, r.n_other, r.n_unique) == (len(own), 1000, 1, 1 + sum(i >= 2990 for i in own))
    assert r.n_valid_unique == sum(i >= 2990 and i % 7 > 0 for i in own) and r.n_problem_rows == sum(i % 7 == 0 for i in own)
    assert r.n_questionable == sum(i < 2990 or i % 7 == 0 for i in range(3000)) and not r.clean


def test_rows_of_one_id_unite_their_identities(spark):
    schema = "feedback_id long, source_name string, external_id string, ticker string, company string"
    r = spark.createDataFrame([(3, "s", "9", None, None), (5, "s", "8", None, None), (5, "s", "9", None, None), (6, None, None, None, None),
        (6, "s", "8", None, None), (7, None, None, None, None)], schema)
    assert sorted(tuple(x) for x in audit.duplicate_groups(r).collect()) == [(3, 3), (5, 3), (6, 3), (7, 7)]


def test_training_overlap_is_the_same_by_a_shuffle(spark, monkeypatch):
    schema = "feedback_id long, source_name string, external_id string, ticker string, company string"
    training = spark.createDataFrame([(i, "s", str(i), f"T{i % 5}", None) for i in range(40)], schema)
    holdout = spark.createDataFrame([(100 + i, "s", str(i), f"T{i % 7}", None) for i in range(30, 50)], schema)
    few = sorted(audit.training_overlap(holdout, training).collect())
    monkeypatch.setattr(audit, "MAX_BROADCAST_IDENTITIES", 3)
    assert few == sorted(audit.training_overlap(holdout, training).collect()) and {x.level for x in few} == {"D", "E"}


def test_first_exposures_tell_whether_there_are_any_before(spark):
    j = spark.createDataFrame([(1, 7), (4, 7), (9, 7), (9, 8), (3, 9), (2, None)], "feedback_id long, source_id long")
    e = spark.createDataFrame([(4, 7, 7), (6, 7, 8), (8, 8, None), (5, None, 7)], "feedback_id long, source_id long, screened_source_id long")
    at = lambda x: x.withColumn("at", F.col("feedback_id"))
    first = j.join(audit.first_exposures(at(e), "at"), "source_id", "left").selectExpr("feedback_id", "source_id",
        "coalesce(first_exposed < feedback_id, false) AS some")
    counts = audit.exposure_counts(at(j).withColumn("feedback_id", F.struct("feedback_id", "source_id")), at(e), "at")
    want = {tuple(r.feedback_id): r.n_exposures > 0 for r in counts.collect()}
    assert {(r.feedback_id, r.source_id): r.some for r in first.collect()} == want and set(want.values()) == {True, False}
