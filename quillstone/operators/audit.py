"""Hold-out integrity: roles, identity keys, duplicate groups, training overlap and validity problems.

Two hold-out rows are the same idea when they share an assignment (A), a document (D), a screening (C), a normalised
ticker (E) or a normalised company (F), directly or through others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.exprs import norm_company, norm_ticker
from quillstone.operators.feedback import is_excluded
from quillstone.operators.joins import components_of, counts_before, link_by_keys
from quillstone.operators.storage import materialize, release, shuffles_removed

#: Levels from the strongest identity down, with their ranks, and those that count against training rows.
LEVELS = ("A", "D", "C", "E", "F")
TRAINING_LEVELS = ("D", "E", "F")
SMOKE_TICKERS = ("TESTCO", "XYZ")
HOLDOUT_SIZE = 20
#: Identities of training rows up to which they are sent to all executors.
MAX_BROADCAST_IDENTITIES = 200_000


def roles(feedback: DataFrame, messages: DataFrame, checkpoint: int, repaired: DataFrame | None = None) -> DataFrame:
    """Feedback after the checkpoint with role: official, superseded, candidate or other, and its message's status and received_at.

    Official rows are those of holdout_pool(), told by their own columns. repaired: feedback_id of recorded duplicate exclusions.
    """
    told = [c for c in ("received_at",) if c in messages.columns and c not in feedback.columns]
    rows = feedback.filter(F.col("feedback_id") > checkpoint).join(messages.select("message_id", "feedback_parse_status", *told), "message_id")
    official = F.col("holdout_eligible").cast("boolean") & ~is_excluded() & (F.col("feedback_parse_status") == "PARSED")
    if repaired is not None:
        rows = rows.join(repaired.select("feedback_id", F.lit(True).alias("__repaired")), "feedback_id", "left")
    else:
        rows = rows.withColumn("__repaired", F.lit(None).cast("boolean"))
    blind = F.col("feedback_origin") == "BLIND_REVIEW"
    if "assignment_id" in feedback.columns:
        blind = blind | F.col("assignment_id").isNotNull()
    role = (F.when(official, "official").when(blind & is_excluded() & F.coalesce("__repaired", F.lit(False)),
        "superseded").when(blind, "candidate").otherwise("other"))
    return rows.withColumn("role", role).drop("__repaired")


def _identities(rows: DataFrame) -> DataFrame:
    """(feedback_id, keys): the identities of each row as an array of (level, rank, value). Columns that rows lack give none."""
    have = lambda c: F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")
    document = F.when((F.length(have("source_name")) > 0) & (F.length(have("external_id")) > 0),
        F.concat_ws(":", have("source_name"), have("external_id")))
    values = {"A": F.concat(F.lit("assignment:"), have("assignment_id")), "D": document,
        "C": F.concat(F.lit("screening:"), have("screening_id")), "E": norm_ticker(have("ticker")), "F": norm_company(have("company"))}
    keys = F.array(*[F.struct(F.lit(x).alias("level"), F.lit(i).alias("rank"), values[x].alias("value")) for i, x in enumerate(LEVELS)])
    return rows.select("feedback_id", F.filter(keys, lambda k: k["value"].isNotNull()).alias("keys"))


def identity_keys(rows: DataFrame) -> DataFrame:
    """(feedback_id, level, rank, value) for each identity that a row has."""
    return _identities(rows).select("feedback_id", F.explode("keys").alias("k")).select("feedback_id", "k.*")


def duplicate_groups(rows: DataFrame) -> DataFrame:
    """(feedback_id, component), written: the least feedback_id that a row is connected with.

    Rows with the same identities become one node first, so the search is over distinct sets of identities, however many
    judgments speak of one idea. Only the rows of an id that occurs more than once are gathered to unite their identities.
    """
    with shuffles_removed(rows.sparkSession):
        own = materialize(_identities(rows).withColumn("keys", F.array_sort("keys")))
        again = materialize(own.groupBy("feedback_id").count().filter("count > 1").select("feedback_id"))
        if again.limit(1).count():
            united = own.join(again, "feedback_id", "left_semi").groupBy("feedback_id").agg(
                F.array_sort(F.array_distinct(F.flatten(F.collect_list("keys")))).alias("keys"))
            whole = materialize(own.join(again, "feedback_id", "left_anti").unionByName(united))
            release(own)
            own = whole
        nodes = materialize(own.filter(F.size("keys") > 0).groupBy("keys").agg(F.min("feedback_id").alias("rep")))
        placed = components_of(link_by_keys(nodes.select("rep", F.explode("keys").alias("k")).select("rep", "k.level", "k.value"), "rep"))
        named = nodes.join(placed, nodes["rep"] == placed["node"], "left").select("keys", F.coalesce("component", "rep").alias("component"))
        found = own.filter(F.size("keys") > 0).join(named, "keys").select("feedback_id", "component")
        out = materialize(found.unionByName(own.filter(F.size("keys") == 0).select("feedback_id", F.col("feedback_id").alias("component"))))
        release(own, again, nodes, placed)
        return out


def group_report(groups: DataFrame, keys: DataFrame) -> DataFrame:
    """One row a group of two or more: size, and the strongest identity that two of its members share (level -: only through others)."""
    sizes = groups.groupBy("component").agg(F.count("*").alias("n_members")).filter("n_members > 1")
    shared = keys.join(groups, "feedback_id").groupBy("component", "level", "rank", "value").agg(F.count("*").alias("c")).filter("c > 1")
    best = shared.groupBy("component").agg(F.min(F.struct("rank", "value", "level")).alias("b"))
    return sizes.join(best, "component", "left").select("component", "n_members", F.coalesce("b.level", F.lit("-")).alias("level"),
        F.coalesce("b.value", F.lit("linked transitively")).alias("value"))


#: Members of a group that are named in a report; the others are counted.
NAMED_REFS = 20


def identity_display(level, value):
    """What members of a group share, for people. Both are columns."""
    after = F.substring_index(value, ":", -1)
    return (F.when(level == "A", F.concat(F.lit("blind assignment BR-"), after)).when(level == "D",
        F.concat(F.lit("source "), F.regexp_replace(value, "^([^:]*):", "$1/"))).when(level == "C", F.concat(F.lit("screening SR-"), after))
        .when(level == "E", F.concat(F.lit("ticker "), value)).when(level == "F", F.concat(F.lit("company "), value)).otherwise(value))


def member_ref():
    """A row's short name: its assignment's, or else the judgment's."""
    return F.when(F.col("assignment_id").isNotNull(), F.concat(F.lit("BR-"), F.col("assignment_id").cast("string"))).otherwise(
        F.concat(F.lit("FB "), F.col("feedback_id").cast("string")))


def remediation(rows: DataFrame, groups: DataFrame, report: DataFrame) -> DataFrame:
    """One row for each group of report (group_report()): what its members share, the row to retain, those to go, and whether labels differ.

    rows: official and candidate rows with role, verdict, assignment_id and problems; groups: duplicate_groups() of them. An
    official row is retained before a candidate, one without problems before others, then the earliest. refs names the
    first NAMED_REFS of the group in that order, the retained one first; n_members counts them all.
    """
    rank = F.struct((F.col("role") != "official").alias("candidate"), (F.size("problems") > 0).alias("bad"), F.col("feedback_id").alias("id"))
    members = rows.join(groups, "feedback_id").join(report.select("component"), "component", "left_semi")
    m = members.select("component", rank.alias("rank"), member_ref().alias("ref"), "verdict", (F.col("role") == "official").alias("official"))
    first = m.withColumn("n", F.row_number().over(Window.partitionBy("component").orderBy("rank"))).filter(F.col("n") <= NAMED_REFS)  # limited before its shuffle
    refs = first.groupBy("component").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "ref"))), lambda x: x["ref"]),
        " / ").alias("refs"))
    whole = m.groupBy("component").agg(F.min("rank").alias("kept"), F.count_if("official").alias("n_official"),
        F.array_join(F.array_sort(F.collect_set(F.coalesce("verdict", F.lit("-")))), ", ").alias("labels"))
    out = report.join(whole, "component").join(refs, "component")
    return out.select("component", "n_members", "n_official", identity_display(F.col("level"), F.col("value")).alias("shared"),
        F.col("kept.id").alias("retained"), (F.col("n_members") - 1).alias("n_to_go"), "labels",
        F.col("labels").contains(",").alias("labels_differ"), "refs")


def remediation_plan(summary, plan: DataFrame, problem_rows: DataFrame, at_most: int = NAMED_REFS) -> list[str]:
    """Lines of what a person should do, from a row of audit_summary(); at most at_most groups and rows are named, with how many there are."""
    out = [f"{summary.replacements_needed} more blind judgments are needed"] if summary.replacements_needed else []
    if summary.n_official > HOLDOUT_SIZE:
        out.append(f"{summary.n_official} official rows, {HOLDOUT_SIZE} expected")
    groups, bad = plan.count(), problem_rows.filter(F.size("problems") > 0)
    out += [f"one idea ({r.shared}): keep FB {r.retained}, exclude the other {r.n_to_go}, and judge as many new ones: {r.refs}" for r in
        plan.orderBy("component").limit(at_most).collect()]
    out += [f"... and {groups - at_most} more groups"] if groups > at_most else []
    n = bad.count()
    out += [f"FB {r.feedback_id} ({r.role}): {', '.join(r.problems)}; decide by hand" for r in bad.orderBy("feedback_id").limit(at_most).collect()]
    return out + ([f"... and {n - at_most} more rows"] if n > at_most else [])


def training_overlap(holdout: DataFrame, training: DataFrame) -> DataFrame:
    """Hold-out rows that share a document, ticker or company with a training row: the strongest such level and the first training row there.

    The identities of training rows are counted: where they are few, those of the hold-out meet them without a shuffle.
    """
    of = lambda rows: identity_keys(rows).filter(F.col("level").isin(*TRAINING_LEVELS))
    first = materialize(of(training).groupBy("level", "value").agg(F.min("feedback_id").alias("training_feedback_id")))
    few = first.limit(MAX_BROADCAST_IDENTITIES + 1).count() <= MAX_BROADCAST_IDENTITIES
    hits = of(holdout).join(F.broadcast(first) if few else first, ["level", "value"])
    return hits.groupBy("feedback_id").agg(F.min(F.struct("rank", "level", "training_feedback_id")).alias("h")).select("feedback_id",
        "h.level", "h.training_feedback_id")


def usable_judgments(feedback: DataFrame, messages: DataFrame, assignments: DataFrame) -> DataFrame:
    """How many counted, parsed judgments each assignment has; 0 where none. feedback: with assignment_id."""
    parsed = feedback.filter(~is_excluded()).join(messages.filter("feedback_parse_status = 'PARSED'").select("message_id"), "message_id",
        "left_semi")
    n = parsed.groupBy("assignment_id").agg(F.count("*").alias("n"))
    return assignments.select("assignment_id").join(n, "assignment_id", "left").select("assignment_id",
        F.coalesce("n", F.lit(0)).alias("usable_judgments"))


def prior_exposure(judgments: DataFrame, exposures: DataFrame, order: str) -> DataFrame:
    """(feedback_id, exposed_feedback_id): earlier feedback that shows a source's prediction, for judgments of that source.

    exposures: feedback_id, order column, and source_id or screened_source_id. The two ways are two equi-joins, united.
    """
    theirs = lambda c: exposures.select(F.col("feedback_id").alias("exposed_feedback_id"), F.col(order).alias("__at"),
        F.col(c).alias("source_id")).filter("source_id IS NOT NULL")
    ways = [c for c in ("source_id", "screened_source_id") if c in exposures.columns]
    every = theirs(ways[0])
    for c in ways[1:]:
        every = every.unionByName(theirs(c))
    return judgments.join(every.distinct(), "source_id").filter(F.col("__at") < F.col(order)).select("feedback_id", "exposed_feedback_id")


def exposure_counts(judgments: DataFrame, exposures: DataFrame, order: str) -> DataFrame:
    """(feedback_id, n_exposures) by counts_before(): linear where prior_exposure() lists every pair, hot sources in slices.

    An exposure counts once for its own source and once for the one of its screening (screened_source_id), if that is another.
    """
    if "screened_source_id" in exposures.columns:
        ways = F.filter(F.array_distinct(F.array("source_id", "screened_source_id")), lambda x: x.isNotNull())
        exposures = exposures.withColumn("source_id", F.explode(ways))
    return counts_before(judgments.select("source_id", "feedback_id", order), exposures.select("source_id", order), ["source_id"],
        order).select("feedback_id", F.col("n").alias("n_exposures"))


def first_exposures(exposures: DataFrame, order: str) -> DataFrame:
    """(source_id, first_exposed): when a source's prediction was first shown, by its own or its screening's source. Where it only
    matters whether exposure_counts() are above 0, this says so for a judgment that comes later, by one aggregation."""
    ways = F.array(*[c for c in ("source_id", "screened_source_id") if c in exposures.columns])
    return exposures.select(F.explode(ways).alias("source_id"), order).filter("source_id IS NOT NULL").groupBy("source_id").agg(
        F.min(order).alias("first_exposed"))


def validity_problems(rows: DataFrame) -> DataFrame:
    """Adds problems, an array of codes in a fixed order. rows: official and candidate rows with usable_judgments, screening_id,
    explicit_screening_id, screened_at, shown_at, judged_at, n_exposures and training_level where known; shown_seq and judged_seq where these have no common clock;
    for n_exposures, first_exposed where feedback_id is the order of first_exposures()."""
    have = lambda c, t: F.col(c) if c in rows.columns else F.lit(None).cast(t)
    ticker, company = norm_ticker(have("ticker", "string")), norm_company(have("company", "string"))
    origin, assignment, judged = F.col("feedback_origin"), have("assignment_id", "long"), have("judged_at", "string")
    source, screening = have("source_id", "long"), have("screening_id", "long")
    checks = [
        ("OFFICIAL_NOT_BLIND", (F.col("role") == "official") & (origin != "BLIND_REVIEW")),
        ("NO_ASSIGNMENT", (origin == "BLIND_REVIEW") & assignment.isNull()),
        ("BLIND_WITH_SCREENING", (origin == "BLIND_REVIEW") & have("explicit_screening_id", "long").isNotNull()),
        ("NOT_HOLDOUT_ELIGIBLE", ~F.col("holdout_eligible").cast("boolean")),
        ("EXCLUDED", is_excluded()), ("NOT_PARSED", F.col("feedback_parse_status") != "PARSED"),
        ("USABLE_JUDGMENTS", assignment.isNotNull() & (have("usable_judgments", "long") != 1)),
        ("NO_SOURCE", source.isNull()), ("NO_SCREENING", source.isNotNull() & screening.isNull()),
        ("SCREENED_LATER", source.isNotNull() & (have("screened_at", "string") > judged)),
        ("SHOWN_BEFORE", F.coalesce(have("shown_at", "string") < judged, have("shown_seq", "long") < have("judged_seq", "long"))),
        ("PRIOR_EXPOSURE", F.coalesce(have("n_exposures", "long") > 0, have("first_exposed", "long") < F.col("feedback_id"))), ("SMOKE_TICKER", ticker.isin(*SMOKE_TICKERS)),
        ("SMOKE_COMPANY", company.isin(*[t.lower() for t in SMOKE_TICKERS])),
        ("TRAINING_OVERLAP", have("training_level", "string").isNotNull()),
    ]
    return rows.withColumn("problems", F.filter(F.array(*[F.when(c, name) for name, c in checks]), lambda x: x.isNotNull()))


def reconciliation(rows: DataFrame, pool: DataFrame, feedback: DataFrame, checkpoint: int) -> DataFrame:
    """One row: whether the official rows are exactly the hold-out pool (holdout_pool()), and whether the roles add up to all feedback after the checkpoint.

    rows: of roles(). A row on one side only makes the full join's other side null; nothing but counts is gathered.
    """
    official = rows.filter("role = 'official'").select("feedback_id", F.lit(1).alias("__in_audit"))
    both = official.join(pool.select("feedback_id", F.lit(1).alias("__in_pool")), "feedback_id", "full")
    same = both.agg(F.count_if(F.col("__in_audit").isNull() | F.col("__in_pool").isNull()).alias("n_different"))
    after = feedback.filter(F.col("feedback_id") > checkpoint).agg(F.count("*").alias("n_after"))
    n = rows.agg(*[F.count_if(F.col("role") == r).alias(f"n_{r}") for r in ("official", "candidate", "superseded", "other")])
    out = n.join(F.broadcast(same)).join(F.broadcast(after))  # one row each
    total = F.col("n_official") + F.col("n_candidate") + F.col("n_superseded") + F.col("n_other")
    return out.select("*", (F.col("n_different") == 0).alias("reconciles"), (total == F.col("n_after")).alias("reconciles_total"))


def audit_summary(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: members by role, unique and valid unique ideas, and whether the hold-out is clean. rows: with role and problems.

    A row that is alone in its group gives the group its id, so such rows are found by a count with map-side combine and
    joined by their id: a group is nowhere gathered, however large it is.
    """
    lone = groups.groupBy(F.col("component").alias("feedback_id")).agg(F.count("*").alias("n")).filter("n = 1").select("feedback_id",
        F.lit(True).alias("lone"))
    r = rows.select("feedback_id", "role", (F.size("problems") == 0).alias("ok"))  # narrow before it is shuffled
    r = r.join(groups, "feedback_id", "left").join(lone, "feedback_id", "left")
    official, ok = F.col("role") == "official", F.col("ok")
    alone, shared = F.col("lone").isNotNull(), F.col("component").isNotNull() & F.col("lone").isNull()
    out = r.agg(F.count_if(official).alias("n_official"), F.count_if(F.col("role") == "candidate").alias("n_candidates"),
        F.count_if(F.col("role") == "superseded").alias("n_superseded"),
                F.count_if(F.col("role") == "other").alias("n_other"), F.count_distinct(F.when(official,
                F.col("component"))).alias("n_unique"), F.count_if(official & ok & alone).alias("n_valid_unique"),
                F.count_if(official & ~ok).alias("n_problem_rows"), F.count_if(F.col("role").isin("official",
                "candidate") & (~ok | shared)).alias("n_questionable"))
    full = F.lit(HOLDOUT_SIZE)
    return out.select("*", F.greatest(full - F.col("n_official"), F.lit(0)).alias("replacements_needed"),
                      ((F.col("n_official") == full) & (F.col("n_valid_unique") == full) & (F.col("n_problem_rows") == 0) & (F.col("n_candidates") == 0)).alias("clean"))
