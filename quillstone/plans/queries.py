"""The registered queries over the projections, each with the SQL that must give the same rows in DuckDB.

Queries without SQL are held against brute force in the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import exprs, html, text
from quillstone.operators import audit, digest, evaluation, feedback, ideas, labels, narratives, replies, sources, state, training
from quillstone.operators.joins import latest_per_key
from quillstone.operators.log import EventLog
from quillstone.operators.storage import materialize, release, scratch_dir, shuffles_removed
from quillstone.plans.projections import projection, with_projections

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CHECKPOINT, TASTE = 20000, 2


class Views:
    """Projections by their name without p_, and base tables, of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return projection(self.spark, self.sf_dir, f"p_{name}")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function of views as a query, and its SQL if it has any."""

    def register(f: Callable[[Views], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = with_projections(sql)
        return f

    return register


ELIGIBLE = "SELECT f.* FROM p_feedback f JOIN p_messages m USING (message_id) WHERE f.excluded_from_learning = 0 AND m.feedback_parse_status = 'PARSED'"
CURRENT = "SELECT source_name, external_id, arg_max(source_id, observed_seq * 1000000000 + source_id) AS source_id FROM p_observations GROUP BY 1, 2"
VERDICT_CLASS = "CASE WHEN verdict IN ('STRONG_LIKE', 'LIKE') THEN 'INVESTIGATE_NOW' WHEN verdict = 'MAYBE' THEN 'WATCH' WHEN verdict IN ('PASS', 'STRONG_PASS') THEN 'PASS' END"
NORM_TICKER = "nullif(upper(regexp_replace(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'), '^\\$', '')), '')"
NORM_COMPANY = "nullif(lower(trim(regexp_replace(regexp_replace({0}, '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'))), '')"


# Messages and feedback

@query(f"""SELECT count(*) AS n_messages, {', '.join(f"count(*) FILTER (feedback_parse_status = '{s}') AS n_{s.lower()}" for s in feedback.STATUSES)} FROM p_messages""")
def status_counts(v: Views) -> DataFrame:
    return feedback.status_counts(v.messages)


@query("SELECT id, message_id, thread_id FROM p_messages WHERE feedback_parse_status IN ('UNPARSED', 'RETRYABLE_ERROR')")
def pending_messages(v: Views) -> DataFrame:
    return feedback.pending_messages(v.messages).select("id", "message_id", "thread_id")


@query("SELECT message_id FROM p_messages WHERE coalesce(sender_authenticated, '') = 'AUTHENTICATED'")
def authenticated_messages(v: Views) -> DataFrame:
    return v.messages.filter(F.coalesce("sender_authenticated", F.lit("")) == "AUTHENTICATED").select("message_id")


@query(f"SELECT feedback_id, message_id, event_index, verdict, ticker FROM ({ELIGIBLE})")
def eligible_feedback(v: Views) -> DataFrame:
    return feedback.eligible_feedback(v.feedback, v.messages).select("feedback_id", "message_id", "event_index", "verdict", "ticker")


@query(f"SELECT feedback_id, feedback_origin, verdict FROM ({ELIGIBLE}) WHERE feedback_id > {CHECKPOINT} AND holdout_eligible = 1")
def holdout_pool(v: Views) -> DataFrame:
    return feedback.holdout_pool(v.feedback, v.messages, CHECKPOINT).select("feedback_id", "feedback_origin", "verdict")


@query(f"""SELECT *, CAST(worth_watching AS DOUBLE) / nullif(n_strong_like + n_like + n_maybe + n_pass + n_strong_pass, 0) AS positive_share FROM (SELECT
 {', '.join(f"count(*) FILTER (verdict = '{x}') AS n_{x.lower()}" for x in exprs.VERDICTS)}, count(*) FILTER (verdict IS NULL) AS n_other, count(*) AS total,
 count(*) FILTER (verdict IN ('STRONG_LIKE', 'LIKE', 'MAYBE')) AS worth_watching, count(*) FILTER (verdict IN ('PASS', 'STRONG_PASS')) AS pass_family FROM ({ELIGIBLE}))""")
def label_distribution(v: Views) -> DataFrame:
    return feedback.label_distribution(feedback.eligible_feedback(v.feedback, v.messages))


@query("""SELECT message_id, 'NO_EVENTS' AS violation FROM p_messages WHERE feedback_parse_status IN ('PARSED', 'NEEDS_REVIEW') AND message_id NOT IN (SELECT message_id FROM p_feedback)
 UNION ALL SELECT message_id, 'UNEXPECTED_EVENTS' FROM p_messages WHERE feedback_parse_status NOT IN ('PARSED', 'NEEDS_REVIEW') AND message_id IN (SELECT message_id FROM p_feedback)""")
def invariant_violations(v: Views) -> DataFrame:
    return feedback.invariant_violations(v.feedback, v.messages)


@query("SELECT feedback_origin, count(*) AS n FROM p_feedback GROUP BY 1")
def count_by_origin(v: Views) -> DataFrame:
    return feedback.count_by_origin(v.feedback)


@query("""SELECT feedback_id, f.message_id, thread_id, received_at, feedback_parse_status, verdict, f.ticker, f.source_id, s.ticker AS source_ticker, collection_status, r.taste_version AS reviewed_taste_version, r.overall_prediction AS reviewed_prediction
 FROM p_feedback f JOIN p_messages m USING (message_id) LEFT JOIN p_sources s ON s.source_id = f.source_id LEFT JOIN p_screenings r ON r.screening_id = f.feedback_id % 5000 ORDER BY feedback_id DESC LIMIT 25""")
def latest_feedback_topn(v: Views) -> DataFrame:
    return feedback.latest_feedback(v.feedback.withColumn("screening_id", F.col("feedback_id") % 5000), v.messages, v.sources, 25, v.screenings)


@query("""SELECT m.message_id, coalesce(n, 0) AS n_events, n IS NOT NULL AS approvable FROM p_messages m LEFT JOIN (SELECT message_id, count(*) AS n FROM p_feedback GROUP BY 1) USING (message_id) WHERE feedback_parse_status = 'NEEDS_REVIEW'""")
def messages_under_review(v: Views) -> DataFrame:
    return feedback.under_review(v.messages, v.feedback)


# States as views over events

@query("""SELECT m.message_id, CASE WHEN s.seq IS NULL THEN m.feedback_parse_status ELSE s.status END AS feedback_parse_status, s.error, coalesce(n, 0) AS attempt_count, last_attempt_at FROM p_messages m
 LEFT JOIN (SELECT * FROM p_message_events WHERE kind = 'STATUS' QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY seq DESC) = 1) s USING (message_id)
 LEFT JOIN (SELECT message_id, count(*) AS n, max("at") AS last_attempt_at FROM p_message_events WHERE kind = 'ATTEMPT' GROUP BY 1) a USING (message_id)""")
def current_message_states(v: Views) -> DataFrame:
    return state.current_messages(v.messages, v.message_events).select("message_id", "feedback_parse_status", "error", "attempt_count", "last_attempt_at")


CURRENT_FEEDBACK = """SELECT f.feedback_id, f.message_id, CASE WHEN e.kind IS NULL THEN f.excluded_from_learning = 1 ELSE e.kind = 'EXCLUDE' END AS excluded_from_learning FROM p_feedback f
 LEFT JOIN (SELECT * FROM p_feedback_events WHERE kind <> 'DELETE' QUALIFY row_number() OVER (PARTITION BY feedback_id ORDER BY seq DESC) = 1) e USING (feedback_id)
 WHERE f.feedback_id NOT IN (SELECT feedback_id FROM p_feedback_events WHERE kind = 'DELETE')"""


@query(CURRENT_FEEDBACK)
def current_feedback_states(v: Views) -> DataFrame:
    return state.current_feedback(v.feedback, v.feedback_events).select("feedback_id", "message_id", "excluded_from_learning")


@query("""SELECT s.source_id, coalesce(c.collection_status, s.collection_status) AS collection_status, CASE WHEN x.source_id IS NOT NULL THEN 'EXTRACTED' ELSE s.extraction_status END AS extraction_status, i.reason AS invalid_reason, o.seen AS last_observed_at
 FROM p_sources s LEFT JOIN (SELECT source_id, arg_max(collection_status, seq) AS collection_status FROM p_source_events WHERE kind IN ('STATUS', 'INVALID') GROUP BY 1) c USING (source_id)
 LEFT JOIN (SELECT DISTINCT source_id FROM p_source_events WHERE kind = 'EXTRACTED') x USING (source_id) LEFT JOIN (SELECT source_id, arg_max(reason, seq) AS reason FROM p_source_events WHERE kind = 'INVALID' GROUP BY 1) i USING (source_id)
 LEFT JOIN (SELECT source_id, max("at") AS seen FROM p_source_events WHERE kind = 'OBSERVED' GROUP BY 1) o USING (source_id)""")
def current_source_states(v: Views) -> DataFrame:
    return state.current_source_state(v.sources, v.source_events).select("source_id", "collection_status", "extraction_status", "invalid_reason", "last_observed_at")


@query("""SELECT feedback_id, CASE WHEN excluded_from_learning = 1 THEN 'INCLUDE' ELSE 'EXCLUDE' END AS kind FROM p_feedback WHERE (lower(ticker) = 'tk7' OR lower(company) = 'tk7') AND excluded_from_learning = 0""")
def exclusions_of_an_idea(v: Views) -> DataFrame:
    return state.exclusions(v.feedback, "t", about="TK7").select("feedback_id", "kind")


@query("""SELECT message_id AS id, 'message' AS what FROM p_messages WHERE feedback_parse_status = 'NEEDS_REVIEW' UNION ALL
 SELECT CAST(feedback_id AS VARCHAR), 'feedback' FROM p_feedback WHERE message_id IN (SELECT message_id FROM p_messages WHERE feedback_parse_status = 'NEEDS_REVIEW')""")
def requeue_events(v: Views) -> DataFrame:
    changed, gone = state.requeued(v.messages, v.feedback, "t")
    return changed.select(F.col("message_id").alias("id"), F.lit("message").alias("what")).union(gone.select(F.col("feedback_id").cast("string"), F.lit("feedback")))


# Idea records and predictions

@query("SELECT idea_id, max(prediction_id) AS prediction_id, arg_max(overall_prediction, prediction_id) AS overall_prediction FROM p_predictions GROUP BY 1")
def latest_idea_predictions(v: Views) -> DataFrame:
    return ideas.latest_predictions(v.predictions).select("idea_id", "prediction_id", "overall_prediction")


@query(f"""SELECT idea_id, message_id FROM p_ideas WHERE source_status = 'ISOLATED' AND extraction_status = 'EXTRACTED' AND idea_id NOT IN (SELECT idea_id FROM p_predictions WHERE taste_version = {TASTE} AND screen_rules_sha256 = 'r1')""")
def ideas_without_prediction(v: Views) -> DataFrame:
    return ideas.without_prediction(v.ideas, v.predictions, TASTE, "r1").select("idea_id", "message_id")


@query("SELECT idea_id, ticker FROM p_ideas WHERE source_status = 'ISOLATED' AND extraction_status <> 'EXTRACTED'")
def ideas_pending_extraction(v: Views) -> DataFrame:
    return ideas.pending_extraction(v.ideas).select("idea_id", "ticker")


@query(f"""SELECT (SELECT count(*) FROM ({ELIGIBLE}) WHERE feedback_id > {CHECKPOINT} AND holdout_eligible = 1) AS n_holdout, (SELECT count(*) FROM p_ideas WHERE source_status = 'ISOLATED') AS n_isolated,
 (SELECT count(*) FROM p_ideas WHERE source_status = 'UNSCORABLE_SOURCE') AS n_unscorable, (SELECT count(*) FROM p_predictions WHERE taste_version = {TASTE}) AS n_predictions""")
def shadow_counters(v: Views) -> DataFrame:
    return ideas.sweep_counters(v.ideas, v.predictions, v.feedback, v.messages, CHECKPOINT, TASTE)


@query(f"""SELECT idea_id, e.feedback_id, e.verdict, p.overall_prediction FROM (SELECT * FROM p_predictions QUALIFY row_number() OVER (PARTITION BY idea_id ORDER BY prediction_id DESC) = 1) p JOIN p_ideas USING (idea_id) JOIN ({ELIGIBLE}) e USING (message_id)""")
def revealed_predictions(v: Views) -> DataFrame:
    return ideas.revealed(v.ideas, v.predictions, v.feedback, v.messages).select("idea_id", "feedback_id", "verdict", "overall_prediction")


@query("""SELECT min(prediction_id) AS prediction_id, idea_id, taste_version, screen_rules_sha256 FROM p_predictions WHERE prediction_id >= 5000 AND (idea_id, taste_version, screen_rules_sha256) NOT IN
 (SELECT (idea_id, taste_version, screen_rules_sha256) FROM p_predictions WHERE prediction_id < 5000) GROUP BY ALL""")
def predictions_to_insert(v: Views) -> DataFrame:
    """The later half of the predictions against a store that has the earlier: each (idea, version, rules) goes in once, by its first."""
    made = v.predictions.filter("prediction_id >= 5000").groupBy(*ideas.VERSION).agg(F.min("prediction_id").alias("prediction_id"))
    return ideas.new_predictions(made, v.predictions.filter("prediction_id < 5000")).select("prediction_id", *ideas.VERSION)


# Narratives

def _substantive(c: str) -> str:
    words = ", ".join(f"'{p}'" for p in text.PLACEHOLDERS)
    return f"list_filter(list_transform({c}, lambda x: trim(x)), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]') AND rtrim(lower(x), '.:;!,') NOT IN ({words}))"


def _effective(c: str) -> str:
    return f"CASE WHEN len({_substantive('n.' + c)}) > 0 THEN {_substantive('n.' + c)} ELSE coalesce({_substantive('r.' + c)}, []) END AS {c}"


EFFECTIVE = f"""SELECT screening_id, {', '.join(_effective(c) for c in text.NARRATIVE)} FROM p_narratives n LEFT JOIN (SELECT * FROM p_repairs WHERE status = 'REPAIRED' QUALIFY row_number() OVER (PARTITION BY screening_id ORDER BY repair_id DESC) = 1) r USING (screening_id)"""
GAPS = f"""SELECT e.*, s.source_id, s.overall_prediction, CASE WHEN s.overall_prediction IN ('WATCH', 'INVESTIGATE_NOW') THEN concat_ws(',', {', '.join(f"CASE WHEN len({c}) = 0 THEN '{c}' END" for c in text.NARRATIVE)}) ELSE '' END AS gaps FROM ({EFFECTIVE}) e JOIN p_screenings s USING (screening_id)"""


def _narrated(v: Views) -> DataFrame:
    return v.screenings.join(v.narratives, "screening_id")


@query(f"SELECT screening_id, {', '.join(f"array_to_string({c}, '|') AS {c}" for c in text.NARRATIVE)}, gaps FROM ({GAPS})")
def effective_narratives(v: Views) -> DataFrame:
    rows = narratives.with_gaps(narratives.effective(_narrated(v), v.repairs))
    return rows.select("screening_id", *[F.array_join(c, "|").alias(c) for c in text.NARRATIVE], F.array_join("gaps", ",").alias("gaps"))


@query(f"""SELECT g.overall_prediction, count(*) AS n, count(*) FILTER (o.gaps <> '') AS n_own_gap, count(*) FILTER (g.gaps <> '') AS n_gap FROM ({GAPS}) g
 JOIN ({GAPS.replace("status = 'REPAIRED'", "false")}) o USING (screening_id) GROUP BY 1""")
def narrative_audit(v: Views) -> DataFrame:
    return narratives.audit(_narrated(v), v.repairs)


@query(f"""SELECT screening_id, overall_prediction, gaps FROM ({GAPS.replace("status = 'REPAIRED'", "false")}) WHERE gaps <> '' AND screening_id NOT IN (SELECT screening_id FROM p_repairs)""")
def repairable_narratives(v: Views) -> DataFrame:
    return narratives.repairable(_narrated(v), v.repairs).select("screening_id", "overall_prediction", F.array_join("gaps", ",").alias("gaps"))


@query(f"""SELECT screening_id, repair_id, status, source_id, concat_ws(',', {', '.join(f"CASE WHEN len({_substantive('p.' + c)}) > 0 THEN '{c}' END" for c in text.NARRATIVE)}) AS returned, g.gaps = '' AS complete FROM p_repairs p JOIN ({GAPS}) g USING (screening_id)
 WHERE screening_id IN (SELECT max(screening_id) FROM p_screenings GROUP BY source_id)""")
def narrative_repair_listing(v: Views) -> DataFrame:
    return narratives.repair_listing(_narrated(v), v.repairs).select("screening_id", "repair_id", "status", "source_id", F.array_join("returned", ",").alias("returned"), "complete")


# Training corpus and labels

@query("""SELECT feedback_id, concat_ws(chr(10), 'idea = ' || coalesce(nullif(ticker, ''), nullif(company, ''), '?'), 'kind = ' || event_type, 'verdict = ' || coalesce(verdict, 'none'), 'comment = ' || user_comment,
 CASE WHEN parsed_json LIKE '{%' THEN 'positive_reasons = p' || feedback_id || ' | q' END) AS text FROM p_judged_notes""")
def training_texts(v: Views) -> DataFrame:
    return training.record_texts(training.training_records(v.judged_notes))


@query("""SELECT feedback_id, concat_ws(' | ', 'FB ' || feedback_id, coalesce(ticker, nullif(company, ''), '-'), '-', coalesce(verdict, '-'), '-') AS label, concat_ws(' / ', coalesce(ticker, '-'), coalesce(company, '-')) AS pair FROM p_feedback""")
def feedback_labels(v: Views) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = v.feedback.withColumn("event_type", none).withColumn("user_comment", none)
    return rows.select("feedback_id", labels.feedback_label().alias("label"), labels.idea_pair().alias("pair"))


@query("SELECT feedback_id, ticker, company FROM p_feedback WHERE lower(ticker) = 'tk7' OR lower(company) = 'tk7'")
def feedback_by_ticker_or_company(v: Views) -> DataFrame:
    return feedback.feedback_about(v.feedback, "TK7").select("feedback_id", "ticker", "company")


@query("""SELECT m.message_id, feedback_parse_status, reason IS NULL AS may_requeue, reason, feedback_parse_status = 'NEEDS_REVIEW' AND n > 0 AS drops_events FROM (
 SELECT m.message_id, m.feedback_parse_status, coalesce(n, 0) AS n, CASE WHEN feedback_parse_status IN ('UNPARSED', 'RETRYABLE_ERROR') THEN 'ALREADY_PENDING' WHEN feedback_parse_status = 'PARSED' THEN 'ALREADY_PARSED'
 WHEN feedback_parse_status = 'NO_FEEDBACK' THEN 'HAS_NO_FEEDBACK' END AS reason FROM p_messages m LEFT JOIN (SELECT message_id, count(*) AS n FROM p_feedback GROUP BY 1) USING (message_id)) m""")
def requeue_decisions(v: Views) -> DataFrame:
    return feedback.requeue_decision(v.messages, v.feedback)


@query("SELECT message_id FROM p_messages WHERE feedback_parse_status = 'NEEDS_REVIEW' AND message_id IN (SELECT message_id FROM p_feedback)")
def approvable_messages(v: Views) -> DataFrame:
    return feedback.approvable(v.messages, v.feedback).select("message_id")


@query(f"SELECT DISTINCT {NORM_TICKER.format('ticker')} AS norm_ticker, {NORM_COMPANY.format('company')} AS norm_company FROM p_sources")
def normalized_identities(v: Views) -> DataFrame:
    return digest.with_identity(v.sources).select("norm_ticker", "norm_company").distinct()


# Sources and their versions

@query(f"SELECT s.source_id, s.external_id, s.collection_status FROM p_sources s JOIN ({CURRENT}) c USING (source_id)")
def current_sources(v: Views) -> DataFrame:
    return sources.current_sources(v.sources, v.observations).select("source_id", "external_id", "collection_status")


@query("SELECT source_name, external_id, count(*) AS n_versions, min(source_id) AS first_version, max(source_id) AS last_version FROM p_sources GROUP BY 1, 2")
def source_versions(v: Views) -> DataFrame:
    return sources.source_versions(v.sources)


@query("""SELECT source_name, count(DISTINCT external_id) AS n_documents, count(*) AS n_versions, count(*) FILTER (collection_status = 'COLLECTED') AS n_collected,
 count(*) FILTER (collection_status = 'INCOMPLETE_CONTENT') AS n_incomplete_content, count(*) FILTER (extraction_status = 'PENDING') AS n_pending, count(*) FILTER (extraction_status = 'EXTRACTED') AS n_extracted FROM p_sources GROUP BY 1""")
def source_status_counters(v: Views) -> DataFrame:
    return sources.source_counters(v.sources)


@query("SELECT source_name, max(CAST(discovered_seq AS VARCHAR)) AS newest FROM p_sources GROUP BY 1")
def newest_source_date(v: Views) -> DataFrame:
    return sources.newest_text(v.sources, "discovered_seq")


@query(f"SELECT s.source_id, s.external_id FROM p_sources s JOIN ({CURRENT}) c USING (source_id) WHERE extraction_status = 'PENDING' AND collection_status = 'COLLECTED'")
def pending_extraction(v: Views) -> DataFrame:
    return sources.pending_extraction(v.sources, v.observations, "catalog").select("source_id", "external_id")


@query(f"""SELECT s.source_id, s.external_id FROM p_sources s JOIN ({CURRENT}) c USING (source_id) WHERE extraction_status = 'EXTRACTED' AND collection_status = 'COLLECTED'
 AND s.source_id NOT IN (SELECT source_id FROM p_screenings WHERE taste_version = {TASTE})""")
def missing_screening(v: Views) -> DataFrame:
    return sources.missing_screening(v.sources, v.observations, v.screenings, TASTE).select("source_id", "external_id")


@query("SELECT source_name, count(*) AS n_screened FROM p_sources WHERE source_id IN (SELECT source_id FROM p_screenings) GROUP BY 1")
def screened_sources_count(v: Views) -> DataFrame:
    return sources.screened_sources_count(v.sources, v.screenings)


@query("SELECT source_id, max(screening_id) AS screening_id, arg_max(overall_prediction, screening_id) AS overall_prediction FROM p_screenings GROUP BY 1")
def latest_screening_per_source(v: Views) -> DataFrame:
    return sources.latest_screening(v.screenings).select("source_id", "screening_id", "overall_prediction")


@query("SELECT source_id, taste_version, max(screening_id) AS screening_id FROM p_screenings GROUP BY 1, 2")
def latest_screening_per_version(v: Views) -> DataFrame:
    return sources.latest_screening(v.screenings, "taste_version").select("source_id", "taste_version", "screening_id")


@query("""SELECT source_id, screening_id, created_at, overall_prediction, external_id, ticker, collection_status FROM p_screenings JOIN p_sources USING (source_id)
 ORDER BY created_at DESC, screening_id DESC LIMIT 20""")
def recent_screenings_all(v: Views) -> DataFrame:
    return sources.recent_screenings(v.sources, v.screenings, 20).select("source_id", "screening_id", "created_at", "overall_prediction", "external_id", "ticker", "collection_status")


@query(f"""SELECT source_id, screening_id, created_at, external_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY screening_id DESC) AS rn FROM p_screenings)
 JOIN p_sources USING (source_id) WHERE rn = 1 AND collection_status = 'COLLECTED' AND source_id IN (SELECT source_id FROM ({CURRENT})) ORDER BY created_at DESC, screening_id DESC LIMIT 20""")
def recent_screenings_current(v: Views) -> DataFrame:
    return sources.recent_current_screenings(v.sources, v.observations, v.screenings, 20).select("source_id", "screening_id", "created_at", "external_id")


@query(f"""SELECT source_id, external_id, screening_id, overall_prediction FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY screening_id DESC) AS rn FROM p_screenings WHERE taste_version = {TASTE})
 JOIN p_sources USING (source_id) WHERE rn = 1 AND collection_status = 'COLLECTED' AND source_id IN (SELECT source_id FROM ({CURRENT}))""")
def screenings_for_audit(v: Views) -> DataFrame:
    return sources.screenings_for_audit(v.sources, v.observations, v.screenings, TASTE).select("source_id", "external_id", "screening_id", "overall_prediction")


@query("SELECT screening_id, max(repair_id) AS repair_id, arg_max(key_reason, repair_id) AS key_reason FROM p_repairs WHERE status = 'REPAIRED' GROUP BY 1")
def latest_repairs(v: Views) -> DataFrame:
    return sources.latest_repairs(v.repairs).select("screening_id", "repair_id", "key_reason")


# Digest and blind review

POOL = f"""SELECT s.source_id, s.external_id, s.ticker, s.company, r.screening_id, r.created_at, r.overall_prediction FROM p_sources s JOIN ({CURRENT}) c USING (source_id)
 JOIN (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY screening_id DESC) AS rn FROM p_screenings WHERE taste_version = {TASTE}) r ON r.source_id = s.source_id AND r.rn = 1
 WHERE s.collection_status = 'COLLECTED' AND r.overall_prediction <> 'PASS' AND s.source_id NOT IN (SELECT source_id FROM p_shown)"""
JUDGED = f"""SELECT p.*, CASE WHEN {NORM_TICKER.format('p.ticker')} IS NOT NULL THEN {NORM_TICKER.format('p.ticker')} IN (SELECT {NORM_TICKER.format('ticker')} FROM e WHERE ticker IS NOT NULL)
 ELSE coalesce({NORM_COMPANY.format('p.company')} IN (SELECT {NORM_COMPANY.format('company')} FROM e), false) END AS judged, g.gaps <> '' AS gap FROM pool p JOIN ({GAPS}) g USING (screening_id)"""
JUDGED_CTES = f"WITH e AS ({ELIGIBLE}), pool AS ({POOL}), j AS ({JUDGED})"


def _judged_pool(v: Views) -> DataFrame:
    """The digest's pool with judged and gap: whether the effective narrative lacks what its prediction needs."""
    pool = digest.digest_pool(v.sources, v.observations, v.screenings, v.shown, TASTE)
    told = narratives.with_gaps(narratives.effective(_narrated(v), v.repairs)).select("screening_id", "gap")
    return digest.judged_pool(pool.join(told, "screening_id"), v.feedback, v.messages)


@query(POOL)
def digest_pool(v: Views) -> DataFrame:
    return digest.digest_pool(v.sources, v.observations, v.screenings, v.shown, TASTE)


@query(f"""{JUDGED_CTES} SELECT source_id, screening_id, overall_prediction, row_number() OVER (ORDER BY CASE WHEN overall_prediction = 'INVESTIGATE_NOW' THEN 0 ELSE 1 END, created_at, screening_id) AS position
 FROM j WHERE NOT judged AND NOT gap AND overall_prediction IN ('INVESTIGATE_NOW', 'WATCH') QUALIFY position <= 5""")
def digest_selection_top5(v: Views) -> DataFrame:
    return digest.select_digest(_judged_pool(v)).select("source_id", "screening_id", "overall_prediction", "position")


@query(f"{JUDGED_CTES} SELECT count(*) AS n_candidates, count(*) FILTER (judged) AS n_already_judged, count(*) FILTER (NOT judged AND gap) AS n_narrative_gaps FROM j")
def digest_suppression_counters(v: Views) -> DataFrame:
    return digest.suppression_counters(_judged_pool(v))


BLIND_POOL = f"""SELECT s.* FROM p_sources s JOIN ({CURRENT}) c USING (source_id) WHERE extraction_status = 'EXTRACTED' AND collection_status = 'COLLECTED' AND s.source_id NOT IN (SELECT source_id FROM p_shown)
 AND s.source_id NOT IN (SELECT source_id FROM p_assignments) AND s.source_id NOT IN (SELECT source_id FROM p_screenings WHERE source_id IN (SELECT source_id FROM p_feedback WHERE feedback_origin = 'SCREEN_REVIEW' AND excluded_from_learning = 0))"""


def _blind_pool(v: Views) -> DataFrame:
    return digest.blind_review_pool(v.sources, v.observations, v.shown, v.assignments, v.screenings, v.feedback)


@query(f"SELECT source_id, external_id, discovered_seq FROM ({BLIND_POOL})")
def blind_review_pool(v: Views) -> DataFrame:
    return _blind_pool(v).select("source_id", "external_id", "discovered_seq")


#: Reviews that are assigned at once.
ASSIGNED = 60
PROSPECTS = f"SELECT source_id, discovered_seq, {NORM_TICKER.format('ticker')} AS t, {NORM_COMPANY.format('company')} AS c, assigned FROM p_prospects"


@query(f"""WITH RECURSIVE p AS ({PROSPECTS}), known AS (SELECT * FROM p WHERE assigned = 1), f AS (SELECT row_number() OVER (ORDER BY discovered_seq, source_id) AS n, source_id, coalesce(t, '') AS t, coalesce(c, '') AS c FROM p
 WHERE assigned = 0 AND (t IS NULL OR t NOT IN (SELECT t FROM known WHERE t IS NOT NULL)) AND (c IS NULL OR c NOT IN (SELECT c FROM known WHERE c IS NOT NULL))),
 g(position, source_id, n, ts, cs) AS (SELECT 0, CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[])
 UNION ALL SELECT * FROM (SELECT g.position + 1, f.source_id, f.n, list_append(g.ts, f.t), list_append(g.cs, f.c) FROM g JOIN f ON f.n > g.n AND (f.t = '' OR NOT list_contains(g.ts, f.t)) AND (f.c = '' OR NOT list_contains(g.cs, f.c))
 WHERE g.position < {ASSIGNED} ORDER BY f.n LIMIT 1)) SELECT position, source_id FROM g WHERE position > 0""")
def greedy_blind_assignment(v: Views) -> DataFrame:
    known = digest.identities(v.prospects.filter("assigned = 1"))
    return digest.greedy_assignments(v.prospects.filter("assigned = 0"), known, ASSIGNED)


@query("SELECT assignment_id, source_id, ticker, assigned_seq FROM p_assignments JOIN p_sources USING (source_id) WHERE judged_seq IS NULL")
def unjudged_assignments(v: Views) -> DataFrame:
    return v.assignments.filter("judged_seq IS NULL").join(v.sources.select("source_id", "ticker"), "source_id").select("assignment_id", "source_id", "ticker", "assigned_seq")


@query("""SELECT a.assignment_id, a.judged_seq, f.feedback_id, f.verdict, s.ticker FROM p_assignments a JOIN p_sources s USING (source_id) JOIN p_feedback f ON f.source_id = a.source_id
 WHERE a.judged_seq IS NOT NULL AND f.feedback_origin = 'BLIND_REVIEW' ORDER BY a.judged_seq DESC, a.assignment_id DESC, f.feedback_id DESC LIMIT 30""")
def judged_assignments_reveal(v: Views) -> DataFrame:
    f = v.feedback.filter("feedback_origin = 'BLIND_REVIEW'").select("source_id", "feedback_id", "verdict")
    rows = v.assignments.filter("judged_seq IS NOT NULL").join(v.sources.select("source_id", "ticker"), "source_id").join(f, "source_id")
    return rows.orderBy(F.desc("judged_seq"), F.desc("assignment_id"), F.desc("feedback_id")).limit(30).select("assignment_id", "judged_seq", "feedback_id", "verdict", "ticker")


@query("SELECT provider_thread_id, max(delivery_id) AS delivery_id, arg_max(taste_version, delivery_id) AS taste_version FROM p_deliveries WHERE provider_thread_id <> '' GROUP BY 1")
def delivery_by_thread(v: Views) -> DataFrame:
    return digest.delivery_by_thread(v.deliveries).select("provider_thread_id", "delivery_id", "taste_version")


@query("SELECT delivery_id, position, source_id, ticker, external_id FROM p_delivery_items JOIN p_sources USING (source_id)")
def delivery_items(v: Views) -> DataFrame:
    return digest.delivery_items(v.delivery_items, v.sources).select("delivery_id", "position", "source_id", "ticker", "external_id")


@query("""SELECT sent_at, substr(sha256(strftime(sent_at, '%Y-%m-%d') || '|' || string_agg(CAST(source_id AS VARCHAR), '-' ORDER BY source_id)), 1, 32) AS idempotency_key, delivery_id
 FROM p_deliveries JOIN p_delivery_items USING (delivery_id) GROUP BY delivery_id, sent_at""")
def idempotency_key(v: Views) -> DataFrame:
    ids = v.delivery_items.groupBy("delivery_id").agg(F.collect_list("source_id").alias("ids"))
    return v.deliveries.join(ids, "delivery_id").select("delivery_id", "sent_at", exprs.idempotency_key(F.date_format("sent_at", "yyyy-MM-dd"), F.col("ids")).alias("idempotency_key"))


# Evaluation

ASOF = f"""SELECT j.feedback_id, j.source_id, j.verdict, s.screening_id, s.overall_prediction FROM p_judgments j LEFT JOIN p_screenings s ON s.source_id = j.source_id AND s.taste_version = {TASTE} AND s.created_at <= j.judged_at
 QUALIFY row_number() OVER (PARTITION BY j.feedback_id ORDER BY s.created_at DESC NULLS LAST, s.screening_id DESC NULLS LAST) = 1"""
EVAL = f"""SELECT feedback_id, verdict, overall_prediction AS p, {VERDICT_CLASS} AS a FROM ({ASOF}) WHERE overall_prediction IS NOT NULL AND verdict IS NOT NULL"""
KIND = """CASE WHEN p = 'INSUFFICIENT_INFORMATION' THEN 'unscored' WHEN p = a THEN 'correct' WHEN a IN ('INVESTIGATE_NOW', 'WATCH') AND p = 'PASS' THEN 'false_negative' WHEN a = 'PASS' AND p IN ('INVESTIGATE_NOW', 'WATCH') THEN 'false_positive' ELSE 'severity_mismatch' END"""
BUCKET = """CASE WHEN p = a THEN 8 WHEN p = 'PASS' THEN CASE verdict WHEN 'STRONG_LIKE' THEN 1 WHEN 'LIKE' THEN 2 WHEN 'MAYBE' THEN 3 ELSE 7 END WHEN verdict IN ('STRONG_LIKE', 'LIKE') AND p = 'WATCH' THEN 4
 WHEN verdict IN ('PASS', 'STRONG_PASS') AND p = 'INVESTIGATE_NOW' THEN 5 WHEN verdict IN ('PASS', 'STRONG_PASS') AND p = 'WATCH' THEN 6 ELSE 7 END"""
METRICS = f"""SELECT *, (recall + specificity) / 2 AS balanced_accuracy FROM (SELECT *, CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS "precision", CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS recall, CAST(tn AS DOUBLE) / nullif(tn + fp, 0) AS specificity,
 CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0) AS f1, CAST(hc_hit AS DOUBLE) / nullif(hc_actual, 0) AS hc_recall, CAST(n_pass_predicted AS DOUBLE) / nullif(n, 0) AS pass_predicted_share,
 CAST(n_pass_actual AS DOUBLE) / nullif(n, 0) AS pass_actual_share, CAST(n_positive_actual AS DOUBLE) / nullif(n, 0) AS positive_actual_share FROM (SELECT count(*) AS n, count(*) FILTER (p = a) AS exact_correct,
 count(*) FILTER (p <> 'INSUFFICIENT_INFORMATION') AS n_scored, count(*) FILTER (a <> 'PASS' AND p IN ('INVESTIGATE_NOW', 'WATCH')) AS tp, count(*) FILTER (a = 'PASS' AND p IN ('INVESTIGATE_NOW', 'WATCH')) AS fp,
 count(*) FILTER (a = 'PASS' AND p = 'PASS') AS tn, count(*) FILTER (a <> 'PASS' AND p = 'PASS') AS fn, count(*) FILTER (a = 'INVESTIGATE_NOW') AS hc_actual, count(*) FILTER (a = 'INVESTIGATE_NOW' AND p = 'INVESTIGATE_NOW') AS hc_hit,
 count(*) FILTER (p = 'PASS') AS n_pass_predicted, count(*) FILTER (a = 'PASS') AS n_pass_actual, count(*) FILTER (a <> 'PASS') AS n_positive_actual FROM ({EVAL})))"""


def _evaluated(v: Views) -> DataFrame:
    return evaluation.evaluation_rows(evaluation.asof_predictions(v.judgments, v.screenings, TASTE))


@query(ASOF)
def asof_predictions(v: Views) -> DataFrame:
    return evaluation.asof_predictions(v.judgments, v.screenings, TASTE).select("feedback_id", "source_id", "verdict", "screening_id", "overall_prediction")


@query(f"SELECT a AS actual, {', '.join(f"count(*) FILTER (p = '{p}') AS predicted_{p.lower()}" for p in exprs.PREDICTIONS)} FROM ({EVAL}) GROUP BY a")
def confusion_matrix(v: Views) -> DataFrame:
    return evaluation.confusion_matrix(_evaluated(v))


@query(METRICS)
def binary_metrics(v: Views) -> DataFrame:
    return evaluation.metrics(_evaluated(v))


@query(f"SELECT {BUCKET} AS bucket, {KIND} AS kind, count(*) AS n, min(feedback_id) AS first_feedback_id FROM ({EVAL}) GROUP BY 1, 2")
def error_buckets(v: Views) -> DataFrame:
    return evaluation.error_table(_evaluated(v))


@query(f"""WITH m AS ({METRICS.replace('p_judgments', 'p_harsh_judgments')}) SELECT 'ALMOST_ALL_PASS' AS warning FROM m WHERE pass_predicted_share >= 0.9 UNION ALL SELECT 'FEW_POSITIVES' FROM m WHERE positive_actual_share < 0.25
 UNION ALL SELECT 'MANY_POSITIVES' FROM m WHERE positive_actual_share > 0.75""")
def class_balance_warnings(v: Views) -> DataFrame:
    """Of judgments of which few are positive."""
    return evaluation.balance_warnings(evaluation.metrics(evaluation.evaluation_rows(evaluation.asof_predictions(v.harsh_judgments, v.screenings, TASTE))))


@query(f"""SELECT feedback_id, verdict, overall_prediction, CASE WHEN verdict IN ('STRONG_LIKE', 'LIKE') THEN 'positive' WHEN verdict = 'MAYBE' THEN 'neutral' WHEN verdict IN ('PASS', 'STRONG_PASS') THEN 'negative' END
 = CASE overall_prediction WHEN 'INVESTIGATE_NOW' THEN 'positive' WHEN 'WATCH' THEN 'neutral' WHEN 'PASS' THEN 'negative' END AS matches FROM ({ASOF})""")
def categorical_match(v: Views) -> DataFrame:
    return evaluation.asof_predictions(v.judgments, v.screenings, TASTE).select("feedback_id", "verdict", "overall_prediction", exprs.categorical_match(F.col("verdict"), F.col("overall_prediction")).alias("matches"))


@query(f"""SELECT feedback_id, count(DISTINCT screening_prompt_version) AS n_prompt_versions FROM p_judgments j JOIN p_screenings s ON s.source_id = j.source_id AND s.taste_version = {TASTE} AND s.created_at <= j.judged_at
 GROUP BY 1 HAVING count(DISTINCT screening_prompt_version) > 1""")
def mixed_prompt_versions(v: Views) -> DataFrame:
    return evaluation.prompt_versions(v.judgments, v.screenings, TASTE)


# Hold-out audit

ROLE = f"""SELECT f.*, CASE WHEN m.feedback_parse_status = 'PARSED' AND excluded_from_learning = 0 AND holdout_eligible = 1 THEN 'official' WHEN feedback_origin = 'BLIND_REVIEW' AND excluded_from_learning = 1 AND f.feedback_id % 3 = 0 THEN 'superseded'
 WHEN feedback_origin = 'BLIND_REVIEW' THEN 'candidate' ELSE 'other' END AS role FROM p_feedback f JOIN p_messages m USING (message_id) WHERE f.feedback_id > {CHECKPOINT}"""


def _roles(v: Views) -> DataFrame:
    return audit.roles(v.feedback, v.messages, CHECKPOINT, v.feedback.filter("feedback_id % 3 = 0").select("feedback_id"))


@query(f"SELECT role, count(*) AS n, min(feedback_id) AS first_feedback_id FROM ({ROLE}) GROUP BY 1")
def holdout_roles(v: Views) -> DataFrame:
    return _roles(v).groupBy("role").agg(F.count("*").alias("n"), F.min("feedback_id").alias("first_feedback_id"))


@query(f"""SELECT *, 0 = n_different AS reconciles, n_official + n_candidate + n_superseded + n_other = n_after AS reconciles_total FROM (SELECT {', '.join(f"count(*) FILTER (role = '{r}') AS n_{r}" for r in ('official', 'candidate', 'superseded', 'other'))},
 (SELECT count(*) FROM (SELECT feedback_id FROM ({ROLE}) WHERE role = 'official') a FULL JOIN (SELECT feedback_id FROM ({ELIGIBLE}) WHERE feedback_id > {CHECKPOINT} AND holdout_eligible = 1) b ON a.feedback_id = b.feedback_id WHERE a.feedback_id IS NULL OR b.feedback_id IS NULL) AS n_different,
 (SELECT count(*) FROM p_feedback WHERE feedback_id > {CHECKPOINT}) AS n_after FROM ({ROLE}))""")
def audit_reconciliation(v: Views) -> DataFrame:
    return audit.reconciliation(_roles(v), feedback.holdout_pool(v.feedback, v.messages, CHECKPOINT), v.feedback, CHECKPOINT)


@query("""SELECT a.assignment_id, count(m.message_id) AS usable_judgments FROM p_assignments a LEFT JOIN p_feedback f ON f.source_id = a.source_id AND f.feedback_origin = 'BLIND_REVIEW' AND f.excluded_from_learning = 0
 LEFT JOIN p_messages m ON m.message_id = f.message_id AND m.feedback_parse_status = 'PARSED' GROUP BY 1""")
def usable_judgments(v: Views) -> DataFrame:
    f = v.feedback.filter("feedback_origin = 'BLIND_REVIEW'").withColumn("assignment_id", F.col("source_id"))
    return audit.usable_judgments(f, v.messages, v.assignments)


EXPOSED = """SELECT j.feedback_id, count(e.feedback_id) AS n_exposures FROM p_feedback j LEFT JOIN (SELECT feedback_id, source_id FROM p_exposures UNION SELECT feedback_id, screened_source_id FROM p_exposures) e
 ON e.source_id = j.source_id AND e.feedback_id < j.feedback_id GROUP BY 1"""


def _exposures(v: Views) -> DataFrame:
    return v.exposures.withColumn("at", F.col("feedback_id"))


@query(f"SELECT * FROM ({EXPOSED}) WHERE feedback_id IN (SELECT feedback_id FROM p_feedback WHERE feedback_origin = 'BLIND_REVIEW')")
def prior_exposure(v: Views) -> DataFrame:
    f = v.feedback.withColumn("at", F.col("feedback_id"))
    out = audit.exposure_counts(f.filter("feedback_origin = 'BLIND_REVIEW'"), _exposures(v), "at")
    return out.withColumn("n_exposures", F.coalesce("n_exposures", F.lit(0)))


def _identified(v: Views, rows: DataFrame, assignments: DataFrame | None = None) -> DataFrame:
    """Feedback with the identities it has: document, assignment and newest screening of its source, and ticker and company, the source's before its own.
    assignments: source_id, assignment_id, judged_seq and what else is wanted of them."""
    assignments = v.assignments.select("source_id", "assignment_id", "judged_seq") if assignments is None else assignments
    of = v.sources.select("source_id", "source_name", "external_id", F.col("ticker").alias("__ticker"), F.col("company").alias("__company"))
    newest = sources.latest_screening(v.screenings).select("source_id", "screening_id", F.col("created_at").alias("screened_at"))
    out = rows.join(of, "source_id", "left").join(assignments, "source_id", "left").join(newest, "source_id", "left")
    first = {c: F.coalesce(F.when(F.length(f"__{c}") > 0, F.col(f"__{c}")), c) for c in ("ticker", "company")}
    return out.withColumns(first).drop("__ticker", "__company")


#: Feedback with its document and normalised ticker and company, the source's before its own; assignment and screening belong to a source and so to its document.
IDENTIFIED = f"""SELECT f.feedback_id, s.source_name || ':' || CAST(s.external_id AS VARCHAR) AS d, {NORM_TICKER.format("coalesce(nullif(s.ticker, ''), f.ticker)")} AS e, {NORM_COMPANY.format("coalesce(nullif(s.company, ''), f.company)")} AS f FROM rows f LEFT JOIN p_sources s USING (source_id)"""
#: Components of rows over their documents: two documents are linked through the least one that has a ticker or company of theirs.
COMPONENTS = f"""i AS ({IDENTIFIED}), v AS (SELECT DISTINCT d, 'E' AS k, e AS x FROM i WHERE e IS NOT NULL UNION ALL SELECT DISTINCT d, 'F', f FROM i WHERE f IS NOT NULL), hub AS (SELECT k, x, min(d) AS h FROM v GROUP BY 1, 2),
 link AS (SELECT DISTINCT d AS a, h AS b FROM v JOIN hub USING (k, x)), u AS (SELECT a, b FROM link UNION SELECT b, a FROM link), r(a, b) AS (SELECT DISTINCT d, d FROM i UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
 least AS (SELECT d, min(feedback_id) AS m FROM i GROUP BY 1), c AS (SELECT r.a AS d, min(m) AS component FROM r JOIN least ON least.d = r.b GROUP BY 1)"""


@query(f"WITH RECURSIVE rows AS (SELECT * FROM p_feedback), {COMPONENTS} SELECT feedback_id, component FROM i JOIN c USING (d)")
def duplicate_groups(v: Views) -> DataFrame:
    return audit.duplicate_groups(_identified(v, v.feedback))


OVERLAP = f"""SELECT feedback_id, min(level) AS level, arg_min(first, level) AS training_feedback_id FROM (SELECT feedback_id, unnest(['D', 'E', 'F']) AS level, unnest([d, e, f]) AS value FROM i WHERE feedback_id > {CHECKPOINT}) h
 JOIN (SELECT level, value, min(feedback_id) AS first FROM (SELECT feedback_id, unnest(['D', 'E', 'F']) AS level, unnest([d, e, f]) AS value FROM i WHERE feedback_id <= {CHECKPOINT}) GROUP BY 1, 2) t USING (level, value) GROUP BY 1"""


@query(f"WITH rows AS (SELECT * FROM p_feedback), i AS ({IDENTIFIED}) {OVERLAP}")
def training_overlap(v: Views) -> DataFrame:
    rows = _identified(v, v.feedback)
    return audit.training_overlap(rows.filter(F.col("feedback_id") > CHECKPOINT), rows.filter(F.col("feedback_id") <= CHECKPOINT))


_PROBLEMS = (
    ("OFFICIAL_NOT_BLIND", "role = 'official' AND feedback_origin <> 'BLIND_REVIEW'"), ("NO_ASSIGNMENT", "feedback_origin = 'BLIND_REVIEW' AND a.assignment_id IS NULL"), ("BLIND_WITH_SCREENING", "feedback_origin = 'BLIND_REVIEW' AND r.feedback_id % 50 = 0"),
    ("NOT_HOLDOUT_ELIGIBLE", "holdout_eligible = 0"), ("EXCLUDED", "excluded_from_learning = 1"), ("NOT_PARSED", "m.feedback_parse_status <> 'PARSED'"), ("USABLE_JUDGMENTS", "a.assignment_id IS NOT NULL AND u.n <> 1"), ("NO_SOURCE", "r.source_id IS NULL"),
    ("NO_SCREENING", "r.source_id IS NOT NULL AND s.source_id IS NULL"), ("SCREENED_LATER", "s.created_at > m.received_at"), ("SHOWN_BEFORE", "h.shown_seq < a.judged_seq"), ("PRIOR_EXPOSURE", "x.n_exposures > 0"), ("SMOKE_TICKER", "i.e IN ('TESTCO', 'XYZ')"),
    ("SMOKE_COMPANY", "i.f IN ('testco', 'xyz')"), ("TRAINING_OVERLAP", "t.level IS NOT NULL"),
)
AUDITED = f"""WITH rows AS (SELECT * FROM p_feedback), i AS ({IDENTIFIED}) SELECT r.feedback_id, r.role, r.source_id, concat_ws(',', {', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _PROBLEMS)}) AS problems FROM ({ROLE}) r
 JOIN p_messages m USING (message_id) JOIN i ON i.feedback_id = r.feedback_id LEFT JOIN p_assignments a ON a.source_id = r.source_id
 LEFT JOIN (SELECT source_id, coalesce(n, 0) AS n FROM p_assignments LEFT JOIN (SELECT f.source_id, count(*) AS n FROM p_feedback f JOIN p_messages p USING (message_id) WHERE f.feedback_origin = 'BLIND_REVIEW' AND f.excluded_from_learning = 0 AND p.feedback_parse_status = 'PARSED' GROUP BY 1) USING (source_id)) u ON u.source_id = a.source_id
 LEFT JOIN (SELECT source_id, max(screening_id) AS screening_id, arg_max(created_at, screening_id) AS created_at FROM p_screenings GROUP BY 1) s ON s.source_id = r.source_id LEFT JOIN p_shown h ON h.source_id = r.source_id
 LEFT JOIN ({EXPOSED}) x ON x.feedback_id = r.feedback_id LEFT JOIN ({OVERLAP}) t ON t.feedback_id = r.feedback_id"""


#: What the audit needs of feedback, and what duplicate_groups() does.
_JUDGMENT = ("feedback_id", "source_id", "ticker", "company", "feedback_origin", "holdout_eligible", "excluded_from_learning")
_IDENTITY = ("source_name", "external_id", "assignment_id", "screening_id", "ticker", "company")


def _audited(v: Views) -> DataFrame:
    """Feedback of every role after the checkpoint, with its identities and problems, written. Feedback has no time of its own: its message's stands for it, and shown and judged have sequence numbers.

    Each step is written and its shuffles go before the next. Whole rows are shuffled once by source and once by id; what
    depends on their message, assignment or earlier exposures is found from narrow ones.
    """
    with shuffles_removed(v.feedback.sparkSession):
        told = materialize(_roles(v).select("feedback_id", "role", "feedback_parse_status", F.col("received_at").alias("judged_at")))
        exposed = materialize(audit.first_exposures(_exposures(v), "at"))
        blind = v.feedback.filter("feedback_origin = 'BLIND_REVIEW'").join(v.assignments.select("source_id", "assignment_id"), "source_id")
        usable = audit.usable_judgments(blind, v.messages, v.assignments)
        assigned = materialize(v.assignments.select("source_id", "assignment_id", "judged_seq").join(usable, "assignment_id", "left"))
        rows = _identified(v, v.feedback.select(*_JUDGMENT), assigned).join(v.shown.select("source_id", "shown_seq"), "source_id", "left")
        rows = materialize(rows.join(exposed, "source_id", "left"))
        later = rows.filter(F.col("feedback_id") > CHECKPOINT)
        overlap = audit.training_overlap(later, rows.filter(F.col("feedback_id") <= CHECKPOINT))
        overlap = materialize(overlap.select("feedback_id", F.col("level").alias("training_level")))
        later = later.withColumn("explicit_screening_id", F.expr("CASE WHEN feedback_id % 50 = 0 THEN feedback_id END"))
        later = later.join(told, "feedback_id").join(overlap, "feedback_id", "left")
        out = materialize(audit.validity_problems(later).select("feedback_id", "role", "problems", *_IDENTITY))
        release(told, exposed, assigned, rows, overlap)
        return out


@query(f"SELECT feedback_id, role, problems FROM ({AUDITED}) WHERE role IN ('official', 'candidate')")
def validity_problems(v: Views) -> DataFrame:
    return _audited(v).filter(F.col("role").isin("official", "candidate")).select("feedback_id", "role", F.array_join("problems", ",").alias("problems"))


@query(f"""WITH RECURSIVE judged AS ({AUDITED}), rows AS (SELECT * FROM ({ROLE}) WHERE role IN ('official', 'candidate')), {COMPONENTS}, g AS (SELECT feedback_id, component, count(*) OVER (PARTITION BY component) AS n FROM i JOIN c USING (d))
 SELECT *, greatest(20 - n_official, 0) AS replacements_needed, n_official = 20 AND n_valid_unique = 20 AND n_problem_rows = 0 AND n_candidates = 0 AS clean FROM (SELECT count(*) FILTER (role = 'official') AS n_official,
 count(*) FILTER (role = 'candidate') AS n_candidates, count(*) FILTER (role = 'superseded') AS n_superseded, count(*) FILTER (role = 'other') AS n_other, count(DISTINCT component) FILTER (role = 'official') AS n_unique,
 count(*) FILTER (role = 'official' AND problems = '' AND n = 1) AS n_valid_unique, count(*) FILTER (role = 'official' AND problems <> '') AS n_problem_rows,
 count(*) FILTER (role IN ('official', 'candidate') AND (problems <> '' OR n > 1)) AS n_questionable FROM judged LEFT JOIN g USING (feedback_id))""")
def audit_summary(v: Views) -> DataFrame:
    rows = _audited(v)
    return audit.audit_summary(rows, audit.duplicate_groups(rows.filter(F.col("role").isin("official", "candidate"))))


@query(f"""WITH RECURSIVE i AS (SELECT feedback_id, role, coalesce(verdict, '-') AS verdict, doubtful, CASE WHEN assignment_id IS NULL THEN 'FB ' || feedback_id ELSE 'BR-' || assignment_id END AS ref, {NORM_TICKER.format('ticker')} AS e, {NORM_COMPANY.format('company')} AS f FROM p_reviewed),
 v AS (SELECT feedback_id, 3 AS k, e AS x FROM i WHERE e IS NOT NULL UNION ALL SELECT feedback_id, 4, f FROM i WHERE f IS NOT NULL), hub AS (SELECT k, x, min(feedback_id) AS h FROM v GROUP BY 1, 2), link AS (SELECT DISTINCT feedback_id AS a, h AS b FROM v JOIN hub USING (k, x)),
 u AS (SELECT a, b FROM link UNION SELECT b, a FROM link), r(a, b) AS (SELECT feedback_id, feedback_id FROM i UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a), c AS (SELECT a AS feedback_id, min(b) AS component FROM r GROUP BY 1),
 w AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY role <> 'official', doubtful, feedback_id) AS n FROM i JOIN c USING (feedback_id)),
 best AS (SELECT component, k, x FROM v JOIN c USING (feedback_id) GROUP BY 1, 2, 3 HAVING count(*) > 1 QUALIFY row_number() OVER (PARTITION BY component ORDER BY k, x) = 1)
 SELECT component, count(*) AS n_members, count(*) FILTER (role = 'official') AS n_official, max(CASE k WHEN 3 THEN 'ticker ' || x ELSE 'company ' || x END) AS shared, max(CASE WHEN n = 1 THEN feedback_id END) AS retained, count(*) - 1 AS n_to_go,
 string_agg(DISTINCT verdict, ', ' ORDER BY verdict) AS labels, count(DISTINCT verdict) > 1 AS labels_differ, string_agg(ref, ' / ' ORDER BY n) FILTER (n <= {audit.NAMED_REFS}) AS refs FROM w LEFT JOIN best USING (component) GROUP BY component HAVING count(*) > 1""")
def holdout_remediation(v: Views) -> DataFrame:
    """Which row of each group of one idea stays, and which go."""
    problems = F.when(F.col("doubtful"), F.array(F.lit("DOUBTFUL"))).otherwise(F.array().cast("array<string>"))
    rows = v.reviewed.withColumn("problems", problems)
    groups = audit.duplicate_groups(rows)
    return audit.remediation(rows, groups, audit.group_report(groups, audit.identity_keys(rows)))


# Replies and reviews against what they answer

@query("""WITH i AS (SELECT delivery_id, source_id, upper(trim(replace(ticker, '$', ''))) AS t FROM p_delivery_items JOIN p_sources USING (source_id)), n AS (SELECT delivery_id, count(*) AS n, min(source_id) AS lone FROM i GROUP BY 1),
 h AS (SELECT message_id, count(*) AS hits, min(i.source_id) AS source_id FROM p_answers a JOIN i ON i.delivery_id = a.delivery_id AND i.t = 'TK' || a.tk GROUP BY 1),
 r AS (SELECT a.message_id, form, line, n, lone, coalesce(hits, 0) AS hits, h.source_id, CASE WHEN form = 0 AND n > 1 OR form = 3 AND n > 1 THEN 'NO_LABELLED_HEADER' WHEN form = 3 THEN 'NO_VERDICT_LINE' WHEN form = 4 THEN 'UNKNOWN_LABEL'
 WHEN form IN (1, 2) AND coalesce(hits, 0) = 0 THEN 'UNKNOWN_LABEL' WHEN form IN (1, 2) AND hits > 1 THEN 'AMBIGUOUS_LABEL' END AS reason FROM p_answers a JOIN n ON n.delivery_id = a.delivery_id LEFT JOIN h ON h.message_id = a.message_id)
 SELECT message_id, reason IS NULL AS ok, CASE WHEN reason IS NULL THEN CASE form WHEN 0 THEN lone ELSE source_id END END AS source_id, CASE WHEN reason IS NULL THEN CASE form WHEN 0 THEN 'LIKE' WHEN 1 THEN 'PASS' ELSE 'STRONG_LIKE' END END AS verdict,
 CASE WHEN reason IS NULL THEN 'so it is ' || line END AS comment, reason FROM r""")
def digest_replies(v: Views) -> DataFrame:
    """One-block answers to digests of one or several ideas: bare, by ticker in two spellings, by no idea's name, or without a verdict."""
    items = digest.delivery_items(v.delivery_items, v.sources).select("delivery_id", "source_id", "ticker", "company")
    found = replies.digest_replies(v.answers.select("message_id", "body", "delivery_id"), items)
    one = F.get("blocks", F.lit(0))
    return found.select("message_id", "ok", *[one.getField(c).alias(c) for c in ("source_id", "verdict", "comment")], "reason")


@query("""WITH s AS (SELECT a.assignment_id AS ref, a.judged_seq IS NOT NULL AS marked, a.assignment_id IN (SELECT source_id FROM p_feedback WHERE feedback_origin = 'BLIND_REVIEW') AS has FROM p_assignments a),
 w AS (SELECT ref, CASE WHEN marked <> has THEN 'INCONSISTENT_BLIND_REVIEW_STATE' WHEN marked THEN 'DUPLICATE_BLIND_REVIEW' END AS reason FROM s),
 r AS (SELECT b.message_id, b.ref, b.next_ref, p_name, CASE WHEN x.ref IS NULL THEN 'UNKNOWN_REFERENCE' ELSE coalesce(x.reason, CASE WHEN y.ref IS NULL THEN 'UNKNOWN_REFERENCE' ELSE y.reason END) END AS reason
 FROM p_blind_answers b LEFT JOIN w x ON x.ref = b.ref LEFT JOIN w y ON y.ref = b.next_ref)
 SELECT message_id, reason IS NULL AS ok, reason, CASE WHEN reason IS NULL THEN ref || ' LIKE ' || p_name || ', ' || next_ref || ' STRONG_PASS ' END AS blocks FROM r""")
def blind_reviews(v: Views) -> DataFrame:
    """Reviews of two assignments each; one that is unknown, judged or in doubt fails its message."""
    judged = v.feedback.filter("feedback_origin = 'BLIND_REVIEW'").select(F.col("source_id").alias("assignment_id"))
    found = replies.blind_reviews(v.blind_answers.select("message_id", "body"), v.assignments.withColumnRenamed("judged_seq", "judged_at"), judged)
    told = F.array_join(F.transform("blocks", lambda b: F.concat_ws(" ", b["ref"].cast("string"), b["verdict"], b["comment"])), ", ")
    return found.select("message_id", "ok", "reason", told.alias("blocks"))


@query("""WITH c AS (SELECT DISTINCT feedback_id % 5000 AS ref FROM p_feedback WHERE feedback_origin = 'SCREEN_REVIEW' AND excluded_from_learning = 0),
 r AS (SELECT a.message_id, a.event_type, s.source_id, CASE WHEN a.ref % 6 = 5 THEN 'UNKNOWN_VERDICT' WHEN s.screening_id IS NULL THEN 'UNKNOWN_REFERENCE' WHEN c.ref IS NOT NULL THEN 'DUPLICATE_SCREEN_REVIEW' END AS reason
 FROM p_screen_answers a LEFT JOIN p_screenings s ON s.screening_id = a.ref LEFT JOIN c ON c.ref = a.ref)
 SELECT message_id, reason IS NULL AS ok, reason, CASE WHEN reason IS NULL THEN source_id END AS source_id, CASE WHEN reason IS NULL THEN event_type END AS comment FROM r""")
def screen_reviews(v: Views) -> DataFrame:
    counted = v.feedback.withColumn("screening_id", F.col("feedback_id") % 5000)
    one = F.get("blocks", F.lit(0))
    return replies.screen_reviews(v.screen_answers.select("message_id", "body"), v.screenings, counted).select("message_id", "ok", "reason", one["source_id"].alias("source_id"), one["comment"].alias("comment"))


@query("""SELECT message_id, CASE WHEN message_id IN (SELECT message_id FROM p_feedback WHERE feedback_id % 9 = 0) THEN 'RESYNC' WHEN sender LIKE '%eve%' THEN 'SKIPPED_SENDER' WHEN sender_authenticated IS NULL THEN 'SKIPPED_UNAUTHENTICATED'
 WHEN subject LIKE '%Screen Review' THEN 'SCREEN_REVIEW' WHEN subject LIKE '%blind review' THEN 'BLIND_REVIEW' WHEN thread_id IN (SELECT provider_thread_id FROM p_deliveries WHERE provider_thread_id <> '') THEN 'DIGEST_REPLY'
 WHEN subject LIKE 'Re: RE: %' THEN 'NEEDS_REVIEW' ELSE 'MODEL' END AS route FROM p_mail""")
def mail_routes(v: Views) -> DataFrame:
    return feedback.route_messages(v.mail, v.feedback.filter("feedback_id % 9 = 0"), v.deliveries, ["Joe@x.org"]).select("message_id", "route")


@query(f"""WITH s AS (SELECT source_id, source_name, external_id, 'h' || (source_id % 4) AS content_hash, collection_status FROM p_sources), c AS ({CURRENT})
 SELECT f.external_id, f.content_hash, s.source_id AS known_id, c.source_id AS previous_version, CASE WHEN s.source_id IS NULL THEN 'insert' WHEN s.collection_status = 'COLLECTED' THEN 'known_complete' WHEN f.content_complete THEN 'promote' ELSE 'refresh' END AS action
 FROM p_fetched f LEFT JOIN s USING (source_name, external_id, content_hash) LEFT JOIN c USING (source_name, external_id)""")
def fetched_versions(v: Views) -> DataFrame:
    known = v.sources.withColumn("content_hash", F.concat(F.lit("h"), (F.col("source_id") % 4).cast("string")))
    return sources.resolve_fetched(v.fetched, known, v.observations).select("external_id", "content_hash", "known_id", "previous_version", "action")


# A store over several batches

@query("""WITH e AS (SELECT *, seq % 4 AS batch FROM p_message_events WHERE kind = 'STATUS'),
 now AS (SELECT 'now' AS state, message_id, status, error FROM e WHERE batch <> 2 QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY batch DESC, seq DESC) = 1),
 before AS (SELECT 'as of the snapshot' AS state, message_id, status, error FROM e WHERE batch < 2 QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY batch DESC, seq DESC) = 1),
 lost AS (SELECT 'as of the restored' AS state, message_id, status, error FROM e WHERE batch < 3 QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY batch DESC, seq DESC) = 1)
 SELECT * FROM now UNION ALL SELECT * FROM before UNION ALL SELECT * FROM lost""")
def restored_states(v: Views) -> DataFrame:
    """States of messages in a store that gets all events in four batches, and is restored to the second before the fourth comes: now, as of
    the snapshot, and as of the last batch before the restore."""
    events = v.message_events
    log = EventLog(v.spark, scratch_dir(v.spark, "log"), {"events": events.schema})
    for batch in range(4):
        if batch == 3:
            log.restore("kept")
        log.commit(events=events.filter(F.col("seq") % 4 == batch))
        if batch == 1:
            log.snapshot("kept")
    def states(name: str, as_of: int | None) -> DataFrame:
        rows = log.table("events", as_of).filter("kind = 'STATUS'")
        return latest_per_key(rows, ["message_id"], "__seq", "seq").select(F.lit(name).alias("state"), "message_id", "status", "error")

    return states("now", None).unionByName(states("as of the snapshot", 2)).unionByName(states("as of the restored", 3))



# Texts and pages

@query("SELECT source AS document, count(*) AS n_versions, count(DISTINCT sha256(coalesce(text, ''))) AS n_contents, min(sha256(coalesce(text, ''))) AS first_hash, count(DISTINCT sha256(coalesce(text, ''))) = 1 AS same FROM documents GROUP BY 1")
def content_hash_versions(v: Views) -> DataFrame:
    return sources.content_versions(v.table("documents"), "source", "text")


@query(" UNION ALL ".join(f"SELECT '{name}' AS theme, count(*) FILTER (regexp_matches(text, '(?i){'|'.join(f'(?:{p})' for p in ps)}')) AS n_rows FROM documents" for name, ps in evaluation.THEMES))
def theme_counts(v: Views) -> DataFrame:
    return evaluation.theme_counts(v.table("documents"), "doc_id", "text")


#: Every text of a narrative with its place; blank ones are none.
ITEMS = """SELECT screening_id, field_no, field, item_no - 1 AS item_no, t[item_no] AS text FROM (SELECT screening_id, field_no, field, t, unnest(range(1, len(t) + 1)) AS item_no FROM (
 SELECT screening_id, 0 AS field_no, 'key_reasons' AS field, key_reasons AS t FROM p_narratives UNION ALL SELECT screening_id, 1, 'key_concerns', key_concerns FROM p_narratives
 UNION ALL SELECT screening_id, 2, 'critical_questions', critical_questions FROM p_narratives)) WHERE trim(t[item_no]) <> ''"""


@query(f"SELECT screening_id, field, CAST(field_no AS INTEGER) AS field_no, CAST(item_no AS INTEGER) AS item_no, text FROM ({ITEMS})")
def text_items(v: Views) -> DataFrame:
    return evaluation.text_items(v.narratives, "screening_id").select("screening_id", "field", "field_no", "item_no", "text")


# The second pattern engine has no look-around, so the SQL has what may stand beside a multiple spelled out. The texts are short: an excerpt is all of one.
HITS = f"""SELECT * FROM (SELECT screening_id, field_no, item_no, field, text, unnest([0, 1, 2]) AS i, unnest(['3x-style multiple', 'three-bagger', 'effective hurdle']) AS category,
 unnest([regexp_matches(text, '(?i)(^|[^\\w.])~?\\s*(2\\s*-\\s*)?3\\s*x([^a-z]|$)'), regexp_matches(text, '(?i)three[\\s-]+bagger'), regexp_matches(text, '(?i)effective\\s+hurdle')]) AS hit FROM ({ITEMS})) WHERE hit"""


@query(f"""WITH h AS ({HITS}), b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY screening_id, i ORDER BY field_no, item_no) = 1),
 r AS (SELECT screening_id, bool_or(regexp_matches(text, '100\\s*%')) AS framed FROM ({ITEMS}) GROUP BY 1)
 SELECT screening_id, string_agg(category, ', ' ORDER BY field_no, item_no, i) AS categories, arg_min(field, field_no * 1000000 + item_no * 10 + i) AS field,
 trim(regexp_replace(arg_min(text, field_no * 1000000 + item_no * 10 + i), '\\s+', ' ', 'g')) AS excerpt, bool_or(framed) AS permanent_framing FROM b JOIN r USING (screening_id) GROUP BY 1""")
def hurdle_hits(v: Views) -> DataFrame:
    return evaluation.hurdle_hits(evaluation.text_items(v.narratives, "screening_id"), "screening_id")


@query("WITH items AS (" + ITEMS + "), t AS (" + " UNION ALL ".join(f"SELECT DISTINCT {i} AS theme_no, screening_id FROM items WHERE regexp_matches(text, '(?i){'|'.join(f'(?:{p})' for p in ps)}')" for i, (_, ps) in enumerate(evaluation.THEMES))
    + "), n AS (SELECT *, row_number() OVER (PARTITION BY theme_no ORDER BY screening_id) AS n FROM t), g AS (SELECT theme_no, count(*) AS n_rows, string_agg(CAST(screening_id AS VARCHAR), ', ' ORDER BY screening_id) FILTER (n <= 20) AS refs FROM n GROUP BY 1)"
    + " SELECT a.theme_no, a.theme, coalesce(n_rows, 0) AS n_rows, coalesce(refs, '') AS refs FROM (" + " UNION ALL ".join(f"SELECT {i} AS theme_no, '{name}' AS theme" for i, (name, _) in enumerate(evaluation.THEMES)) + ") a LEFT JOIN g USING (theme_no)")
def theme_report(v: Views) -> DataFrame:
    return evaluation.theme_report(evaluation.text_items(v.narratives, "screening_id"), "screening_id")



@query()
def html_canonical_text(v: Views) -> DataFrame:
    pages = html.dealt(v.table("pages").select("page_id", "html")).select("page_id", html.parsed_page("html", "plain", "title").alias("p"))
    return pages.select("page_id", F.col("p.title").alias("title"), html.canonical_text(F.col("p.plain")).alias("canonical"))


@query()
def page_validity(v: Views) -> DataFrame:
    pages = html_canonical_text(v)
    return pages.select("page_id", html.page_problem(F.col("canonical"), F.col("title")).alias("problem"), F.length("canonical").alias("n_chars"))


@query()
def page_links(v: Views) -> DataFrame:
    pages = html.dealt(v.table("pages").select("page_id", "html")).select("page_id", html.parsed_page("html", "links").alias("p"))
    return html.exploded(pages, F.col("p.links"), "page_id").select("page_id", "position", "item.href", "item.text")


LETTERS = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZABCD', CAST(p_partkey % 26 + 1 AS INT), {0})"


@query(f"""SELECT p_partkey AS part, 0 AS position, CAST(p_partkey AS VARCHAR) AS external_id, p_name AS title, 'Ann Lee' AS author, NULL AS published_at, 'Jan ' || p_size AS added_at, {LETTERS.format(3)} AS ticker, p_type || ' Works' AS company FROM part
 UNION ALL SELECT p_partkey, 1, CAST(1000000 + p_partkey AS VARCHAR), {LETTERS.format(2)}, 'Value Club', '2026-01-02', NULL, {LETTERS.format(2)}, NULL FROM part""")
def discover_pitches(v: Views) -> DataFrame:
    """Both cards of every feed page, from its HTML; the SQL has the fields from the rows that the HTML was made of."""
    found = html.discovered_pitches(html.dealt(v.feed).select("part", html.parsed_page("html", "cards").alias("p")), "p", ["part"])
    return found.select("part", "position", "external_id", "title", "author", "published_at", "added_at", "ticker", "company")


@query("""SELECT part, 'Feed & more' AS title, sha256(html) AS raw_capture_hash, part % 4 < 2 AS content_complete FROM p_feed""")
def pitch_documents(v: Views) -> DataFrame:
    return html.pitch_documents(v.feed).select("part", "title", "raw_capture_hash", "content_complete")


@query("""SELECT reply_id, reply_id % 7 NOT IN (3, 5) AS ok, CASE reply_id % 7 WHEN 0 THEN 'LIKE' WHEN 1 THEN 'maybe.' || chr(10) || 'so so' WHEN 2 THEN 'PASS' WHEN 4 THEN 'LIKE' WHEN 6 THEN 'PASS' || chr(10) || 'no' END AS text,
 CASE reply_id % 7 WHEN 3 THEN 'INTERLEAVED_QUOTES' WHEN 5 THEN 'EMPTY_BODY' END AS reason FROM p_replies""")
def reply_isolation(v: Views) -> DataFrame:
    return v.replies.select("reply_id", text.isolate_reply(F.col("body")).alias("r")).select("reply_id", "r.*")


@query("""SELECT reply_id, CASE reply_id % 7 WHEN 0 THEN 'LIKE' WHEN 1 THEN 'MAYBE' WHEN 2 THEN 'PASS' WHEN 4 THEN 'LIKE' ELSE 'PASS' END AS verdict, CASE reply_id % 7 WHEN 1 THEN 'so so' WHEN 6 THEN 'no' ELSE '' END AS comment FROM p_replies WHERE reply_id % 7 NOT IN (3, 5)""")
def reply_verdicts(v: Views) -> DataFrame:
    """What isolated replies to one idea say."""
    own = reply_isolation(v).filter("ok").select("reply_id", F.explode(text.reply_blocks(F.col("text"), F.lit(1))["blocks"]).alias("b"))
    return own.select("reply_id", "b.verdict", "b.comment")


@query("""SELECT conv_id, turn, regexp_matches(trim(text), '^(?i)(strong\\s+like|strong\\s+pass|like|maybe|pass)\\s*[.:!]?$') AS is_verdict FROM conversations""")
def verdict_lines(v: Views) -> DataFrame:
    return v.table("conversations").select("conv_id", "turn", F.trim("text").rlike(text.BARE_VERDICT).alias("is_verdict"))


@query("""SELECT note_id, 1 AS line, CASE note_id % 8 WHEN 0 THEN 'We require at least 3x here' WHEN 2 THEN 'an effective hurdle of sorts' WHEN 3 THEN 'must reach 90% or more' WHEN 4 THEN 'a 4x floor' WHEN 5 THEN '100% of the floor, a 3-bagger' ELSE 'three bagger, effective hurdle' END AS excerpt,
 CASE note_id % 8 WHEN 0 THEN 'MULTIPLE_REQUIRED' WHEN 2 THEN 'EFFECTIVE_HURDLE' WHEN 3 THEN 'PERCENTAGE_REQUIRED' WHEN 4 THEN 'MULTIPLE_AS_HURDLE' WHEN 5 THEN 'PERCENTAGE_AS_HURDLE' ELSE 'EFFECTIVE_HURDLE' END AS reason FROM p_notes WHERE note_id % 8 NOT IN (1, 6)""")
def threshold_conflicts(v: Views) -> DataFrame:
    none = F.array().cast("array<double>")
    found = v.notes.select("note_id", F.explode(text.threshold_conflicts(F.col("text"), none, none)).alias("c"))
    return found.select("note_id", "c.*")
