"""Messages and feedback events: eligibility, hold-out pool, invariants, counters and lookups.

Definitions used everywhere: an event is eligible for learning when it is not excluded and its message is PARSED; the
hold-out pool is the eligible events after a checkpoint that are marked hold-out eligible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.exprs import VERDICTS, ratio

STATUSES = ("UNPARSED", "PARSED", "NO_FEEDBACK", "NEEDS_REVIEW", "RETRYABLE_ERROR", "ERROR", "SKIPPED_SENDER", "SKIPPED_UNAUTHENTICATED")
PENDING = ("UNPARSED", "RETRYABLE_ERROR")
WITH_EVENTS = ("PARSED", "NEEDS_REVIEW")
REQUEUEABLE = ("ERROR", "NEEDS_REVIEW")


def is_excluded() -> Column:
    return F.col("excluded_from_learning").cast("boolean")


def pending_messages(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("feedback_parse_status").isin(*PENDING))


def messages_with_status(messages: DataFrame, *statuses: str) -> DataFrame:
    return messages.filter(F.col("feedback_parse_status").isin(*statuses))


def status_counts(messages: DataFrame) -> DataFrame:
    """One row: a count for each status, and the total, in a single pass."""
    count = lambda s: F.count_if(F.col("feedback_parse_status") == s).alias(f"n_{s.lower()}")
    return messages.agg(F.count("*").alias("n_messages"), *[count(s) for s in STATUSES])


def eligible_feedback(feedback: DataFrame, messages: DataFrame) -> DataFrame:
    parsed = messages.filter("feedback_parse_status = 'PARSED'").select("message_id")
    return feedback.filter(~is_excluded()).join(parsed, "message_id", "left_semi")


def holdout_pool(feedback: DataFrame, messages: DataFrame, checkpoint: int) -> DataFrame:
    later = feedback.filter((F.col("feedback_id") > checkpoint) & F.col("holdout_eligible").cast("boolean"))
    return eligible_feedback(later, messages)


def invariant_violations(feedback: DataFrame, messages: DataFrame) -> DataFrame:
    """(message_id, violation): statuses that need events and have none, and events under a status that has none."""
    own = feedback.select("message_id").distinct()
    needs = F.col("feedback_parse_status").isin(*WITH_EVENTS)
    none = messages.filter(needs).join(own, "message_id", "left_anti").select("message_id", F.lit("NO_EVENTS").alias("violation"))
    some = messages.filter(~needs).join(own, "message_id", "left_semi").select("message_id", F.lit("UNEXPECTED_EVENTS").alias("violation"))
    return none.unionByName(some)


def count_by_origin(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("feedback_origin").agg(F.count("*").alias("n"))


def feedback_with_ids(feedback: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose feedback_id is in ids; none where ids is empty."""
    return feedback.join(ids.select("feedback_id").distinct(), "feedback_id", "left_semi")


def feedback_about(feedback: DataFrame, value: str) -> DataFrame:
    """Events whose ticker or company equals value, ignoring case."""
    low = F.lower(F.lit(value))
    return feedback.filter((F.lower("ticker") == low) | (F.lower("company") == low))


def latest_feedback(feedback: DataFrame, messages: DataFrame, sources: DataFrame, n: int, screenings: DataFrame | None = None) -> DataFrame:
    """The n newest events with their message and, if any, their source and the screening they speak of (screening_id). Top-n comes first: only n rows are joined."""
    top = feedback.join(messages.select("message_id"), "message_id", "left_semi").orderBy(F.desc("feedback_id")).limit(n)
    m = messages.select("message_id", "thread_id", "received_at", "feedback_parse_status")
    s = sources.select("source_id", F.col("ticker").alias("source_ticker"), F.col("collection_status"))
    own = ["feedback_id", "message_id", "thread_id", "received_at", "feedback_parse_status", "verdict", "ticker", "source_id",
        "source_ticker", "collection_status"]
    out = top.join(m, "message_id").join(s, "source_id", "left")
    if screenings is None:
        return out.select(*own)
    reviewed = screenings.select("screening_id", F.col("taste_version").alias("reviewed_taste_version"),
        F.col("overall_prediction").alias("reviewed_prediction"))
    return out.join(reviewed, "screening_id", "left").select(*own, "reviewed_taste_version", "reviewed_prediction")


def events_of(feedback: DataFrame, messages: DataFrame) -> DataFrame:
    """Every event of some messages with its number among them, for a review."""
    return feedback.join(messages.select("message_id"), "message_id", "left_semi").orderBy("message_id", "event_index")


def under_review(messages: DataFrame, feedback: DataFrame) -> DataFrame:
    """Messages in review with how many events they have; those without any can't be approved."""
    n = feedback.groupBy("message_id").agg(F.count("*").alias("n_events"))
    rows = messages.filter("feedback_parse_status = 'NEEDS_REVIEW'").join(n, "message_id", "left")
    return rows.select("message_id", F.coalesce("n_events", F.lit(0)).alias("n_events"), F.col("n_events").isNotNull().alias("approvable"))


def label_distribution(rows: DataFrame) -> DataFrame:
    """One row: a count for each verdict, others, the total, and the shares of the positive side."""
    count = lambda v: F.count_if(F.col("verdict") == v)
    known = F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False))
    worth = F.coalesce(F.col("verdict").isin(*VERDICTS[:3]), F.lit(False))
    return rows.agg(*[count(v).alias(f"n_{v.lower()}") for v in VERDICTS], F.count_if(~known).alias("n_other"), F.count("*").alias("total"),
                    F.count_if(worth).alias("worth_watching"), F.count_if(known & ~worth).alias("pass_family"), ratio(F.count_if(worth), F.count_if(known)).alias("positive_share"))


def requeue_decision(messages: DataFrame, feedback: DataFrame) -> DataFrame:
    """message_id, may_requeue, reason and drops_events: the state machine behind putting messages back in the queue."""
    n = feedback.groupBy("message_id").agg(F.count("*").alias("n_events"), F.count_if(is_excluded()).alias("n_excluded"))
    s, e = F.col("feedback_parse_status"), F.coalesce("n_events", F.lit(0))
    reason = (F.when(s.isin(*PENDING), "ALREADY_PENDING").when(s == "PARSED", "ALREADY_PARSED").when(s.startswith("SKIPPED"),
        "SKIPPED_ON_PURPOSE")
              .when(s == "NO_FEEDBACK", "HAS_NO_FEEDBACK").when((s == "ERROR") & (e > 0), "ERROR_WITH_EVENTS").when(~s.isin(*REQUEUEABLE),
              "UNKNOWN_STATUS"))
    return messages.join(n, "message_id", "left").select("message_id", s, reason.isNull().alias("may_requeue"), reason.alias("reason"),
        ((s == "NEEDS_REVIEW") & (e > 0)).alias("drops_events"))


def approvable(messages: DataFrame, feedback: DataFrame) -> DataFrame:
    """Messages in review that have at least one event."""
    return messages.filter("feedback_parse_status = 'NEEDS_REVIEW'").join(feedback.select("message_id").distinct(), "message_id",
        "left_semi")


def route_messages(messages: DataFrame, events: DataFrame, deliveries: DataFrame, allowed: list[str]) -> DataFrame:
    """Adds route: which parser a pending message goes to. The first rule that fits wins.

    messages need sender, subject and thread_id. A message in a digest's thread goes to the digest parser even if its
    subject looks like nothing; one that only looks like a digest reply needs review.
    """
    from quillstone.functions import exprs, text

    known = events.select("message_id", F.lit(True).alias("__has")).distinct()
    threads = deliveries.filter(F.col("provider_thread_id").isNotNull() & (F.col("provider_thread_id") != "")).select(F.col("provider_thread_id").alias("thread_id"), F.lit(True).alias("__delivery")).distinct()
    sender = exprs.sender_address(F.col("sender"))
    route = (F.when(F.col("__has"), "RESYNC").when(~F.coalesce(sender.isin(*[a.lower() for a in allowed]), F.lit(False)), "SKIPPED_SENDER")
             .when(F.coalesce(F.col("sender_authenticated"), F.lit("")) != "AUTHENTICATED", "SKIPPED_UNAUTHENTICATED")
             .when(text.is_screen_review_subject(F.col("subject")), "SCREEN_REVIEW").when(text.is_blind_review_subject(F.col("subject")),
             "BLIND_REVIEW")
             .when(F.col("__delivery"), "DIGEST_REPLY").when(text.is_digest_reply_subject(F.col("subject")),
             "NEEDS_REVIEW").otherwise("MODEL"))
    return messages.join(known, "message_id", "left").join(threads, "thread_id", "left").withColumn("route",
        route).select(*messages.columns, "route")
