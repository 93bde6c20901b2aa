"""State of messages, feedback and sources as views over events.

Nothing is updated in place: each change is an event with a sequence number, and the current state of a row is its own
columns overlaid with the latest event that speaks of them. The views are one pre-aggregated pass over the events and
one join; the writers below only make event rows, which EventLog.commit() makes visible together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.feedback import approvable, feedback_about, is_excluded, requeue_decision

MESSAGE_EVENT = "message_id string, kind string, status string, error string, at string"
FEEDBACK_EVENT = "feedback_id long, kind string, reason string, at string"
SOURCE_EVENT = "source_id long, kind string, collection_status string, reason string, at string"


def _last(value: Column, when: Column, order: str) -> Column:
    """The value of the last event, by order, for which a condition holds; null without one."""
    return F.max_by(F.when(when, value), F.when(when, F.col(order)))


def current_messages(messages: DataFrame, events: DataFrame, order: str = "seq") -> DataFrame:
    """messages with feedback_parse_status and error as the last STATUS event left them, attempt_count and last_attempt_at from ATTEMPT events."""
    status, attempt = F.col("kind") == "STATUS", F.col("kind") == "ATTEMPT"
    last = events.groupBy("message_id").agg(
        _last(F.struct("status", "error"), status, order).alias("__now"), F.count_if(attempt).alias("__n"),
        F.max(F.when(attempt, F.col("at"))).alias("__at"))
    own = [c for c in messages.columns if c not in ("feedback_parse_status", "error", "attempt_count", "last_attempt_at")]
    before = lambda c, t: F.col(c) if c in messages.columns else F.lit(None).cast(t)
    changed = F.col("__now").isNotNull()
    return messages.join(last, "message_id", "left").select(
        *own, F.when(changed, F.col("__now.status")).otherwise(F.col("feedback_parse_status")).alias("feedback_parse_status"),
        F.when(changed, F.col("__now.error")).otherwise(before("error", "string")).alias("error"),
        (F.coalesce("__n", F.lit(0)) + F.coalesce(before("attempt_count", "long"), F.lit(0))).alias("attempt_count"),
        F.coalesce("__at", before("last_attempt_at", "string")).alias("last_attempt_at"))


def current_feedback(feedback: DataFrame, events: DataFrame, order: str = "seq") -> DataFrame:
    """feedback without deleted rows, with excluded_from_learning (boolean) as the last EXCLUDE or INCLUDE event left it."""
    flag = F.col("kind").isin("EXCLUDE", "INCLUDE")
    last = events.groupBy("feedback_id").agg(_last(F.col("kind") == "EXCLUDE", flag, order).alias("__excluded"),
        F.bool_or(F.col("kind") == "DELETE").alias("__deleted"))
    rows = feedback.join(last, "feedback_id", "left").filter(~F.coalesce("__deleted", F.lit(False)))
    return rows.select(*[F.coalesce("__excluded",
        is_excluded()).alias(c) if c == "excluded_from_learning" else c for c in feedback.columns])


def current_source_state(sources: DataFrame, events: DataFrame, order: str = "seq") -> DataFrame:
    """sources with the collection status of their last STATUS or INVALID event, EXTRACTED if any such event came, the reason of the last INVALID one, and when they were last OBSERVED."""
    kind = F.col("kind")
    last = events.groupBy("source_id").agg(
        _last(F.col("collection_status"), kind.isin("STATUS", "INVALID"), order).alias("__status"),
        F.bool_or(kind == "EXTRACTED").alias("__extracted"),
        _last(F.col("reason"), kind == "INVALID", order).alias("invalid_reason"),
        F.max(F.when(kind == "OBSERVED", F.col("at"))).alias("last_observed_at"))
    own = [c for c in sources.columns if c not in ("collection_status", "extraction_status")]
    return sources.join(last, "source_id", "left").select(
        *own, F.coalesce("__status", "collection_status").alias("collection_status"),
        F.when(F.coalesce("__extracted", F.lit(False)), "EXTRACTED").otherwise(F.col("extraction_status")).alias("extraction_status"),
        "invalid_reason", "last_observed_at")


# Writers: rows of events, for EventLog.commit().

def attempts(messages: DataFrame, at: str) -> DataFrame:
    """That a parse of these messages was tried, whatever came of it."""
    none = F.lit(None).cast("string")
    return messages.select("message_id", F.lit("ATTEMPT").alias("kind"), none.alias("status"), none.alias("error"), F.lit(at).alias("at"))


def status_changes(messages: DataFrame, status: Column | str, at: str, error: Column | None = None) -> DataFrame:
    status = F.lit(status) if isinstance(status, str) else status
    return messages.select("message_id", F.lit("STATUS").alias("kind"), status.alias("status"),
        (F.lit(None).cast("string") if error is None else error).alias("error"), F.lit(at).alias("at"))


def exclusions(feedback: DataFrame, at: str, about: str | None = None, ids: list[int] | None = None, excluded: bool = True) -> DataFrame:
    """EXCLUDE or INCLUDE events for the rows about a ticker or company, or of the given ids, that aren't so already."""
    if (about is None) == (ids is None):
        raise ValueError("give either about or ids")
    rows = feedback_about(feedback, about) if about is not None else feedback.filter(F.col("feedback_id").isin(ids))
    changed = rows.filter(is_excluded() != F.lit(excluded))
    return changed.select("feedback_id", F.lit("EXCLUDE" if excluded else "INCLUDE").alias("kind"),
        F.lit(None).cast("string").alias("reason"), F.lit(at).alias("at"))


def requeued(messages: DataFrame, feedback: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """(message events, feedback events) that put messages back in the queue: those that may go back become UNPARSED, and what was derived from messages in review is deleted."""
    may = requeue_decision(messages, feedback).filter("may_requeue")
    dropped = feedback.join(may.filter("drops_events").select("message_id"), "message_id", "left_semi")
    gone = dropped.select("feedback_id", F.lit("DELETE").alias("kind"), F.lit("REQUEUED").alias("reason"), F.lit(at).alias("at"))
    return status_changes(may, "UNPARSED", at), gone


def approved(messages: DataFrame, feedback: DataFrame, at: str) -> DataFrame:
    """Message events that approve all messages in review that have an event."""
    return status_changes(approvable(messages, feedback), "PARSED", at)


def invalidated(sources: DataFrame, at: str, reason: Column) -> DataFrame:
    """Source events for versions that turned out to hold no content; what was extracted from them stays as it is."""
    return sources.select("source_id", F.lit("INVALID").alias("kind"), F.lit("INCOMPLETE_CONTENT").alias("collection_status"),
        reason.alias("reason"), F.lit(at).alias("at"))


def content_repairs(sources: DataFrame, pages: DataFrame, at: str) -> DataFrame:
    """Source events for complete versions whose stored page (source_id, html) is none: see functions.html.page_problem()."""
    from quillstone.functions import html

    read = html.dealt(pages).select("source_id", html.parsed_page("html", "plain", "title").alias("p")).select("source_id",
        html.page_problem(html.canonical_text(F.col("p.plain")), F.col("p.title")).alias("problem"))
    bad = sources.filter("collection_status = 'COLLECTED'").join(read.filter("problem IS NOT NULL"), "source_id")
    return invalidated(bad, at, F.col("problem"))


def duplicate_repair(rows: DataFrame, exclude: int, retain: int, expected: dict, reason: str, at: str) -> tuple[list[str],
        DataFrame | None]:
    """(failures, EXCLUDE event): takes a confirmed duplicate out of the hold-out if all that is expected of both rows holds.

    rows: of audit.roles(), with assignment_id, ticker and company. expected: ref, ticker, company and verdict of the
    excluded row, retain_ref of the other. At most two rows reach the driver. A row that is excluded already gives no
    failure and no event.
    """
    from quillstone.functions.exprs import norm_company, norm_ticker, review_ref

    if not reason.strip():
        return ["REASON_IS_EMPTY"], None
    facts = rows.filter(F.col("feedback_id").isin(exclude, retain)).select(
        "feedback_id", "role", "feedback_origin", is_excluded().alias("excluded"), F.upper("verdict").alias("verdict"),
        review_ref("BR", F.col("assignment_id")).alias("ref"),
        norm_ticker(F.col("ticker")).alias("ticker"), norm_company(F.col("company")).alias("company"),
        norm_ticker(F.lit(expected["ticker"])).alias("want_ticker"), norm_company(F.lit(expected["company"])).alias("want_company"))
    found = {r.feedback_id: r for r in facts.collect()}
    out, kept = found.get(exclude), found.get(retain)
    if out is not None and out.excluded and out.role == "superseded":
        return [], None
    checks = [("SAME_ROW", exclude != retain), ("EXCLUDED_ROW_UNKNOWN", out is not None), ("RETAINED_ROW_UNKNOWN", kept is not None)]
    if out is not None:
        checks += [("EXCLUDED_ROW_NOT_OFFICIAL", out.role == "official"), ("EXCLUDED_ROW_NOT_BLIND", out.feedback_origin == "BLIND_REVIEW"),
            ("REF_DIFFERS", out.ref == expected["ref"].upper()),
                   ("TICKER_DIFFERS", out.ticker == out.want_ticker), ("COMPANY_DIFFERS", out.company == out.want_company),
                   ("LABEL_DIFFERS", out.verdict == expected["verdict"].upper())]
    if kept is not None:
        checks += [("RETAINED_ROW_NOT_OFFICIAL", kept.role == "official"),
            ("RETAINED_REF_DIFFERS", kept.ref == expected["retain_ref"].upper())]
    if out is not None and kept is not None:
        checks.append(("NOT_THE_SAME_IDEA", (out.ticker, out.company) == (kept.ticker, kept.company)))
    failures = [name for name, ok in checks if not ok]
    if failures:
        return failures, None
    event = rows.filter(F.col("feedback_id") == exclude).select("feedback_id", F.lit("EXCLUDE").alias("kind"),
        F.lit(f"DUPLICATE_OF {retain}: {reason.strip()}").alias("reason"), F.lit(at).alias("at"))
    return [], event


def repaired_duplicates(events: DataFrame) -> DataFrame:
    """feedback_id of the recorded duplicate exclusions, as audit.roles() takes them."""
    return events.filter("kind = 'EXCLUDE' AND reason LIKE 'DUPLICATE_OF %'").select("feedback_id").distinct()
