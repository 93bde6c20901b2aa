"""From parsed reply blocks to judgments: labels and references are resolved set-wise, and one bad block fails its message.

Blocks come from quillstone.functions.text, one array a message. Results have one row a message: ok, the resolved blocks in
their order, and the first reason where the message fails.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text
from quillstone.functions.exprs import norm_company, norm_ticker
from quillstone.operators.feedback import is_excluded
from quillstone.operators.storage import materialize


def _exploded(messages: DataFrame, parsed: str, *keep: str) -> DataFrame:
    """(message_id, keep, position, block...) of messages whose parse is ok."""
    return messages.filter(F.col(f"{parsed}.ok")).select("message_id", *keep,
        F.posexplode(f"{parsed}.blocks").alias("position", "b")).select("message_id", *keep, "position", "b.*")


def _whole_messages(messages: DataFrame, parsed: str, resolved: DataFrame, fields: list[str]) -> DataFrame:
    """resolved: message_id, position, reason (null if fine) and fields."""
    block = F.struct("position", *fields)
    g = resolved.groupBy("message_id").agg(F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("position"))).alias("__reason"),
        F.array_sort(F.collect_list(block)).alias("__blocks"))
    out = messages.select("message_id", F.col(f"{parsed}.reason").alias("__parse")).join(g, "message_id", "left")
    reason = F.coalesce("__parse", "__reason")
    return out.select("message_id", reason.isNull().alias("ok"), F.when(reason.isNull(), F.col("__blocks")).alias("blocks"),
        reason.alias("reason"))


def digest_replies(messages: DataFrame, items: DataFrame) -> DataFrame:
    """messages (message_id, body, delivery_id) against the items (delivery_id, source_id, ticker, company) of their digest.

    A label names the one item with its ticker, else the one with its company; several hits are as bad as none. A block without a
    label answers a digest of one item.
    """
    n = items.groupBy("delivery_id").agg(F.count("*").alias("n_items"))
    reply = messages.withColumn("__r", text.isolate_reply(F.col("body"))).join(n, "delivery_id", "left")
    blocks = text.reply_blocks(F.col("__r.text"), F.coalesce("n_items", F.lit(0)))
    parsed = reply.withColumn("__b", F.when(F.col("__r.ok"), blocks).otherwise(F.struct(F.lit(False).alias("ok"),
        F.lit(None).cast("array<struct<label:string,verdict:string,comment:string>>").alias("blocks"),
        F.col("__r.reason").alias("reason"))))
    parsed = materialize(parsed.select("message_id", "delivery_id", "__b"))  # read twice, parsed once
    # Labels are normalised here, once a block, and not once for each item of its digest.
    rows = _exploded(parsed, "__b", "delivery_id").withColumns({"label_t": norm_ticker(F.col("label")), "label_c": norm_company(F.col("label"))})
    named = items.select("delivery_id", F.col("source_id").alias("item"), norm_ticker(F.col("ticker")).alias("t"),
        norm_company(F.col("company")).alias("c"))
    # A message has few blocks and a digest few items, so this join is bounded by both.
    hits = rows.join(named, "delivery_id").groupBy("message_id", "position", "label", "verdict", "comment").agg(
        F.collect_list(F.when(F.col("label_t") == F.col("t"), F.col("item"))).alias("by_t"),
        F.collect_list(F.when(F.col("label_c") == F.col("c"), F.col("item"))).alias("by_c"), F.min("item").alias("only"))
    one_t, one_c = F.size("by_t") == 1, (F.size("by_t") == 0) & (F.size("by_c") == 1)
    source = F.when(F.col("label").isNull(), F.col("only")).when(one_t, F.get("by_t", F.lit(0))).when(one_c, F.get("by_c", F.lit(0)))
    reason = F.when(source.isNull(), F.when((F.size("by_t") > 1) | (F.size("by_c") > 1), "AMBIGUOUS_LABEL").otherwise("UNKNOWN_LABEL"))
    return _whole_messages(parsed, "__b", hits.select("message_id", "position", source.alias("source_id"), "verdict", "comment",
        reason.alias("reason")), ["source_id", "verdict", "comment"])


def _reviews(messages: DataFrame, prefix: str) -> DataFrame:
    reply = messages.withColumn("__r", text.isolate_reply(F.col("body")))
    headers = text.review_headers(F.col("__r.text"), prefix)
    none = F.struct(F.lit(False).alias("ok"), F.lit(None).cast("array<struct<ref:bigint,verdict:string,comment:string>>").alias("blocks"),
        F.col("__r.reason").alias("reason"))
    return materialize(reply.select("message_id", F.when(F.col("__r.ok"), headers).otherwise(none).alias("__b")))  # read twice, parsed once


def blind_reviews(messages: DataFrame, assignments: DataFrame, judgments: DataFrame) -> DataFrame:
    """messages (message_id, body) against assignments (assignment_id, source_id, judged_at) and judgments (assignment_id).

    A judged assignment is final, whatever became of its judgment; one whose mark and judgments disagree takes no more either.
    """
    parsed = _reviews(messages, "BR")
    judged = judgments.filter("assignment_id IS NOT NULL").select("assignment_id", F.lit(True).alias("__has")).distinct()
    state = assignments.join(judged, "assignment_id", "left").select(F.col("assignment_id").alias("ref"), "source_id",
        F.col("judged_at").isNotNull().alias("__marked"), F.coalesce("__has", F.lit(False)).alias("__has"))
    rows = _exploded(parsed, "__b").join(state, "ref", "left")
    reason = (F.when(F.col("__marked").isNull(), "UNKNOWN_REFERENCE").when(F.col("__marked") != F.col("__has"),
        "INCONSISTENT_BLIND_REVIEW_STATE").when(F.col("__marked"), "DUPLICATE_BLIND_REVIEW"))
    return _whole_messages(parsed, "__b", rows.withColumn("reason", reason), ["ref", "source_id", "verdict", "comment"])


def screen_reviews(messages: DataFrame, screenings: DataFrame, feedback: DataFrame) -> DataFrame:
    """messages (message_id, body) against screenings (screening_id, source_id); a counted review of a screening stands, an excluded one doesn't."""
    parsed = _reviews(messages, "SR")
    counted = feedback.filter((F.col("feedback_origin") == "SCREEN_REVIEW") & ~is_excluded()).select(F.col("screening_id").alias("ref"),
        F.lit(True).alias("__counted")).distinct()
    known = screenings.select(F.col("screening_id").alias("ref"), "source_id", F.lit(True).alias("__known"))
    rows = _exploded(parsed, "__b").join(known, "ref", "left").join(counted, "ref", "left")
    reason = F.when(F.col("__known").isNull(), "UNKNOWN_REFERENCE").when(F.col("__counted"), "DUPLICATE_SCREEN_REVIEW")
    return _whole_messages(parsed, "__b", rows.withColumn("reason", reason), ["ref", "source_id", "verdict", "comment"])


def as_feedback(results: DataFrame, origin: str, holdout_eligible: bool) -> DataFrame:
    """One event a resolved block: event_index is its position in the message."""
    good = results.filter("ok").select("message_id", F.posexplode("blocks").alias("event_index", "b"))
    return good.select("message_id", "event_index", F.lit("FEEDBACK").alias("event_type"), "b.source_id", "b.verdict",
        F.col("b.comment").alias("user_comment"), F.lit(origin).alias("feedback_origin"),
                       F.lit(holdout_eligible).alias("holdout_eligible"), F.lit(False).alias("excluded_from_learning"))
