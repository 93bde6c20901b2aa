"""Idea records and blind predictions: source isolation, extraction, prediction once for each version, and the gated reveal.

An idea belongs to one message. Its record is what its events say: ISOLATED or UNSCORABLE first, EXTRACTED later.
Predictions are immutable and unique for (idea_id, taste_version, screen_rules_sha256).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.isolation import isolate_source
from quillstone.operators.feedback import eligible_feedback, holdout_pool
from quillstone.operators.joins import latest_per_key
from quillstone.operators.models import PREDICTION, EXTRACTED_IDEA, apply_model, checked_json

ISOLATED, UNSCORABLE = "ISOLATED", "UNSCORABLE_SOURCE"
VERSION = ["idea_id", "taste_version", "screen_rules_sha256"]


def first_comments(pool: DataFrame) -> DataFrame:
    """(message_id, comment): the comment of each message's first event."""
    return pool.groupBy("message_id").agg(F.min_by("user_comment", "feedback_id").alias("comment"))


def isolated(messages: DataFrame, pool: DataFrame, ideas: DataFrame) -> DataFrame:
    """Records for messages of the pool that have none, or an unscorable one that can be isolated by now.

    message_id, source_status, source_type, source_text, source_hash, unscorable_reason. What stays unscorable gives no
    new record, so a run that finds nothing new writes nothing.
    """
    known = ideas.select("message_id", F.col("source_status").alias("__before"))
    todo = messages.join(first_comments(pool), "message_id").join(known, "message_id",
        "left").filter(F.col("__before").isNull() | (F.col("__before") == UNSCORABLE))
    read = isolate_source(todo.select("message_id", "body_raw", "comment", "__before"), "body_raw", "comment", to="__r")
    ok = F.col("__r.ok")
    return read.filter(ok | F.col("__before").isNull()).select(
        "message_id", F.when(ok, ISOLATED).otherwise(UNSCORABLE).alias("source_status"), F.col("__r.kind").alias("source_type"),
        F.col("__r.text").alias("source_text"),
        F.sha2("__r.text", 256).alias("source_hash"), F.col("__r.reason").alias("unscorable_reason"))


def pending_extraction(ideas: DataFrame) -> DataFrame:
    return ideas.filter((F.col("source_status") == ISOLATED) & (F.col("extraction_status") != "EXTRACTED"))


def without_prediction(ideas: DataFrame, predictions: DataFrame, taste_version: int, rules_sha256: str) -> DataFrame:
    """Extracted ideas without a prediction of exactly this version and these rules."""
    done = predictions.filter((F.col("taste_version") == taste_version) & (F.col("screen_rules_sha256") == rules_sha256)).select("idea_id").distinct()
    return ideas.filter((F.col("source_status") == ISOLATED) & (F.col("extraction_status") == "EXTRACTED")).join(done, "idea_id",
        "left_anti")


def new_predictions(made: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predictions whose (idea, version, rules) has none yet, one of each; the rest is ignored."""
    return made.dropDuplicates(VERSION).join(predictions.select(*VERSION).distinct(), VERSION, "left_anti").select(*made.columns)


def latest_predictions(predictions: DataFrame) -> DataFrame:
    """The newest prediction of each idea."""
    return latest_per_key(predictions, ["idea_id"], "prediction_id")


def sweep_counters(ideas: DataFrame, predictions: DataFrame, feedback: DataFrame, messages: DataFrame, checkpoint: int,
        taste_version: int) -> DataFrame:
    """One row of counts, none of which tells a single prediction: hold-out judgments, isolated and unscorable sources, predictions of the version."""
    n = ideas.agg(F.count_if(F.col("source_status") == ISOLATED).alias("n_isolated"),
        F.count_if(F.col("source_status") == UNSCORABLE).alias("n_unscorable"))
    p = predictions.agg(F.count_if(F.col("taste_version") == taste_version).alias("n_predictions"))
    h = holdout_pool(feedback, messages, checkpoint).agg(F.count("*").alias("n_holdout"))
    return h.join(F.broadcast(n)).join(F.broadcast(p))  # one row each


def revealed(ideas: DataFrame, predictions: DataFrame, feedback: DataFrame, messages: DataFrame) -> DataFrame:
    """The newest prediction of each idea beside each eligible judgment of its message; ideas without one don't appear at all."""
    judged = eligible_feedback(feedback, messages)
    comment = F.col("user_comment") if "user_comment" in feedback.columns else F.lit(None).cast("string")
    judged = judged.select("message_id", "feedback_id", "verdict", comment.alias("user_comment"))
    return latest_predictions(predictions).join(ideas.select("idea_id", "message_id", "ticker", "company"), "idea_id").join(judged,
        "message_id")


def extraction(ideas: DataFrame, factory: Callable) -> DataFrame:
    """Ideas pending extraction with status and, where it is OK, the struct idea of the model's answer; the others are tried again in a later run."""
    answered = apply_model(pending_extraction(ideas), "source_text", factory, EXTRACTED_IDEA)
    return answered.withColumn("idea", checked_json(F.col("answer"), EXTRACTED_IDEA))


def screening(ideas: DataFrame, predictions: DataFrame, prompt: str, factory: Callable, taste_version: int, rules_sha256: str) -> DataFrame:
    """Rows for new_predictions() of the ideas that lack one: the anti-join comes before the model."""
    todo = without_prediction(ideas, predictions, taste_version, rules_sha256)
    answered = apply_model(todo, prompt, factory, PREDICTION).filter("status = 'OK'").withColumn("__p",
        checked_json(F.col("answer"), PREDICTION))
    return answered.select("idea_id", F.lit(taste_version).alias("taste_version"), F.lit(rules_sha256).alias("screen_rules_sha256"),
        "source_hash", *[F.col(f"__p.{c}").alias(c) for c in PREDICTION])
