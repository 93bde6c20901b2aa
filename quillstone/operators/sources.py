"""Versioned documents: current versions, counters, sweeps, screenings and their latest state.

A document's current version is the one observed last, not the one with the highest id; whether it is complete is
looked at only then, so an older complete version never stands in for a newer incomplete one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators.joins import latest_per_key

DOCUMENT = ["source_name", "external_id"]


def current_pointers(observations: DataFrame, order: tuple[str, ...] = ("observed_seq", "source_id")) -> DataFrame:
    """The version of each document that was observed last."""
    return latest_per_key(observations, DOCUMENT, *order).select(*DOCUMENT, "source_id")


def current_sources(sources: DataFrame, observations: DataFrame) -> DataFrame:
    return sources.join(current_pointers(observations).select("source_id"), "source_id", "left_semi")


def ready_sources(sources: DataFrame, observations: DataFrame) -> DataFrame:
    """Current versions that are complete and extracted."""
    return current_sources(sources, observations).filter("collection_status = 'COLLECTED' AND extraction_status = 'EXTRACTED'")


def source_versions(sources: DataFrame) -> DataFrame:
    """Versions of each document: how many, first and last."""
    return sources.groupBy(*DOCUMENT).agg(F.count("*").alias("n_versions"), F.min("source_id").alias("first_version"),
        F.max("source_id").alias("last_version"))


def source_counters(sources: DataFrame) -> DataFrame:
    """One row for each source name: documents, versions and their states, in one pass."""
    state = lambda c, v: F.count_if(F.col(c) == v).alias(f"n_{v.lower()}")
    return sources.groupBy("source_name").agg(
        F.countDistinct("external_id").alias("n_documents"), F.count("*").alias("n_versions"), state("collection_status", "COLLECTED"),
        state("collection_status", "INCOMPLETE_CONTENT"), state("extraction_status", "PENDING"), state("extraction_status", "EXTRACTED"))


def newest_text(sources: DataFrame, column: str) -> DataFrame:
    """The greatest value of a text column by source name, as text: dates are whatever the page said."""
    return sources.groupBy("source_name").agg(F.max(F.col(column).cast("string")).alias("newest"))


def pending_extraction(sources: DataFrame, observations: DataFrame, source_name: str) -> DataFrame:
    mine = sources.filter((F.col("source_name") == source_name) & (F.col("extraction_status") == "PENDING") & (F.col("collection_status") == "COLLECTED"))
    return mine.join(current_pointers(observations).select("source_id"), "source_id", "left_semi")


def missing_screening(sources: DataFrame, observations: DataFrame, screenings: DataFrame, taste_version: int,
        rules_sha256: str | None = None) -> DataFrame:
    """Ready sources without a screening of this version and, where it is given, these rules; whatever its prompt version: a new prompt alone re-screens nothing."""
    of = F.col("taste_version") == taste_version
    if rules_sha256 is not None:
        of = of & (F.col("screen_rules_sha256") == rules_sha256)
    done = screenings.filter(of).select("source_id").distinct()
    return ready_sources(sources, observations).join(done, "source_id", "left_anti")


def screened_sources_count(sources: DataFrame, screenings: DataFrame) -> DataFrame:
    return sources.join(screenings.select("source_id").distinct(), "source_id",
        "left_semi").groupBy("source_name").agg(F.count("*").alias("n_screened"))


def latest_screening(screenings: DataFrame, *keys: str) -> DataFrame:
    """The newest screening for each source, or for each (source, further keys)."""
    return latest_per_key(screenings, ["source_id", *keys], "screening_id")


def recent_screenings(sources: DataFrame, screenings: DataFrame, n: int) -> DataFrame:
    """The n newest screenings of any version with their source; the top comes before the join."""
    top = screenings.join(sources.select("source_id"), "source_id", "left_semi").orderBy(F.desc("created_at"),
        F.desc("screening_id")).limit(n)
    return top.join(sources.select("source_id", "external_id", "ticker", "collection_status"), "source_id")


def recent_current_screenings(sources: DataFrame, observations: DataFrame, screenings: DataFrame, n: int) -> DataFrame:
    """The newest screening of each complete current version, newest n."""
    live = current_sources(sources, observations).filter("collection_status = 'COLLECTED'").select("source_id", "external_id", "ticker")
    return latest_screening(screenings).join(live, "source_id").orderBy(F.desc("created_at"), F.desc("screening_id")).limit(n)


def screenings_for_audit(sources: DataFrame, observations: DataFrame, screenings: DataFrame, taste_version: int) -> DataFrame:
    """The newest screening of one version for each complete current version of a document, whatever it predicts."""
    live = current_sources(sources, observations).filter("collection_status = 'COLLECTED'").select("source_id", *DOCUMENT, "ticker")
    return latest_screening(screenings.filter(F.col("taste_version") == taste_version)).join(live, "source_id")


def latest_repairs(repairs: DataFrame) -> DataFrame:
    """The newest successful repair of each screening's narrative."""
    return latest_per_key(repairs.filter("status = 'REPAIRED'"), ["screening_id"], "repair_id")


def resolve_fetched(fetched: DataFrame, sources: DataFrame, observations: DataFrame) -> DataFrame:
    """What to do with fetched versions (source_name, external_id, content_hash, content_complete), against sources with content_hash.

    known_complete: only the pointer moves; promote: the stored incomplete version becomes complete; refresh: it stays
    incomplete; insert: a new version after previous_version, by completeness.
    """
    have = sources.select(*DOCUMENT, "content_hash", F.col("source_id").alias("known_id"), "collection_status")
    now = current_pointers(observations).withColumnRenamed("source_id", "previous_version")
    case = (F.when(F.col("known_id").isNull(), "insert").when(F.col("collection_status") == "COLLECTED", "known_complete")
            .when(F.col("content_complete"), "promote").otherwise("refresh"))
    return fetched.dropDuplicates([*DOCUMENT, "content_hash"]).join(have, [*DOCUMENT, "content_hash"], "left").join(now, DOCUMENT,
        "left").select(
        *fetched.columns, "known_id", "previous_version", case.alias("action"))


def content_versions(texts: DataFrame, document: str, text: str) -> DataFrame:
    """Distinct contents of each document by SHA-256, and whether all its versions agree."""
    hashed = texts.select(F.col(document).alias("document"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("content_hash"))
    return hashed.groupBy("document").agg(F.count("*").alias("n_versions"), F.countDistinct("content_hash").alias("n_contents"),
        F.min("content_hash").alias("first_hash")).withColumn("same", F.col("n_contents") == 1)
