"""Candidate pools, suppression by identity, digest selection and blind-review assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.exprs import norm_company, norm_ticker
from quillstone.operators.joins import greedy_distinct
from quillstone.operators.feedback import eligible_feedback, is_excluded
from quillstone.operators.sources import current_sources, latest_screening, ready_sources

DIGEST_SIZE = 5
SHOWN_PREDICTIONS = ("INVESTIGATE_NOW", "WATCH")


def with_identity(df: DataFrame) -> DataFrame:
    return df.withColumns({"norm_ticker": norm_ticker(F.col("ticker")), "norm_company": norm_company(F.col("company"))})


def identities(rows: DataFrame) -> DataFrame:
    """(kind, value): the normalised tickers and companies of rows, each once."""
    both = F.array(F.struct(F.lit("ticker").alias("kind"), F.col("norm_ticker").alias("value")),
        F.struct(F.lit("company").alias("kind"), F.col("norm_company").alias("value")))
    return with_identity(rows).select(F.explode(both).alias("i")).select("i.kind", "i.value").filter("value IS NOT NULL").distinct()


def with_hits(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Adds hit_ticker and hit_company: whether the candidate's identity is among the known ones."""
    of = lambda kind: known.filter(F.col("kind") == kind).select(F.col("value").alias(f"norm_{kind}"),
        F.lit(True).alias(f"__{kind}"))
    out = with_identity(candidates).join(of("ticker"), "norm_ticker", "left").join(of("company"), "norm_company", "left")
    return out.withColumns({f"hit_{k}": F.coalesce(f"__{k}", F.lit(False)) for k in ("ticker", "company")}).drop("__ticker", "__company")


def ticker_first():
    """A candidate with a ticker is known by it alone; the company counts only without one."""
    return F.when(F.col("norm_ticker").isNotNull(), F.col("hit_ticker")).otherwise(F.col("hit_company"))


def digest_pool(sources: DataFrame, observations: DataFrame, screenings: DataFrame, shown: DataFrame, taste_version: int) -> DataFrame:
    """Complete current sources not yet shown, with their newest screening of the version, unless that one says PASS.

    The newest is taken over all predictions first: a newer PASS hides an older WATCH.
    """
    newest = latest_screening(screenings.filter(F.col("taste_version") == taste_version)).filter("overall_prediction <> 'PASS'")
    live = current_sources(sources, observations).filter("collection_status = 'COLLECTED'").join(shown.select("source_id").distinct(),
        "source_id", "left_anti")
    return live.select("source_id", "external_id", "ticker", "company").join(newest.select("source_id", "screening_id", "created_at",
        "overall_prediction"), "source_id")


def judged_pool(pool: DataFrame, feedback: DataFrame, messages: DataFrame) -> DataFrame:
    """The pool with judged: whether an eligible judgment already names its identity."""
    return with_hits(pool, identities(eligible_feedback(feedback, messages))).withColumn("judged", ticker_first())


def select_digest(pool: DataFrame, size: int = DIGEST_SIZE) -> DataFrame:
    """INVESTIGATE_NOW before WATCH, each oldest screening first; at most size rows, with their position from 1. pool: with judged, and gap if narratives are checked."""
    from pyspark.sql import Window

    gap = F.col("gap") if "gap" in pool.columns else F.lit(False)
    rank = F.when(F.col("overall_prediction") == "INVESTIGATE_NOW", 0).otherwise(1)
    best = pool.filter(~F.col("judged") & ~gap & F.col("overall_prediction").isin(*SHOWN_PREDICTIONS)).withColumn("__rank",
        rank).orderBy("__rank", "created_at", "screening_id").limit(size)
    return best.withColumn("position", F.row_number().over(Window.orderBy("__rank", "created_at",
        "screening_id"))).drop("__rank")  # at most size rows


def suppression_counters(pool: DataFrame) -> DataFrame:
    gap = F.col("gap") if "gap" in pool.columns else F.lit(False)
    return pool.agg(F.count("*").alias("n_candidates"), F.count_if("judged").alias("n_already_judged"),
        F.count_if(~F.col("judged") & gap).alias("n_narrative_gaps"))


def blind_review_pool(sources: DataFrame, observations: DataFrame, shown: DataFrame, assignments: DataFrame, screenings: DataFrame,
        feedback: DataFrame) -> DataFrame:
    """Ready sources never shown, never assigned, and with no screening that a counted screen review speaks of."""
    reviewed = feedback.filter((F.col("feedback_origin") == "SCREEN_REVIEW") & ~is_excluded()).select("source_id")
    spoken = screenings.select("source_id").join(reviewed, "source_id", "left_semi")
    taken = shown.select("source_id").unionByName(assignments.select("source_id")).unionByName(spoken).distinct()
    return ready_sources(sources, observations).join(taken, "source_id", "left_anti")


def greedy_assignments(pool: DataFrame, known: DataFrame, limit: int) -> DataFrame:
    """(position, source_id): up to limit sources in order of discovery, each with a ticker and a company that no known or earlier chosen one has."""
    fresh = with_hits(pool, known).filter(~F.col("hit_ticker") & ~F.col("hit_company"))
    chosen = greedy_distinct(fresh.select("source_id", "discovered_seq", "norm_ticker", "norm_company"), ["discovered_seq", "source_id"],
        ["norm_ticker", "norm_company"], limit)
    return chosen.select(F.col("position").cast("int").alias("position"), "source_id")


def judged_or_assigned(feedback: DataFrame, messages: DataFrame, assigned: DataFrame) -> DataFrame:
    """Identities that a new blind review must not repeat: of every eligible judgment, and of every source ever assigned (rows with ticker and company)."""
    return identities(eligible_feedback(feedback, messages).select("ticker", "company").unionByName(assigned.select("ticker", "company")))


def delivery_by_thread(deliveries: DataFrame) -> DataFrame:
    """The newest delivery of each thread; a null or blank thread has none."""
    from quillstone.operators.joins import latest_per_key

    return latest_per_key(deliveries.filter("provider_thread_id <> ''"), ["provider_thread_id"], "delivery_id")


def delivery_items(items: DataFrame, sources: DataFrame) -> DataFrame:
    return items.join(sources.select("source_id", "ticker", "company", "external_id"), "source_id")
