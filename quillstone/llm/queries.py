"""The registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import chat, conversations, decontam, langid, lmscore, minhash, mixing, quality, resampling, secrets, sharding, toxicity, urlfilter
from quillstone.llm.common import fold, literal_rows, materialize, table


def op1_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, held_out = table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) == 1
    return toxicity.classify(table(spark, sf_dir, "documents"), labels.filter(~held_out), held_out)


def op2_segmentation_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    return langid.identify(docs, docs.filter(~held_out), held_out)


def op3_threshold_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op4_range_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.url_filter(table(spark, sf_dir, "pages"), urlfilter.rules_frame(spark, urlfilter.RULES))


def op5_kdtree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), shards=8)


def op6_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents are mixed and written; the result names the copies in their order."""
    mixed = materialize(mixing.shuffled(mixing.mix(table(spark, sf_dir, "documents"))))
    return mixed.select("row.doc_id", "row.source", "copy", F.col("place").alias("shuffle_order"))


def op7_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target: documents that are labelled as of good quality."""
    return lmscore.cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter("quality = 1"))


def op8_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op9_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_typed_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = literal_rows(spark, [(-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)],
        "conv_id long, turn long, role string, text string")
    messages = rows.unionByName(probe).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    return chat.digests(chat.read_back(chat.format_chat(messages)))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversations.digests(conversations.damage(rows), rows)


def queries() -> dict:
    return {f.__name__: f for f in (op1_counterfactual_toxicity, op2_segmentation_langid, op3_threshold_quality, op4_range_url_filter,
        op5_kdtree_sharding, op6_poisson_mixing, op7_cross_entropy_difference, op8_minmax_near_dedup, op9_pigeonhole_decontamination,
        op10_typed_chat, op11_importance_resampling, op12_secret_scan, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    return {"op3_threshold_quality": quality.oracle(), "op4_range_url_filter": urlfilter.oracle(), "op6_poisson_mixing": mixing.oracle(),
        "op8_minmax_near_dedup": minhash.oracle(), "op10_typed_chat": chat.oracle(),
        "op11_importance_resampling": resampling.oracle(), "op13_conversation_repair": conversations.oracle()}
