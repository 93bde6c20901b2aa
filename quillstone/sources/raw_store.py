"""Raw pages, content-addressed: the first write of a page wins and later ones are no-ops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.exprs import artifact_path

SCHEMA = "source_name string, external_id string, content_hash string, path string, html string"
KEY = ["source_name", "external_id", "content_hash"]


def read_raw(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(SCHEMA).parquet(root)
    except Exception as e:  # the store doesn't exist before its first page
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SCHEMA)


def save_raw(pages: DataFrame, root: str) -> None:
    """Appends pages (source_name, external_id, html; content_hash optional) whose content isn't stored yet."""
    if "content_hash" not in pages.columns:
        pages = pages.withColumn("content_hash", F.sha2("html", 256))
    named = pages.withColumn("path", artifact_path(F.col("source_name"), F.col("external_id"), F.col("content_hash"))).select("source_name",
        "external_id", "content_hash", "path", "html")
    new = named.dropDuplicates(KEY).join(read_raw(pages.sparkSession, root).select(*KEY), KEY, "left_anti")
    new.select("external_id", "content_hash", "path", "html", "source_name").write.mode("append").partitionBy("source_name").parquet(root)


def intact(pages: DataFrame) -> DataFrame:
    """Stored pages, each checked against the hash that it is filed under as it is read; one that differs fails the job and is named."""
    what = F.concat_ws("/", "source_name", "external_id", "content_hash")
    checked = F.when(F.sha2("html", 256) == F.col("content_hash"), F.col("html")).otherwise(F.raise_error(F.concat(
        F.lit("a stored page isn't what its hash says: "), what)).cast("string"))
    return pages.withColumn("html", checked)
