"""Where intermediate tables go: the folder in spark.checkpoint.dir, which the driver and all executors share."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, from spark.checkpoint.dir; a temporary one only where that is unset and the master is local."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quillstone-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def _at(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, which goes with the session."""
    path = f"{shared_dir(spark)}/quillstone-{name}-{uuid.uuid4().hex}"
    target, fs = _at(spark, path)
    fs.mkdirs(target)
    fs.deleteOnExit(target)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back.

    Lineage ends there, so a lost executor costs one stage, and choices that another run could make otherwise (range
    bounds, partition ids) are fixed. The files go with the session, or earlier by release().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillstone-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target, fs = _at(spark, path)
    fs.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillstone_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes what materialize() wrote for these frames, once no later plan reads it."""
    for df in frames:
        path = getattr(df, "_quillstone_path", None)
        if path:
            target, fs = _at(df.sparkSession, path)
            fs.delete(target, True)


#: Whether the shuffle files of a query go from all disks when it ends. Else they stay until the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run within leave no shuffle files, so in steps of materialize() the disk holds the shuffles of one step, not of all."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows that the driver knows, as one literal inside the plan: no RDD and no Python worker."""
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    made = F.from_json(F.lit(text), f"array<struct<{', '.join(c.replace(' ', ': ', 1) for c in schema.split(', '))}>>")
    return spark.range(0, 1, 1, 1).select(F.inline(made))


#: Bits of a place written by in_order() that count rows within a range; those above number the range.
PLACE_BITS = 33


def in_order(rows: DataFrame, *order: Column) -> DataFrame:
    """rows sorted by ranges and written, with __at: it grows in the order given, over all ranges, and numbers the rows of each
    range without gaps. A range is one task's share, whatever the keys: equal rows are dealt to several, in any order."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order, "__tie").sortWithinPartitions(
        *order, "__tie")
    return materialize(ranged.drop("__tie").withColumn("__at", F.monotonically_increasing_id()))
