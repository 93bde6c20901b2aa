"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.storage import PLACE_BITS, in_order, literal_rows, materialize, release, shared_dir

__all__ = ["PLACE_BITS", "byte_blocks", "byte_runs", "byte_size", "default_parallelism", "fold", "in_order", "literal_rows", "materialize", "release", "shared_dir", "short_batches", "spread",
    "table", "whole", "words_of"]

#: White space that separates words: space, tab, newline, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
#: Ids (8 bytes each) that are broadcast; more are joined by shuffle.
MAX_BROADCAST_IDS = 2_000_000
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text in order; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus one, as long."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids fall into no fold (-1)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(-1))


def whole(df: DataFrame) -> Column:
    """All columns of a row as one struct, so that columns put beside it can't clash with them."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns])


def spread(df: DataFrame, row: str = "row") -> DataFrame:
    """The columns of a struct made by whole(), alone."""
    return df.select(*[F.col(row).getField(c).alias(c) for c in df.schema[row].dataType.names])


def short_batches(spark: SparkSession) -> None:
    """Lets Python see at most BATCH_ROWS rows at once in this session: texts are long, and a batch is held whole on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def default_parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def byte_blocks(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The UTF-8 bytes of an Arrow column of texts in blocks of about size bytes (a longer text alone): the number of the
    block's first text, its bytes, and where each of its texts ends in them. Null texts are empty. Nothing is copied."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data, at = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at]
        at = to


def byte_runs(inside: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the longest runs of marked bytes start and stop, by differences; a run that goes on from one text into the next is two."""
    edge, marked = np.zeros(len(inside) + 1, np.int8), inside.astype(np.int8)
    edge[:-1] = marked
    edge[1:] -= marked
    cut = np.unique(ends[(ends > 0) & (ends < len(inside))])
    cut = cut[inside[cut - 1] & inside[cut]]
    return np.sort(np.concatenate([np.flatnonzero(edge == 1), cut])), np.sort(np.concatenate([np.flatnonzero(edge == -1), cut]))
