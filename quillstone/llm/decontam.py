"""Benchmark decontamination by pigeonhole edit matching.

Texts are normalised: A-Z lower-cased, every run of ASCII punctuation and white space one space. A test item of m bytes
may be found with up to e = floor(m * ERROR_PERCENT / 100) edits. Cut into e + 1 pieces, at least one piece of it must
then stand unchanged in a matching document, so an Aho-Corasick automaton of all pieces finds every candidate place,
and Myers' bit-parallel algorithm decides in the window around it what the least edit distance is.

Items go through in blocks whose automaton stays below BLOCK_BYTES of pieces, a pass over the documents for each block:
a stated query set against all rows. Only items are ever sent to the executors, a block at a time. The distinct texts
of the items are read to the driver, in blocks as well.

Cases: null and blank texts match nothing, and null or blank items are never found; an item of fewer than
13 bytes is matched exactly, as its budget is 0; several items with one text
are each reported, as is each item with the least of its distances in a document, whatever places have it; repeated documents are each reported; a text of any length is searched whole, in memory in
proportion to it; an empty table of either kind gives an empty result. find_leaks() ignores other columns; decontaminate()
carries them, whatever their names, and judges rows with a null or repeated id each by its own text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import short_batches

#: Edits allowed, per cent of an item's normalised length; bytes of pieces in one automaton.
ERROR_PERCENT, BLOCK_BYTES = 8, 8_000_000
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normalise(text: bytes | None) -> bytes:
    return b" ".join((text or b"").translate(_TABLE).split())


def budget(length: int) -> int:
    return length * ERROR_PERCENT // 100


def pieces(item: bytes) -> list[tuple[int, bytes]]:
    """(offset, piece) of the budget + 1 pieces, of nearly equal lengths."""
    n = budget(len(item)) + 1
    cuts = [i * len(item) // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: bytes, text: bytes) -> tuple[int, int]:
    """The least edit distance of the pattern to a substring of the text, and where the first such substring ends."""
    m = len(pattern)
    masks: dict[int, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, at = m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        rise, fall = down | ~(diagonal | up), up & diagonal
        score += bool(rise & top) - bool(fall & top)
        rise, fall = (rise << 1) & full, (fall << 1) & full
        # The text may begin anywhere, so the first row stays 0: no carry into bit 0.
        up, down = (fall | ~(diagonal | rise)) & full, rise & diagonal
        if score < best:
            best, at = score, j + 1
    return best, at


def _automaton(items: list[tuple[list[int], bytes]]):
    import ahocorasick

    auto, of = ahocorasick.Automaton(ahocorasick.STORE_ANY), defaultdict(list)
    for i, (_, text) in enumerate(items):
        for offset, piece in pieces(text):
            of[piece].append((i, offset))
    for piece, places in of.items():
        auto.add_word(piece.decode("latin-1"), (len(piece), places))
    auto.make_automaton()
    return auto


def match(text: bytes, items: list[tuple[list[int], bytes]], auto) -> list[tuple[int, int, int]]:
    """(item, distance, end in the normalised text) of the best match of each item within its budget. text: normalised."""
    if not text:
        return []
    places: dict[int, set[int]] = defaultdict(set)
    for end, (size, found) in auto.iter(text.decode("latin-1")):
        for i, offset in found:
            places[i].add(end + 1 - size - offset)
    out = []
    for i, starts in places.items():
        item = items[i][1]
        e, best = budget(len(item)), None
        through = -1
        for s in sorted(starts):
            if best is not None and best[0] == 0:
                break
            if text.startswith(item, max(s, 0)) and s >= 0:
                best = (0, s + len(item))
            elif e and s > through:
                # Starts within the budget of each other share a window.
                a, b = max(0, s - e), min(len(text), s + len(item) + 2 * e)
                through = s + e
                d, at = myers(item, text[a:b])
                if d <= e and (best is None or d < best[0]):
                    best = (d, a + at)
        if best:
            out.append((i, *best))
    return out


def _scan(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    items, auto = shared.value, None
    for batch in batches:
        auto = auto or _automaton(items)
        rows: list[tuple] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
            for i, d, end in match(normalise(text), items, auto):
                rows += [(doc_id, item_id, d, end, len(items[i][1])) for item_id in items[i][0]]
        cols = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "distance", "end", "item_length"])


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[list[int], bytes]]]:
    """Distinct normalised items with their ids, in blocks of BLOCK_BYTES, read one partition at a time."""
    ids: dict[bytes, list[int]] = defaultdict(list)
    total = 0
    for row in benchmark.filter("text IS NOT NULL").select(F.col("item_id").cast("long"), "text").toLocalIterator():
        text = normalise(row[1].encode())
        if text:
            total += 0 if text in ids else len(text)
            ids[text].append(row[0])
        if total >= BLOCK_BYTES:
            yield [(v, k) for k, v in ids.items()]
            ids, total = defaultdict(list), 0
    if ids:
        yield [(v, k) for k, v in ids.items()]


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, end, item_length) for every item found in a document within its error budget."""
    spark, out = docs.sparkSession, None
    short_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, distance long, end long, item_length long"
    for items in _blocks(benchmark):
        found = docs.mapInArrow(partial(_scan, shared=spark.sparkContext.broadcast(items)), schema)
        out = found if out is None else out.union(found)
    return docs.limit(0).mapInArrow(partial(_scan, shared=spark.sparkContext.broadcast([])), schema) if out is None else out


def _clean(batches: Iterator[pa.RecordBatch], shared, text_at: int) -> Iterator[pa.RecordBatch]:
    """The rows of whole batches in whose text no item is found."""
    items, auto = shared.value, None
    for batch in batches:
        auto = auto or _automaton(items)
        texts = batch.column(text_at).cast(pa.large_binary()).to_pylist()
        yield batch.filter(pa.array([not match(normalise(t), items, auto) for t in texts], pa.bool_()))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no item is found, with all their columns: a filter row by row, so ids play no part in it."""
    short_batches(docs.sparkSession)
    for items in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)
        docs = docs.mapInArrow(partial(_clean, shared=shared, text_at=docs.columns.index("text")), docs.schema)
    return docs
