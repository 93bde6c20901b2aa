"""Language-model scoring by cross-entropy difference.

A target and a background model of the same form (word bigrams, interpolated with unigrams by a Dirichlet prior) share
one vocabulary: words, A-Z lower-cased, and their pairs, each known by its full 64-bit hash, so distinct n-grams have
counts of their own however many there are. Background counts are scaled to the target's tokens, so that smoothing acts
alike on both. A document's own counts are taken out of both before it is scored. The score is the mean over its tokens
of target loss minus background loss: the lower, the more like the target.

Counting: documents are dealt by a hash into blocks of about BLOCK_BYTES of text. Each block sends its distinct n-grams
with their counts to the parts of the hash range; a part sums them over all blocks and sends each block the sums of its
own n-grams, in the order in which it came with them. The vocabulary, over which the unigram prior is uniform, is the
number of distinct words of all documents. Blocks and parts grow in number with the input, not in size, and
an n-gram comes once from each block, however common it is. The driver receives three sums.

Cases: null and blank texts have 0 tokens and null losses; repeated rows each count and are each scored; a text of any
length is handled whole; with no target rows the target model is its prior, uniform over the vocabulary; an empty table
gives an empty result; other columns are ignored. A null id is not in the target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weight of the unigram model in tokens, and what each word of that has from the start.
PRIOR, FLOOR = 20.0, 0.1
#: Target ids that are broadcast; more are joined by shuffle. Words whose hashes a worker remembers, and those it holds for the vocabulary.
MAX_BROADCAST_IDS, CACHE, HELD = 2_000_000, 250_000, 500_000
#: Text of a block of documents, and blocks for each part of the hash range.
BLOCK_BYTES, BLOCKS_PER_PART = 8_000_000, 2
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_COUNTS = "part long, block long, n long, keys binary, background binary, target binary"
_SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word) or 1  # 0 stands for the start of a text
        return out


def tokens(text: bytes | None, hashes: dict) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with the start mark in front, and pair hashes of each word with the one before."""
    found = (text or b"").lower().split()
    ids = np.zeros(len(found) + 1, np.uint64)
    ids[1:] = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    h = ids[:-1] * _A + ids[1:] * _B
    return ids, (h ^ (h >> np.uint64(31))) * _A


def _read(rows: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    hashes = _Hashes()
    return [tokens(t.as_py(), hashes) for t in rows.column("text").cast(pa.large_binary())]


def _keys(docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """All n-grams of the texts that have words."""
    return np.concatenate([np.zeros(0, np.uint64), *[x for d in docs if len(d[1]) for x in d]])


def _size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = background = target = 0
    for batch in batches:
        for text, is_target in zip(batch.column(0).cast(pa.large_binary()), batch.column(1).to_pylist(), strict=True):
            text = text.as_py() or b""
            n = len(text.split())
            size, background, target = size + len(text), background + n, target + n * is_target
    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (size, background, target)], ["size", "background", "target"])


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of a task's words; a word comes again only after HELD others."""
    hashes, held = _Hashes(), set()
    for batch in batches:
        for text in batch.column(0).cast(pa.large_binary()):
            held.update(map(hashes.__getitem__, set((text.as_py() or b"").lower().split())))
            if len(held) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(np.fromiter(held, np.uint64, len(held)).view(np.int64))], ["word"])
                held = set()
    yield pa.RecordBatch.from_arrays([pa.array(np.fromiter(held, np.uint64, len(held)).view(np.int64))], ["word"])


def _pack(rows: list[tuple]) -> pa.Table:
    names = [c.split()[0] for c in _COUNTS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, types, strict=True))})


def _planes(x: np.ndarray) -> bytes:
    """Numbers of 0 or more as bytes: the lowest byte of each, then the next of each, as far as any isn't 0."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _numbers(planes: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, : len(planes) // n] = np.frombuffer(planes, np.uint8).reshape(-1, n).T
    return out.view("<u8").ravel()


def _packed(part: int, block: int, keys: np.ndarray, background: np.ndarray, target: np.ndarray) -> tuple:
    """One row of counts; keys as differences, which take fewer bytes."""
    return part, block, len(background), _planes(np.diff(keys, prepend=np.uint64(0))), _planes(background), _planes(target)


def _unpacked(rows: pa.Table, column: str) -> list[np.ndarray]:
    return [_numbers(x.as_py(), n) for x, n in zip(rows.column(column), rows.column("n").to_pylist(), strict=True)]


def _count(key: tuple, rows: pa.Table, parts: int) -> pa.Table:
    """The distinct n-grams of a block and their counts in it, one row for each part that has any."""
    docs = _read(rows)
    keys, background = np.unique(_keys(docs), return_counts=True)
    of_target, n = np.unique(_keys([d for d, t in zip(docs, rows.column("is_target").to_pylist(), strict=True) if t]), return_counts=True)
    target = np.zeros(len(keys), np.int64)
    target[np.searchsorted(keys, of_target)] = n
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # grows with the key
    starts = np.unique(part, return_index=True)[1]
    return _pack([_packed(int(part[a]), key[0].as_py(), keys[a:b], background[a:b], target[a:b]) for a,
        b in zip(starts, np.append(starts, len(keys))[1:], strict=True)])


def _sum(rows: pa.Table) -> pa.Table:
    """The counts of a part summed over all blocks, for each row in the order of its keys."""
    each = [np.cumsum(x, dtype=np.uint64) for x in _unpacked(rows, "keys")]
    found, back = np.unique(np.concatenate(each), return_inverse=True)
    sums = []
    for c in ("background", "target"):
        s = np.zeros(len(found), np.int64)
        np.add.at(s, back, np.concatenate(_unpacked(rows, c)).astype(np.int64))
        sums.append(s)
    out, at = [], 0
    for part, block, keys in zip(rows.column("part").to_pylist(), rows.column("block").to_pylist(), each, strict=True):
        of = back[at : at + len(keys)]
        out.append(_packed(part, block, keys[:0], sums[0][of], sums[1][of]))
        at += len(keys)
    return _pack(out)


def losses(c1: np.ndarray, c2: np.ndarray, total: float, scale: float, vocabulary: int) -> np.ndarray:
    """Minus log probability of each token, from the counts of words (the start mark first) and pairs without the document's own."""
    c1, c2, total = np.maximum(c1, 0) * scale, np.maximum(c2, 0) * scale, max(total, 0) * scale
    word = (c1[1:] + FLOOR) / (total + FLOOR * vocabulary)
    return -np.log((c2 + PRIOR * word) / (np.maximum(c1[:-1], c2) + PRIOR))


def _own(x: np.ndarray) -> np.ndarray:
    _, back, n = np.unique(x, return_inverse=True, return_counts=True)
    return n[back]


def _score(rows: pa.Table, sums: pa.Table, all_b: int, all_t: int, vocabulary: int) -> pa.Table:
    docs, sums = _read(rows), sums.sort_by("part")
    found, at = np.unique(_keys(docs), return_inverse=True)
    background, target = (np.concatenate([np.zeros(0, np.uint64), *_unpacked(sums, c)]).astype(np.int64) for c in ("background", "target"))
    if len(background) != len(found):
        raise ValueError(f"{len(background)} sums for {len(found)} n-grams of a block")
    scale = all_t / all_b if all_b and all_t else 1.0
    n, lt, lb, start = [], [], [], 0
    for (ids, pairs), is_target in zip(docs, rows.column("is_target").to_pylist(), strict=True):
        n.append(len(pairs))
        if not len(pairs):
            lt.append(None)
            lb.append(None)
            continue
        i1, i2 = at[start : start + len(ids)], at[start + len(ids) : start + len(ids) + len(pairs)]
        start += len(ids) + len(pairs)
        o1, o2, out = _own(i1), _own(i2), int(is_target)
        lt.append(float(losses(target[i1] - out * o1, target[i2] - out * o2, all_t - out * len(pairs), 1.0, vocabulary).mean()))
        lb.append(float(losses(background[i1] - o1, background[i2] - o2, all_b - len(pairs), scale, vocabulary).mean()))
    diff = [None if t is None else t - b for t, b in zip(lt, lb, strict=True)]
    return pa.table({"doc_id": rows.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "target_loss": pa.array(lt, pa.float64()),
        "background_loss": pa.array(lb, pa.float64()), "score": pa.array(diff, pa.float64())})


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score for every row of docs (doc_id, text); target_ids (doc_id) names the target."""
    ids = target_ids.select(F.col("doc_id").alias("__id")).filter("__id IS NOT NULL").distinct()
    few = ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    rows = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("__id"), "left")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("__id").isNotNull().alias("is_target"))
    size = rows.select("text", "is_target").mapInArrow(_size, "size long, background long, target long").agg(*[F.coalesce(F.sum(c),
        F.lit(0)) for c in ("size", "background", "target")]).first()
    vocabulary = rows.select("text").mapInArrow(_vocabulary, "word long").distinct().count()
    blocks = 1 + size[0] // BLOCK_BYTES
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    parts, (_, all_b, all_t) = 1 + blocks // BLOCKS_PER_PART, size
    counts = rows.groupBy("block").applyInArrow(lambda key, rows: _count(key, rows, parts), _COUNTS)
    sums = counts.groupBy("part").applyInArrow(_sum, _COUNTS)
    return rows.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(lambda rows, sums: _score(rows, sums, all_b, all_t, vocabulary), _SCORES)
