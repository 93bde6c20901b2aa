"""Importance resampling against plain Python, on odd texts and rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain_buckets(text, buckets=resampling.BUCKETS, longest=2):
    w = plain_words(text)
    runs = [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    return [zlib.crc32(r.encode()) % buckets for r in runs]


def plain_resample(rows, target, percent=25, least=20):
    s, t = [0] * 10000, [0] * 10000
    for side, texts in ((s, [x for _, x in rows]), (t, target)):
        for x in texts:
            for b in plain_buckets(x):
                side[b] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[i] + 1) * (S + 10000) / ((s[i] + 1) * (T + 10000)))) for i in range(10000)]
    out = []
    for i, x in rows:
        b = plain_buckets(x)
        weight = sum(gain[k] for k in b) // len(b) if b else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None,
            len(plain_words(x)) >= least])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for n, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = n
    return [tuple(r[:5]) for r in out]


def automaton(texts, longest=2):
    """Buckets of each text, sorted."""
    out = [[] for _ in texts]
    for first, words in resampling._blocks(pa.array(texts, pa.string())):
        for b, i in zip(*words.features(longest, resampling.BUCKETS), strict=True):
            out[first + i].append(int(b))
    return [sorted(x) for x in out]


BITS = st.sampled_from(["a", "Z", "0", "9", ":", "@", "[", "`", "{", "\x7f", "\x00", " ", "\n", "é", "İ", "K", "\u0085", "漢", "😀", "b" * 47,
    "c" * 60])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(BITS, max_size=14).map("".join)), max_size=8), st.integers(1, 4))
def test_automaton_hashes_the_runs_of_every_text(texts, longest):
    assert automaton(texts, longest) == [sorted(plain_buckets(x, longest=longest)) for x in texts]


def test_automaton_in_blocks_and_slices(monkeypatch):
    rng = random.Random(4)
    texts = [None, "", "a" * 5000, "é" * 100, *["".join(rng.choice("abZ09 .é") for _ in range(rng.randint(0, 90))) for _ in range(200)]]
    want = [sorted(plain_buckets(x)) for x in texts]
    for size in (1, 50, 700, 10**6):
        monkeypatch.setattr(resampling, "BLOCK_BYTES", size)
        assert automaton(texts) == want
    cut = pa.array(texts, pa.string()).slice(3, 50)
    got = [sorted(w.features(1, 10000)[0].tolist()) for _, w in resampling._blocks(cut)]
    assert sorted(b for g in got for b in g) == sorted(b for x in texts[3:53] for b in plain_buckets(x, longest=1))


def test_crc_is_the_public_one():
    assert np.array_equal(resampling.STEP[:3], [0, 0x77073096, 0xEE0E612C])
    assert automaton(["123456789"], 1) == [[0xCBF43926 % 10000]]


def test_resampling_matches_plain_python(spark):
    rng = random.Random(8)
    words = ["alpha", "Beta", "gamma9", "été", "x", "漢字", "delta-", "ω"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))
    rows = [(i, text()) for i in range(300)] + [(1000, None), (1001, ""), (1002, "a b " * 20000), (1003, "q" * 100_000)]
    rows += [(5, rows[5][1])] * 3 + [(None, "alpha beta " * 15)] * 40  # repeated rows and ids
    target = ["alpha Beta gamma9", None, "alpha beta", ""]
    docs = spark.createDataFrame([(i, x, "clash") for i, x in rows], "doc_id long, text string, score string").repartition(3)
    got = resampling.importance_resample(docs, spark.createDataFrame([(x,) for x in target], "text string"))
    found = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()]
    want = plain_resample(rows, target)
    none = lambda r: tuple(-10**9 if v is None else v for v in r)
    assert sorted(map(none, found)) == sorted(map(none, want))
    drawn = resampling.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"))
    assert drawn.columns == docs.columns
    assert sorted(map(none, ((r.doc_id, r.text) for r in drawn.collect())), key=str) == sorted(map(none, [(i, x) for (i, x),
        w in zip(rows, want, strict=True) if w[4]]), key=str)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.importance_resample(none, none).count() == 0
    docs = spark.createDataFrame([(1, "a b " * 10), (2, "c")], "doc_id long, text string")
    got = {r.doc_id: r for r in resampling.importance_resample(docs, none, percent=100).collect()}
    assert got[1]["rank"] == 1 and got[2]["rank"] is None and got[1].n_features == 39


def test_shares_of_ranges_are_even_though_scores_tie(spark):
    rows = spark.range(4000).selectExpr("5L AS score", "CAST(NULL AS LONG) AS id")
    placed = resampling._placed(rows, rows["score"].desc(), rows["id"].asc())
    assert sorted(r.place for r in placed.select("place").collect()) == list(range(4000))
    assert max(len(p) for p in placed.rdd.glom().collect()) < 2500
