"""Sharding, mixing and near-duplicates against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from quillstone.llm import minhash, mixing, sharding

DOCS = "doc_id long, text string, lang string, source string, size string"


def documents(n=400, seed=1):
    rng = random.Random(seed)
    rows = [(i, "x" * rng.randint(0, 400) if i % 9 else None, rng.choice(["en", "de", None]),
        "hot" if rng.random() < 0.5 else f"s{rng.randint(0, 5)}", "clash") for i in range(n)]
    return rows + [(10_000 + i, "copy of one text " * 10, "en", "hot", "clash") for i in range(n // 2)] + [(7, "again", "en", "hot",
        "clash"), (None, "no id", None, None, "clash")]


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_are_balanced_and_slots_gapless(spark, shards):
    rows = documents()
    got = sharding.assign_shards(spark.createDataFrame(rows, DOCS), shards=shards).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    size, slots = defaultdict(int), defaultdict(list)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(size) == set(range(shards)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(size.values()) - min(size.values()) <= 3 * 401


def plain_kd_tree(rows, shards):
    """{(size, text): shard} by a k-d tree over groups of equal texts, each in one piece."""
    mask, groups = 2**42 - 1, {}
    code = lambda x: zlib.crc32((x if x is not None else "\0").encode()) >> 12
    for _, t, lang, source, _ in rows:
        g = groups.setdefault(t or "", [0, (1 << 20, 0)])
        g[0] += len((t or "").encode()) + 1
        g[1] = min(g[1], (code(lang), code(source)))
    points = [(t, n, (*p, min(2**20 - 1, math.floor(math.log2(len(t.encode()) + 1) * (2**20 / 40))),
        xxhash.xxh64_intdigest(t.encode(), seed=42) & mask)) for t, (n, p) in groups.items()]
    out = {}

    def split(own, first, k):
        if k == 1 or not own:
            out.update({t: first for t, _, _ in own})
            return
        dim = max(range(3), key=lambda d: max(p[d] for _, _, p in own) - min(p[d] for _, _, p in own))
        own = sorted(own, key=lambda x: (x[2][dim], x[2][3]))
        want, upto = sum(n for _, n, _ in own) * (k // 2) / k, 0
        for i, (_, n, _) in enumerate(own):
            if upto + n >= want or i == len(own) - 1:
                at = i + (upto + n - want <= want - upto)
                break
            upto += n
        split(own[:at], first, k // 2)
        split(own[at:], first + k // 2, k - k // 2)

    split(points, 0, shards)
    return out


@pytest.mark.parametrize("shards", [2, 5, 8])
def test_shards_match_a_plain_kd_tree(spark, monkeypatch, shards):
    monkeypatch.setattr(sharding, "SLACK", 0.0)
    monkeypatch.setattr(sharding, "GROUP_SLACK", 1e9)
    rows = [(i, t, lang, s, x) for i, (d, t, lang, s, x) in enumerate(documents(300, seed=4))] + [(900 + i, "two copies " * 3, f"l{i}",
        f"s{i}", "x") for i in range(6)]
    want = plain_kd_tree(rows, shards)
    got = sharding.assign_shards(spark.createDataFrame(rows, DOCS), shards=shards).collect()
    text = {r[0]: r[1] or "" for r in rows}
    assert {r.doc_id: r.shard for r in got} == {d: want[t] for d, t in text.items()}


@pytest.mark.parametrize("doc_id", [5, None])
def test_repeated_rows_are_dealt_evenly(spark, doc_id):
    df = spark.createDataFrame([(doc_id, "one text for all of them", "en", "hot", "x")] * 4000, DOCS).repartition(7)
    got = Counter(r.shard for r in sharding.assign_shards(df, shards=8).collect())
    assert set(got) == set(range(8)) and max(got.values()) - min(got.values()) <= 20


def test_equal_texts_stay_together(spark):
    rng = random.Random(6)
    rows = [(i, f"text {rng.randint(0, 700)} " * 9, rng.choice(["en", "de", "fr"]), f"s{rng.randint(0, 9)}", "x") for i in range(4000)]
    got = sharding.assign_shards(spark.createDataFrame(rows, DOCS), shards=8, keep=("doc_id", "text", "size", "lang")).collect()
    shards, size = defaultdict(set), Counter()
    for r in got:
        shards[r.text].add(r.shard)
        size[r.shard] += r.size
    assert all(len(s) == 1 for s in shards.values()) and max(size.values()) < 1.04 * min(size.values())


def test_shards_by_target_bytes_and_empty(spark):
    df = spark.createDataFrame(documents(), DOCS)
    total = sum(len(r[1] or "") + 1 for r in documents())
    assert len({r.shard for r in sharding.assign_shards(df, target_bytes=total // 5 + 1).collect()}) == 5
    assert sharding.assign_shards(df.limit(0), shards=4).count() == 0
    one = spark.createDataFrame([(1, "only", None, None, "x")], DOCS)
    assert [(r.size, r.slot) for r in sharding.assign_shards(one, shards=8).collect()] == [(5, 0)]


def poisson_count(rate, doc_id, seed=mixing.SEED):
    u = (int(hashlib.md5(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    k, p = 0, math.exp(-rate)
    c = p
    while c <= u and k < 10_000:
        k += 1
        p *= rate / k
        c += p
    return k


def test_mixing_draws_the_inverted_counts(spark):
    rows = documents()
    weights = {"hot": 1.0, "s1": 2.0, "s2": 0.0, None: 5.0, "absent": 9.0}
    df = spark.createDataFrame(rows, DOCS)
    n = Counter(r[3] for r in rows)
    share = {s: weights.get(s, 0.0) for s in n}
    rate = {s: round(share[s] * len(rows) / (sum(share.values()) * n[s]), 9) for s in n}
    got = Counter((r.row.doc_id, r.row.source, r.row.text) for r in mixing.mix(df, weights).collect())
    want = Counter()
    for d, t, _, s, _ in rows:
        if rate[s] > 0:
            want[(d, s, t)] += poisson_count(rate[s], d)
    assert got == +want and max(rate.values()) > 100  # the null source's single row is repeated some hundred times
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_meets_the_target(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "CASE WHEN id % 10 < 7 THEN 'a' ELSE 'b' END AS source", "'t' AS text")
    out = mixing.shuffled(mixing.mix(df, {"a": 0.5, "b": 0.5}))
    by = {r.source: r["count"] for r in out.groupBy("row.source").count().collect()}
    assert abs(by["a"] - 10_000) < 400 and abs(by["b"] - 10_000) < 400
    assert out.select("copy", "row.doc_id").distinct().count() == out.count()


def test_mixing_spreads_rows_of_one_id(spark):
    df = spark.range(20_000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 7 ELSE id END AS doc_id", "'s' AS source", "'t' AS text")
    sizes = [len(p) for p in mixing.shuffled(mixing.mix(df)).select("place").rdd.glom().collect()]
    assert max(sizes) < 1.3 * sum(sizes) / len(sizes)


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k, percent):
    sets, root = [shingles(t, k) for _, t in rows], {d: d for d, _ in rows if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            both = len(sets[i] & sets[j])
            if None not in (a, b) and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in root}


def near_rows(seed=2):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("klmnop") + str(rng.randint(0, 30))
    rows, bases = [], [[word() for _ in range(rng.randint(30, 120))] for _ in range(25)]
    for base in bases:
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w))
    passage = " ".join(word() for _ in range(60))
    rows += [passage + " " + " ".join(word() for _ in range(rng.randint(15, 40))) for _ in range(60)]
    chain = [word() for _ in range(100)]
    for i in range(12):
        chain = chain[3:] + [word() for _ in range(3)]
        rows.append(" ".join(chain))
    rows += ["A b", "a B", "a", "", None, " \n", "a b c", "A B C\u00c9", "z " * 5000] + [rows[0].upper()] * 40
    rng.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(spark, k, percent, monkeypatch):
    rows = near_rows()
    extra = [(6, "something else entirely " * 3), (None, rows[0][1]), (rows[3][0], rows[3][1])]
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows + extra], "doc_id long, text string, key string")
    want = brute_components(rows + extra, k, percent)
    for small in (2048, 4):  # the second makes residual buckets go through pivots
        monkeypatch.setattr(minhash, "SMALL_BUCKET", small)
        got = minhash.near_duplicates(df, k, percent).collect()
        assert len(got) == len(rows) + 3
        assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
        texts = defaultdict(set)
        for d, t in rows + extra:
            texts[d].add(len(shingles(t, k)))
        assert all(r.n_shingles in texts[r.doc_id] for r in got)
    kept = minhash.deduplicate(df, k, percent)
    left = Counter(r.doc_id for r in kept.collect())
    blank = Counter(d for d, t in rows + extra if not (t or "").strip())
    with_words = {d for d, t in rows + extra if (t or "").strip() and d is not None}
    assert kept.columns == df.columns and left == Counter(d for d in with_words if want[d] == d) + blank + Counter([None])


def test_one_row_of_each_component_stays(spark):
    texts = [f"document {i} has words of its own {i * 7} and {i * 11} more of them {i}" for i in range(20)]
    rows = [(i, t, "a", i, "b", True) for i, t in enumerate(texts)] * 2 + [(100, texts[3], "a", 1, "b", None), (5, None, "a", 1, "b", None),
        (None, texts[4], "a", 1, "b", None), (None, texts[4], "a", 1, "b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, n long, what string, wordless boolean")
    left = minhash.deduplicate(df)
    assert left.columns == df.columns and Counter(r.doc_id for r in left.collect()) == Counter([*range(20), 5, None, None])
    assert minhash.deduplicate(df.limit(0)).count() == 0


@pytest.mark.parametrize("many", [0, 1])
def test_hot_classes_and_many_ids_change_nothing(spark, monkeypatch, many):
    """With every bound at 0 or 1 the joins go by shuffle and hot classes alone are broadcast."""
    rows = near_rows(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, 5, 80)
    monkeypatch.setattr(minhash, "MAX_BROADCAST_CLASSES", many)
    monkeypatch.setattr(minhash, "MAX_BROADCAST_IDS", many)
    monkeypatch.setattr(minhash, "HOT_CLASS", 10)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()} == want
    assert {r.doc_id for r in minhash.deduplicate(df).collect()} == {d for d, c in want.items() if c == d}


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(df).count() == 0
    blank = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert sorted(tuple(r) for r in minhash.near_duplicates(blank).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(4)
    flips, factors = minhash._permutations(400)
    for s in (0.5, 0.8, 0.9):
        n = 500
        common = int(2 * n * s / (1 + s))
        x = rng.integers(0, 2**63, 2 * n - common, dtype=np.uint64)
        a, b = minhash.signature(np.sort(x[:n]), flips, factors), minhash.signature(np.sort(x[n - common :]), flips, factors)
        assert abs((a == b).mean() - common / (2 * n - common)) < 0.06
