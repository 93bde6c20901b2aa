"""Language ID, toxicity, language-model scores and decontamination."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import decontam, langid, lmscore, queries, toxicity

SF = "/root/testdata/sf0.01"


def brute_probability(word, pieces, p, unknown):
    """Sum over all segmentations, by enumeration."""
    def ways(s):
        if not s:
            return 1.0
        total = 0.0
        for n in range(1, min(len(s), langid.LONGEST) + 1):
            piece = s[:n]
            if piece in pieces:
                total += p[pieces.index(piece)] * ways(s[n:])
            elif n == 1:
                total += unknown * ways(s[n:])
        return total
    return ways(langid.MARK + word)


def test_forward_sums_all_segmentations():
    pieces = sorted(["▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab", "abab", "c"])
    lattice = langid.Lattice(pieces)
    rng = np.random.default_rng(1)
    p = rng.random((len(pieces) + 2, 3)) / 10
    p[lattice.unknown], p[lattice.none] = langid.UNKNOWN, 0
    found = ["a", "ab", "abab", "xab", "bababac", "abx", "ü", "ab" * 20]
    got = lattice.log_probabilities(found, p)
    for w, row in zip(found[:-1], got, strict=False):
        for c in range(3):
            assert math.isclose(row[c], math.log(brute_probability(w, pieces, p[:, c], langid.UNKNOWN)), rel_tol=1e-9)
    long = "ab" * 20
    assert np.allclose(got[-1], lattice._long(long, p)) and np.allclose(lattice._long("abab", p), got[2])
    assert np.isfinite(lattice._long("ab" * 6000, p)).all()


def plain_counts(word, pieces, p):
    """Expected piece counts of a word over all its segmentations, by dictionaries of sums of its beginnings and ends."""
    text, n = langid.MARK + word, len(word) + 1
    steps = []
    for i in range(n):
        for size in range(1, min(langid.LONGEST, n - i) + 1):
            piece = text[i : i + size]
            if piece in pieces:
                steps.append((i, i + size, pieces.index(piece), p[pieces.index(piece)]))
            elif size == 1:
                steps.append((i, i + 1, len(pieces), langid.UNKNOWN))
    ahead, back = {0: 1.0}, {n: 1.0}
    for i, j, _, q in steps:
        ahead[j] = ahead.get(j, 0.0) + ahead.get(i, 0.0) * q
    for i, j, _, q in reversed(steps):
        back[i] = back.get(i, 0.0) + q * back.get(j, 0.0)
    out = Counter()
    for i, j, k, q in steps:
        out[k] += ahead.get(i, 0.0) * q * back.get(j, 0.0) / ahead[n]
    return out


def test_expectation_maximisation_matches_plain_counts():
    pieces = sorted(["▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab", "c"])
    counts = {"abab": 5, "a": 2, "baxb": 1, "ab" * 20: 3, "c" * 33: 1}  # two words are longer than what is vectorised
    lattice = langid.Lattice(pieces)
    p = [1 / len(pieces)] * len(pieces)
    for rounds in (1, 2, 3):
        want = Counter()
        for w, n in counts.items():
            for k, x in plain_counts(w, pieces, p).items():
                want[k] += n * x
        got = langid.fit_language(lattice, counts, rounds)
        assert np.allclose(got, [want[i] for i in range(len(pieces))], rtol=1e-6)
        total = sum(want[i] for i in range(len(pieces)))
        p = [(want[i] + 1e-3) / (total + 1e-3 * len(pieces)) for i in range(len(pieces))]


def test_numerals_are_no_words_wherever_they_stand():
    for n in (1, 49, 50, 51, 200):
        assert langid.words("a " * n + "²²") == ["a"] * n and langid.words("²² " * n + "é") == ["é"]
    assert langid.words("x²y Ⅻ") == ["x²y"]


def test_every_language_is_learned(spark):
    rows = [(i * 7 + j, f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100]}",
        f"l{i}") for i in range(300) for j in range(2)]
    counts = langid.sample_counts(spark.createDataFrame([*rows, (1, "x", None), (2, None, "none")],
        "doc_id long, text string, lang string"))
    assert set(counts) == {f"l{i}" for i in range(300)} and all(sum(c.values()) == 2 for c in counts.values())


def test_scores_are_posteriors_of_the_mean_evidence(spark):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    pieces = langid.load_pieces()
    languages, p = langid.fit_model(pieces, langid.sample_counts(docs))
    lattice = langid.Lattice(pieces)
    some = docs.filter("length(text) < 800").limit(40)
    got = {r.doc_id: r for r in langid.identify(some, docs).collect()}
    for r in some.collect():
        own = langid.words(r.text)
        each = lattice.log_probabilities(own, p) if own else np.zeros((0, len(languages)))
        total = [math.fsum(each[:, c]) for c in range(len(languages))]
        if own:
            best = max(range(len(languages)), key=lambda c: total[c])
            share = min(len(own), langid.EVIDENCE_WORDS) / len(own)
            assert got[r.doc_id].lang_pred == languages[best] and math.isclose(got[r.doc_id].score,
                1 / sum(math.exp((t - total[best]) * share) for t in total), rel_tol=1e-6)


def test_language_id_held_out_and_odd_rows(spark):
    docs = queries.table(spark, SF, "documents")
    got = {r.doc_id: r for r in queries.op2_segmentation_langid(spark, SF).collect()}
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [d for d, r in got.items() if r.held_out]
    assert len(got) == len(lang) and sum(got[d].lang_pred == lang[d] for d in held) >= 0.98 * len(held)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 ²² !?"), (4, "日本" * 3000), (5, "the"), (5, "the")], "doc_id long, text string")
    r = sorted((x.doc_id, x.lang_pred, x.score) for x in langid.identify(odd, docs).collect())
    assert [x[1] for x in r[:3]] == ["und"] * 3 and r[3][1] != "und" and r[4] == r[5] and all(0 <= x[2] <= 1 for x in r)
    none = langid.identify(odd, docs.limit(0)).collect()
    assert {x.lang_pred for x in none} == {"und"}


def labelled(n=600, seed=3):
    """Toxic texts have an insult; identity terms stand in both kinds, but more often in the toxic ones."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        toxic = rng.random() < 0.4
        w = [rng.choice("lorem ipsum dolor sit amet elit sed do tempor magna".split()) for _ in range(20)]
        if toxic:
            w[3] = rng.choice(["wretchling", "wretchface", "dolt"]) if rng.random() < 0.9 else w[3]
        if rng.random() < (0.6 if toxic else 0.06):
            w[5] = "muslim"
        elif rng.random() < 0.1:
            w[5] = rng.choice(["hindu", "jewish", "christian"])
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_counterfactual_penalty_frees_neutral_mentions(spark):
    rows = labelled()
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, x) for d, _, x in rows], "doc_id long, toxic int")
    train = docs.join(labels, "doc_id")
    plain, fair = toxicity.fit(train, penalty=0.0), toxicity.fit(train)
    side = lambda m: sum(m[0].get(f, 0.0) for f in toxicity.features("muslim"))
    assert side(plain) > 1.0 and abs(side(fair)) < 0.5 * side(plain)
    tests = spark.createDataFrame([(1, "lorem muslim dolor"), (2, "you wretchling"), (3, None), (4, ""), (5, "Wretchoid sit " * 2000),
        (2, "you wretchling")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.classify(tests.union(docs.selectExpr("doc_id + 1000", "text")),
        labels.selectExpr("doc_id + 1000 AS doc_id", "toxic")).collect()}
    assert got[1].predicted == 0 and got[2].predicted == 1 and got[3].score == got[4].score and got[3].predicted == 0 and 0 <= got[5].score <= 1


def test_toxicity_matches_plain_counts_losses_and_scores(spark):
    rows = labelled(400, seed=9)
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t, _ in rows], "doc_id long, text string, toxic string, score int")
    labels = spark.createDataFrame([(d, x, "clash") for d, _, x in rows] + [(None, 1, "")], "doc_id long, toxic int, text string")
    n1 = sum(x for *_, x in rows)
    n0 = len(rows) - n1
    seen = {0: Counter(), 1: Counter()}
    for _, t, x in rows:
        seen[x].update({f for w in set(t.split()) for f in toxicity.features(w)})
    kept = set()
    for f, x in seen[1].items():
        y = seen[0][f]
        q = (x + y) / (n1 + n0)
        z = (x / n1 - y / n0) / math.sqrt(q * (1 - q + 1e-9) * (1 / n1 + 1 / n0))
        if x >= toxicity.LEAST_DOCS and z >= toxicity.LEAST_Z and x / n1 >= toxicity.LEAST_RATIO * y / n0:
            kept.add(f)
    train = docs.select("doc_id", "text").join(labels.select("doc_id", "toxic"), "doc_id")
    names = toxicity.screen(train, n1, n0)
    assert set(names) == kept | {"=" + t for t in toxicity.GROUP_OF}

    def encoded(words):
        return [i for i, f in enumerate(names) if any(f in toxicity.features(w) for w in words)]

    own = [encoded(set(t.split())) for _, t, _ in rows]
    turned = [toxicity.swapped(set(t.split())) for _, t, _ in rows]
    other = [None if w is None else encoded(w) for w in turned]
    y = [x for *_, x in rows]

    def loss(w, b):
        total = 2 * 0.0
        for o, x in zip(own, y, strict=True):
            z = b + sum(w[i] for i in o)
            total += math.log1p(math.exp(-z if x else z)) / len(y)
        pairs = [(a, o) for a, o in zip(own, other, strict=True) if o is not None]
        total += toxicity.COUNTERFACTUAL * sum((sum(w[i] for i in a) - sum(w[i] for i in o)) ** 2 for a, o in pairs) / len(pairs)
        return total + toxicity.RIDGE * sum(x * x for x in w)

    w, b = toxicity.fit_weights(y, own, other, len(names))
    here, rng = loss(w, b), random.Random(1)
    assert here < loss([0.0] * len(names), b)
    for _ in range(60):  # a step in any direction doesn't help
        step = [rng.gauss(0, 0.02) for _ in names]
        assert loss([a + x for a, x in zip(w, step, strict=True)], b) > here - 1e-4
    weights, intercept = toxicity.fit(train)
    for r in toxicity.classify(docs, labels).collect():
        z = intercept + sum(weights.get(f, 0.0) for f in {f for x in set(rows[r.doc_id][1].split()) for f in toxicity.features(x)})
        assert math.isclose(r.score, 1 / (1 + math.exp(-z)), rel_tol=1e-9) and r.predicted == (r.score >= 0.7)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert [r.score for r in toxicity.classify(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()] == [0.0, 0.0]
    one = spark.createDataFrame([(1, None), (2, 0)], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.classify(docs, one).collect()] == [0, 0]


def test_toxicity_held_out(spark):
    got = {r.doc_id: r for r in queries.op1_counterfactual_toxicity(spark, SF).collect()}
    truth = {r.doc_id: r.toxic for r in queries.table(spark, SF, "labels").collect()}
    held = [(truth[d], got[d].predicted) for d in truth if got[d].held_out]
    false, found, toxic = sum(p for y, p in held if y == 0), sum(p for y, p in held if y == 1), sum(y for y, _ in held)
    print(f"held out: {found} of {toxic} toxic found, {false} of {len(held) - toxic} others")
    assert false <= 1 and found >= 0.75 * toxic


def test_losses_match_counts_by_hand(spark):
    texts = ["a b a b c", "b a b", "c c", None, " "]
    target = {0, 1}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    ids = spark.createDataFrame([(0,), (1,), (1,), (None,)], "doc_id long")
    got = {r.doc_id: r for r in lmscore.cross_entropy_difference(docs, ids).collect()}
    words = [(t or "").split() for t in texts]
    pairs = [list(zip(["<s>", *w], w)) for w in words]

    def model(members):
        one, two = Counter(), Counter()
        for i in members:
            if words[i]:
                one.update(["<s>", *words[i]])
                two.update(pairs[i])
        return one, two, sum(len(words[i]) for i in members)

    n_t, n_b = model(target)[2], model(range(5))[2]
    vocabulary = len({x for w in words for x in w})
    everything = model(range(5))[0]
    del everything["<s>"]
    unigrams = [(everything[w] + lmscore.FLOOR) / (n_b + lmscore.FLOOR * vocabulary) for w in everything]
    assert math.isclose(sum(unigrams), 1)  # the prior is a distribution over the words that there are
    for i, w in enumerate(words):
        if not w:
            assert got[i].n_tokens == 0 and got[i].score is None
            continue
        want = []
        for members, scale in ((target - {i}, 1.0), (set(range(5)) - {i}, n_t / n_b)):
            one, two, n = model(members)
            loss = 0.0
            for a, b in pairs[i]:
                p1 = (one[b] * scale + lmscore.FLOOR) / (n * scale + lmscore.FLOOR * vocabulary)
                loss -= math.log((two[a, b] * scale + lmscore.PRIOR * p1) / (max(one[a], two[a, b]) * scale + lmscore.PRIOR))
            want.append(loss / len(w))
        assert math.isclose(got[i].target_loss, want[0], rel_tol=1e-6) and math.isclose(got[i].background_loss, want[1], rel_tol=1e-6)
    assert lmscore.cross_entropy_difference(docs.limit(0), ids).count() == 0


def edit_distance_in(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=70).map(lambda b: bytes(97 + x % 3 for x in b)),
    st.binary(max_size=90).map(lambda b: bytes(97 + x % 3 for x in b)))
def test_myers_is_the_edit_distance(pattern, text):
    assert decontam.myers(pattern, text)[0] == edit_distance_in(pattern, text)


def test_leaks_match_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioubcdfg") for _ in range(rng.randint(2, 7)))
    items = [" ".join(word() for _ in range(rng.randint(4, 40))).capitalize() + "." for _ in range(12)] + ["Ok", None, " ",
        "same text twice over here", "Same TEXT, twice over here!"]
    docs = [" ".join(word() for _ in range(rng.randint(0, 150))) for _ in range(40)] + [None, "", "ok"]
    for i in range(60):
        t, d = list(rng.choice(items[:12])), docs[i % 40].split()
        for _ in range(rng.randint(0, max(1, len(t) // 12))):
            t[rng.randrange(len(t))] = rng.choice("xyz ,")
        d.insert(rng.randint(0, len(d)), "".join(t).replace(" ", rng.choice([" ", "\n", "  "])))
        docs.append(" ".join(d))
    docs += ["it was the same text twice over, here"] * 3
    a = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    want = {}
    for i, t in enumerate(items):
        p = decontam.normalise((t or "").encode())
        for j, d in enumerate(docs):
            x = decontam.normalise((d or "").encode())
            e = edit_distance_in(p, x) if p and x else 99
            if e <= decontam.budget(len(p)):
                want[j, i] = e
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.find_leaks(a, b).collect()}
    assert got == want
    left = decontam.decontaminate(a, b)
    assert left.columns == a.columns and {r.doc_id for r in left.collect()} == set(range(len(docs))) - {j for j, _ in want}
    assert decontam.find_leaks(a, b.limit(0)).count() == 0 and decontam.find_leaks(a.limit(0), b).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_covers_registered_queries(name):
    assert name in queries.queries()


def test_words_have_counts_of_their_own(spark, monkeypatch):
    import xxhash

    seen, pair = {}, None
    for i in range(5000):
        word = f"w{i}"
        slot = xxhash.xxh3_64_intdigest(word.encode()) % (2**17 - 1)
        if slot in seen:
            pair = seen[slot], word
            break
        seen[slot] = word
    ids = spark.createDataFrame([(0,)], "doc_id long")

    def scores(a, b):
        docs = spark.createDataFrame([(0, f"{a} {a} {a} q"), (1, f"{b} q"), (2, f"q {b} {a}"), (None, "q q"), (4, None)],
            "doc_id long, text string")
        return {r.doc_id: (r.n_tokens, r.target_loss, r.background_loss, r.score) for r in lmscore.cross_entropy_difference(docs,
            ids).collect()}

    one = scores(*pair)
    assert one == scores("one", "other")  # a word's name doesn't matter
    monkeypatch.setattr(lmscore, "BLOCK_BYTES", 4)
    assert one == scores(*pair)  # nor do the number of blocks and parts


def test_many_labels_are_joined_by_shuffle_alike(spark, monkeypatch):
    rows = labelled(300, seed=5)
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, x) for d, _, x in rows] + [(None, 1)], "doc_id long, toxic int")
    score = lambda: {r.doc_id: round(r.score, 9) for r in toxicity.classify(docs, labels).collect()}
    loss = lambda: {r.doc_id: r.score for r in lmscore.cross_entropy_difference(docs,
        labels.filter("toxic = 1").select("doc_id")).collect()}
    want = score(), loss()
    monkeypatch.setattr(toxicity, "MAX_BROADCAST_IDS", 0)
    monkeypatch.setattr(lmscore, "MAX_BROADCAST_IDS", 0)
    assert (score(), loss()) == want
