"""Quality rules, URL rules and chat formatting against plain Python, on odd rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quillstone.llm import chat, quality, urlfilter

DOCS = "doc_id long, text string, lang string, n_words string"


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = set()
    for i, w in enumerate(wins):
        if wins.count(w) > 1:
            hit |= set(range(i, i + 5))
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))


def test_quality_counts_match_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a", "a b c d", "a b c d e a b c d e", "x x x x x x x", "é ü|#\n\né ü|#\n", "a\u00a0b\x0bc\x0cd\re",
        "😀 😀 # <b>"]
    texts += [" ".join(rng.choice("ab\ncd") for _ in range(rng.randint(1, 60))) for _ in range(60)] + ["word " * 3000 + "end"]
    df = spark.createDataFrame([(i, t, "en", "clash") for i, t in enumerate(texts)] + [(0, None, "en", "clash")], DOCS)
    got = quality.quality_rules(df).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(texts[r.doc_id]), texts[r.doc_id]
        base = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == base and not (base and r.kept)


def test_kept_columns_give_way_to_results(spark):
    df = spark.createDataFrame([(1, "a b", "en", "clash")], DOCS)
    out = quality.quality_rules(df, keep=("doc_id", "lang", "n_words"))
    assert out.columns.count("n_words") == 1 and out.first().n_words == 2 and out.first().lang == "en"


def test_quality_verdicts(spark):
    good = "The cat sat on the mat and it was not at all sure of that until the end of the long and rainy day in town"
    df = spark.createDataFrame([(1, good), (2, good.replace(" ", "# ")), (3, " ".join(f"zq{i}" for i in range(200))),
        (4, good.upper().replace(" ", "!! "))], "doc_id long, text string")
    got = {r.doc_id: (r.kept, r.failed_rules) for r in quality.quality_rules(df).collect()}
    assert got == {1: (True, ""), 2: (False, "symbols_per_word"), 3: (False, "stop_words"), 4: (False, "shouting")}
    assert quality.quality_rules(df.limit(0)).count() == 0


def test_quality_runs_no_python(spark):
    plan = quality.quality_rules(spark.createDataFrame([(1, "a")],
        "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def brute_url(url, rules, default):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [r for r in rules if host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host) + len(r.path), len(r.host)), default=None)
    return (host, path, best and best.host + best.path, best.verdict if best else default)


def test_url_rules_match_brute_force(spark):
    rng = random.Random(5)
    hosts = ["org", "example.org", "a.example.org", "EXAMPLE.org", "xexample.org", "com", "b.com", "", "d.c.b.com", "org.",
        "example.org:80"]
    paths = ["", "/", "/es/", "/es/1", "/en/1", "/en/12/3", "/fr/", "/de/x?y", "/en", "/e#/es/"]
    urls = [None, "", "no", "x://", "mailto:a",
        "http://h://x/es/"] + [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)] + ["https://example.org/es/1"] * 50
    more = [urlfilter.UrlRule(rng.choice(["allow", "block"]), h, p) for h in ("org", "example.org", "b.com", "c.b.com") for p in ("/", "/e",
        "/en/", "/en/12", "/es/1")]
    for rules in (urlfilter.RULES, tuple({(r.host, r.path): r for r in more}.values()), ()):
        df = spark.createDataFrame([(i // 2, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
        frame = urlfilter.rules_frame(spark, rules) if rules else spark.createDataFrame([], "verdict string, host string, path string")
        got = sorted(map(repr, ((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.url_filter(df, frame).collect())))
        assert got == sorted(map(repr, ((i // 2, *brute_url(u, rules, "allow")) for i, u in enumerate(urls))))
    assert urlfilter.url_filter(df.limit(0), urlfilter.rules_frame(spark, urlfilter.RULES)).count() == 0


MESSAGE = f"conv_id long, turn long, role string, parts array<{chat.PART}>"
text = lambda t: ("text", t, None, None, None, None, None)


def test_chat_round_trip_of_any_text(spark):
    rng = random.Random(9)
    bits = [*chat.CONTROL, "\\", "<", "[", "|", "turn|>", "INST]", "a", "\n", "é", "😀", "$1", "<\\|turn|>", "<\\\\|end|>"]
    rows = [(c, rng.randint(0, 3), rng.choice(["user", "assistant", None, "<|turn|>"]),
        rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0,
        9)))])) for c in range(80) for _ in range(rng.randint(1, 6))]
    rows += [(500, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(300)] + rows[:5]
    df = spark.createDataFrame([(c, t, r, [text(x)]) for c, t, r, x in rows], MESSAGE)
    got = {r.conv_id: r for r in chat.digests(chat.read_back(chat.format_chat(df))).collect()}
    sizes = {r.conv_id: len(r.formatted) for r in chat.format_chat(df).select("conv_id", "formatted").collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((t, r or "", x or "") for cc, t, r, x in rows if cc == c), key=lambda v: (v[0], v[1].encode(), v[2].encode()))
        whole, loss = "".join(f"{r}\n{x}\n" for _, r, x in own), "".join(x for _, r, x in own if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256, g.formatted_chars) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), sizes[c])


def test_chat_round_trip_of_texts_in_parts(spark):
    """However a text is cut into parts, it is formatted as if it were whole; no parts make up a turn of their own."""
    rng = random.Random(11)
    whole = ["<|end|>hidden", "see <|turn|>user<|text|>evil", "<\\|end|>", "[INST] a [/INST]", "", "é<|im_start|>😀"]
    whole += ["".join(rng.choice([*chat.CONTROL, "\\", "<", "|", "a", "é"]) for _ in range(rng.randint(0, 8))) for _ in range(60)]
    image = ("image", None, "a.png", 28, 28, None, None)

    def cut(t):
        at = sorted(rng.randint(0, len(t)) for _ in range(rng.randint(0, 6)))
        return [text(t[a:b] or None) for a, b in zip([0, *at], [*at, len(t)], strict=True)]

    rows = [(c, 0, "assistant", cut(t)) for c, t in enumerate(whole)] + [(1000 + c, 0, "assistant", [*cut(t), image, *cut(t)]) for c,
        t in enumerate(whole)]
    chats = chat.format_chat(spark.createDataFrame(rows, MESSAGE))
    one = chat.format_chat(spark.createDataFrame([(c, 0, "assistant", [text(t)]) for c, t in enumerate(whole)], MESSAGE))
    same = {r.conv_id: r.formatted for r in one.collect()}
    got = {r.conv_id: r for r in chats.collect()}
    assert {c: r.formatted for c, r in got.items() if c < 1000} == same
    back = {r.conv_id: r for r in chat.read_back(chats).collect()}
    for c, t in enumerate(whole):
        assert [tuple(x) for x in back[c].turns] == [("assistant", t)] and back[c].loss_text == t
        assert len(back[1000 + c].turns) == 1 and back[1000 + c].turns[0].text.startswith(t)
        assert got[1000 + c].formatted.count("<|image|>") == 1 and got[1000 + c].attachments[0].ref == "a.png"


def test_chat_parts_become_placeholders(spark):
    parts = [text("see <|image|>"), ("image", None, "a.png", 57, 28, None, None), ("audio", None, "b.wav", None, None, 81, None),
        ("document", None, "c.pdf", None, None, None, 2), text(None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [text("ok")]), (2, 0, "user", None)], MESSAGE)
    r = {x.conv_id: x for x in chat.format_chat(df).collect()}
    assert r[1].formatted == "<|turn|>user<|text|>see <\\|image|><|image|><|audio|><|document|><|end|><|turn|>assistant<|text|>ok<|end|>"
    assert [(a.turn, a.part, a.ref, a.tokens) for a in r[1].attachments] == [(0, 1, "a.png", 3), (0, 2, "b.wav", 3),
        (0, 3, "c.pdf", 512)] and r[1].expanded_tokens == 518
    (span,) = r[1].loss_spans
    assert r[1].formatted[span.start : span.start + span.length] == "ok" and r[2].formatted == "<|turn|>user<|text|><|end|>"
    assert chat.format_chat(df.limit(0)).count() == 0


def test_the_loss_is_read_through_its_spans(spark):
    df = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", [text(f"é{i} <|end|> text {i}")], "x") for i in range(6)],
        MESSAGE + ", formatted string")
    chats = chat.format_chat(df)
    assert chat.read_back(chats).first().loss_text == "".join(f"é{i} <|end|> text {i}" for i in (1, 3, 5))
    moved = chats.withColumn("loss_spans", F.transform("loss_spans",
        lambda s: F.struct((s["start"] + 1).alias("start"), s["length"].alias("length"))))
    assert chat.read_back(moved).first().loss_text == "".join(f"{i} <|end|> text {i}<" for i in (1, 3, 5))
    lost = chats.withColumn("loss_spans", F.array(F.struct(F.lit(9_999).cast("long").alias("start"), F.lit(5).alias("length"))))
    with pytest.raises(Exception, match="outside of every turn"):
        chat.read_back(lost).collect()


def test_chat_runs_no_python(spark):
    df = spark.createDataFrame([(1, 0, "user", [text("x")])], MESSAGE)
    plan = chat.digests(chat.read_back(chat.format_chat(df)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and df.select(F.lit(1)).count() == 1
