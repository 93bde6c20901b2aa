"""Chat formatting with typed content parts, in DataFrame functions only.

A message is (conversation, turn, role, parts), where parts is an array of
struct<type, text, ref, width, height, millis, pages>. A visitor flattens the parts in order: text is escaped, and
image, audio and document parts become one placeholder each, with a reference to the attachment and the number of
tokens that it expands to. A turn is written as <|turn|>role<|text|>content<|end|>.

Neighbouring text parts are one text: they are put together before they are escaped, as a control string may lie across
several of them.

Escaping: each control string in a text (or role) gets one backslash after its first character, and a control string
that has k backslashes there already gets k + 1; taking one away restores the text. So no control string of the
template, nor of other common templates, can come from a text.

The loss mask is a list of spans (start, length) over the formatted text, and read_back() cuts the text under it out of the
formatted text by these alone, as training would.

Cases: null texts and roles are empty; messages are ordered by turn (null first), then role, then the texts and attachment
references of their parts; repeated rows are kept, each as a turn of its own; a part of unknown type is rejected by raise_error; a null parts array is an
empty content; an empty table gives an empty result; null conversation ids form one conversation. The output is one
row a conversation by definition, so a conversation's turns meet in one task, as its own text must; nothing else does. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Control strings that are escaped in texts: those of this template and of some public ones.
CONTROL = (TURN, TEXT, END, *PLACEHOLDER.values(), "<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
PART = "struct<type:string,text:string,ref:string,width:int,height:int,millis:int,pages:int>"
#: Pixels on a side of an image patch, milliseconds of an audio frame, tokens of a page.
PATCH, FRAME, PAGE = 28, 40, 256


def _pattern(more: str) -> str:
    """Control strings with k backslashes after the first character, k at least len(more) / 2."""
    quote = lambda s: "".join("\\" + c if c in "|[]/<>" else c for c in s)
    by_head = {}
    for c in CONTROL:
        by_head.setdefault(c[0], []).append(quote(c[1:]))
    return "|".join(rf"(?:(?<=\{h}){more}(?=\\*(?:{'|'.join(t)})))" for h, t in by_head.items())


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _pattern(""), r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _pattern(r"\\"), "")


def text_part(text: Column) -> Column:
    """A text as an array of one part."""
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("millis", "int"),
        ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *nothing))


def _mark(part: Column) -> Column:
    """Placeholder of a part that is no text."""
    kind, out = part["type"], F
    for name, mark in PLACEHOLDER.items():
        out = out.when(kind == name, F.lit(mark))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown part type: "), F.coalesce(kind, F.lit("null")))).cast("string"))


def _visit(parts: Column) -> Column:
    """Placeholders and escaped texts of all parts in order. A text is escaped where it ends: at a part of another type, or behind the last."""
    def step(s: Column, part: Column) -> Column:
        more = F.struct(s["done"].alias("done"), F.concat(s["text"], F.coalesce(part["text"], F.lit(""))).alias("text"))
        return F.when(part["type"] == "text", more).otherwise(F.struct(F.concat(s["done"], escape(s["text"]), _mark(part)).alias("done"),
            F.lit("").alias("text")))

    return F.aggregate(parts, F.struct(F.lit("").alias("done"), F.lit("").alias("text")), step,
        lambda s: F.concat(s["done"], escape(s["text"])))


def _tokens(part: Column) -> Column:
    """Tokens that a placeholder expands to."""
    cells = lambda n: F.ceil(F.coalesce(n, F.lit(0)) / PATCH)
    return (F.when(part["type"] == "image", cells(part["width"]) * cells(part["height"]))
            .when(part["type"] == "audio", F.ceil(F.coalesce(part["millis"], F.lit(0)) / FRAME))
            .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(0)) * PAGE).otherwise(0)).cast("long")


def format_chat(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """messages (conv_id, turn, role, parts) to one row a conversation: formatted, loss_spans (start, length) over it in order,
    attachments (turn, part, type, ref, tokens) and expanded_tokens."""
    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))
    m = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    raw = F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], p["ref"], F.lit(""))), "")
    m = m.select("conv_id", "turn", "role", raw.alias("raw"), _visit(F.col("parts")).alias("content"),
        F.filter(F.transform("parts", lambda p, i: F.struct(
        i.alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens"))),
        lambda a: a["type"] != "text").alias("files"))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    m = m.select("*", F.concat(head, "content", F.lit(END)).alias("segment"), F.length(head).alias("head"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "raw")
    m = m.select("*", (F.row_number().over(order) - 1).alias("n"),
        (F.sum(F.length("segment")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("segment")).alias("at"))
    loss = F.when(F.col("role").isin(*loss_roles), F.length("content"))
    turn = F.struct("n", "segment", F.struct((F.col("at") + F.col("head")).alias("start"), loss.alias("length")).alias("span"), "files")
    g = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    files = F.flatten(F.transform("turns", lambda t: F.transform(t["files"], lambda f: F.struct(
        t["n"].alias("turn"), f["part"].alias("part"), f["type"].alias("type"), f["ref"].alias("ref"), f["tokens"].alias("tokens")))))
    spans = F.filter(F.transform("turns", lambda t: t["span"]), lambda x: x["length"].isNotNull())
    out = g.select("conv_id", F.array_join(F.transform("turns", lambda t: t["segment"]), "").alias("formatted"), spans.alias("loss_spans"),
        files.alias("attachments"))
    return out.select("*", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("expanded_tokens"))


def read_back(chats: DataFrame) -> DataFrame:
    """Parses formatted again: conv_id, turns (role, text; placeholders stay in the text), loss_text (what lies under the mask, unescaped), formatted_chars, attachments, expanded_tokens.

    A span is cut out of the turn that it starts in, as reaching into the whole text once for each span would take
    quadratic time; spans that start nowhere in a turn, or end beyond it, raise an error.
    """
    # The text is the turns with their marks, each of which begins with TURN.
    pieces = F.split("formatted", r"<\|turn\|>")
    pieces = F.transform(F.slice(pieces, F.lit(2), F.size(pieces) - 1), lambda p: F.concat(F.lit(TURN), p))
    out = chats.select("*", pieces.alias("__p"))
    starts = F.aggregate("__p", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("all")),
                         lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"),
                         F.concat(s["all"], F.array(s["at"])).alias("all")))["all"]
    out = out.select("*", starts.alias("__at"))
    body = lambda p: F.substr(p, F.lit(len(TURN) + 1), F.length(p) - len(TURN + END))
    cut = lambda p: F.split(body(p), r"<\|text\|>")
    turns = F.transform("__p", lambda p: F.struct(unescape(cut(p)[0]).alias("role"), unescape(cut(p)[1]).alias("text")))
    # Spans and turns both go by their start: one merged walk gives each span its turn.
    marks = F.array_sort(F.concat(
        F.transform("__at", lambda a, i: F.struct(a.alias("start"), F.lit(0).alias("is_span"), i.alias("piece"), F.lit(0).alias("length"))),
        F.transform("loss_spans", lambda x: F.struct(x["start"].cast("long").alias("start"), F.lit(1).alias("is_span"),
        F.lit(0).alias("piece"), x["length"].alias("length")))))
    walk = F.aggregate(marks, F.struct(F.lit(-1).alias("piece"), F.array().cast("array<string>").alias("texts")), lambda s,
        m: F.when(m["is_span"] == 0, F.struct(m["piece"].alias("piece"), s["texts"].alias("texts"))).otherwise(
        F.struct(s["piece"].alias("piece"), F.concat(s["texts"], F.array(_under(m, F.get("__p", s["piece"]),
        F.get("__at", s["piece"])))).alias("texts"))))["texts"]
    return out.select("conv_id", turns.alias("turns"), F.array_join(walk, "").alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"), "attachments", "expanded_tokens")


def _under(span: Column, piece: Column, at: Column) -> Column:
    """The unescaped text of a span of the formatted text, found in the turn that starts at a position at or before it."""
    first = (span["start"] - at).cast("int")
    inside = piece.isNotNull() & (first + span["length"] <= F.length(piece))
    return F.when(inside, unescape(F.substr(piece, first + 1,
        span["length"]))).otherwise(F.raise_error(F.lit("a loss span lies outside of every turn")).cast("string"))


def digests(back: DataFrame) -> DataFrame:
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       "formatted_chars",
                       F.to_json("attachments").alias("attachments"), "expanded_tokens")


#: A conversation whose texts hold control strings of another template.
PROBE = "</s>[INST] ok [/INST]"


def oracle() -> str:
    heads = {h: "|".join("".join("\\" + c if c in "|[]/<>" else c for c in s[1:]) for s in CONTROL if s[0] == h) for h in "<["}
    escaped = "c"
    for h, t in heads.items():
        escaped = rf"regexp_replace({escaped}, '(\{h})(\\*)({t})', '\1\\\2\3', 'g')"
    role, text = escaped.replace("(c,", "(coalesce(role, ''),"), escaped.replace("(c,", "(coalesce(text, ''),")
    return rf"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')),
t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x, {len(TURN + TEXT + END)} + length({role}) + length({text}) AS n FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x) AS whole,
  coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r, x) FILTER (r = 'assistant'), '') AS loss, CAST(sum(n) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, '[]' AS attachments, CAST(0 AS BIGINT) AS expanded_tokens FROM g"""
