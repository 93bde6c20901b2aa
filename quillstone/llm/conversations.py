"""Conversation structure repair: the cheapest edits that make a conversation alternate properly.

A proper conversation has the role initials (s?(ua)+)?: nothing, or pairs of user and assistant after an optional system
turn. Each turn is kept, reroled to user or assistant, or deleted, and turns with an empty text may be inserted; the
costs are constants below. Blank turns and repeats of an earlier (role, text) must be deleted.

Retained-subsequence DP. A solution is the subsequence of the turns that are retained, kept or reroled. What lies
between two of them is deleted, at a price that prefix sums of deletions give; how many turns have to be inserted there
follows from the pair of roles. So each turn, in each role that it may take, is joined to the best of four running
minima: the states of what was retained last (nothing, s, u, a), with the prefix sum taken off. Among solutions of equal
cost that with the ASCII-least audit (the edits' initials in order) wins. All partial audits of a state have the same
number of turns and end with one, so none is a beginning of another and the rank of an audit among the four, with the
edits that follow, is enough to compare: the DP takes constant time and space a turn.

Scale. Turns are sorted by ranges of (conversation, turn) and written; ranges are cut into blocks of BLOCK rows, in which
each conversation's share is one segment. A segment in the middle of a block is a whole conversation and solved at once.
One at an edge may go on in the next block: for each state at its start and end it gives the least cost and audit, and
segments are chained by costs and ranks alone. So a conversation of any length is solved by as many tasks as it has
blocks. Only digests(), which returns one audit and one hash for each conversation, lets a conversation's turns pass
through one task in order, as the hash demands, in a stream that holds one batch. repaired_turns() doesn't.

Cases: null roles and texts are one space; null turns come first, and rows of the same turn are ordered by role, then
text; an empty role has the initial of no proper role; null conversation ids form one conversation; repeated rows are
repeats, of which the first stays; texts of any length are handled whole; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillstone.llm.common import PLACE_BITS, default_parallelism, in_order, materialize, short_batches

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows of a block; length up to which a worker remembers solutions.
BLOCK, REMEMBER = 10_000, 48
NONE, S, U, A = range(4)
#: Turns to insert between what was retained last and what is retained next; none: the pair can't be made proper.
BETWEEN = {(NONE, S): 0, (NONE, U): 0, (NONE, A): 1, (S, U): 0, (S, A): 1, (U, U): 1, (U, A): 0, (A, U): 0, (A, A): 1}
AT_END = {NONE: 0, S: 2, U: 1, A: 0}
STATE = {"s": S, "u": U, "a": A}
ROLE = {U: "user", A: "assistant"}
LEGAL = {"su", "ua", "au"}
SPACE = " \t\n\x0b\x0c\r"


def transfer(codes: str, start: int) -> dict[int, tuple[int, str]]:
    """For each state after the turns of codes, if start is the state before: least cost and its least audit.

    A code is s, u, a or x (any other role), in upper case for a truncated turn, or - for one that must be deleted.
    """
    best, steps = {start: (0, 0)}, []  # state: cost less the prefix sum of deletions, rank of the audit
    for code in codes:
        found = {q: (cost, (rank, "D"), q) for q, (cost, rank) in best.items()}
        if code != "-":
            own = STATE.get(code.lower())
            price = (TRUNCATED if code.isupper() else 0) - DELETE
            for q, (cost, rank) in best.items():
                for r in (S, U, A) if own == S else (U, A):
                    n = BETWEEN.get((q, r))
                    if n is None:
                        continue
                    new = (cost + INSERT * n + price + (0 if r == own else REROLE), (rank, "I" * n + ("K" if r == own else "R")), q)
                    if r not in found or new[:2] < found[r][:2]:
                        found[r] = new
        ranks = {a: i for i, a in enumerate(sorted({f[1] for f in found.values()}))}
        best = {q: (cost, ranks[a]) for q, (cost, a, _) in found.items()}
        steps.append({q: (last, a[1]) for q, (_, a, last) in found.items()})
    out = {}
    for q, (cost, _) in best.items():
        edits, at = [], q
        for step in reversed(steps):
            at, edit = step[at]
            edits.append(edit)
        out[q] = (cost + DELETE * len(codes), "".join(reversed(edits)))
    return out


@lru_cache(20_000)
def _remembered(codes: str) -> tuple[int, str]:
    return min((cost + INSERT * AT_END[q], audit + "I" * AT_END[q]) for q, (cost, audit) in transfer(codes, NONE).items())


def solve(codes: str) -> tuple[int, str]:
    """Least cost of a whole conversation and its ASCII-least audit."""
    return _remembered(codes) if len(codes) <= REMEMBER else _remembered.__wrapped__(codes)


def chain(segments: list[list[dict]]) -> tuple[list[int], int]:
    """The path to take in each segment (paths: start, end, cost, rank of the audit among the segment's) and the turns inserted at the end."""
    best, steps = {NONE: (0, 0)}, []
    for paths in segments:
        found = {}
        for i, p in enumerate(paths):
            if p["start"] in best:
                cost, rank = best[p["start"]]
                new = (cost + p["cost"], (rank, p["rank"]), i, p["start"])
                if p["end"] not in found or new[:2] < found[p["end"]][:2]:
                    found[p["end"]] = new
        ranks = {a: i for i, a in enumerate(sorted({f[1] for f in found.values()}))}
        best = {q: (f[0], ranks[f[1]]) for q, f in found.items()}
        steps.append({q: f[2:] for q, f in found.items()})
    state = min(best, key=lambda q: (best[q][0] + INSERT * AT_END[q], best[q][1], AT_END[q]))
    tail, taken = AT_END[state], []
    for step in reversed(steps):
        path, state = step[state]
        taken.append(path)
    return taken[::-1], tail


def sorted_turns(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, initial and fault (blank, truncated or empty) of all rows in order, with __at; written."""
    m = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"))
    end = F.rtrim("text", F.lit(SPACE))
    first = F.substring("role", 1, 1)
    m = m.select("*", F.when(first.isin(*STATE), first).otherwise("x").alias("initial"),
        F.when(end == "", "blank").when(~F.substring(end, -1, 1).isin(".", "!", "?"), "truncated").otherwise("").alias("fault"))
    return in_order(m, *[F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")])


def _block(at: Column) -> list[Column]:
    return [F.shiftright(at, PLACE_BITS).alias("part"), F.floor(at.bitwiseAND(F.lit(2**PLACE_BITS - 1)) / BLOCK).alias("block")]


_PATHS = "array<struct<start:int,end:int,cost:bigint,rank:int,audit:string>>"
_COUNTS = "n long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, head string, tail string"


def _segment(rows: dict, a: int, b: int, firsts: set, whole: bool) -> tuple:
    """One output row for the rows a to b of a block."""
    faults, initials = rows["fault"][a:b], rows["initial"][a:b]
    codes, n = [], {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
    for at, fault, initial in zip(rows["__at"][a:b], faults, initials, strict=True):
        kind = "duplicate" if fault != "blank" and at not in firsts else fault
        n[kind] += 1
        codes.append("-" if kind in ("blank", "duplicate") else initial.upper() if kind else initial)
    codes = "".join(codes)
    turns = {t for t in rows["turn"][a:b] if t is not None}
    if whole:
        cost, audit = solve(codes)
        paths = [{"start": NONE, "end": NONE, "cost": cost, "rank": 0, "audit": audit}]
    else:
        found = [(q, r, *x) for q in range(4) for r, x in transfer(codes, q).items()]
        rank = {s: i for i, s in enumerate(sorted({f[3] for f in found}))}
        paths = [{"start": q, "end": r, "cost": cost, "rank": rank[audit], "audit": audit} for q, r, cost, audit in found]
    illegal = sum(x + y not in LEGAL for x, y in zip(initials, initials[1:], strict=False))
    return (rows["conv_id"][a], rows["__at"][a], whole, paths, b - a, n["blank"], n["duplicate"], n["truncated"], illegal, len(turns),
        min(turns, default=None), max(turns, default=None), initials[0], initials[-1])


def _segments(rows: pa.Table, firsts: pa.Table, schema: pa.Schema) -> pa.Table:
    rows = rows.sort_by("__at").to_pydict()
    firsts, ids, out, a = set(firsts.column("__at").to_pylist()), rows["conv_id"], [], 0
    for b in range(1, len(ids) + 1):
        if b == len(ids) or ids[b] != ids[a]:
            out.append(_segment(rows, a, b, firsts, 0 < a and b < len(ids)))
            a = b
    return pa.Table.from_pydict({f.name: pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)}, schema=schema)


def _chained(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("__at")
    taken, tail = chain(rows.column("paths").to_pylist())
    return pa.table({"__at": rows.column("__at"), "path": pa.array(taken, pa.int32()),
        "inserted": pa.array([0] * (len(taken) - 1) + [tail], pa.int32())})


def _schema(turns: DataFrame, others: str) -> tuple[T.StructType, pa.Schema]:
    """The conversation's id and other columns, for Spark and for Arrow."""
    schema = T.StructType([turns.schema["conv_id"], *T.StructType.fromDDL(others)])
    return schema, to_arrow_schema(schema)


def plan_repairs(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sorted_turns() of messages (conv_id, turn, role, text), and one row for each segment of them: conv_id, __at (of its first
    row), start (the state before it), cost, audit, and counts of its rows, faults and turns. Both are written."""
    turns = sorted_turns(messages)
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    firsts = turns.groupBy("conv_id", same.alias("same")).agg(F.min("__at").alias("__at")).select("__at")
    schema, arrow = _schema(turns, f"__at long, whole boolean, paths {_PATHS}, {_COUNTS}")
    found = turns.select("conv_id", "turn", "__at", "initial", "fault").groupBy(*_block(F.col("__at"))).cogroup(firsts.groupBy(
        *_block(F.col("__at")))).applyInArrow(lambda rows, first: _segments(rows, first, arrow), schema)
    found = materialize(found)
    bare = F.transform("paths", lambda p: F.struct(*[p[c].alias(c) for c in ("start", "end", "cost", "rank")]))
    taken = found.filter("NOT whole").select("conv_id", "__at", bare.alias("paths")).groupBy("conv_id").applyInArrow(_chained,
        "__at long, path int, inserted int")
    path = F.col("paths")[F.coalesce("path", F.lit(0))]
    extra = F.coalesce("inserted", F.lit(0))
    counts = [c.split()[0] for c in _COUNTS.split(", ")]
    chosen = found.join(taken, "__at", "left").select("conv_id", "__at", path["start"].alias("start"), (path["cost"] + INSERT *
        extra).alias("cost"), F.concat(path["audit"], F.expr("repeat('I', coalesce(inserted, 0))")).alias("audit"), *counts)
    return turns, materialize(chosen)


class _Walk:
    """The edits of a segment, taken row by row. A proper conversation alternates, so the role of a turn follows from the one before."""

    def __init__(self, segment: dict):
        self.audit, self.last, self.at, self.left = segment["audit"], segment["start"], 0, segment["n"]

    def _next(self) -> str:
        self.last = A if self.last == U else U
        return ROLE[self.last]

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._next(), "", "I"

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """Role, text and edit of the turns that the next row leads to: those inserted before it and, at the segment's end, behind it, and itself."""
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at, self.left = self.at + 1, self.left - 1
        if edit == "R":
            yield self._next(), text, edit
        elif edit == "K":
            self.last = STATE[role[0]]
            yield role, text, edit
        if not self.left:
            yield from self._inserted()


def _stream(turns: DataFrame, plan: DataFrame, by: list[Column], ids: DataFrame | None = None) -> DataFrame:
    """Conversation ids (kind 0), segments (1), each before its rows, and rows (2), dealt by the columns given and sorted."""
    packed = F.struct(*[c for c in plan.columns if c not in ("conv_id", "__at")])
    out = plan.select("conv_id", "__at", F.lit(1).alias("kind"), packed.alias("segment")).unionByName(turns.select("conv_id", "__at",
        F.lit(2).alias("kind"), "role", "text"), allowMissingColumns=True)
    if ids is not None:
        out = out.unionByName(ids.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long").alias("__at"),
            F.lit(0).alias("kind")), allowMissingColumns=True)
    return out.repartition(default_parallelism(turns.sparkSession), *by).sortWithinPartitions(F.asc_nulls_first("conv_id"), "__at", "kind")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    names = ("conv_id", "__at", "kind", "segment", "role", "text")
    for batch in batches:
        yield list(zip(*[batch.column(c).to_pylist() for c in names], strict=True))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _repaired(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    walk = None
    for rows in _read(batches):
        out = []
        for conv, at, kind, segment, role, text in rows:
            if kind == 1:
                walk = _Walk(segment)
            else:
                out += [(conv, at, i, *turn) for i, turn in enumerate(walk.row(role, text))]
        yield _batch(out, schema)


class _Digest:
    """What is returned for a conversation, taken in from its segments and turns in order."""

    def __init__(self, conv):
        self.conv, self.sha, self.turns, self.audit = conv, hashlib.sha256(), 0, []
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
        self.low = self.high = self.tail = None
        self.distinct = 0

    def segment(self, s: dict) -> None:
        for c in self.sums:
            self.sums[c] += s[c]
        if self.tail is not None and self.tail + s["head"] not in LEGAL:
            self.sums["illegal"] += 1
        self.tail = s["tail"]
        if s["low"] is not None:
            self.distinct += s["turns"] - (s["low"] == self.high)
            self.low, self.high = s["low"] if self.low is None else self.low, s["high"]
        self.audit.append(s["audit"])

    def turn(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.turns else ''}{role}:{text}".encode())
        self.turns += 1

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return self.conv, gaps, *self.sums.values(), "".join(self.audit), self.sha.hexdigest()


def _digests(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    walk = digest = None
    for rows in _read(batches):
        out = []
        for conv, _, kind, segment, role, text in rows:
            if kind == 0:
                if digest:
                    out.append(digest.row())
                digest = _Digest(conv)
            elif kind == 1:
                walk = _Walk(segment)
                digest.segment(segment)
            else:
                for r, t, _ in walk.row(role, text):
                    digest.turn(r, t)
        yield _batch(out, schema)
    if digest:
        yield _batch([digest.row()], schema)


def repaired_turns(messages: DataFrame) -> DataFrame:
    """conv_id, place, step, role, text and edit (K, R or I) of every turn after repair of messages (conv_id, turn, role, text). A
    conversation's turns are ordered by place, then step; those of a long conversation come from several tasks."""
    short_batches(messages.sparkSession)
    turns, plan = plan_repairs(messages)
    schema, arrow = _schema(turns, "place long, step int, role string, text string, edit string")
    return _stream(turns, plan, _block(F.col("__at"))).mapInArrow(lambda batches: _repaired(batches, arrow), schema)


def digests(messages: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """For each conversation of messages, and of ids (conv_id): gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256."""
    short_batches(messages.sparkSession)
    turns, plan = plan_repairs(messages)
    known = messages.select("conv_id") if ids is None else messages.select("conv_id").unionByName(ids.select("conv_id"))
    schema, arrow = _schema(turns, ", ".join(f"{c} long" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")) +
        ", audit string, repaired_sha256 string")
    return _stream(turns, plan, [F.col("conv_id")], known).mapInArrow(lambda batches: _digests(batches, arrow), schema)


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of rows after damage by the CRC-32 of `conv_id:turn`, modulo 20: 0 drops a row, 1 empties its
    text, 2 takes its [.!?] away, 3 repeats it, 4 makes it the user's. Nulls are one space (turn and conv_id stay null)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    m = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"),
        (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20).alias("__how")).filter("__how <> 0")
    text = F.when(F.col("__how") == 1, "").when(F.col("__how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("__how") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("__how") == 3, 2).otherwise(1))).alias("__copy")
    return m.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("__copy")


def _sql_step() -> list[str]:
    """The states after a row, as SQL of the states s (nothing, s, u, a) and the row's code x[1]. A state is its cost in nine
    digits and its audit, so that the least text is the cheapest and then the least audit."""
    def add(state: int, cost: str, edits: str) -> str:
        s = f"s[{state + 1}]"
        return f"lpad(CAST(CAST(substr({s}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({s}, 10) || {edits}"

    out = []
    for r, initial in ((NONE, None), (S, "s"), (U, "u"), (A, "a")):
        ways = [add(r, str(DELETE), "'D'")]
        for (q, to), n in BETWEEN.items():
            if to == r:
                own, late = f"lower(x[1]) = '{initial}'", f"CASE WHEN x[1] BETWEEN 'A' AND 'Z' THEN {TRUNCATED} ELSE 0 END"
                cost = f"{INSERT * n} + {late} + CASE WHEN {own} THEN 0 ELSE {REROLE} END"
                edits = f"'{'I' * n}' || CASE WHEN {own} THEN 'K' ELSE 'R' END"
                ways.append(f"CASE WHEN {own if r == S else chr(39) + '-' + chr(39) + ' <> x[1]'} THEN {add(q, cost, edits)} END")
        out.append(f"least({', '.join(ways)})" if len(ways) > 1 else ways[0])
    return out


def oracle() -> str:
    """SQL of damage() and digests() over conversations."""
    space, shift = r"[\x20\x09-\x0D]", "xor(s >> 1, CASE WHEN s & 1 = 1 THEN 3988292384 ELSE 0 END)"
    ends = [f"lpad(CAST(CAST(substr(s[{q + 1}], 1, 9) AS BIGINT) + {INSERT * n} AS VARCHAR), 9, '0') || substr(s[{q + 1}], 10) || '{'I' * n}'"
        for q, n in AT_END.items()]
    text = "CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(x, '[.!?]', '', 'g') ELSE x END"
    return rf"""
WITH RECURSIVE e(k, s, n) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT k, {shift}, n + 1 FROM e WHERE n < 8),
tbl AS (SELECT list(s ORDER BY k) AS t FROM e WHERE n = 8),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS x,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
c AS (SELECT conv_id, turn, r, x, xor(list_reduce(list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(substr(key, CAST(i AS INTEGER), 1)) AS BIGINT)),
  lambda s, x: xor(s >> 8, t[1 + (xor(s, x) & 255)]), 4294967295), 4294967295) % 20 AS how FROM k, tbl),
m AS (SELECT conv_id, turn, CASE how WHEN 4 THEN 'user' ELSE r END AS role, {text} AS text, unnest(range(CASE how WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n FROM m),
f AS (SELECT *, CASE WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE 'x' END AS i,
  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
  WHEN regexp_matches(text, '[^.!?\x20\x09-\x0D]{space}*\z') THEN 'truncated' ELSE '' END AS fault FROM o),
p AS (SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i AS pair FROM f),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(CASE fault WHEN 'blank' THEN 1 ELSE 0 END) AS blank,
  sum(CASE fault WHEN 'duplicate' THEN 1 ELSE 0 END) AS duplicate, sum(CASE fault WHEN 'truncated' THEN 1 ELSE 0 END) AS truncated,
  sum(CASE WHEN pair NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END) AS illegal,
  list([CASE WHEN fault IN ('blank', 'duplicate') THEN '-' WHEN fault = 'truncated' THEN upper(i) ELSE i END] ORDER BY n) AS codes FROM p GROUP BY conv_id),
d AS (SELECT *, list_reduce(codes, lambda s, x: [{', '.join(_sql_step())}], ['000000000', NULL, NULL, NULL]) AS s FROM g),
b AS (SELECT *, least({', '.join(ends)}) AS best FROM d),
a AS (SELECT * EXCLUDE (codes, s, best), CAST(substr(best, 1, 9) AS BIGINT) AS cost, substr(best, 10) AS audit FROM b),
w AS (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS pos, audit FROM a),
y AS (SELECT conv_id, pos, substr(audit, CAST(pos AS INTEGER), 1) AS edit, length(replace(substr(audit, 1, CAST(pos AS INTEGER)), 'I', '')) AS n FROM w),
z AS (SELECT y.conv_id, pos, edit, role, text, row_number() OVER (PARTITION BY y.conv_id ORDER BY pos) AS j
  FROM y LEFT JOIN o ON edit <> 'I' AND y.conv_id IS NOT DISTINCT FROM o.conv_id AND y.n = o.n WHERE edit <> 'D'),
v AS (SELECT conv_id, pos, edit, role, coalesce(text, '') AS text, j + max(CASE WHEN j = 1 AND edit = 'K' AND role LIKE 's%' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS j FROM z),
t AS (SELECT conv_id, string_agg((CASE WHEN edit = 'K' THEN role WHEN j % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY pos) AS whole FROM v GROUP BY conv_id)
SELECT q.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN a ON q.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN t ON q.conv_id IS NOT DISTINCT FROM t.conv_id"""
