"""Conversation repair against a search over all edits and a plain run over damaged rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from quillstone.llm import conversations as cv

PROPER = re.compile(r"(s?(ua)+)?")


def all_edits(codes):
    """Cheapest cost and least audit over every sequence of edits, by enumeration (a few turns only)."""
    options = []
    for c in codes:
        keep = [] if c == "-" else [("K", c.lower(), 0), ("R", "u", 1), ("R", "a", 1)]
        options.append([("D", "", 2), *[(e, r, n + (5 if c.isupper() else 0)) for e, r, n in keep]])
    gaps = [[("", "", 0)] + [("I" * n, "".join(r), 5 * n) for n in (1, 2) for r in itertools.product("ua", repeat=n)]] * (len(codes) + 1)
    best = None
    for rows in itertools.product(*options):
        for ins in itertools.product(*gaps):
            audit, roles, cost = ins[0]
            for (e, r, n), (x, y, m) in zip(rows, ins[1:], strict=True):
                audit, roles, cost = audit + e + x, roles + r + y, cost + n + m
            if PROPER.fullmatch(roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def test_solution_is_the_best_of_all_edits():
    for n in range(4):
        for codes in itertools.product("suaxSUAX-", repeat=n) if n < 3 else random.Random(1).sample([*itertools.product("suaxSUAX-",
                repeat=3)], 30):
            assert cv.solve("".join(codes)) == all_edits("".join(codes)), codes


def plain_dp(codes):
    """Least (cost, audit) over all turns, by a table of whole audits for the role that comes last."""
    best = {"": (0, "")}
    for c in codes:
        new = {}

        def offer(state, cost, audit, new=new):
            if state not in new or (cost, audit) < new[state]:
                new[state] = (cost, audit)

        for state, (cost, audit) in best.items():
            offer(state, cost + 2, audit + "D")
            if c == "-":
                continue
            for role in "sua":
                if role == "s" and (state or c.lower() != "s"):
                    continue
                need = "u" if state != "u" else "a"
                k = 0 if role == "s" or role == need else 1
                offer(role, cost + 5 * k + (0 if role == c.lower() else 1) + (5 if c.isupper() else 0),
                    audit + "I" * k + ("K" if role == c.lower() else "R"))
        best = new
    end = {"": 0, "s": 2, "u": 1, "a": 0}
    return min((cost + 5 * end[s], audit + "I" * end[s]) for s, (cost, audit) in best.items())


def test_solution_and_chains_of_segments_match_a_plain_table():
    rng = random.Random(2)
    for _ in range(800):
        codes = "".join(rng.choice(rng.choice(["suaxSUAX-", "ua", "uaA", "u", "s-"])) for _ in range(rng.randint(0, 40)))
        want = plain_dp(codes)
        assert cv.solve(codes) == want
        cuts = sorted(rng.randint(0, len(codes)) for _ in range(rng.randint(0, 5)))
        parts = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)], strict=True)]
        segments = []
        for part in parts:
            found = [(q, r, *x) for q in range(4) for r, x in cv.transfer(part, q).items()]
            rank = {a: i for i, a in enumerate(sorted({f[3] for f in found}))}
            segments.append([{"start": q, "end": r, "cost": c, "rank": rank[a], "audit": a} for q, r, c, a in found])
        taken, tail = cv.chain(segments)
        paths = [s[i] for s, i in zip(segments, taken, strict=True)]
        assert (sum(p["cost"] for p in paths) + 5 * tail, "".join(p["audit"] for p in paths) + "I" * tail) == want


def plain_damage(rows):
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if how == 1 else re.sub("[.!?]", "", x) if how == 2 else x
        out += [(c, t, "user" if how == 4 else r, x)] * (0 if how == 0 else 2 if how == 3 else 1)
    return out


def plain_repair(rows, ids):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r, x))
    out, texts = {}, {}
    for c in ids:
        own = sorted(by[c], key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), v[2].encode()))
        seen, codes, n = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, r, x in own:
            end = re.sub(r"[\x20\x09-\x0D]+\Z", "", x)
            kind = "blank" if not end else "duplicate" if (r, x) in seen else "truncated" if end[-1] not in ".!?" else None
            seen.add((r, x))
            initial = r[:1] if r[:1] in ("s", "u", "a") else "x"
            codes += "-" if kind in ("blank", "duplicate") else initial.upper() if kind else initial
            if kind:
                n[kind] += 1
        cost, audit = plain_dp(codes)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        done, last, rest = [], "", iter(own)
        for e in audit:
            row = next(rest) if e != "I" else None
            if e == "D":
                continue
            last = row[1][0] if e == "K" else "a" if last == "u" else "u"
            role = row[1] if e == "K" else {"u": "user", "a": "assistant"}[last]
            done.append((role, row[2] if row else ""))
        assert PROPER.fullmatch("".join(r[0] for r, _ in done))
        texts[c] = done
        out[c] = (gaps, *n.values(), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in done).encode()).hexdigest())
    return out, texts


def odd_rows():
    rng = random.Random(6)
    bits = ["", " ", "\n\t", "yes.", "no!  ", "why?\x0b", "well", "é.", " ", "a\u0085", "end.\n\n", None]
    role = lambda: rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "USER"])
    rows = [(c, rng.choice([*range(8), None]), role(), rng.choice(bits)) for c in [*range(60), None] for _ in range(rng.randint(1, 9))]
    rows += [(500, i, "user" if i % 2 == 0 else "assistant", f"text {i}.") for i in range(900)]
    rows += [(501, i, rng.choice(["user", "assistant"]), rng.choice(["again.", "x", f"{i}!"])) for i in range(700)]
    rows += [(502, 3, "user", "same.")] * 400 + [(503, 1, "user", "long. " * 50_000), (503, 2, "assistant", "w" * 200_000)]
    return rows


@pytest.mark.parametrize("block", [7, 100, cv.BLOCK])
def test_repair_of_damaged_rows_matches_plain_python(spark, monkeypatch, block):
    monkeypatch.setattr(cv, "BLOCK", block)
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, audit string").repartition(3)
    damaged = plain_damage(rows)
    as_key = lambda r: repr(tuple(r))
    assert sorted(map(as_key, cv.damage(df).collect())) == sorted(map(as_key, damaged))
    want, texts = plain_repair(damaged, {r[0] for r in rows})
    got = cv.digests(cv.damage(df), df).collect()
    assert len(got) == len(want)
    for r in got:
        assert tuple(r[1:]) == want[r.conv_id], r.conv_id
    turns = defaultdict(list)
    for r in sorted(cv.repaired_turns(cv.damage(df)).collect(), key=lambda r: (r.place, r.step)):
        turns[r.conv_id].append((r.role, r.text))
    assert turns == {c: t for c, t in texts.items() if t}


def test_a_long_conversation_is_repaired_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(cv, "BLOCK", 50)
    df = spark.range(2000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat(id, '.') AS text")
    _, plan = cv.plan_repairs(df)
    assert plan.count() >= 40 and plan.agg({"n": "max"}).first()[0] <= 50
    sizes = cv.repaired_turns(df).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 2000 and max(sizes) < 1500


def test_repair_of_empty_tables(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cv.digests(none, none).count() == 0 and cv.repaired_turns(none).count() == 0
    ids = spark.createDataFrame([(1,), (1,), (None,)], "conv_id long")
    assert sorted(map(repr, (tuple(r) for r in cv.digests(none, ids).collect()))) == sorted(map(repr, [(c, 0, 0, 0, 0, 0, 0, "",
        hashlib.sha256(b"").hexdigest()) for c in (1, None)]))
