"""Conversation repair against an exhaustive search over edits."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from scoreloom.llm import conversations as C

from ..compare import difference

SCHEMA = "conv_id long, turn long, role string, text string"
ROLE = {"u": "user", "a": "assistant"}


def after_damage(rows):
    out = []
    for c, t, r, x in rows:
        shown = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{shown(c)}:{shown(t)}".encode()) % 20
        r, x = shown(r), shown(x)
        if kind:
            out += [(c, t, "user" if kind == 4 else r, {1: "", 2: re.sub("[.!?]", "", x)}.get(kind, x))] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, r, x in rows:
        solid = x.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not solid else "duplicate" if (r, x) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((r, x))
    return out


def cheapest(rows, bad):
    """Least (cost, audit) and its lines, over every choice of edits with up to two additions in each gap."""
    best = None
    choices = ["D" if f in ("blank", "duplicate") else "DKR" for f in bad]
    for edits in itertools.product(*choices):
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "".join("I" * g + e for g, e in zip(gaps, edits, strict=False)) + "I" * gaps[-1]
            cost = sum({"D": 4, "K": 0, "R": 3, "I": 3}[e] for e in audit) + 3 * sum(e != "D" and f == "truncated" for e, f in zip(edits, bad, strict=True))
            if best and (cost, audit) >= best[:2]:
                continue
            lines, k, ok, need = [], 0, True, "u"
            for e in audit:
                role, text = (rows[k][2], rows[k][3]) if e != "I" else (None, "")
                k += e != "I"
                if e == "D":
                    continue
                if e == "K" and role[:1] == "s" and not lines:
                    lines.append((role, text))
                    continue
                ok &= e != "K" or role[:1] == need
                lines.append((role if e == "K" else ROLE[need], text))
                need = "a" if need == "u" else "u"
            if ok and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in lines)):
                best = (cost, audit, lines)
    return best


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in after_damage(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))
        bad = faults(mine)
        turns = [r[1] for r in mine if r[1] is not None]
        pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(mine)]
        cost, audit, lines = cheapest(mine, bad)
        text = "\n".join(f"{r}:{x}" for r, x in lines)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        count = [bad.count(f) for f in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *count, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def random_rows(seed: int, conversations: int = 120):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        for t in range(rng.randint(1, 3)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Hello.", "Why?", "no end", " \t", "", None, "one. two", "end! \n", "é "])
            rows.append((c, rng.choice([t, t, t + 3, None]), role, text))
    return [*rows, (None, 0, "user", "Hi."), (None, 1, "assistant", "Yes."), rows[0], rows[0]]


@pytest.mark.parametrize("seed", range(3))
def test_equals_search(spark, seed):
    rows = random_rows(seed)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", signature string, kind int")
    got = {r[0]: tuple(r[1:]) for r in C.repaired(C.damaged(df)).collect()}
    assert got == expected(rows)


def test_equals_sql(spark, tmp_path):
    spark.createDataFrame(random_rows(9), SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert difference(C.op13_conversation_repair(spark, str(tmp_path)), con, C.OP13_SQL) is None


def test_long_conversation_over_many_partitions(spark):
    turns = [(1, t, ["user", "assistant"][t % 2], f"Line {t}.") for t in range(3000)] + [(2, t, "user", "same") for t in range(500)]
    rows = spark.createDataFrame(turns, SCHEMA).selectExpr("*", "1 as copies").repartition(9)
    got = {r["conv_id"]: r for r in C.repaired(rows).collect()}
    text = "\n".join(f"{r}:{x}" for _, _, r, x in turns[:3000])
    assert got[1]["audit"] == "K" * 3000 and got[1]["cost"] == 0 and got[1]["repaired_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert got[2]["duplicate"] == 499 and got[2]["audit"] == "D" * 500 and got[2]["illegal"] == 499 and got[2]["truncated"] == 1


def test_no_rows(spark):
    assert C.repaired(C.damaged(spark.createDataFrame([], SCHEMA))).count() == 0


def test_nodes_of_shared_ends_are_worked_out_once():
    one = C.Automaton()
    rng = random.Random(3)
    given = sorted({"".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(0, 30))) for _ in range(300)}, key=lambda s: s[::-1])
    assert [one.solve(s) for s in given] == [C.Automaton().solve(s) for s in given]
    assert len(one.known) < 16 * 60


def test_very_long_signature():
    text = "0132" * 50_000
    blank, duplicate, truncated, illegal, cost, audit = C.Automaton().solve(text)
    assert (blank, duplicate, truncated) == (0, 0, 0) and len(audit) >= len(text) and illegal > 0 and cost > 0
