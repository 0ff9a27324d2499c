from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pandas as pd

from tessera.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"


def slow_edits(rows, longest=3):
    """All edits of short conversations, one after another: the cheapest, and of equals the least audit string."""
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\v\f\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None
    slots = len(rows) + 1
    for total in range(longest + 1):
        for where in itertools.combinations_with_replacement(range(slots), total):
            inserts = [where.count(i) for i in range(slots)]
            options = [["D"] if f in ("blank", "duplicate") else ["D", "K", "u", "a"] for f in faults]
            for edits in itertools.product(*options):
                for kinds in itertools.product("ua", repeat=total):
                    kind, initials, audit, cost, out = iter(kinds), "", "", 0, []
                    for i in range(slots):
                        for _ in range(inserts[i]):
                            k = next(kind)
                            initials, audit, cost = initials + k, audit + "I", cost + 2
                            out.append(repair.ROLES[k] + ":")
                        if i < len(rows):
                            (_, role, text), e = rows[i], edits[i]
                            audit += e if e in "DK" else "R"
                            cost += {"D": 3, "K": 0}.get(e, 2) + (faults[i] == "truncated" and e != "D")
                            if e != "D":
                                initials += role[:1] if e == "K" else e
                                out.append(f"{role if e == 'K' else repair.ROLES[e]}:{text}")
                    if re.fullmatch("(s?(ua)+)?", initials) and (best is None or (cost, audit) < best[:2]):
                        best = cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()
    return best, faults


def conversation(rows, texts=True):
    c, seen = repair.Conversation(texts), set()
    for turn, role, text in rows:
        c.row(turn, role, text, (role, text) in seen)
        seen.add((role, text))
    return c.result()


def test_edits_by_brute_force():
    rng = random.Random(4)
    for n in [0, 1, 1, 2, 2, 3, 3, 3, 4, 4, 4]:
        for _ in range(6):
            rows = [(i, rng.choice(["user", "assistant", "system", "tool", " "]), rng.choice(["a.", "b?", "cut", "", " \t", "d!"])) for i in range(n)]
            (cost, audit, sha), faults = slow_edits(rows)
            got = conversation(rows)
            assert (got["cost"], got["audit"], got["repaired_sha256"]) == (cost, audit, sha), rows
            assert [got[k] for k in ("blank", "duplicate", "truncated")] == [faults.count(k) for k in ("blank", "duplicate", "truncated")]
            assert got["repaired_sha256"] == hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in got["repaired"]).encode()).hexdigest()


def test_long_conversations_set_their_audit_aside(monkeypatch):
    rng = random.Random(5)
    rows = [(i, rng.choice(["user", "assistant", "system"]), rng.choice(["one.", "two", "", "three!", f"{i}?"])) for i in range(3000)]
    some = conversation(rows, texts=False)
    monkeypatch.setattr(repair, "SHARED", 10**9)
    assert some == conversation(rows) | {"repaired": None}
    monkeypatch.setattr(repair, "SHARED", 1)
    assert some == conversation(rows, texts=False)
    assert len(some["audit"].replace("I", "")) == len(rows)


def odd_rows():
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(["Hello.", "no end", None, "", "Why? Yes!", "x" * 3000])) for c in range(60) for t in range(rng.randint(1, 6))]
    rows += [(None, 0, "user", "nobody's."), (None, None, None, None), (7, None, "user", "no turn."), (7, None, "assistant", "no turn."), (8, 1, "user", "again."), (8, 1, "user", "again."), (9, 90, "", "far.")]
    # Conversations of which nothing is left.
    gone = [c for c in range(100, 400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:2]
    return rows + [(c, 0, "user", "goes.") for c in gone], gone


def test_query_by_sql(spark):
    rows, gone = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS seen", "'x' AS gone_", "2 AS copy")
    got = {r.conv_id: r.asDict() for r in repair.repair(repair.damage(df), texts=False).drop("repaired").collect()}
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
    want = duckdb.sql(repair.OP11_SQL)
    names = want.columns
    assert got == {r[0]: dict(zip(names, r, strict=True)) for r in want.fetchall()}
    assert len(gone) == 2 and all((got[c]["audit"], got[c]["cost"], got[c]["repaired_sha256"]) == ("", 0, hashlib.sha256(b"").hexdigest()) for c in gone)
    assert None in got


def test_repaired_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hi."), (1, 3, "assistant", "Hi."), (2, 0, "user", "Q?")], SCHEMA)
    got = {r.conv_id: r for r in repair.repair(df).collect()}
    assert [tuple(x) for x in got[1].repaired] == [("system", "Be kind."), ("user", ""), ("assistant", "Hi.")]
    assert (got[1].audit, got[1].cost, got[1].gaps, got[1].duplicate, got[1].illegal) == ("KIKD", 5, 1, 1, 2)
    assert (got[2].audit, got[2].cost) == ("KI", 2)
    assert repair.repair(repair.damage(spark.createDataFrame([], SCHEMA))).count() == 0
