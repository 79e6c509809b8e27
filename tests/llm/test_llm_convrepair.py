"""Conversation repair: the DP against exhaustive search, segments against the whole, the query against a written definition."""

import hashlib
import itertools
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import convrepair as cr
from tidemark.llm.common import table

SF = "/root/testdata/sf0.001"
GOAL = re.compile(r"(s?(ua)+)?\Z")


def exhaustive(rows):
    """(cost, audit) by trying every audit that costs no more than the best so far; rows are (initial, must go, cut)."""
    best = (2 * len(rows), "D" * len(rows))  # to delete all is always possible

    def walk(i, seq, cost, audit, gap):
        nonlocal best
        if cost > best[0] or not re.match("s?(ua)*u?\\Z", seq):
            return
        if i == len(rows) and GOAL.match(seq) and (cost, audit) < best:
            best = (cost, audit)
        if gap < 2:
            for r in "ua":
                walk(i, seq + r, cost + 5, audit + "I", gap + 1)
        if i < len(rows):
            c, must, cut = rows[i]
            walk(i + 1, seq, cost + 2, audit + "D", 0)
            if not must:
                walk(i + 1, seq + (c or "?"), cost + 5 * cut, audit + "K", 0)
                for r in "ua":
                    walk(i + 1, seq + r, cost + 1 + 5 * cut, audit + "R", 0)

    walk(0, "", 0, "", 0)
    return best


def solve(rows, **kw):
    dp = cr.Repair(0, lead=True, **kw)
    for r in rows:
        dp.row(*r)
    cost, node = dp.result()
    return cost, dp.audits.text(node)


def random_rows(rng, n):
    return [(str(rng.choice(list("ssuuuaaat") + [""])), bool(rng.random() < .2), bool(rng.random() < .3)) for _ in range(n)]


def test_dp_equals_exhaustive_search():
    rng = np.random.default_rng(3)
    for n in range(7):
        for _ in range(60):
            rows = random_rows(rng, n)
            assert solve(rows) == exhaustive(rows), rows
    for n in range(4):
        for rows in itertools.product([("s", False, False), ("u", False, False), ("a", False, True), ("u", True, False)], repeat=n):
            assert solve(rows) == exhaustive(rows), rows


def test_hash_collisions_do_not_decide():
    rng = np.random.default_rng(4)
    for _ in range(60):
        rows = random_rows(rng, 40)
        assert solve(rows) == solve(rows, modulus=3, base=2) == solve(rows, modulus=1, base=1)


def test_persistent_prefixes():
    a = cr.Audits()
    x = [0]
    for k in range(50):
        x.append(a.add(x[-1], "KDR"[k % 3]))
    y = a.add(x[20], "I")
    assert a.ancestor(x[50], 13) == x[13] and a.text(y) == a.text(x[20]) + "I"
    assert a.same(x[5], x[5]) and not a.same(x[21], y)
    for k in range(21, 50):
        y = a.add(y, "KDR"[k % 3])
    assert a.less(y, "", x[50], "") == (a.text(y) < a.text(x[50]))


def test_segments_equal_the_whole(monkeypatch):
    rng = np.random.default_rng(6)
    for _ in range(40):
        rows = random_rows(rng, int(rng.integers(2, 60)))
        cut = int(rng.integers(1, 9))
        top = cr.Repair()
        for k in range(0, len(rows), cut):
            ways = []
            for s in ([0] if k == 0 else range(4)):
                m = cr.Repair(s, lead=k == 0)
                for r in rows[k:k + cut]:
                    m.row(*r)
                ways += [(s, e, m.best[e][0], m.audits.text(m.best[e][1])) for e in range(4) if m.best[e]]
            top.segment(ways)
        cost, node = top.result()
        assert (cost, top.audits.text(node)) == solve(rows)


def defined(rows):
    """The contract, row by row in plain Python, over (conv_id, turn, role, text)."""
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, [])
        say = lambda v: " " if v is None else str(v)
        z = zlib.crc32(f"{say(c)}:{say(t)}".encode()) % 20
        r, x = say(r), say(x)
        x = "" if z == 1 else re.sub("[.!?]", "", x) if z == 2 else x
        r = "user" if z == 4 else r
        convs[c] += [(t, r, x)] * (0 if z == 0 else 2 if z == 3 else 1)
    out = []
    for c, lines in convs.items():
        lines.sort(key=lambda v: (v[0] is not None, v[0] or 0, v[1], hashlib.sha256(v[2].encode()).hexdigest()))
        seen, dp, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for t, r, x in lines:
            body = x.strip(cr.WHITE)
            fault = "blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((r, x))
            if fault:
                n[fault] += 1
            dp.append((r[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit = solve(dp) if lines else (0, "")
        turns = [t for t, *_ in lines if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[0] + b[0] for a, b in zip(dp, dp[1:])]
        done, state = [], 0
        for at, role, state in cr.replay(audit, 0, [d[0] for d in dp]):
            done.append(f"{role}:" if at < 0 else f"{role or lines[at][1]}:{lines[at][2]}")
        out.append((c, gaps, n["blank"], n["duplicate"], n["truncated"], sum(p not in cr.LEGAL for p in pairs), cost, audit,
                    hashlib.sha256("\n".join(done).encode()).hexdigest()))
    return out


COLS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def query(spark, df, monkeypatch):
    monkeypatch.setattr(cr, "table", lambda *_: df)
    return sorted(map(tuple, cr.op13_convrepair(spark, "").select(COLS).collect()), key=repr)


def test_query_equals_definition(spark):
    rows = list(map(tuple, table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()))
    assert sorted(map(tuple, cr.op13_convrepair(spark, SF).select(COLS).collect()), key=repr) == sorted(defined(rows), key=repr)


@pytest.mark.parametrize("segment_rows", [3, 4096])
def test_edges(spark, monkeypatch, segment_rows):
    """Nulls in every column, ties, repeated rows, odd roles, many buckets and segments, clashing columns."""
    monkeypatch.setattr(cr, "SEGMENT_ROWS", segment_rows)
    rng = np.random.default_rng(8)
    rows = [(None, None, None, None), (None, 3, "user", "hi."), (1, None, "user", "a?"), (1, None, "assistant", "b"), (2, 5, "", ""), (2, 5, "tool", "x!"),
            (3, 2 ** 60, "user", "far."), (3, -2 ** 60 % 7, "assistant", "near."), (4, 0, "user", " \n")] + [(5, 7, "user", "same.")] * 9
    rows += [(int(c), int(rng.integers(0, 30_000)), str(rng.choice(["system", "user", "assistant"])), str(rng.choice(["ok.", "no", "", "why?", "x" * 5000])))
             for c in rng.integers(10, 16, 300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit("clash")).withColumn("bucket", F.lit(None)).repartition(4)
    assert query(spark, df, monkeypatch) == sorted(defined(rows), key=repr)


def test_empty_table(spark, monkeypatch):
    assert query(spark, spark.createDataFrame([], "conv_id long, turn long, role string, text string"), monkeypatch) == []


def test_sql_twin_on_edges(spark, monkeypatch):
    rows = [(1, None, "user", "a?"), (1, 2, "assistant", None), (1, 2, None, "b."), (None, 1, "user", "x"), (7, 9, "user", "é…"), (8, 1, "system", "s."), (8, 2, "user", "u."), (8, 3, "assistant", "a.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = con.execute(f"SELECT {', '.join(COLS)} FROM ({cr.ORACLE})").fetchall()
    assert query(spark, df, monkeypatch) == sorted(got, key=repr) == sorted(defined(rows), key=repr)
