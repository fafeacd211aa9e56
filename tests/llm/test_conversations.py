"""Conversation repair against a plain recursion over all edits."""

import hashlib
import random
import re
import sys
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from waymark.llm import conversations, queries

DUE, THEN = ["user", "user", "assistant", "user"], [2, 2, 3, 2]


def plain_repair(rows):
    """(cost, audit, repaired lines) of rows (role, text, fault) by recursion over suffixes; at most two inserts in a row can pay."""
    sys.setrecursionlimit(20000)

    @lru_cache(None)
    def best(i, q, inserted):
        found = [(0, "")] if i == len(rows) and q in (0, 3) else []
        if inserted < 2:
            cost, audit = best(i, THEN[q], inserted + 1)
            found.append((cost + 5, "I" + audit))
        if i < len(rows):
            role, _, fault = rows[i]
            cost, audit = best(i + 1, q, 0)
            found.append((cost + 2, "D" + audit))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                cost, audit = best(i + 1, THEN[q], 0)
                found.append((cost + 1 + more, "R" + audit))
                if role[:1] == DUE[q][0]:
                    found.append((cost + more, "K" + audit))
                if role[:1] == "s" and q == 0:
                    cost, audit = best(i + 1, 1, 0)
                    found.append((cost + more, "K" + audit))
        return min(found, default=(10**9, ""))

    cost, audit = best(0, 0, 0)
    lines, q, i = [], 0, 0
    for e in audit:
        if e == "I":
            lines.append(f"{DUE[q]}:")
        else:
            role, text, _ = rows[i]
            i += 1
            if e == "D":
                continue
            lines.append(f"{role if e == 'K' else DUE[q]}:{text}")
            if e == "K" and role[:1] == "s":
                q = 1
                continue
        q = THEN[q]
    roles = "".join(line[0] for line in lines)
    assert re.fullmatch("(s?(ua)+)?", roles)
    return cost, audit, lines


def plain_report(given):
    """Rows (conv_id, turn, role, text) damaged and repaired, by conversation."""
    space, by_conv = " \t\n\x0b\x0c\r", defaultdict(list)
    for conv, turn, role, text in given:
        by_conv[conv]  # every conversation is reported
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        by_conv[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, rows in by_conv.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, faulty = set(), []
        for turn, role, text in rows:
            end = text.rstrip(space)
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        n = {k: sum(f[2] == k for f in faulty) for k in ("blank", "duplicate", "truncated")}
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:]))
        cost, audit, lines = plain_repair(tuple(faulty))
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def odd_rows(seed, n, convs):
    rng = random.Random(seed)
    texts = [None, "", " \t", "A b.", "What now?  ", "no end", "x\n", "Ok!\x0b", ".", "A b.", "é…", "long " * 2000 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "umpire"]
    return [(rng.choice(convs), rng.choice([None, *range(n // len(convs) * 2)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_search_against_recursion():
    rng = random.Random(4)
    for k in range(400):
        rows = [(rng.choice("suaux"), "t", rng.choice([None, None, "blank", "truncated"])) for _ in range(rng.randrange(0, 14))]
        code = {"s": 1, "u": 2, "a": 3}
        codes = bytes(code.get(r, 0) | (4 if f == "blank" else 8 if f else 0) for r, _, f in rows)
        want = plain_repair(tuple(rows))[:2]
        assert conversations.cheapest(codes) == want
        chain = conversations.Chain()  # the same in blocks
        size = rng.randrange(1, 5)
        for at in range(0, max(len(codes), 1), size):
            part = codes[at : at + size]
            chain.add([(p, q, *found) for p in range(4) for q in range(4) if (found := conversations.cheapest(part, p, [q]))])
        assert chain.end() == want


def test_query(spark, data):
    given = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{data}/conversations.parquet").collect()]
    assert got(queries.op12_conversation_repair(spark, data)) == plain_report(given)


@pytest.mark.parametrize("block", [512, 3])
def test_odd_rows(spark, monkeypatch, block):
    """Nulls, ties, repeats, a conversation that lies in many partitions, clashing columns."""
    monkeypatch.setattr(conversations, "BLOCK", block)
    given = odd_rows(1, 250, [1, 1, 1, 1, 1, 1, 2, 3, 4, None]) + odd_rows(2, 60, list(range(10, 50))) + [(99, 0, "user", "gone")]
    df = spark.createDataFrame([(*g, "x", 1) for g in given], "conv_id long, turn long, role string, text string, digest string, part int").repartition(4)
    out = queries.conversations.report(conversations.damaged(df), df)
    assert got(out) == plain_report(given)
    none = df.limit(0)
    assert conversations.report(conversations.damaged(none), none).count() == 0


def test_messages(spark):
    rows = [("c", 1, "system", "Be kind."), ("c", 2, "user", "Hi."), ("c", 2, "user", "Hi."), ("c", 3, "user", "No!"), ("c", 4, "assistant", "cut"), ("d", 1, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    audits = conversations.solved(df)
    found = {r.conv_id: r for r in audits.collect()}
    assert (found["c"].audit, found["c"].cost, found["d"].audit) == ("KKDRD", 5, "D")
    out = conversations.messages(df, audits).orderBy("conv_id", "position").collect()
    assert [(r.position, r.edit, r.role, r.text) for r in out] == [(0, "K", "system", "Be kind."), (1, "K", "user", "Hi."), (2, "R", "assistant", "No!")]


def test_nothing_left(spark):
    """Rows that damage drops all leave an empty report."""
    n = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(n, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    (r,) = conversations.report(conversations.damaged(df), df).collect()
    assert tuple(r) == (n, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert conversations.damaged(df).where(F.lit(True)).count() == 0
