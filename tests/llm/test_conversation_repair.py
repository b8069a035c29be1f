"""Conversation repair against all cheapest edits, found by plain search."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sketchloom.llm import conversation_repair as cr

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def best(rows, full=True):
    """(cost, audit, lines) by trying every edit; ``rows``: (role, text, must go, truncated)."""
    from functools import cache

    @cache
    def go(i, last, room):
        out = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        if room:
            for role in ("user", "assistant"):
                if role[0] in NEXT[last]:
                    x = go(i, role[0], room - 1)
                    if x:
                        out.append((x[0] + 2, "I" + x[1], (f"{role}:", *x[2])))
        if i < len(rows):
            role, text, must, late = rows[i]
            x = go(i + 1, last, 2)
            if x:
                out.append((x[0] + 3, "D" + x[1], x[2]))
            if not must:
                for new, letter, cost in ((role, "K", 0), ("user", "R", 2), ("assistant", "R", 2)):
                    if new[:1] and new[0] in NEXT[last] and (letter == "R" or new[0] in "sua"):
                        x = go(i + 1, new[0], 2)
                        if x:
                            out.append((x[0] + cost + late, letter + x[1], (f"{new}:{text}", *x[2])))
        return min(out, default=None)

    return go(0, "", 2)


def expect(rows, damage=True):
    """Rows of the report, by the contract read plainly."""
    by = {}
    for conv, turn, role, text in rows:
        own = by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        x = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if x == 0:
            continue
        text = "" if x == 1 else re.sub("[.!?]", "", text) if x == 2 else text
        own += [(turn, "user" if x == 4 else role, text)] * (2 if x == 3 else 1)
    out = []
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, plain, count = set(), [], [0, 0, 0]
        for _, role, text in own:
            found = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 0 if not found else 1 if (role, text) in seen else 2 if found[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                count[fault] += 1
            plain.append((role, text, fault in (0, 1), fault == 2))
        turns = {t for t, *_ in own if t is not None}
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(plain, plain[1:])]
        cost, audit, lines = best(tuple(plain))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *count, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def odd(seed, n=60, longest=9):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for t in range(rng.randrange(1, longest)):
            rows.append((conv if conv else None, rng.choice([t, t, t, t + 1, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "sys"]),
                         rng.choice(["Hi.", "Hi", "so!  ", "ok \n", " ", "", None, "é?\t", "漢", f"line {rng.randrange(4)}."])))
    return list(dict.fromkeys(rows))


@pytest.mark.parametrize("damage", [True, False])
def test_odd_rows(spark, damage):
    rows = odd(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = cr.report(df, cr.damaged(df) if damage else df.withColumn("id", F.monotonically_increasing_id()).withColumn("a.b", F.lit(1)).withColumn("kinds", F.lit(1)))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert got(out) == expect(rows, damage)


def test_conversations_of_many_blocks(spark):
    """Blocks of three rows, over several ranges, give what one block gives."""
    rows = odd(2, 6, 60)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    whole = got(cr.report(df, cr.damaged(df)))
    assert whole == expect(rows)
    assert cr.repair(cr.damaged(df), 3)["blocks"].where("NOT single").count() > 20
    assert got(cr.report(df, cr.damaged(df), 3)) == whole


def test_blocks_alone():
    rng = random.Random(3)
    for _ in range(300):
        rows = bytes(rng.choice([0, 1, 1, 2, 2, 3, 5, 6, 8]) for _ in range(rng.randrange(1, 30)))
        whole, _ = cr.solve(rows, cr.ENTRY, cr.CLOSING, (0,), True)
        cuts = sorted({0, len(rows), *(rng.randrange(len(rows)) for _ in range(4))})
        parts = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
        steps, mask = [], 1
        for k, (part, (front, back)) in enumerate(zip(parts, cr.borders([cr.matrix(p) for p in parts]))):
            own, left = cr.solve(part, front, back, cr.SETS[mask], k + 1 == len(parts))
            steps += own
            if k + 1 < len(parts):
                mask = cr.frontier_table(part, front, back)[mask]
                assert cr.SETS[mask] == left
        assert steps == whole


def test_least_audit():
    rng = random.Random(4)
    for _ in range(400):
        plain = tuple((rng.choice(["user", "assistant", "system", "x"]), f"t{k}", rng.random() < 0.2, rng.random() < 0.2) for k in range(rng.randrange(8)))
        plain = tuple((r, t, must, late and not must) for r, t, must, late in plain)
        steps, _ = cr.solve(bytes(cr.kind(r[0], must, late) for r, _, must, late in plain), cr.ENTRY, cr.CLOSING, (0,), True)
        assert (sum(x for *_, x in steps), "".join(x for x, *_ in steps)) == best(plain)[:2]


def test_empty_and_dropped(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cr.report(empty, cr.damaged(empty)).count() == 0
    gone = [k for k in range(100) if zlib.crc32(f"{k}:0".encode()) % 20 == 0]
    rows = [(k, 0, "user", "Hi.") for k in gone]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(cr.report(df, cr.damaged(df))) == sorted(((k, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for k in gone), key=str)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(cr.op12_conversation_repair(spark, SF)) == expect(rows)
