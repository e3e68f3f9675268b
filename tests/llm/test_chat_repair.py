"""Repair of conversations against a search over all edits, and its results for odd rows."""

from __future__ import annotations

import heapq
import random
from hashlib import md5, sha256
from itertools import groupby, product

from pyspark.sql import functions as F
from wattcell.llm import chat_repair

SPACE = " \t\n\x0b\f\r"


def searched(turns):
    """Cheapest edits of (initial, must go, truncated), by a best-first search over (turn, last initial)."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, last = heapq.heappop(heap)
        if (i, last) in seen:
            continue
        seen.add((i, last))
        if i == len(turns) and last in ("", "a"):
            return cost, audit
        wanted = "a" if last == "u" else "u"
        heapq.heappush(heap, (cost + 5, audit + "I", i, wanted))
        if i < len(turns):
            initial, gone, truncated = turns[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last))
            if not gone:
                heapq.heappush(heap, (cost + 1 + 5 * truncated, audit + "R", i + 1, wanted))
                if initial == wanted or (initial == "s" and last == ""):
                    heapq.heappush(heap, (cost + 5 * truncated, audit + "K", i + 1, initial))


def expected(rows):
    """Report of one conversation from its (turn, role, text) in order."""
    seen, turns, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        turns.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    initials = [t[0] for t in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit = searched(turns)
    out, place = [], iter(rows)
    for letter in audit:
        row = None if letter == "I" else next(place)
        if letter != "D":
            given = "assistant" if out and out[-1][0][:1] == "u" else "user"
            out.append((row[1] if letter == "K" else given, row[2] if row else ""))
    numbers = [r[0] for r in rows if r[0] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    digest = sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return gaps, *counts.values(), illegal, cost, audit, digest


def test_block_tables_match_search():
    kinds = [(i, g, t) for g, t in ((False, False), (False, True)) for i in "sua?"] + [("u", True, False)]
    rng = random.Random(5)
    lines = [list(x) for n in range(4) for x in product(range(9), repeat=n)]
    lines += [[rng.choice([0, 1, 1, 2, 2, 3, 4, 5, 6, 7, 8]) for _ in range(rng.randint(4, 40))] for _ in range(1500)]
    for line in lines:
        assert chat_repair.repair(bytes(line)) == searched([kinds[s] for s in line])


def test_conversations_match_search(spark):
    rng = random.Random(7)
    rows = []
    for conv in [None, *range(60)]:
        # the last conversation holds most rows
        for turn in range(700 if conv == 59 else rng.randint(1, 9)):
            role = rng.choice(["user", "user", "assistant", "assistant", "system", "tool", ""])
            text = rng.choice(["Yes.", "No!", "Is it?", "cut off", " \t\n", "", "Gut ä. \n", " ", f"number {turn}."])
            rows.append((conv, None if rng.random() < 0.05 else turn + rng.choice([0, 0, 3]) * (turn > 4), role, text))
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    found = {r[0]: tuple(r)[1:] for r in chat_repair.repair_conversations(docs).collect()}
    key = lambda r: (r[0] is not None, r[0] or 0)
    want = {}
    for conv, group in groupby(sorted(rows, key=key), key=lambda r: r[0]):
        ordered = sorted(group, key=lambda r: (r[1] is not None, r[1] or 0, r[2], md5(r[3].encode()).digest()))
        want[conv] = expected([r[1:] for r in ordered])
    assert found == want


def test_odd_rows(spark):
    rows = [
        ("a", 0, None, "Hello.", 1), ("a", 1, "assistant", None, 1),  # null role and text
        ("b", 0, "user", "Gone.", 0),  # no row left
        ("c", 0, "user", "Same.", 3), ("c", 0, "user", "Same.", 1), ("c", 1, "assistant", "Well.", 1),  # repeated rows
        ("d", 4, "user", "long " * 200_000 + ".", 1), ("d", 9, "assistant", "x" * 1_000_000, 1),  # very long
    ]
    docs = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string, n int")
    clashing = docs.withColumns({c: F.lit("x") for c in ("conv", "kind", "digest", "copies", "report", "audit", "cost", "first", "blank")})
    found = {r["conv_id"]: r for r in chat_repair.repair_conversations(clashing, copies=F.col("n")).collect()}
    empty = sha256(b"").hexdigest()
    report = lambda c: tuple(found[c])[1:]
    assert report("a") == (0, 1, 0, 0, 1, 4, "DD", empty)
    assert report("b") == (0, 0, 0, 0, 0, 0, "", empty)
    assert report("c") == (0, 0, 3, 0, 3, 6, "KDDDK", sha256(b"user:Same.\nassistant:Well.").hexdigest())
    assert report("d") == (4, 0, 0, 1, 0, 4, "DD", empty)
    assert chat_repair.repair_conversations(docs.limit(0)).count() == 0
