import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import queries, repair
from millrace.llm.scratch import Scratch

BLANK = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(turns):
    """(cost, audit, repaired lines) by search over all edits; turns are (role, text, fault)."""
    heap, seen = [(0, "", 0, 0, ())], set()
    after = {0: "ua", 1: "u", 2: "a", 3: "u"}
    best = None
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if best and (cost, audit) > best[:2] and cost > best[0]:
            break
        if i == len(turns) and state in (0, 3) and (best is None or (cost, audit) < best[:2]):
            best = cost, audit, lines
        if (i, state, cost, audit) in seen or audit.count("I") > 3 * len(turns) + 3:
            continue
        seen.add((i, state, cost, audit))
        to = {"s": 1, "u": 2, "a": 3}
        for role in ("user", "assistant"):
            if role[0] in after[state] and (role[0] == "u") == (state != 2):
                heapq.heappush(heap, (cost + 5, audit + "I", i, to[role[0]], (*lines, f"{role}:")))
        if i < len(turns):
            role, text, fault = turns[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, lines))
            if fault in ("", "truncated"):
                more = 5 if fault else 0
                initial = role[:1]
                if (initial == "s" and state == 0) or (initial == "u" and state != 2) or (initial == "a" and state == 2):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, to[initial], (*lines, f"{role}:{text}")))
                role = "assistant" if state == 2 else "user"
                heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, to[role[0]], (*lines, f"{role}:{text}")))
    return best


def brute(rows):
    """{conv: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha)} of (conv, turn, role, text)."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        seen, told = set(), []
        for _, role, text in turns:
            last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            fault = "blank" if not BLANK.search(text) else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else ""
            seen.add((role, text))
            told.append((role, text, fault))
        cost, audit, lines = cheapest(told)
        ts = [t for t, _, _ in turns if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        faults = [sum(f == x for *_, f in told) for x in ("blank", "duplicate", "truncated")]
        out[conv] = (max(ts) - min(ts) + 1 - len(set(ts)) if ts else 0, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(spark, df):
    summary, lines = repair.repair(df, Scratch(spark))
    sha = {r.conv_id: r.sha256 for r in repair.digests(lines).collect()}
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, sha.get(r.conv_id, hashlib.sha256(b"").hexdigest())) for r in summary.collect()}


def made(seed, convs=40, most=7):
    rng, rows = random.Random(seed), []
    for c in range(convs):
        for t in range(rng.randrange(1, most)):
            for _ in range(rng.choice([1, 1, 1, 2])):
                rows.append((c if c else None, rng.choice([t, t, 2 * t, None]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(["Hi.", "So?", "cut", " ", "", None, "é!\n", "x. \x85"])))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", range(3))
def test_against_search(spark, seed):
    rows = made(seed)
    assert repaired(spark, spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_matrices_in_any_grouping():
    rng = random.Random(5)
    for n in range(1, 40):
        codes = "".join(rng.choice("ABCDEFGHIJKLMNOP") for _ in range(n))
        whole = repair.of_codes(codes)
        cut = rng.randrange(n + 1)
        assert repair.times(repair.of_codes(codes[:cut]), repair.of_codes(codes[cut:])) == whole
        one = repair.ONE
        for c in codes:
            one = repair.times(one, repair.TURN[c])
        assert one == whole


def test_long_conversations_over_levels(spark, monkeypatch):
    """Segments of 3 rows and groups of 2: the same as one segment, and as the search where it is short."""
    rng = random.Random(8)
    long = [(107, t, rng.choice(["user", "assistant"]), rng.choice(["a.", "b", f"{t}!", f"{t}?"])) for t in range(300)]
    rows = [*long, *made(9, convs=25, most=9), *[(108, 5, "user", "same.")] * 500]
    df = spark.createDataFrame(rows, SCHEMA)
    want = repaired(spark, df)
    monkeypatch.setattr(repair, "SEGMENT", 3)
    monkeypatch.setattr(repair, "FAN", 2)
    assert repaired(spark, df) == want
    short = brute([r for r in rows if r[0] not in (107, 108)])
    assert {c: v for c, v in want.items() if c not in (107, 108)} == short
    assert want[108][:7] == (0, 0, 499, 0, 499, 2 * 500, "D" * 500)


def test_damage(spark):
    rows = [(c, t, "assistant", "A! b? c.") for c in range(60) for t in (0, 1, None)] + [(None, 3, None, None)]
    got = sorted(map(tuple, repair.damaged(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            want += [(c, t, "user" if kind == 4 else role, {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text))] * (2 if kind == 3 else 1)
    assert got == sorted(want, key=str)


def test_edge_cases(spark):
    summary, lines = repair.repair(spark.createDataFrame([], SCHEMA), Scratch(spark))
    assert summary.collect() == [] and repair.digests(lines).collect() == []
    df = spark.createDataFrame([(1, 0, "user", "y" * 200_000 + "."), (1, 1, "assistant", " " * 200_000)], SCHEMA)
    df = df.select("*", *[F.lit("x").alias(n) for n in ("at", "k", "seg", "edit", "part", "copies", "i", "j")])
    summary, lines = repair.repair(df, Scratch(spark))
    assert [(r.cost, r.audit, r.blank) for r in summary.collect()] == [(4, "DD", 1)] and lines.collect() == []


def test_query(same):
    same(queries.QUERIES["op13_repair"], queries.ORACLE_SQL["op13_repair"])
