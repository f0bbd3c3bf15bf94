"""Repaired conversations against a plain search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from meguri.llm import auction, repair
from meguri.llm.common import step, table

FOLDER = "/root/testdata/sf0.001"
GOOD = re.compile(r"(s?(ua)+)?")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        role, text = name(role), name(text)
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of one conversation's
    damaged rows, by Dijkstra over (cost, audit)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    faults, seen = [], set()
    for _, role, text in rows:
        ink = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("b" if not ink else "d" if (role, text) in seen else "t" if ink[-1] not in ".!?" else ".")
        seen.add((role, text))
    first = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, closed = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, said, lines = heapq.heappop(heap)
        if i == len(rows) and said in ("", "a"):
            break
        if (i, said) in closed:  # equal audits give equal states, so the first one popped is the least
            continue
        closed.add((i, said))
        def to(c, mark, n, now, line):
            heapq.heappush(heap, (cost + c, audit + mark, i + n, now, (*lines, *line)))
        for role in ("user", "assistant"):
            if role[0] in after[said]:
                to(5, "I", 0, role[0], [f"{role}:"])
        if i < len(rows):
            to(2, "D", 1, said, [])
            if faults[i] in ".t":
                more = 5 if faults[i] == "t" else 0
                if first[i] and first[i] in after[said]:
                    to(more, "K", 1, first[i], [f"{rows[i][1]}:{rows[i][2]}"])
                for role in ("user", "assistant"):
                    if role[0] in after[said]:
                        to(more + 1, "R", 1, role[0], [f"{role}:{rows[i][2]}"])
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return gaps, *(faults.count(c) for c in "bdt"), illegal, cost, audit, digest


def plain(rows):
    said = {}
    for conv, turn, role, text in plain_damage(rows):
        said.setdefault(conv, []).append((turn, role, text))
    return {c: plain_repair(said.get(c, [])) for c in {r[0] for r in rows}}


def check(spark, rows):
    docs = step(spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, key string").coalesce(1))
    rows = [tuple(r) for r in docs.drop("key").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repaired(docs, repair.damaged(docs)).collect()}
    assert got == plain(rows)


def made_up(rng, n, turns):
    text = lambda: rng.choice(["Yes.", "No!", "and", "", " \n", "So?", "well then.", None, "a. ", "b\x85"])
    role = lambda: rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "User", "agent"])
    return [(rng.choice([None, *range(n)]), rng.choice([None, *range(turns)]), role(), text()) for _ in range(n * turns)]


def test_odd_conversations(spark):
    rng = random.Random(2)
    rows = made_up(rng, 60, 9)
    rows += [(900 + k, t, r, f"{t}.") for k in range(40) for t, r in enumerate(rng.choices(["system", "user", "assistant"], k=rng.randrange(1, 9)))]
    rows += [(2000, 5 * t, "user", "same.") for t in range(20)] + [(2001, 0, "assistant", "word " * 50_000 + ".")]
    check(spark, rows)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repaired(empty, repair.damaged(empty)).count() == 0


@pytest.mark.parametrize("block, fan", [(3, 2), (5, 4)])
def test_conversations_over_many_blocks(spark, monkeypatch, block, fan):
    monkeypatch.setattr(repair, "BLOCK", block)
    monkeypatch.setitem(repair.exclusive.__globals__, "FAN", fan)
    rng = random.Random(block)
    rows = made_up(rng, 12, 25)
    rows += [(77, t, rng.choice(["user", "assistant", "system"]), f"{t}" + rng.choice([".", ".", "", "?"])) for t in range(160)]
    rows += [(78, t, "system", f"{t}.") for t in range(30)] + [(79, t, "tool", " ") for t in range(30)]
    check(spark, rows)


def test_query(spark):
    rows = [tuple(r) for r in table(spark, FOLDER, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert {r["conv_id"]: tuple(r)[1:] for r in repair.op12(spark, FOLDER).collect()} == plain(rows)


def test_prices_and_tight_arcs():
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randrange(0, 9)
        initials, faults = ("".join(rng.choices(letters, k=n)) for letters in ("sua-", "bdt..."))
        leave = None if rng.random() < 0.3 else tuple(rng.choice([0, 3, 20, auction.NEVER]) for _ in range(4))
        graph = auction.arcs(initials, faults, leave)
        price = auction.prices(graph, leave)
        for node, arcs in enumerate(graph[:-1]):  # Bellman's equations hold, so prices are distances
            assert min(price[node], auction.NEVER) == min([min(c + price[to], auction.NEVER) for _, c, to in arcs], default=auction.NEVER)
    long = "sua-" * 3000
    assert auction.prices(auction.arcs(long, "." * len(long), None), None)[0] > 0
