"""Conversation repair against an exhaustive search and a plain program for the whole query."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from lodestone.llm import dialogue
from lodestone.llm._common import table

SF = "/root/testdata/sf0.001"
GOOD = re.compile(r"(s?(ua)+)?\Z")
WS = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """rows: (initial, must go, truncated). Every edit sequence up to the cost of deleting all: the least (cost, audit, roles)."""
    best = (3 * len(rows), "D" * len(rows), "")

    def go(i, cost, audit, roles, inserted):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(rows) and GOOD.match(roles):
            best = min(best, (cost, audit, roles))
        if inserted < 2:
            for x in "ua":
                go(i, cost + 2, audit + "I", roles + x, inserted + 1)
        if i < len(rows):
            initial, gone, cut = rows[i]
            go(i + 1, cost + 3, audit + "D", roles, 0)
            if not gone:
                go(i + 1, cost + cut, audit + "K", roles + (initial or "?"), 0)
                for x in "ua":
                    go(i + 1, cost + 2 + cut, audit + "R", roles + x, 0)

    go(0, 0, "", "", 0)
    return best


def symbol(initial, gone, cut):
    return (("sua".find(initial) if initial else -1) % 4) + 4 * (2 if gone else int(cut))


def test_every_short_conversation():
    automaton = dialogue.Determinised()
    kinds = [(i, g, c) for i in "sua?" for g, c in ((False, False), (False, True), (True, False))]
    for n in (0, 1, 2):
        for rows in product(kinds, repeat=n):
            assert automaton.repair(bytes(symbol(*r) for r in rows)) == cheapest(list(rows))[:2], rows
    rng = random.Random(4)
    for _ in range(150):
        rows = [rng.choice(kinds) for _ in range(rng.choice((3, 4)))]
        assert automaton.repair(bytes(symbol(*r) for r in rows)) == cheapest(rows)[:2], rows
    assert len(automaton.vectors) < 64  # the automaton stays small


def by_hand(rows):
    """rows: (conv_id, turn, role, text). What the query returns, by a dynamic program over plain tuples."""
    convs, out = defaultdict(list), {}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        convs[c] += [] if kind == 0 else [(t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)] * (2 if kind == 3 else 1)
    for c, turns in convs.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2][:64], hashlib.md5(x[2].encode()).hexdigest()))
        seen, kinds, blank, dup, cut = set(), [], 0, 0, 0
        for _, role, text in turns:
            b = not text.strip(WS)
            d = not b and (role, text) in seen
            t = not b and not d and text.rstrip(WS)[-1] not in ".!?"
            seen.add((role, text))
            blank, dup, cut = blank + b, dup + d, cut + t
            kinds.append((role[:1], b or d, t))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        best = {3: (0, ""), 0: (0, ""), 2: (2, "I"), 1: (4, "II")}  # costs and audits to go
        for initial, gone, t in reversed(kinds):
            ahead = {}
            for q in range(4):
                ways = [(3 + best[q][0], "D" + best[q][1])]
                if not gone:
                    n = (2, 2, 3, 2)[q]
                    ways.append((2 + t + best[n][0], "R" + best[n][1]))
                    kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((q, initial))
                    if kept is not None:
                        ways.append((t + best[kept][0], "K" + best[kept][1]))
                ahead[q] = min(ways)
            for _ in range(4):
                ahead = {q: min(ahead[q], (2 + ahead[(2, 2, 3, 2)[q]][0], "I" + ahead[(2, 2, 3, 2)[q]][1])) for q in range(4)}
            best = ahead
        cost, audit = best[0]
        lines, q, left = [], 0, list(turns)
        for letter in audit:
            n = (2, 2, 3, 2)[q]
            name = {2: "user", 3: "assistant"}[n]
            if letter == "I":
                lines.append(f"{name}:")
                q = n
                continue
            _, role, text = left.pop(0)
            if letter == "R":
                lines.append(f"{name}:{text}")
                q = n
            elif letter == "K":
                lines.append(f"{role}:{text}")
                q = {"s": 1, "u": 2, "a": 3}[role[0]]
        out[c] = (gaps, blank, dup, cut, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


ODD = [
    (None, 0, "user", "no id."), (None, 1, "assistant", "an answer."), (None, None, "user", "no turn"), (1, None, None, None), (1, None, "user", "two without a turn"), (1, None, "user", "two without a turn!"),
    (2, 5, "system", "s."), (2, 9, "user", "u?"), (2, 9, "user", "u?"), (2, 9, "assistant", "tie in turns."), (3, 1, "", ""), (3, 2, "tool", "other role."), (3, 3, "user", "x" * 300_000), (4, 1, "user", "　"), (4, 2, "assistant", "日本語。"),
    *((5, t, "user", "again and again.") for t in range(40)), *((6, 3, "assistant", "one row many times.") for _ in range(30)), (7, -4, "assistant", "a"), (7, 100, "user", "u"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string").repartition(5)


def shown(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_query_and_odd_rows(spark, odd):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert shown(dialogue.op12_dialogue(spark, SF)) == by_hand(rows)
    want = by_hand(ODD)
    clash = odd.withColumns({c: F.lit(f"own {c}") for c in ("n", "head", "digest", "fault", "row", "audit", "cost", "first", "part")})
    for turns in (odd, clash.select(*odd.columns), odd.unionByName(odd.limit(0))):
        assert shown(dialogue.repair(dialogue.damage(turns), every=turns)) == want
    empty = odd.limit(0)
    assert dialogue.repair(dialogue.damage(empty), every=empty).count() == 0
    all_gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    lost = spark.createDataFrame([(all_gone, 0, "user", "gone.")], odd.schema)
    assert shown(dialogue.repair(dialogue.damage(lost), every=lost)) == {all_gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repaired_rows(spark, odd):
    found = defaultdict(list)
    for r in dialogue.repaired_turns(odd).orderBy("position").collect():
        assert r.position == len(found[r.conv_id]) and (r.edit != "I" or (r.text == "" and r.turn is None))
        found[r.conv_id].append(r)
    audits = {r.conv_id: r for r in dialogue.repair(odd).collect()}
    for c, r in audits.items():
        assert GOOD.match("".join(x.role[:1] for x in found[c]))
        assert [x.edit for x in found[c]] == [x for x in r.audit if x != "D"]
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in found[c]).encode()).hexdigest() == r.repaired_sha256


def test_long_conversation_in_pieces(spark):
    rows = [(1, i // 2, ("user", "assistant", "system")[i % 3], f"text {i % 700}" + "." * (i % 5 > 0)) for i in range(6000)] + [(2, 0, "user", "q."), (2, 1, "assistant", "a.")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    assert shown(dialogue.repair(dialogue.damage(turns), every=turns)) == by_hand(rows)
