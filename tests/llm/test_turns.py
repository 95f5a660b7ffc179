"""Repair of dialogues against a search over all edit sequences, and its stretches against whole alignments."""

from __future__ import annotations

import hashlib
import heapq
import random
import re

import pytest
from pyspark.sql import functions as F

from sessionloom.llm import turn_repair
from sessionloom.llm.queries import damaged

SCHEMA = "conv_id long, turn long, role string, text string, cost string, part string"
SOUND = re.compile("(s?(ua)+)?")
SPACE = " \t\n\v\f\r"


def judge(rows):
    """Fault of each turn in order, and whether it has to go."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        out.append(fault)
    return out


def cheapest(rows):
    """Cost, audit and repaired turns by a search over edit sequences, cheapest and then least in ASCII first."""
    faults, heap, seen = judge(rows), [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, made, turns = heapq.heappop(heap)
        # The future depends on the place, whether there is a turn yet, and the last role.
        state = (at, made[:1] != "", made[-1:])
        if at == len(rows) and SOUND.fullmatch(made):
            return cost, audit, turns
        if state in seen:
            continue
        seen.add(state)

        def go(cost, letter, at, made, turn):
            if re.fullmatch("(s?(ua)*u?)?", made):
                heapq.heappush(heap, (cost, audit + letter, at, made, turns + turn))

        for role in ("user", "assistant"):
            go(cost + 3, "I", at, made + role[0], ((role, ""),))
        if at == len(rows):
            continue
        role, text = rows[at]
        go(cost + 4, "D", at + 1, made, ())
        if faults[at] in ("blank", "duplicate"):
            continue
        late = 3 if faults[at] else 0
        if role[:1]:
            go(cost + late, "K", at + 1, made + role[0], ((role, text),))
        for new in ("user", "assistant"):
            go(cost + 3 + late, "R", at + 1, made + new[0], ((new, text),))
    raise AssertionError("nothing fits")


def in_order(turns):
    return sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).hexdigest()))


def brute(turns):
    """The digest of a dialogue from its (turn, role, text) rows."""
    rows = in_order([(n, " " if r is None else r, " " if t is None else t) for n, r, t in turns])
    pairs = [(r, t) for _, r, t in rows]
    faults = judge(pairs)
    cost, audit, repaired = cheapest(pairs)
    numbers = [n for n, _, _ in rows if n is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    initials = [r[:1] for r, _ in pairs]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    text = "\n".join(f"{r}:{t}" for r, t in repaired)
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def some_turns(seed, n, roles=("user", "assistant", "system", "tool")):
    draw = random.Random(seed)
    texts = ["Yes.", "no", "Why?", "", " \n", "so be it!", "cut off", "é…", "end. \t"]
    return [(draw.choice([k, k, k, k // 2, None]), draw.choice(roles), draw.choice(texts) if draw.random() < 0.5 else f"text {k}{draw.choice('.x')}") for k in range(n)]


def digests(spark, dialogues):
    rows = [(conv, *turn, "clash", "clash") for conv, turns in dialogues.items() for turn in turns]
    random.Random(1).shuffle(rows)
    found = turn_repair.digests(turn_repair.edits(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(found) == len({r.conv for r in found})
    return {r.conv: tuple(r)[1:] for r in found}


@pytest.fixture(scope="module")
def dialogues():
    out = {k: some_turns(k, k % 9) for k in range(160) if k % 9}
    out[None] = some_turns(500, 12)
    out[200] = [(1, None, None), (1, None, "x."), (None, "", "no role"), (None, "user", None)]
    out[201] = [(3, "user", "Same.")] * 7 + [(4, "assistant", "Same.")] * 2 + [(9, "user", "Same.")]
    out[202] = [(0, "sam", "kept by its initial."), (1, "ursula", "so is this."), (2, "ann", "and this."), (7, "System", "not this.")]
    out[203] = [(k, "user", "word " * 20_000 + ".") for k in range(2)]
    out[204] = [(0, "system", "Alone.")]
    out[205] = [(0, "user", " "), (1, "user", "")]
    out[206] = some_turns(7, 150)
    return out


def test_repairs_equal_a_search_over_edits(spark, dialogues, monkeypatch):
    want = {conv: brute(turns) for conv, turns in dialogues.items()}
    assert digests(spark, dialogues) == want
    # Dialogues in many pieces and stretches.
    monkeypatch.setattr(turn_repair, "PIECE", 5)
    monkeypatch.setattr(turn_repair, "STRETCH", 3)
    turn_repair.stretch_ways.cache_clear()
    assert digests(spark, dialogues) == want
    assert digests(spark, {}) == {}


def test_stretches_compose_to_the_whole():
    draw = random.Random(9)
    for _ in range(300):
        turns = "".join(draw.choice("suaxSUAX") for _ in range(draw.randint(0, 9)))
        whole = turn_repair.stretch_ways(turns)
        for cut in range(len(turns) + 1):
            parts = turn_repair.composed(turn_repair.stretch_ways(turns[:cut]), turn_repair.stretch_ways(turns[cut:]))
            assert {k: (c, p.translate(turn_repair.AUDIT)) for k, (c, p) in parts.items()} == {k: (c, p.translate(turn_repair.AUDIT)) for k, (c, p) in whole.items()}


def test_bands_change_nothing():
    draw = random.Random(10)
    for _ in range(200):
        turns = "".join(draw.choice("suaxSUAX") for _ in range(draw.randint(1, 8)))
        wanted = turn_repair.target(draw.choice("sua"), draw.randint(0, 10))
        free = turn_repair.alignment(turns, wanted, turn_repair.NEVER - 1)
        for limit in (0, 4, 9, 17, 30, 60):
            assert turn_repair.alignment(turns, wanted, limit) == (free if free and free[0] <= limit else None)


def test_repaired_turns_are_sound(spark, dialogues):
    rows = [(conv, *turn, "clash", "clash") for conv, turns in dialogues.items() for turn in turns]
    found = turn_repair.repaired(spark.createDataFrame(rows, SCHEMA)).orderBy("conv", "part", "slot", "step").collect()
    initials: dict = {}
    for r in found:
        initials[r.conv] = initials.get(r.conv, "") + r.role[0]
    # A system turn alone is cheaper to delete than to complete.
    assert all(SOUND.fullmatch(i) for i in initials.values()) and 204 not in initials and len(initials[206]) > 40


def test_damage_follows_the_checksum(spark):
    import zlib

    rows = [(conv, turn, None if turn == 5 else "assistant", None if turn == 6 else "One. Two! Three?", "x", "x") for conv in (None, 3) for turn in (None, *range(40))]
    got = damaged(spark.createDataFrame(rows, SCHEMA)).collect()
    want = []
    for conv, turn, role, text, *_ in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text, role = text or " ", role or " "
        if kind:
            row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            want += [row] * (2 if kind == 3 else 1)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert damaged(spark.createDataFrame(rows, SCHEMA).withColumn("copy", F.lit(1))).count() == len(want)
