"""Repairing the order of turns by aligning them with an alternating pattern of roles.

A sound dialogue reads ``(s?(ua)+)?`` in the initials of its roles: perhaps a system turn, then user and assistant by turns; or nothing. Blank turns and
turns whose role and text occurred before have to go. The others are kept, given another role (user or assistant), or deleted, and empty user or assistant turns are
inserted, at the least cost (``DELETE``, ``REROLE``, ``INSERT``; a truncated turn that stays costs ``TRUNCATED``). Among the cheapest ways the one whose
edits, written as initials in order, come first in ASCII wins.

Turns that have to go cost the same in every way and their D comes before any insertion, so they are set aside. What is left is cut
into stretches of ``STRETCH`` turns. For each pair of states of the pattern at its two ends a stretch is aligned (Wagner-Fischer) with every target that leads from
one to the other: for each feasible length the pattern's string of that length. Only diagonals are filled that can stay within the cheapest cost so far (Ukkonen), which
starts small and is doubled until an alignment fits. Ties between targets are settled by their backtraced audits.

Stretches compose: costs add up over the state between them, and as no stretch ends in an insertion, of two different audits of the same turns none is the
beginning of the other, so the order of audits is settled stretch by stretch too. Dialogues are cut at places of a stored, range-partitioned table, so one that holds a third of
all turns is spread over many tasks; one task then sees some 80 bytes for each ``PIECE`` turns of it. Digests and audits of a dialogue are read off its edits as a stream in order.

Defined cases: null roles and texts count as one space, so such a text is blank. An empty role has no initial and is never kept. Turns come in order of
number, null first; equal numbers by role, then by the SHA-256 of the text. Rows that repeat whole are turns of their own, the later ones duplicates. A null dialogue id is a
dialogue. Dialogues without a turn are not in the result; an empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import materialize
from .columns import NOT_SPACE

DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
STRETCH, PIECE = 32, 4096
SLOT_BITS = 33  # monotonically_increasing_id keeps the row's place in its partition in the low 33 bits
NEVER = 1 << 29

# States of the pattern: nothing yet, after the system turn, after an assistant turn, after a user turn.
START, SYSTEM, ANSWERED, ASKED = range(4)
STATES = range(4)
CLOSING = ["", "ua", "", "a"]  # insertions that complete the pattern from each state
AUDIT = str.maketrans("uaUA", "IIRR")  # a plan names the inserted (u, a) and the new (U, A) roles, an audit does not


def target(first: str, length: int) -> str:
    """The pattern's string of a length that begins with ``first``."""
    return ("s" + "ua" * length if first == "s" else "ua" * length if first == "u" else "au" * length)[:length]


def ends(first: str, start: int, length: int) -> int:
    """The state after such a string."""
    if not length:
        return start
    return {"s": SYSTEM, "u": ASKED, "a": ANSWERED}[target(first, length)[-1]]


def diagonal_bound(n: int, length: int, d: int) -> int:
    """Least cost of the insertions and deletions of a way over the diagonal d."""
    rest = length - n - d
    return INSERT * (max(d, 0) + max(rest, 0)) + DELETE * (max(-d, 0) + max(-rest, 0))


def alignment(turns: str, wanted: str, limit: int) -> tuple[int, str] | None:
    """Cost and plan of the cheapest way from turns to a target that costs ``limit`` at most and ends in a turn; of equal ones the least audit.

    ``turns`` has an initial for each turn, upper-case if it is truncated.
    """
    n, size = len(turns), len(wanted)
    if not n:
        return None if size else (0, "")
    if diagonal_bound(n, size, 0) > limit:
        return None
    band = [d for d in range(-n, size + 1) if diagonal_bound(n, size, d) <= limit]
    if not band:
        return None
    low, high = band[0], band[-1]
    cost = [[NEVER] * (size + 2) for _ in range(n + 1)]
    cost[n][size] = 0
    for i in range(n - 1, -1, -1):
        own, below, turn = cost[i], cost[i + 1], turns[i]
        kept = TRUNCATED if turn.isupper() else 0
        initial = turn.lower()
        for j in range(min(size, i + high), max(0, i + low) - 1, -1):
            best = below[j] + DELETE
            if j < size:
                symbol = wanted[j]
                if symbol != "s":
                    best = min(best, own[j + 1] + INSERT)
                if symbol == initial:
                    best = min(best, below[j + 1] + kept)
                elif symbol != "s":
                    best = min(best, below[j + 1] + REROLE + kept)
            own[j] = best
    if cost[0][0] > limit:
        return None
    plan, i, j = [], 0, 0
    while i < n:
        now, symbol = cost[i][j], wanted[j] if j < size else ""
        if now == cost[i + 1][j] + DELETE:
            plan.append("D")
            i += 1
        elif symbol and symbol != "s" and now == cost[i][j + 1] + INSERT:
            plan.append(symbol)
            j += 1
        else:
            plan.append("K" if symbol == turns[i].lower() else symbol.upper())
            i, j = i + 1, j + 1
    return cost[0][0], "".join(plan)


Ways = dict[tuple[int, int], tuple[int, str]]


def better(one: tuple[int, str] | None, other: tuple[int, str] | None) -> tuple[int, str] | None:
    """The cheaper of two ways; of equal ones the one with the least audit."""
    if one is None or other is None:
        return one or other
    return min(one, other, key=lambda way: (way[0], way[1].translate(AUDIT)))


@lru_cache(maxsize=1 << 15)
def stretch_ways(turns: str) -> Ways:
    """The best way between each two states over some turns."""
    n, ways = len(turns), {}
    most = (DELETE + INSERT + TRUNCATED) * (n + 2)
    for first, starts in (("u", (START, SYSTEM, ANSWERED)), ("a", (ASKED,)), ("s", (START,))):
        if first == "s" and "s" not in turns.lower():
            continue
        lengths: dict[int, list[int]] = {}
        for length in range(1 if first == "s" else 0, 2 * n + 2):
            # Without a symbol the state stays; such ways are told apart from those that come round to it.
            lengths.setdefault(ends(first, -1, length), []).append(length)
        for end, some in lengths.items():
            some.sort(key=lambda length: (abs(length - n), length))
            best, limit = None, DELETE
            while best is None and limit <= 2 * most:
                for length in some:
                    way = alignment(turns, target(first, length), limit if best is None else best[0])
                    best = better(best, way)
                limit *= 2
            if best is None:
                continue
            for start in starts:
                key = (start, start if end < 0 else end)
                ways[key] = better(ways.get(key), best)
    return ways


def composed(one: Ways, other: Ways) -> Ways:
    """The best ways over two stretches that follow each other."""
    out: Ways = {}
    for (p, r), (cost, plan) in one.items():
        for q in STATES:
            if (r, q) in other:
                more, then = other[r, q]
                out[p, q] = better(out.get((p, q)), (cost + more, plan + then))
    return out


def piece_ways(pattern: str) -> Ways:
    """The best ways over a pattern of turns in which ``.`` stands for one that has to go; such a turn gets its D in the plan at no cost."""
    turns = pattern.replace(".", "")
    ways: Ways = {(p, p): (0, "") for p in STATES}
    for begin in range(0, len(turns), STRETCH):
        step = stretch_ways(turns[begin : begin + STRETCH])
        ways = composed(ways, step) if begin else step
    if len(turns) == len(pattern):
        return ways
    return {key: (cost, with_gone(pattern, plan)) for key, (cost, plan) in ways.items()}


def with_gone(pattern: str, plan: str) -> str:
    out, at = [], 0
    for turn in pattern:
        if turn == ".":
            out.append("D")
            continue
        end = at
        while plan[end] in "ua":
            end += 1
        out.append(plan[at : end + 1])
        at = end + 1
    return "".join(out)


def summary(ways: Ways) -> bytes:
    """Costs between all states, and the order of the audits of the ways from each state."""
    costs, ranks = np.full((4, 4), NEVER, dtype="<i4"), np.zeros((4, 4), dtype="<i4")
    for p in STATES:
        own = sorted((ways[p, q][1].translate(AUDIT), q) for q in STATES if (p, q) in ways)
        for rank, (_, q) in enumerate(own):
            costs[p, q], ranks[p, q] = ways[p, q][0], rank
    return costs.tobytes() + ranks.tobytes()


def path(summaries: list[bytes]) -> list[int]:
    """States before, between and after the pieces of a dialogue on its best way."""
    both = [np.frombuffer(s, dtype="<i4").reshape(2, 4, 4).astype(np.int64) for s in summaries]
    left = [np.array([INSERT * len(c) for c in CLOSING], dtype=np.int64)]
    for costs, _ in reversed(both):
        left.append((costs + left[-1]).min(axis=1))
    left.reverse()
    states = [START]
    for k, (costs, ranks) in enumerate(both):
        p = states[-1]
        total = costs[p] + left[k + 1]
        states.append(min(STATES, key=lambda q: (total[q], ranks[p][q])))
    return states


def judged(turns: DataFrame, dialogue: str, number: str, role: str, text: str) -> DataFrame:
    """Distinct turns with ``copies``, ``sha`` and their ``fault``: blank, duplicate, truncated or null."""
    plain = turns.select(
        F.col(dialogue).alias("conv"),
        F.col(number).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
    )
    one = plain.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("sha", F.sha2("text", 256))
    spot = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("at"))
    firsts = one.groupBy(F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("sha").alias("_sha")).agg(F.min(spot).alias("_first"))
    match = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("sha") == F.col("_sha"))
    last = F.regexp_extract("text", rf"({NOT_SPACE})[\x20\x09-\x0D]*\z", 1)
    fault = (
        F.when(~F.col("text").rlike(NOT_SPACE), "blank").when(~F.col("_first")["at"].eqNullSafe(F.col("turn")), "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    )
    return one.join(firsts.hint("merge"), match).select("conv", "turn", "role", "text", "sha", "copies", fault.alias("fault"))


def edits(turns: DataFrame, dialogue: str = "conv_id", number: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The edits of every dialogue, one row each, in the order of ``part``, ``slot``, ``step`` within the dialogue.

    ``conv``, ``op`` (K, R, D or I), ``times`` (over 1 for deleted copies of a turn), ``role`` and ``text`` as they are after the edit (of a deleted turn, as
    they were), and of the turn itself ``turn``, ``initial`` of its role and ``fault``; null for insertions.
    """
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    code = F.when(F.col("fault").isin("blank", "duplicate"), ".").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    order = ["conv", "turn", "role", "sha"]
    rows = judged(turns, dialogue, number, role, text).withColumn("code", code)
    placed = rows.repartitionByRange(*[F.asc_nulls_first(c) for c in order]).sortWithinPartitions(*[F.asc_nulls_first(c) for c in order])
    placed = placed.drop("sha").withColumn("_spot", F.monotonically_increasing_id())
    placed = placed.select("*", F.shiftright("_spot", SLOT_BITS).alias("part"), F.col("_spot").bitwiseAND(F.lit((1 << SLOT_BITS) - 1)).alias("slot")).drop("_spot")
    stored = materialize(placed, "turns")

    codes = F.transform(F.sort_array(F.collect_list(F.struct("slot", "code"))), lambda c: c["code"])
    patterns = stored.groupBy("conv", "part", F.floor(F.col("slot") / PIECE).alias("piece")).agg(F.min("slot").alias("first"), F.array_join(codes, "").alias("pattern"))
    ways = materialize(patterns.select("conv", "part", "first", "pattern").mapInArrow(all_ways, ways_schema(stored.schema["conv"].dataType)), "ways")

    # Where the best way of a dialogue passes between its pieces; a piece is known by its part and first slot.
    pieces = F.sort_array(F.collect_list(F.struct("part", "first", "summary")))
    chosen = ways.groupBy("conv").agg(pieces.alias("pieces")).select(F.transform("pieces", lambda p: p["part"]).alias("parts"), F.transform("pieces", lambda p: p["first"]).alias("firsts"), F.transform("pieces", lambda p: p["summary"]).alias("summaries"))
    chosen = chosen.mapInArrow(all_paths, "part long, first long, before int, after int, last boolean")
    planned = ways.join(chosen.hint("merge"), ["part", "first"]).select("conv", "part", "first", F.get("plans", F.col("before") * 4 + F.col("after")).alias("plan"), "after", "last")
    tokens = planned.select("part", "first", F.posexplode(F.regexp_extract_all("plan", F.lit("[ua]*[KDUA]"), F.lit(0))).alias("at", "token"))
    tokens = tokens.select("part", (F.col("first") + F.col("at")).alias("slot"), "token")

    def named(letter: Column) -> Column:
        return F.when(letter == "u", "user").otherwise("assistant")

    def edit(step, op, times, new_role, new_text, turn, own, fault) -> Column:
        fields = {"step": step, "op": op, "times": times, "role": new_role, "text": new_text, "turn": turn, "initial": own, "fault": fault}
        types = ("int", "string", "long", "string", "string", "long", "string", "string")
        return F.struct(*[v.cast(t).alias(k) for (k, v), t in zip(fields.items(), types, strict=True)])

    none, one = F.lit(None), F.lit(1)

    def inserted(letter: Column, step: Column) -> Column:
        return edit(step, F.lit("I"), one, named(letter), F.lit(""), none, none, none)

    lead = F.filter(F.split(F.expr("substring(token, 1, length(token) - 1)"), ""), lambda c: c != "")
    act = F.substring("token", -1, 1)
    op = F.when(act.isin("U", "A"), "R").otherwise(act)
    new_role = F.when(act.isin("U", "A"), named(F.lower(act))).otherwise(F.col("role"))
    own = edit(F.length("token"), op, one, new_role, F.col("text"), F.col("turn"), initial, F.col("fault"))
    copy_fault = F.when(F.col("fault") == "blank", "blank").otherwise("duplicate")
    copies = F.when(F.col("copies") > 1, F.array(edit(F.length("token") + 1, F.lit("D"), F.col("copies") - 1, F.col("role"), F.col("text"), F.col("turn"), initial, copy_fault)))
    all_steps = F.concat(F.transform(lead, inserted), F.array(own), F.coalesce(copies, F.array().cast(f"array<{EDIT}>")))
    done = stored.join(tokens.hint("merge"), ["part", "slot"]).select("conv", "part", "slot", F.explode(all_steps).alias("e")).select("conv", "part", "slot", "e.*")
    closing = F.get(F.array(*[F.array(*[F.lit(c) for c in text]).cast("array<string>") for text in CLOSING]), F.col("after"))
    closed = planned.filter("last").select("conv", "part", F.lit(1 << SLOT_BITS).alias("slot"), F.explode(F.transform(closing, inserted)).alias("e")).select("conv", "part", "slot", "e.*")
    return done.unionByName(closed)


EDIT = "struct<step:int,op:string,times:bigint,role:string,text:string,turn:bigint,initial:string,fault:string>"


def ways_schema(conv: T.DataType) -> T.StructType:
    fields = [("conv", conv), ("part", T.LongType()), ("first", T.LongType()), ("summary", T.BinaryType()), ("plans", T.ArrayType(T.StringType()))]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def all_ways(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [piece_ways(p) for p in batch.column(3).to_pylist()]
        plans = [[w[p, q][1] if (p, q) in w else None for p in STATES for q in STATES] for w in found]
        columns = [*batch.columns[:3], pa.array([summary(w) for w in found], pa.binary()), pa.array(plans, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, ["conv", "part", "first", "summary", "plans"])


def all_paths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for parts, firsts, summaries in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            states = path(summaries)
            rows += zip(parts, firsts, states[:-1], states[1:], [False] * (len(parts) - 1) + [True], strict=True)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
        columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "first", "before", "after", "last"])


def repaired(turns: DataFrame, dialogue: str = "conv_id", number: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The turns of the repaired dialogues: ``conv``, the place (``part``, ``slot``, ``step``, in order), ``role``, ``text``."""
    return edits(turns, dialogue, number, role, text).filter("op != 'D'").select("conv", "part", "slot", "step", "role", "text")


class Reading:
    """What the edits of one dialogue, read in order, come to."""

    LEGAL = ("su", "ua", "au")

    def __init__(self, conv) -> None:
        self.conv, self.audit, self.hash, self.any = conv, [], hashlib.sha256(), False
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.cost = self.numbers = 0
        self.least = self.most = self.before = None

    def add(self, op: str, times: int, role: str, text: str, turn: int | None, initial: str | None, fault: str | None) -> None:
        self.audit.append(op * times)
        self.cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[op] * times
        if op != "D":
            self.hash.update((b"\n" if self.any else b"") + f"{role}:{text}".encode())
            self.any = True
            self.cost += TRUNCATED if fault == "truncated" else 0
        if initial is None:
            return
        if fault:
            self.counts[fault] += times
        for _ in range(min(times, 2)):
            # Copies of a turn follow it and each other.
            if self.before is not None and self.before + initial not in self.LEGAL:
                self.illegal += 1
            self.before = initial
        if times > 2:
            self.illegal += times - 2
        if turn is not None and turn != self.most:
            self.least = turn if self.least is None else self.least
            self.most = turn
            self.numbers += 1

    def row(self) -> tuple:
        gaps = self.most - self.least + 1 - self.numbers if self.numbers else 0
        return (self.conv, gaps, *self.counts.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


DIGEST = [(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", T.StringType()), ("repaired_sha256", T.StringType())]


def digests(done: DataFrame) -> DataFrame:
    """``conv``, faults, ``cost``, ``audit`` and the SHA-256 of the repaired ``role:text`` lines of each dialogue with edits.

    A dialogue is read as a stream in order: a task holds its audit, not its texts.
    """
    conv = done.schema["conv"].dataType
    kind = to_arrow_type(conv)
    schema = T.StructType([T.StructField("conv", conv), *[T.StructField(n, t) for n, t in DIGEST]])
    kinds = [kind, *[to_arrow_type(t) for _, t in DIGEST]]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], schema.names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reading = None
        for batch in batches:
            full = []
            for conv_id, *edit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if reading is None or reading.conv != conv_id:
                    if reading is not None:
                        full.append(reading.row())
                    reading = Reading(conv_id)
                reading.add(*edit)
            yield batch_of(full)
        if reading is not None:
            yield batch_of([reading.row()])

    columns = ["conv", "op", "times", "role", "text", "turn", "initial", "fault"]
    return done.repartition("conv").sortWithinPartitions("conv", "part", "slot", "step").select(*columns).mapInArrow(run, schema)
