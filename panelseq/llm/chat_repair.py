"""Repair of the turn structure of conversations by a run-length dynamic program.

Each turn becomes a symbol: its role's initial and its fault. Runs of equal symbols are collapsed before any
conversation is brought together, so what is gathered of a conversation are runs and not turns. A symbol has a min-plus
transition over the four states of the turn grammar ``(s?(ua)+)?``; a run is passed through cached binary powers of it,
from the end to the start, and the choices are then unrolled from the start, the least letter first. Texts stay apart:
they are streamed once behind their conversation's edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelseq.llm.common import narrow, shuffle_partitions
from panelseq.session import cut, ship

#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
STATES = 4
INF = 1 << 60
#: The state after an inserted or re-roled turn, and that turn's role.
NEXT = (2, 2, 3, 2)
NEXT_ROLE = ("user", "user", "assistant", "user")
#: The state after a kept turn by initial; a missing entry is not allowed.
KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
#: Cheapest way to an accepting state by insertions alone.
END = (0, 4, 2, 0)
#: A symbol is the initial's place here, three times, plus 0 for sound and 1 for truncated; GONE has to be deleted.
INITIALS = "sua-"
GONE = 2
#: Runs, and steps of a run, whose cost vectors are held at a time.
HELD = 1024
WHITE = " \t\n\x0b\x0c\r"


def edits_of(symbol: int) -> list[tuple[str, int, list[int | None]]]:
    """(letter, cost, next state by state) of what may happen to a turn, least letter first, insertions left out."""
    out = [("D", DELETE, list(range(STATES)))]
    if symbol != GONE:
        late = TRUNCATED * (symbol % 3)
        keep = KEEP.get(INITIALS[symbol // 3], {})
        out += [("K", late, [keep.get(q) for q in range(STATES)]), ("R", REROLE + late, list(NEXT))]
    return out


def times(a, b):
    """Min-plus product of two matrices."""
    return tuple(tuple(min(a[p][r] + b[r][q] for r in range(STATES)) for q in range(STATES)) for p in range(STATES))


def onto(m, v):
    """Costs before a step from the costs after it."""
    a, b, c, d = v
    return tuple(min(r[0] + a, r[1] + b, r[2] + c, r[3] + d) for r in m)


class Transitions:
    """Cached binary powers of each symbol's transition: insertions first, then one edit of the turn."""

    def __init__(self) -> None:
        inserts = [[INF] * STATES for _ in range(STATES)]
        for q in range(STATES):
            to, cost = q, 0
            for _ in range(STATES):
                inserts[q][to] = min(inserts[q][to], cost)
                to, cost = NEXT[to], cost + INSERT
        self.inserts, self.edits, self.powers = inserts, {}, {}

    def power(self, symbol: int, k: int):
        """The transition over 2**k turns."""
        if (symbol, k) not in self.powers:
            if k:
                half = self.power(symbol, k - 1)
                self.powers[symbol, k] = times(half, half)
            else:
                self.edits[symbol] = edits_of(symbol)
                one = [[INF] * STATES for _ in range(STATES)]
                for _, cost, to in self.edits[symbol]:
                    for q in range(STATES):
                        if to[q] is not None:
                            one[q][to[q]] = min(one[q][to[q]], cost)
                self.powers[symbol, 0] = times(self.inserts, one)
        return self.powers[symbol, k]

    def back(self, symbol: int, count: int, v):
        """The costs before a run of ``count`` turns."""
        k = 0
        while count:
            if count & 1:
                v = onto(self.power(symbol, k), v)
            count >>= 1
            k += 1
        return v

    def _unroll(self, symbol: int, count: int, v, state: int, audit: bytearray) -> int:
        """Append the letters of one run whose costs behind it are ``v``; the state after it."""
        for lo in range(0, count, HELD):
            n = min(HELD, count - lo)
            costs = [self.back(symbol, count - lo - n, v)]
            for _ in range(n):
                costs.append(onto(self.power(symbol, 0), costs[-1]))
            for k in range(n, 0, -1):
                here, after = costs[k], costs[k - 1]
                while True:
                    best = here[state]
                    fits = [(x, to[state]) for x, cost, to in self.edits[symbol] if to[state] is not None and cost + after[to[state]] == best]
                    more = NEXT[state]
                    if INSERT + here[more] == best:
                        fits.append(("I", more))
                    letter, state = min(fits)
                    audit += letter.encode()
                    if letter != "I":
                        break
        return state

    def repair(self, runs: list[tuple[int, int]]) -> tuple[int, str]:
        """(cost, edits) of the cheapest repair of runs of (symbol, count); ties go to the least string."""
        ends = [END]
        for hi in range(len(runs), 0, -HELD):
            v = ends[-1]
            for symbol, count in reversed(runs[max(0, hi - HELD): hi]):
                v = self.back(symbol, count, v)
            ends.append(v)
        state, audit, total = 0, bytearray(), ends[-1][0]
        first = len(runs) % HELD or HELD
        bounds = [0, *range(first, len(runs), HELD), len(runs)] if runs else [0]
        for lo, hi, v in zip(bounds, bounds[1:], ends[-2::-1], strict=False):
            behind = [v]
            for symbol, count in reversed(runs[lo + 1: hi]):
                behind.append(self.back(symbol, count, behind[-1]))
            for (symbol, count), after in zip(runs[lo:hi], reversed(behind), strict=True):
                state = self._unroll(symbol, count, after, state, audit)
        while state not in (0, 3):
            audit += b"I"
            state = NEXT[state]
        return total, audit.decode()


def _symbol(role: str, fault: int) -> int:
    i = INITIALS.find(role[0]) if role else 3
    return 3 * (i if i >= 0 else 3) + fault


def _legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


SORTED = ("known", "at", "role", "digest")
SEGMENT = pa.schema([
    *[("known", pa.int32()), ("at", pa.int64()), ("role", pa.string()), ("digest", pa.string())],
    *[("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64())],
    *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")],
    ("symbols", pa.binary()), ("counts", pa.list_(pa.int64()))])
PLAN = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _add(symbols: bytearray, counts: list[int], symbol: int, n: int) -> None:
    if n and symbols and symbols[-1] == symbol:
        counts[-1] += n
    elif n:
        symbols.append(symbol)
        counts.append(n)


def _rows(batches, columns) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in columns), strict=True)


def _batches(rows: Iterator[list], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[list] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _segment(conv, rows: Iterator[tuple]) -> list:
    """What one partition holds of a conversation: its runs, its counts and its ends."""
    symbols, counts = bytearray(), []
    start = low = high = None
    first = last = ""
    turns = blank = duplicate = truncated = illegal = 0
    for _, known, at, role, digest, fault, later, n in rows:
        if start is None:
            start, first = (known, at, role, digest), role[:1]
        else:
            illegal += not _legal(last, role[:1])
        illegal += 0 if _legal(role[:1], role[:1]) else n - 1
        last = role[:1]
        if known and at != high:
            turns, low, high = turns + 1, at if low is None else low, at
        if fault == GONE:
            blank += n
            _add(symbols, counts, GONE, n)
        elif later:
            duplicate += n
            _add(symbols, counts, GONE, n)
        else:
            truncated, duplicate = truncated + fault, duplicate + n - 1
            _add(symbols, counts, _symbol(role, fault), 1)
            _add(symbols, counts, GONE, n - 1)
    return [conv, *start, first, last, low, high, turns, blank, duplicate, truncated, illegal, bytes(symbols), counts]


def _segments(batches):
    """Turns in order in; one row for each conversation and partition out."""
    for b in batches:
        schema = pa.schema([("conv_id", b.schema.field("conv_id").type), *SEGMENT])
        every = groupby(_rows(_again(b, batches), ("conv_id", *SORTED, "fault", "later", "n")), key=lambda r: r[0])
        yield from _batches((_segment(conv, rows) for conv, rows in every), schema)


def _again(first, rest) -> Iterator:
    yield first
    yield from rest


def _whole(machine: Transitions, conv, segments: Iterator[tuple]) -> list:
    """The plan of a conversation from its segments in order."""
    runs: list[tuple[int, int]] = []
    low = high = last = None
    turns = blank = duplicate = truncated = illegal = 0
    for _, head, tail, lo, hi, t, b, d, late, bad, symbols, counts in segments:
        if last is not None:
            illegal += not _legal(last, head)
        last = tail
        turns += t - (lo is not None and lo == high)
        low, high = lo if low is None else low, high if hi is None else hi
        blank, duplicate, truncated, illegal = blank + b, duplicate + d, truncated + late, illegal + bad
        runs += zip(symbols, counts, strict=True)
    cost, audit = machine.repair(runs)
    return [conv, 0 if low is None else high - low + 1 - turns, blank, duplicate, truncated, illegal, cost, audit]


def _plans(batches):
    machine = Transitions()
    columns = ("conv_id", "first", "last", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "symbols", "counts")
    for b in batches:
        schema = pa.schema([("conv_id", b.schema.field("conv_id").type), *[(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in PLAN.split(", ")]])
        every = groupby(_rows(_again(b, batches), columns), key=lambda r: r[0])
        yield from _batches((_whole(machine, conv, rows) for conv, rows in every), schema)


def _edited(rows: Iterator[tuple]) -> Iterator[list]:
    """One row for each edit of a conversation; its audit comes first and then its turns in order."""
    conv, _, audit, *_ = next(rows)
    state = 0
    for place, letter in enumerate(audit):
        role = text = None
        if letter == "I":
            role, text, state = NEXT_ROLE[state], "", NEXT[state]
        else:
            _, _, _, role, text = next(rows)
            if letter == "D":
                role = text = None
            elif letter == "R":
                role, state = NEXT_ROLE[state], NEXT[state]
            else:
                state = KEEP[role[0]][state]
        yield [conv, place, letter, role, text]
    if next(rows, None) is not None:
        raise ValueError(f"conversation {conv}: more turns than edits")


def _rewrite(batches):
    for b in batches:
        schema = pa.schema([("conv_id", b.schema.field("conv_id").type), ("place", pa.int64()), *[(c, pa.string()) for c in ("edit", "role", "text")]])
        every = groupby(_rows(_again(b, batches), ("conv_id", "turned", "audit", "role", "text")), key=lambda r: r[0])
        yield from _batches((e for _, rows in every for e in _edited(rows)), schema)


def _digest(batches):
    """Edits in order in; (conv_id, repaired_sha256) out. A text is hashed and forgotten."""
    def made(rows):
        for conv, edits in groupby(rows, key=lambda r: r[0]):
            total, between = hashlib.sha256(), ""
            for _, role, text in edits:
                if role is not None:
                    total.update(f"{between}{role}:{text}".encode())
                    between = "\n"
            yield [conv, total.hexdigest()]

    for b in batches:
        schema = pa.schema([("conv_id", b.schema.field("conv_id").type), ("repaired_sha256", pa.string())])
        yield from _batches(made(_rows(_again(b, batches), ("conv_id", "role", "text"))), schema)


def _turns(turns: DataFrame) -> DataFrame:
    """The four columns with nulls of role and text as one space, and the sort key of a turn."""
    rows = narrow(turns, "conv_id", "turn", "role", "text")
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return rows.select(
        "conv_id", F.col("turn").isNotNull().cast("int").alias("known"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("at"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), text.alias("text"), F.sha2(text, 256).alias("digest"))


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` with planted faults, chosen by the CRC-32 of ``conv_id:turn`` (nulls: one space) modulo 20.

    0 drops the turn, 1 empties its text, 2 takes its stops out, 3 repeats it, 4 makes it a user's.
    """
    rows = narrow(turns, "conv_id", "turn", "role", "text")

    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = rows.withColumn("kind", kind).where("kind <> 0").withColumn("copy", F.explode(F.expr("sequence(0, if(kind = 3, 1, 0))")))
    words = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(text("role")).alias("role"), words.alias("text"))


def repair_plans(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), one row for each conversation.

    Turns are ordered by turn (null first), then by role and digest of the text, so repeated rows are neighbours. The
    first fault of a turn counts: blank, seen earlier with the same role and text, or not ended by a stop. ``audit`` holds the initials
    of the cheapest Keep, Rerole, Delete and Insert edits in order; of equally cheap ones it is the least string. Empty roles and
    roles of other initials than s, u and a have to be re-roled or deleted. A null conv_id is a conversation; an
    empty table gives no rows; long texts are read for their digest and last characters only. Equal turns are counted before they
    are shuffled and turns are dealt by ranges of conversation and turn, so a conversation may span any
    number of tasks until only its runs are left. Turns have to be integers, or null.
    """
    spark = turns.sparkSession
    ship(spark)
    kind = turns.schema["conv_id"].dataType.simpleString()
    solid = F.rtrim("text", F.lit(WHITE))
    fault = F.when(solid == "", GONE).when(F.right(solid, F.lit(1)).isin(".", "!", "?"), 0).otherwise(1)
    rows = cut(_turns(turns).withColumn("fault", fault).groupBy("conv_id", *SORTED, "fault").agg(F.count("*").alias("n")))
    place = F.struct("known", "at")
    seen = rows.groupBy("conv_id", "role", "digest").agg(F.min(place).alias("seen")).select(
        F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "seen")
    same = rows["conv_id"].eqNullSafe(seen["c"]) & (rows["role"] == seen["r"]) & (rows["digest"] == seen["d"])
    marked = cut(rows.join(seen, same).withColumn("later", place > F.col("seen")).drop("c", "r", "d", "seen"))
    parts = shuffle_partitions(spark)
    order = ["conv_id", *SORTED]
    fields = ", ".join(f"{f.name} {_spark_type(f.type)}" for f in SEGMENT)
    segments = marked.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_segments, f"conv_id {kind}, {fields}")
    return cut(segments.repartition(parts, "conv_id").sortWithinPartitions(*order).mapInArrow(_plans, f"conv_id {kind}, {PLAN}"))


def _spark_type(t: pa.DataType) -> str:
    return {pa.int32(): "int", pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}.get(t, "array<bigint>")


def repaired(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text), one row for each edit; deleted turns have no role and text.

    The rows of a conversation are neighbours and in order. Its texts are not held: its edits come first in the sort, and each turn is passed on
    as its edit says.
    """
    ship(turns.sparkSession)
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = _turns(turns)
    own = rows.select("conv_id", F.lit(1).alias("turned"), *SORTED, "text", F.lit(None).cast("string").alias("audit"))
    first = plans.select(
        "conv_id", F.lit(0).alias("turned"), F.lit(0).alias("known"), F.lit(0).cast("long").alias("at"), F.lit("").alias("role"), F.lit("").alias("digest"),
        F.lit(None).cast("string").alias("text"), "audit")
    both = own.unionByName(first).repartition(shuffle_partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turned", *SORTED)
    return both.mapInArrow(_rewrite, f"conv_id {kind}, place bigint, edit string, role string, text string")


def repair_report(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The plan of every conversation of ``conversations`` and ``repaired_sha256`` of its repaired ``role:text`` lines.

    A conversation without turns has zeros, no edits and the digest of nothing. The digest is sequential by nature, so the
    texts of one conversation pass through one task, one batch at a time.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    plans = repair_plans(turns)
    digests = repaired(turns, plans).mapInArrow(_digest, f"conv_id {kind}, repaired_sha256 string")
    ids = narrow(conversations, "conv_id").distinct()
    p, d = plans.withColumnRenamed("conv_id", "p"), digests.withColumnRenamed("conv_id", "d")
    out = ids.join(p, ids["conv_id"].eqNullSafe(p["p"]), "left").join(d, ids["conv_id"].eqNullSafe(d["d"]), "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
