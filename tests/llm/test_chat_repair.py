"""Repair plans against a search over all edits, and whole conversations against a plain walk."""

import hashlib
import random
import re

import pytest

from panelseq.llm import chat_repair as cr

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def cheapest(symbols):
    """The best (cost, edits) by trying every edit of every turn, states kept apart."""
    best = {0: (0, "")}

    def grow(costs):
        for _ in range(4):
            for q, (c, s) in list(costs.items()):
                if (c + 2, s + "I") < costs.get(cr.NEXT[q], (10**9, "")):
                    costs[cr.NEXT[q]] = (c + 2, s + "I")
        return costs

    for x in symbols:
        new = {}
        for q, (c, s) in grow(dict(best)).items():
            role, late = "sua-"[x // 3], x % 3
            options = [("D", 3, q)]
            if x != 2:
                options.append(("R", 2 + late, 3 if q == 2 else 2))
                to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role, q))
                if to:
                    options.append(("K", late, to))
            for letter, price, to in options:
                new[to] = min(new.get(to, (10**9, "")), (c + price, s + letter))
        best = new
    best = grow(best)
    return min(best[q] for q in (0, 3) if q in best)


def collapse(symbols):
    runs = []
    for x in symbols:
        if runs and runs[-1][0] == x:
            runs[-1] = (x, runs[-1][1] + 1)
        else:
            runs.append((x, 1))
    return runs


def test_plans_are_cheapest_and_least(monkeypatch):
    rng = random.Random(3)
    alphabet = [0, 1, 2, 3, 4, 6, 7, 9, 10]
    for held in (1024, 3):
        monkeypatch.setattr(cr, "HELD", held)
        machine = cr.Transitions()
        for _ in range(400):
            some = rng.sample(alphabet, rng.randint(1, 4))
            symbols = [rng.choice(some) for _ in range(rng.randint(0, 14))]
            assert machine.repair(collapse(symbols)) == cheapest(symbols), symbols


def test_long_runs():
    machine = cr.Transitions()
    runs = [(3, 5000), (6, 4097), (2, 3000), (4, 1)]
    symbols = [x for x, n in runs for _ in range(n)]
    assert machine.repair(runs) == cheapest(symbols)


def plain(rows):
    """The report of conversations by a walk over sorted rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        known = [r[0] for r in own if r[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        symbols, seen, counts = [], set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in own:
            solid = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            i = max("sua-".find(role[:1] or "-"), -1)
            symbols.append(2 if fault in ("blank", "duplicate") else 3 * (i if i >= 0 else 3) + (fault == "truncated"))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit = cheapest(symbols)
        lines, left = [], iter(own)
        for letter in audit:
            role, text = (None, "") if letter == "I" else next(left)[1:]
            if letter in "IR":
                role = "assistant" if lines and lines[-1].startswith("u") else "user"
            if letter != "D":
                lines.append(f"{role}:{text}")
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


ODD = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 1, "user", "Hi."), (1, 4, "assistant", "no stop"), (1, None, "user", " \t\n"),
    (1, None, None, "odd role."), (2, None, "tool", "x."), (2, None, "user", None), (None, 3, "assistant", "A?"), (None, 5, "user", "B!  \n"),
    (3, 7, "", ""), (4, -2, "user", "q " * 30000), (4, 2, "assistant", "é."), (5, 0, "assistant", "Hi."), (5, 1, "assistant", "Hi."), (5, 2, "assistant", "Ho."),
]


@pytest.mark.parametrize("parts", [1, 7])
def test_reports(spark, parts):
    """A long conversation is dealt over several tasks; the whole report stays as in one."""
    rng = random.Random(5)
    long = [(9, k // 2, rng.choice(["user", "user", "assistant", "system", "x"]), rng.choice(["a.", "b", f"t{k}.", "", "same?"])) for k in range(600)]
    rows = ODD + long
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        turns = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS place", "'x' AS audit").repartition(5)
        ids = spark.createDataFrame([*rows, (77, 0, None, None)], SCHEMA)
        got = {r[0]: tuple(r)[1:] for r in cr.repair_report(turns, ids).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    empty = hashlib.sha256().hexdigest()
    assert got == plain(rows) | {77: (0, 0, 0, 0, 0, 0, "", empty)}


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in (0, 1, None)] + [(None, None, None, None)]
    import zlib
    want = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            want += [(c, t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    got = [tuple(r) for r in cr.damage(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_edits_and_empty(spark):
    turns = spark.createDataFrame(ODD[:6], SCHEMA)
    edits = cr.repaired(turns, cr.repair_plans(turns)).collect()
    assert "".join(r.edit for r in edits) == plain(ODD[:6])[1][6]
    assert all((r.role is None) == (r.edit == "D") for r in edits) and [r.place for r in edits] == list(range(len(edits)))
    none = spark.createDataFrame([], SCHEMA)
    assert cr.repair_report(none, none).collect() == []
