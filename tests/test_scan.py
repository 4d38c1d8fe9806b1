"""Ranks and running values over ranges, and Holm adjustment of families of any size."""

import random

import pytest
from pyspark.sql import functions as F

from panelseq.operators import infer as I
from panelseq.operators import scan


def table(n, seed=5):
    """One family has most of the rows, one has no name; values repeat and some are null."""
    draw = random.Random(seed)
    fams = ["hot"] * 6 + ["a", "b", None, None]
    return [(draw.choice(fams), i, draw.choice([None, 0.0, 1.0, draw.random(), draw.random() ** 8])) for i in range(n)]


def plain_holm(rows):
    out = {}
    for fam in {f for f, _, _ in rows}:
        tested = sorted((p, i) for f, i, p in rows if f == fam and p is not None)
        top = 0.0
        for k, (p, i) in enumerate(tested):
            top = max(top, min(1.0, (len(tested) - k) * p))
            out[i] = top
        out |= {i: None for f, i, p in rows if f == fam and p is None}
    return out


@pytest.mark.parametrize("n", [0, 400])
def test_holm_families(spark, n):
    rows = table(n)
    df = spark.createDataFrame(rows, "fam string, comparison_id long, p double")
    for by, of in ((["fam"], rows), ([], [(None, i, p) for _, i, p in rows])):
        got = {r.comparison_id: r.holm_p for r in I.holm(df, by, ranges=7).collect()}
        want = plain_holm(of)
        assert got.keys() == want.keys()
        assert all((got[i] is None) == (want[i] is None) and (got[i] is None or got[i] == pytest.approx(want[i], abs=1e-12)) for i in want)


def test_holm_keeps_columns_and_ties(spark):
    df = spark.createDataFrame([("x", 0.01, "one"), ("y", 0.01, "two"), ("x", 0.01, "one"), ("z", None, "three")], "comparison_id string, p double, total string")
    rows = I.holm(df, ranges=3).collect()
    assert sorted(rows[0].asDict()) == ["comparison_id", "holm_p", "p", "total"] and len(rows) == 4
    assert sorted(str(r.holm_p) for r in rows) == ["0.03", "0.03", "0.03", "None"]


@pytest.mark.parametrize("kind", ["max", "min", "sum"])
def test_running_values(spark, kind):
    rows = table(300, 9)
    df = scan.ranged(spark.createDataFrame(rows, "fam string, i long, v double"), ["fam"], ["i"], 7)
    assert df.select("_range").distinct().count() > 1
    got = {r.i: (r["rank"], r.total, r.running) for r in scan.running(scan.ranks(df, ["fam"], ["i"]), ["fam"], ["i"], F.col("v"), kind).collect()}
    whole = {"max": max, "min": min, "sum": sum}[kind]
    for fam in {f for f, _, _ in rows}:
        mine = [(i, v) for f, i, v in rows if f == fam]
        for k, (i, _) in enumerate(mine):
            seen = [v for _, v in mine[: k + 1] if v is not None]
            want = whole(seen) if seen else None
            assert got[i][:2] == (k + 1, len(mine))
            assert got[i][2] == (pytest.approx(want) if want is not None else None)


def test_one_range_of_a_hot_family_is_a_part(spark):
    df = scan.ranged(spark.range(20_000).select(F.lit("hot").alias("fam"), "id"), ["fam"], ["id"], 7)
    most = df.groupBy("_range").count().agg(F.max("count")).first()[0]
    assert most < 20_000 / 2
