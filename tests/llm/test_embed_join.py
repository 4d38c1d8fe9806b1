"""Embedding links against all pairs."""

import math

import numpy as np
import pytest

from panelseq.llm import embed_join as E

SCHEMA = "vec_id long, embedding array<float>, label int, n_links int, cell string"


def plain(rows):
    vec = []
    for i, v, label in rows:
        ok = i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.array(v, np.float32).astype(float) if ok else None
        vec.append((i, label, x / np.linalg.norm(x) if ok else None))
    n = len(vec)
    link = [[b for b in range(n) if a != b and vec[a][2] is not None and vec[b][2] is not None and vec[a][1] == vec[b][1]
             and len(vec[a][2]) == len(vec[b][2]) and vec[a][2] @ vec[b][2] >= 0.98] for a in range(n)]
    out = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            for b in link[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        low = min((vec[b][0] for b in seen if vec[b][0] is not None), default=None)
        out.append((vec[a][0], len(link[a]), low, True if low is None else vec[a][0] == low))
    return sorted(out, key=str)


@pytest.mark.parametrize(("per_pivot", "cell_rows"), [(4096, 2048), (10, 5)])
def test_equals_all_pairs(spark, per_pivot, cell_rows, monkeypatch):
    monkeypatch.setattr(E, "ROWS_PER_PIVOT", per_pivot)
    monkeypatch.setattr(E, "CELL_ROWS", cell_rows)
    rng = np.random.default_rng(2)
    rows = []
    for k in range(240):
        base = np.random.default_rng(k % 24).normal(size=8)
        v = base + rng.normal(size=8) * rng.choice([0.0, 0.05, 0.12, 1.0])
        rows.append((k, v.astype(np.float32).tolist(), int(k % 3)))
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 8, 1), (303, [1.0, None], 1), (304, [float("nan"), 1.0], 1), (305, [float("inf"), 1.0], 1),
             (306, rows[0][1], None), (307, rows[0][1][:4], 0), (308, [2 * x for x in rows[0][1]], 0), (None, rows[0][1], 0), (5, rows[5][1], 2), (309, [-0.0, 1.0], 0), (310, [0.0, 1.0], 0)]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], SCHEMA).repartition(4)
    got = sorted((tuple(r) for r in E.embedding_links(df).collect()), key=str)
    assert got == plain(rows)
    assert E.embedding_links(df.limit(0)).count() == 0
