"""Keyed draws of whole runs of slots, and bootstrap means that hash a draw once for all keys of one size."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from panelseq.functions.keyed import draw_hashes
from panelseq.operators import infer as I


def plain(seed, draw, n):
    return np.array([int(hashlib.md5(f"{seed}:{draw}:{i}".encode()).hexdigest()[:8], 16) for i in range(n)], np.int64)


@pytest.mark.parametrize("n", [1, 11, 511, 512, 12_345, 100_001])
@pytest.mark.parametrize("seed", [7, 20260905, 10**45])
def test_hashes(n, seed):
    draws = [0, 9, 10, 9999] if n < 1000 else [8, 12345]
    for draw, got in zip(draws, draw_hashes(seed, draws, n), strict=True):
        assert (got == plain(seed, draw, n)).all()


def test_a_draw_is_hashed_once_for_all_keys(monkeypatch):
    asked = []

    def counted(seed, draws, n):
        asked.extend(draws)
        return draw_hashes(seed, draws, n)

    monkeypatch.setattr(I, "draw_hashes", counted)
    values = {k: np.random.default_rng(i).normal(size=600) for i, k in enumerate("abc")}
    rows = [{"q": k, "n": 600, "block": 1, "idx": list(range(lo, lo + 300)), "value": list(v[lo: lo + 300])} for lo in (300, 0) for k, v in values.items()]
    out = I._block_means(7, 300, ["q"], {"value": "m"})(pa.Table.from_pylist(rows)).to_pylist()
    assert asked == list(range(250, 300)) and len(out) == 150
    for r in out[::17]:
        assert r["m"] == pytest.approx(values[r["q"]][plain(7, r["draw"], 600) % 600].mean(), abs=1e-12)


@pytest.mark.parametrize("most", [1 << 22, 100])
def test_means_of_columns_with_nulls(spark, monkeypatch, most):
    monkeypatch.setattr(I, "TASK_VALUES", most)
    rng = np.random.default_rng(5)
    rows = [(g, float(rng.normal()), float(rng.normal()) if g % 3 else None, None) for g in range(700)]
    df = spark.createDataFrame(rows, "group_id long, x double, y double, z double").repartition(3)
    got = {r.draw: r for r in I.bootstrap_means(df, ["x", "y", "z"], 40, 11).collect()}
    order = sorted(range(700), key=lambda g: hashlib.md5(str(g).encode()).hexdigest())
    assert sorted(got) == list(range(40))
    for draw, r in got.items():
        picked = [rows[order[i]] for i in plain(11, draw, 700) % 700]
        assert r.x == pytest.approx(np.mean([p[1] for p in picked]), abs=1e-12)
        assert r.y == pytest.approx(np.mean([p[2] for p in picked if p[2] is not None]), abs=1e-12)
        assert r.z is None
