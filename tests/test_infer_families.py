"""Normal quantiles as columns, and BCa intervals of many keys at once against a plain computation."""

import hashlib
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelseq.functions import normal
from panelseq.operators import infer as I


def test_normal_columns(spark):
    shares = [1e-8, 0.001, 0.02425, 0.1, 0.5, 0.9, 0.97575, 0.9999, 0.0, 1.0, None]
    rows = spark.createDataFrame([(p,) for p in shares], "p double").withColumn("x", normal.inverse(F.col("p"))).withColumn("back", normal.cdf(F.col("x"))).collect()
    for r in rows:
        if r.p is None or not 0 < r.p < 1:
            assert r.x is None
        else:
            assert abs(r.x - NormalDist().inv_cdf(r.p)) < 1e-8 and abs(r.back - r.p) < 1e-12
    far = spark.createDataFrame([(-8.0,), (9.0,)], "x double").select(normal.cdf(F.col("x")).alias("c")).collect()
    assert far[0].c == pytest.approx(NormalDist().cdf(-8), rel=1e-6) and far[1].c == 1.0


def plain(values, resamples, seed):
    """``values`` in index order."""
    n, v = len(values), np.array(values)
    hit = np.array([[int(hashlib.md5(f"{seed}:{b}:{i}".encode()).hexdigest()[:8], 16) % n for i in range(n)] for b in range(resamples)])
    means = np.sort(v[hit].mean(1))
    m = v.mean()
    accel = ((v - m) ** 3).sum() / (6 * ((v - m) ** 2).sum() ** 1.5)
    z = NormalDist()
    z0 = z.inv_cdf(np.where(np.abs(means - m) <= 1e-15, 0.5, means < m).mean())
    out = []
    for p in (0.025, 0.975):
        s = z0 + z.inv_cdf(p)
        out.append(np.quantile(means, z.cdf(z0 + s / (1 - accel * s))))
    return [m, *out, accel]


@pytest.mark.parametrize("most", [1 << 22, 12])
def test_families(spark, monkeypatch, most):
    """Keys of other sizes have their own draws; the joined way beyond the bound gives the same means."""
    monkeypatch.setattr(I, "TASK_VALUES", most)
    rng = np.random.default_rng(4)
    rows = [(k, g, float(rng.gamma(2))) for k, n in (("a", 9), ("b", 17), ("c", 5)) for g in range(n)] + [("flat", g, 2.0) for g in range(4)] + [("one", 0, 1.0), ("a", 99, None)]
    df = spark.createDataFrame(rows, "q string, group_id long, v double").repartition(3)
    got = {r.q: r for r in I.bca_family(df, ["q"], "v", 600, 7).collect()}
    for key in "abc":
        own = sorted(((g, v) for k, g, v in rows if k == key and v is not None), key=lambda x: (hashlib.md5(str(x[0]).encode()).hexdigest(), x[0]))
        v = [x for _, x in own]
        r = got[key]
        assert np.allclose([r.estimate, r.lower, r.upper, r.acceleration], plain(v, 600, 7), atol=1e-9) and r.n == len(v)
        without = [(sum(v) - x) / (len(v) - 1) for x in v]
        assert np.allclose([r.leave_out_low, r.leave_out_high, r.q1, r.median, r.q3], [min(without), max(without), *np.quantile(v, [0.25, 0.5, 0.75])])
    assert got["flat"].status == got["one"].status == "DEGENERATE" and got["flat"].lower is None
