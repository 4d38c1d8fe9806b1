"""Updaters against plain loops, and chunked runs against whole ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelseq import SEQUENCE, TIME
from panelseq.operators import contracts as C
from panelseq.operators import metrics as M
from panelseq.operators import updaters as U

KEYS = [*SEQUENCE, TIME]


def sine(n=400):
    t = np.arange(n)
    fast = 0.4 + 0.17 * np.sin(t / 13) + 0.07 * np.cos(t / 5)
    fast[0] = 0.83
    return fast, 0.13 + 0.0004 * t


def panel(spark, sequences):
    parts = []
    for (g, s, r), (fast, slow) in sequences.items():
        parts.append(pd.DataFrame({
            "group_id": g, "seed": s, "recording_id": r, TIME: np.arange(len(fast)), "fast": fast, "slow": slow, "target": fast * 0.5 + 0.1}))
    df = pd.concat(parts, ignore_index=True).sample(frac=1, random_state=3)
    return spark.createDataFrame(df, "group_id long, seed int, recording_id int, time_index long, fast double, slow double, target double")


@pytest.fixture(scope="module")
def seqs():
    rng = np.random.default_rng(5)
    out = {(1, 42, 0): sine(), (1, 42, 1): sine(73)}
    for g in range(2, 5):
        n = int(rng.integers(1, 60))
        out[(g, 123, 0)] = (rng.random(n), rng.random(n))
    return out


def series(df, key, col="state"):
    rows = df.where((F.col("group_id") == key[0]) & (F.col("seed") == key[1]) & (F.col("recording_id") == key[2])).orderBy(TIME).select(col).collect()
    return np.array([r[0] for r in rows])


def loop_gain(fast, start, a):
    out, s = [], start
    for x in fast:
        s = min(1.0, max(0.0, a * x + (1 - a) * s))
        out.append(s)
    return np.array(out)


def loop_tracker(fast, slow, c=U.TrackerConfig()):
    out, alphas, s = [], [], slow[0]
    for i, x in enumerate(fast):
        h = fast[max(0, i - c.past_window):i]
        slope = cons = var = 0.0
        if len(h) > 1:
            slope = np.polyfit(np.arange(len(h)), h, 1)[0]
            d = np.diff(h)
            nz = np.sign(d[np.abs(d) > 1e-12])
            cons, var = (abs(nz.mean()) if len(nz) else 0.0), np.var(h)
        inn, gap = x - s, x - slow[i]
        agree = 0.5 if abs(slope) <= 1e-12 or abs(inn) <= 1e-12 else float(np.sign(slope) == np.sign(inn))
        qi, qd, qs, qv = (1 - np.exp(-v / k) for v, k in (
            (abs(inn), c.innovation_scale), (abs(gap), c.disagreement_scale), (abs(slope), c.slope_scale), (var, c.variance_scale)))
        sc = np.array([
            1.6 * qi + 1.2 * qd + 1.1 * (1 - cons) + 1.1 * (1 - agree) + 0.5 * qv - 0.4 * qs,
            1.5 * (1 - qi) + (1 - qd) + 0.8 * (1 - qs) + 0.8 * (1 - qv) + 0.3 * cons,
            1.4 * qi + 1.1 * qd + qs + cons + 1.2 * agree - 0.5 * qv]) / c.temperature
        p = np.exp(sc - sc.max())
        p /= p.sum()
        a = float(p @ [c.alpha_outlier, c.alpha_stable, c.alpha_transition])
        s = min(1.0, max(0.0, a * x + (1 - a) * s))
        out.append(s)
        alphas.append(a)
    return np.array(out), np.array(alphas)


def loop_kalman(fast, mean, p=U.KalmanParams()):
    out, cov, r = [], p.p0, p.r
    for i, x in enumerate(fast):
        prior = cov + p.q
        k = prior / (prior + r)
        e = x - mean
        mean, cov = mean + k * e, (1 - k) * prior
        if i + 1 > p.warmup_steps:
            r = min(p.r_max, max(p.r_min, 0.95 * r + 0.05 * min(1.0, max(-1.0, e)) ** 2))
        out.append(mean)
    return np.array(out)


def test_against_loops(spark, seqs):
    p = panel(spark, seqs)
    got = {
        "gain": U.constant_gain(p, 0.2), "ema": U.ema(p, 0.3), "tracker": U.change_aware(p), "kalman": U.kalman_adaptive(p)}
    for key, (fast, slow) in seqs.items():
        np.testing.assert_allclose(series(got["gain"], key), loop_gain(fast, slow[0], 0.2), atol=1e-12)
        np.testing.assert_allclose(series(got["ema"], key), loop_gain(fast, fast[0], 0.3), atol=1e-12)
        state, alpha = loop_tracker(fast, slow)
        np.testing.assert_allclose(series(got["tracker"], key), state, atol=1e-10)
        np.testing.assert_allclose(series(got["tracker"], key, "alpha"), alpha, atol=1e-10)
        np.testing.assert_allclose(series(got["kalman"], key), loop_kalman(fast, slow[0]), atol=1e-12)


@pytest.mark.parametrize("name", ["gain", "fixed", "tracker", "adaptive"])
def test_chunked_equals_whole(spark, seqs, name):
    """A sequence far longer than a chunk: two-level scan, or shooting with repair."""
    p = panel(spark, seqs)
    run = {
        "gain": lambda **k: U.constant_gain(p, 0.01, **k), "fixed": lambda **k: U.kalman_fixed(p, 1e-4, 1e-1, **k),
        "tracker": lambda **k: U.change_aware(p, warmup=16, **k), "adaptive": lambda **k: U.kalman_adaptive(p, warmup=16, **k)}[name]
    whole, parts = run(), run(chunk=16 if name in ("gain", "fixed") else 24)
    bad = C.align_frames(whole, parts, KEYS, ["state"], 1e-10)
    assert bad.count() == 0


def test_tracker_config_and_gain_guards(spark, seqs):
    with pytest.raises(ValueError):
        U.TrackerConfig(alpha_stable=0.9)
    with pytest.raises(ValueError):
        U.TrackerConfig(past_window=2)
    p = panel(spark, seqs).withColumn("alpha", F.lit(1.5))
    with pytest.raises(Exception, match="gain outside"):
        U.supplied_gain(p).collect()


def test_native_context_equals_kernel_context(spark, seqs):
    p = panel(spark, seqs)
    native = U.past_context(p, 10, chunk=32)
    full = U.change_aware(p)
    cols = ["past_slope", "past_consistency", "past_variance"]
    assert C.align_frames(native, full, KEYS, cols, 1e-9).count() == 0


def test_prefix_and_future_do_not_matter(spark, seqs):
    fast, slow = seqs[(1, 42, 0)]
    whole = U.change_aware(panel(spark, {(1, 42, 0): (fast, slow)}))
    for n in (1, 11, 73):
        part = U.change_aware(panel(spark, {(1, 42, 0): (fast[:n], slow[:n])}))
        np.testing.assert_array_equal(series(whole, (1, 42, 0))[:n], series(part, (1, 42, 0)))


def test_gain_grid_chunked(spark, seqs):
    p = panel(spark, seqs)
    gains = [i / 20 for i in range(21)]
    a = M.gain_grid_objective(p, gains, 400)
    b = M.gain_grid_objective(p, gains, 400, chunk=32)
    assert C.align_frames(a, b, ["group_id", "gain_index"], ["rmse"], 1e-9).count() == 0
    fast, slow = seqs[(2, 123, 0)]
    want = np.sqrt(np.mean((fast * 0.5 + 0.1 - loop_gain(fast, slow[0], 0.35)) ** 2))
    got = a.where("group_id = 2 and gain_index = 7").first()["rmse"]
    assert abs(got - want) < 1e-12
