"""Windows, indices and quantiles that never hold a whole group in one task."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelseq.operators import blocks as B
from panelseq.operators import features as X
from panelseq.operators import infer as I
from panelseq.operators import splits as S


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    n = np.array([700, 5, 12, 1])
    df = pd.concat([pd.DataFrame({"k": i, "time_index": np.arange(m), "v": rng.normal(size=m).round(2)}) for i, m in enumerate(n)])
    return spark.createDataFrame(df, "k long, time_index long, v double")


@pytest.mark.parametrize("chunk", [41, 4096])
def test_halo_windows_equal_plain_windows(spark, skewed, chunk):
    a = X.rolling_stats(skewed, ["v"], keys=["k"], chunk=chunk)
    a = X.temporal_pattern(a, "v", keys=["k"], chunk=chunk)
    a = X.differences(a, "v", keys=["k"], chunk=chunk)
    w = Window.partitionBy("k").orderBy("time_index")
    for k in X.WINDOWS:
        a = a.withColumn(f"e{k}", F.abs(F.col(f"v_w{k}_std") - F.stddev_pop("v").over(w.rowsBetween(-(k - 1), 0))))
    got = a.toPandas()
    assert len(got) == 718 and got[[f"e{k}" for k in X.WINDOWS]].max().max() < 1e-9
    one = got[got.k == 0].sort_values("time_index")
    v = one.v.to_numpy()
    for t in (0, 1, 2, 40, 41, 699):
        h = v[max(0, t - 9): t + 1]
        want = 0.0 if len(h) < 3 else np.corrcoef(h[:-1], h[1:])[0, 1]
        assert abs(one.v_w10_autocorrelation.to_numpy()[t] - want) < 1e-9
        trend = abs(np.mean(np.sign(np.diff(h)))) if len(h) > 1 else 0.0
        assert abs(one.v_w10_trend_consistency.to_numpy()[t] - trend) < 1e-12
    np.testing.assert_allclose(one.v_d1, np.diff(v, prepend=v[:1]))
    first = np.diff(v, prepend=v[:1])
    np.testing.assert_allclose(one.v_d2, np.diff(first, prepend=first[:1]))


def test_exact_quantiles_small_and_large_path(spark, skewed):
    probs, names = [0.05, 0.5, 0.95], ["a", "b", "c"]
    plain = B.exact_quantiles(skewed, ["k"], "v", probs, names).toPandas().set_index("k").sort_index()
    large = B.exact_quantiles(skewed, ["k"], "v", probs, names, small=3, splits=16).toPandas().set_index("k").sort_index()
    raw = skewed.toPandas()
    for k, rows in raw.groupby("k"):
        np.testing.assert_allclose(plain.loc[k, names].to_numpy(float), np.quantile(rows.v, probs), atol=1e-12)
        np.testing.assert_allclose(large.loc[k, names].to_numpy(float), np.quantile(rows.v, probs), atol=1e-12)
    assert abs(B.exact_quantiles(skewed, [], "v", [0.5], ["m"], small=10).first()["m"] - raw.v.median()) < 1e-12


def test_dense_index(spark, skewed):
    d = B.dense_index(skewed.drop("time_index").withColumn("o", F.monotonically_increasing_id()), ["k"], F.expr("o div 1000000"), ["o"])
    top = d.groupBy("k").agg(F.max("time_index").alias("m"), F.count_distinct("time_index").alias("n")).toPandas()
    assert (top.m + 1 == top.n).all()


def test_units_are_never_split(spark, skewed):
    def kernel(table, starts):
        n = np.diff(np.append(starts, table.num_rows))
        return B.extend(table.take(starts), ["k"], {"rows": n.astype(np.int64)})

    got = B.map_units(skewed, ["k"], ["time_index"], kernel, "k long, rows long", flush_rows=7).toPandas().sort_values("k")
    assert list(got.rows) == [700, 5, 12, 1]


def test_balanced_folds_match_greedy(spark):
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 9, 60)
    df = spark.createDataFrame(pd.DataFrame({"group_id": np.repeat(np.arange(60), sizes)}))
    got = S.balanced_group_folds(df, 4).toPandas()
    assert sorted(got.group_id) == list(range(60))
    loads = [0] * 4
    for s in sorted(sizes, reverse=True):
        loads[int(np.argmin(loads))] += int(s)
    assert sorted(got.groupby("fold").rows.sum()) == sorted(loads)


def test_bca_against_plain_computation(spark):
    from statistics import NormalDist

    rng = np.random.default_rng(4)
    v = rng.gamma(2.0, size=21)
    df = spark.createDataFrame(pd.DataFrame({"group_id": np.arange(21), "x": v, "flat": 1.0}))
    row = {r.quantity: r for r in I.bca_mean(df, ["x", "flat"], resamples=3000).collect()}
    means = np.sort(I.bootstrap_means(df, ["x"], 3000).toPandas().x.to_numpy())
    z = NormalDist()
    z0 = z.inv_cdf((np.sum(means < v.mean()) + 0.5 * np.sum(means == v.mean())) / len(means))
    jack = (v.sum() - v) / 20
    d = jack.mean() - jack
    acc = (d**3).sum() / (6 * (d**2).sum() ** 1.5)
    want = []
    for p in (0.025, 0.975):
        s = z0 + z.inv_cdf(p)
        want.append(np.quantile(means, z.cdf(z0 + s / (1 - acc * s))))
    assert abs(row["x"].lower - want[0]) < 1e-9 and abs(row["x"].upper - want[1]) < 1e-9
    assert row["x"].lower < v.mean() < row["x"].upper
    assert row["flat"].status == "DEGENERATE" and row["flat"].lower is None


@pytest.mark.parametrize("n", [1, 2, 6, 15])
def test_sign_flip_exact_equals_all_patterns(spark, n):
    v = np.array([0.3, -0.1, 0.4, 0.2, -0.05, 0.0, 0.7, 0.11, -0.35, 0.09, 0.31, 0.02, -0.08, 0.5, 0.25])[:n]
    df = spark.createDataFrame(pd.DataFrame({"group_id": np.arange(n), "x": v, "y": v[::-1].copy(), "z": np.zeros(n)}))
    got = {r.comparison_id: r for r in I.sign_flip(df, ["x", "y", "z"]).collect()}
    signs = np.array(np.meshgrid(*[[1, -1]] * n)).reshape(n, -1)
    want = np.sum(np.abs((signs * v[:, None]).mean(axis=0)) >= abs(v.mean()) - 7.1e-15)
    assert [(got[c].method, got[c].total, got[c].extreme) for c in "xyz"] == [("exact", 2**n, want), ("exact", 2**n, want), ("exact", 2**n, 2**n)]


def test_sign_flip_names_its_method(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame(pd.DataFrame({"group_id": np.arange(26), "x": rng.normal(0.2, 1.0, 26)}))
    exact = I.sign_flip(df, ["x"]).first()
    drawn = I.sign_flip(df, ["x"], method="sampled", sampled=20_000).first()
    assert (exact.method, exact.total) == ("exact", 2**26) and (drawn.method, drawn.total) == ("sampled", 20_001)
    assert abs(exact.p - drawn.p) < 0.02
    again = I.sign_flip(df.repartition(3), ["x"], method="sampled", sampled=20_000).first()
    assert again.extreme == drawn.extreme
    many = spark.createDataFrame(pd.DataFrame({"group_id": np.arange(60), "x": np.linspace(-1, 1.1, 60)}))
    with pytest.raises(ValueError, match="sampled"):
        I.sign_flip(many, ["x"])
    with pytest.raises(ValueError, match="method"):
        I.sign_flip(df, ["x"], method="auto")
