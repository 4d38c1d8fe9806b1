"""Selections without one group, outer fits on the train part and feature sets of one Gram matrix, each against a plain computation."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelseq.operators import nested as N
from panelseq.operators import oof as O
from panelseq.operators import splits as SP


@pytest.fixture(scope="module", params=[7, 8, 1, 2])
def metrics(request):
    rng = np.random.default_rng(request.param)
    rows = []
    for g in range(request.param):
        for c in ("ema_1", "ema_2", "kalman_1", "kalman_2"):
            if (g, c) != (3, "ema_2"):
                lag = None if rng.random() < 0.3 else float(rng.integers(0, 3))
                rows.append((g, c, c.split("_")[0], float(rng.integers(10, 14)) / 10, lag, float(rng.integers(1, 5))))
    return rows


def test_outer_summaries(spark, metrics):
    df = spark.createDataFrame(metrics, "group_id long, candidate_id string, family string, rmse double, absolute_lag double, mafd double").repartition(3)
    table = pd.DataFrame(metrics, columns=["g", "c", "f", "rmse", "lag", "mafd"])
    got = {r.outer_group: r for r in N.outer_summaries(df).collect()}
    assert set(got) == set(table.g)
    for g, r in got.items():
        rest = table[table.g != g]
        assert r.development_rows == len(rest) and r.outer_rows_used == 0
        assert [c.candidate_id for c in r.candidates] == sorted(table.c.unique())
        for c in r.candidates:
            own = rest[rest.c == c.candidate_id]
            want = [own.rmse.mean(), own.rmse.std() / np.sqrt(len(own)) if len(own) else np.nan, own.lag.median(), own.mafd.median()]
            have = [c.mean_rmse, c.rmse_se, c.median_absolute_lag, c.median_mafd]
            assert np.allclose([np.nan if x is None else x for x in have], want, atol=1e-8, equal_nan=True), (g, c)


def test_outer_choices(spark, metrics):
    df = spark.createDataFrame(metrics, "group_id long, candidate_id string, family string, rmse double, absolute_lag double, mafd double")
    table = pd.DataFrame(metrics, columns=["g", "c", "f", "rmse", "lag", "mafd"])
    if table.g.nunique() < 3:
        pytest.skip("no deviation without three groups")
    for r in N.outer_choices(N.outer_summaries(df), 2, ("ema", "kalman"), "kalman_1", matched_family="ema").collect():
        rest = table[table.g != r.outer_group]
        s = rest.groupby(["f", "c"]).agg(m=("rmse", "mean"), sd=("rmse", "std"), n=("rmse", "size"), lag=("lag", "median"), mafd=("mafd", "median")).reset_index().round({"m": 9})
        s["se"] = (s.sd / np.sqrt(s.n)).round(9)
        best = s.sort_values(["m", "c"]).iloc[0]
        pool = s[s.m <= best.m + best.se]
        fast = pool.sort_values(["lag", "m", "c"]).iloc[0]
        rest_pool = pool[pool.c != fast.c].sort_values(["mafd", "m", "c"])
        assert (r.best_candidate, r.pool_size, r.fast_candidate, r.slow_candidate) == (best.c, len(pool), fast.c, rest_pool.iloc[0].c if len(rest_pool) else None)
        assert r.best_ema == s[s.f == "ema"].sort_values(["m", "lag", "mafd", "c"]).iloc[0].c
        ref = s[s.c == "kalman_1"].iloc[0]
        e = s[s.f == "ema"].assign(d=lambda x: (x.mafd - ref.mafd).abs().round(9)).sort_values(["d", "m", "c"]).iloc[0]
        assert r.median_mafd_match == e.c and r.median_mafd_within == (e.d <= 0.1 * max(abs(ref.mafd), 1e-12))


def test_ranks_over_many_equal_values(spark):
    rows = [(k % 3, float(k % 7), k) for k in range(500)] + [(0, None, 999)]
    df = spark.createDataFrame(rows, "u int, v double, id long")
    got = {(r.u, r.id): r.rank for r in N.value_rank(df, ["u"], "v", ["id"]).collect()}
    for u in range(3):
        order = sorted((v, i) for a, v, i in rows if a == u and v is not None)
        assert [got[u, i] for _, i in order] == list(range(len(order)))


def group_rows(spark, n_groups, p=2):
    rng = np.random.default_rng(n_groups)
    rows = []
    for g in range(n_groups):
        for t in range(int(rng.integers(1, 6))):
            x = rng.normal(size=p)
            rows.append((g, t, *map(float, x), float(x @ np.arange(1, p + 1) + rng.normal())))
    return rows, spark.createDataFrame(rows, "group_id long, time_index long, " + ", ".join(f"x{i} double" for i in range(p)) + ", target double")


def ridge(x, y, penalty):
    x = np.column_stack([np.ones(len(x)), x])
    d = penalty * np.eye(x.shape[1])
    d[0, 0] = 0
    return np.linalg.solve(x.T @ x + d, x.T @ y)


def draw(n, *key):
    return int(hashlib.md5(":".join(map(str, key)).encode()).hexdigest()[:8], 16) % n


@pytest.mark.parametrize("ranks", [256, 4])
def test_outer_models_see_the_train_part_only(spark, monkeypatch, ranks):
    monkeypatch.setattr(O, "RANKS", ranks)
    rows, df = group_rows(spark, 23)
    splits = SP.loso_splits(df, [1, 5], 0.2)
    table = splits.toPandas()
    sets = {"a": ["x0"], "ab": ["x0", "x1"]}
    got = {(r.seed, r.group_id, r.member, r.candidate_id): r.coef for r in O.outer_models(df, splits, ["x0", "x1"], 3, 0.5, candidates=sets).collect()}
    assert len(got) == 2 * 23 * 3 * 2
    data = pd.DataFrame(rows, columns=["g", "t", "x0", "x1", "y"])
    for seed, part in table.groupby("seed"):
        order = part.sort_values("rank").group_id.tolist()
        cutoff = int(part.cutoff.iloc[0])
        for test in order:
            others = [g for g in order if g != test]
            train = others[cutoff:]
            for m in range(3):
                sample = [train[draw(len(train), seed, "outer", m, j)] for j in range(len(train))]
                assert not set(sample) & {test, *others[:cutoff]}
                d = pd.concat([data[data.g == g] for g in sample])
                assert np.allclose(got[seed, test, m, "ab"], ridge(d[["x0", "x1"]].to_numpy(), d.y.to_numpy(), 0.5))
                one = ridge(d[["x0"]].to_numpy(), d.y.to_numpy(), 0.5)
                assert np.allclose(got[seed, test, m, "a"], [*one, 0.0])


def test_outer_models_without_a_train_part(spark):
    _, df = group_rows(spark, 2)
    assert O.outer_models(df, SP.loso_splits(df, [1], 0.2), ["x0"], 2, 0.5).count() == 0


def test_candidate_errors_of_wide_sets(spark):
    """Thirty features in three sets: errors from Gram matrices equal those of row by row predictions."""
    rows, df = group_rows(spark, 12, 30)
    names = [f"x{i}" for i in range(30)]
    sets = {"all": names, "even": names[::2], "one": names[7:8]}
    folds = SP.grouped_kfold(df.select("group_id").distinct(), [3], 4)
    models = {(r.fold, r.member): r for r in O.member_weights(folds, 4, 2).groupBy("fold", "member").agg(F.collect_list(F.struct("group_id", "weight")).alias("w")).collect()}
    got = {(r.group_id, r.candidate_id): r.rmse for r in O.oof_candidate_errors(df, folds, names, sets, 4, 2, 0.7).collect()}
    data = pd.DataFrame(rows, columns=["g", "t", *names, "y"])
    for f in folds.collect():
        own = data[data.g == f.group_id]
        for name, columns in sets.items():
            coef = []
            for m in range(2):
                d = pd.concat([data[data.g == w.group_id] for w in models[f.fold, m].w for _ in range(int(w.weight))])
                coef.append(ridge(d[columns].to_numpy(), d.y.to_numpy(), 0.7))
            c = np.mean(coef, 0)
            error = own.y - c[0] - own[columns].to_numpy() @ c[1:]
            assert np.isclose(got[f.group_id, name], np.sqrt((error**2).mean()), atol=1e-6)
