"""Contracts on broken fixtures; labels and algebra on published aggregate numbers."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelseq.operators import claims as Q
from panelseq.operators import contracts as C
from panelseq.operators import oof as O
from panelseq.operators import perturb as T
from panelseq.operators import reduce as R
from panelseq.operators import splits as S


def rules(df):
    return sorted((r.rule_id, r.key) for r in df.collect())


def test_index_key_and_domain_rules(spark):
    df = spark.createDataFrame(
        [(1, 0, 0.1), (1, 1, 0.2), (1, 3, 0.3), (2, 0, 0.5), (2, 0, 1.5), (3, 0, float("nan"))], "g int, time_index long, v double")
    assert [k for _, k in rules(C.check_contiguous(df, ["g"]))] == ["1", "2"]
    assert C.first_gap(df, ["g"]).collect()[0].first_gap == 3
    assert rules(C.check_unique(df, ["g", "time_index"])) == [("unique_key", "2|0")]
    assert C.check_domain(df, ["v"]).first().detail == "2"
    with pytest.raises(C.ContractError):
        C.assert_empty(C.check_unique(df, ["g"]))
    C.assert_empty(C.check_unique(df.where("g = 3"), ["g"]))
    with pytest.raises(C.ContractError):
        C.require_target_free(df)
    with pytest.raises(Exception, match="not finite"):
        C.handle_nonfinite(df, ["v"]).collect()


def test_ledger_with_one_missing_branch(spark):
    dims = {"seed": [1, 2], "sign": [-1, 1]}
    rows = [(1, 0, 20, s, g) for s in (1, 2) for g in (-1, 1)] + [(1, 0, 21, s, g) for s in (1, 2) for g in (-1, 1)][:-1] + [(9, 0, 5, 1, 1)]
    led = spark.createDataFrame(rows, "group_id long, recording_id int, t0 long, seed int, sign int")
    roots = spark.createDataFrame([(1, 0, 20), (1, 0, 21), (1, 0, 22)], "group_id long, recording_id int, t0 long")
    assert rules(C.validate_ledger(led, roots, dims)) == [
        ("extra_root", "9|0|5"), ("incomplete_root", "1|0|21"), ("missing_root", "1|0|22")]


def test_overlapping_split(spark):
    df = spark.createDataFrame(
        [(1, 0, 7, "train"), (1, 0, 7, "validation"), (1, 1, 7, "train"), (1, 0, 8, "train"), (1, 1, 8, "validation")], "seed int, fold int, group_id int, role string")
    assert rules(C.check_splits(df)) == [("overlapping_roles", "1|0|7")]


def test_kfold_covers_each_group_once(spark):
    groups = spark.range(23).withColumnRenamed("id", "group_id")
    folds = S.grouped_kfold(groups, [1, 2], 5)
    sizes = folds.groupBy("seed", "fold").count().toPandas()
    assert sorted(sizes[sizes.seed == 1]["count"]) == [4, 4, 5, 5, 5]
    assert C.check_splits(S.fold_roles(folds, 5)).count() == 0
    roles = S.loso_roles(S.loso_splits(groups, [1], 0.2), [3, 4]).groupBy("test_group", "role").count().toPandas()
    assert set(roles[roles.role == "validation"]["count"]) == {4} and set(roles[roles.role == "test"]["count"]) == {1}


# Published aggregate values used as fixed inputs: (view, T, S, C0 T, C0 S, Theta).
VIEWS = (
    ("fixed_amplitude", 1.484708802702293, 22.288401822083298, 0.99999999999999978, 20.0, 1.8036930193810075),
    ("dose_normalized", 1.484708802702293, 1.1144200911041651, 0.99999999999999978, 1.0, -0.3702887115981281),
    ("equal_total_dose", 1.484708802702293, 1.2613919431318965, 0.99999999999999978, 0.9999999999999919, -0.22331685957038866))


def test_theta_identities_on_published_cells(spark):
    rows = []
    for view, t, s, ct, cs, _ in VIEWS:
        rows += [(view, 1, "Full", "transient", t), (view, 1, "Full", "sustained", s), (view, 1, "C0", "transient", ct), (view, 1, "C0", "sustained", cs)]
    cells = spark.createDataFrame(rows, "view string, group_id int, controller string, shape string, A double")
    got = {r["view"]: r for r in R.theta(cells).collect()}
    for view, *_, want in VIEWS:
        assert abs(got[view].Theta - want) < 1e-9 and abs(got[view].Theta - got[view].Theta_from_method) < 1e-12
    diff = Q.construction_difference(R.theta(cells))
    assert abs(diff.first().delta + 2.0270098789513962) < 1e-9
    assert all(r.max_abs_error < 1e-9 for r in Q.identity_errors(diff).collect())


def test_labels(spark):
    df = spark.createDataFrame([
        (9.9e-05, "includes_zero", 1, -5.6e-05, "includes_zero", -1, "includes_zero"), (-0.00036, "negative", -1, -0.0001, "negative", -1, "positive"),
        (1.0, "positive", 1, 2.0, "positive", 1, "includes_zero")],
        "d0_mean double, d0_support string, d0_polarity int, dm_mean double, dm_support string, dm_polarity int, k_support string")
    assert [r.classification for r in Q.classify_construction(df).collect()] == ["construction-sensitive", "magnitude-sensitive", "construction-robust"]
    m = spark.createDataFrame([(21, 0, 0), (0, 21, 0), (11, 10, 0), (2, 2, 17)], "positive_groups int, negative_groups int, zero_groups int")
    assert [r.majority for r in Q.majority(m).collect()] == ["ALL_POSITIVE", "ALL_NEGATIVE", "POSITIVE_MAJORITY", "TIED_MAJORITY"]
    flip = Q.flip_orientation(spark.createDataFrame([(1.0, -2.0, 3.0, 4, 5, "positive")], "mean double, lower double, upper double, positive_groups int, negative_groups int, support string")).first()
    assert (flip.mean, flip.lower, flip.upper, flip.positive_groups, flip.support) == (-1.0, -3.0, 2.0, 5, "negative")


def test_printed_numbers(spark):
    a = spark.createDataFrame([(1, 0.123449), (2, 0.123449), (3, -1.25)], "k int, value double")
    b = spark.createDataFrame([(1, "0.1234"), (2, "0.124"), (3, "−1.25")], "k int, token string")
    assert rules(C.check_printed(a, b, ["k"])) == [("printed_number", "2")]
    cells = spark.createDataFrame([("mean 0.25 [-1.5, 2.0e-3]",)], "cell string")
    assert C.printed_numbers(cells, "cell").first().tokens == ["0.25", "-1.5", "2.0e-3"]


def test_constant_gain_areas_have_closed_form(spark):
    n, h, a = 60, 20, 0.3
    p = spark.range(n).select(
        F.lit(1).cast("long").alias("group_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("seed"), F.lit(0).alias("recording_id"),
        F.col("id").alias("time_index"), (0.5 + 0.3 * F.sin("id")).alias("fast"), F.lit(0.4).alias("slow"))
    roots = T.root_table(p, 5, h, 5, delta=0.05, seeds=2)
    ok = T.eligible_roots(roots)
    assert ok.count() == n - h + 1 - 5
    for chunk in (4096, 24):
        ctl = (T.ConstantGain("C0", a), T.Tracker("Full"))
        led = T.replay(T.clean_traces(p, ctl, n), ok, ctl, T.standard_branches(0.05, 5), h, 0.05, (0, 5), chunk=chunk)
        roots_seen = led.select("t0").distinct().count()
        assert roots_seen == n - h + 1 - 5
        areas = {r.construction: r.A for r in R.reduce_ledger(led.where("controller = 'C0'")).collect()}
        assert abs(areas["fixed_transient"] - (1 - (1 - a) ** h)) < 1e-9
        assert abs(areas["equal_sustained"] * 5 - areas["fixed_sustained"]) < 1e-9


def test_replay_equals_full_rerun(spark):
    """A replay from the clean state equals tracking the perturbed sequence from 0."""
    from panelseq.operators import updaters as U

    n = 50
    p = spark.range(n).select(
        F.lit(1).cast("long").alias("group_id"), F.lit(1).alias("seed"), F.lit(0).alias("recording_id"), F.col("id").alias("time_index"),
        (0.5 + 0.3 * F.sin("id")).alias("fast"), F.lit(0.4).alias("slow"))
    ctl = (T.Tracker("Full"), T.AdaptiveKalman("Kalman"))
    for t0 in (3, 17):
        root = spark.createDataFrame([(1, 0, t0)], "group_id long, recording_id int, t0 long")
        got = T.replay(T.clean_traces(p, ctl, n), root, ctl, (T.Branch("b", "sustained", 0.05, 5),), 20, emit="states").where("sign = 1").toPandas()
        moved = p.withColumn("fast", F.col("fast") + F.when(F.col("time_index").between(t0, t0 + 4), 0.05).otherwise(0.0))
        for name, run in (("Full", U.change_aware), ("Kalman", U.kalman_adaptive)):
            want = run(moved).where(F.col("time_index").between(t0, t0 + 19)).orderBy("time_index").toPandas().state.to_numpy()
            have = got[got.controller == name].sort_values("offset").state.to_numpy()
            assert abs(want - have).max() < 1e-12


def test_two_feature_models_against_plain_solve(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    df = pd.DataFrame({"group_id": np.repeat(np.arange(8), 30), "a": rng.normal(size=240), "b": rng.normal(size=240)})
    df["target"] = 1 + 2 * df.a - df.b + 0.1 * rng.normal(size=240)
    rows = spark.createDataFrame(df)
    coef = np.array(O.solve_ridge(O.group_gram(rows, ["a", "b"]), ["group_id"], ["a", "b"], 0.7).where("group_id = 3").first().coef)
    g = df[df.group_id == 3]
    x = np.column_stack([np.ones(30), g.a, g.b])
    want = np.linalg.solve(x.T @ x + np.diag([0, 0.7, 0.7]), x.T @ g.target)
    np.testing.assert_allclose(coef, want, atol=1e-9)
    folds = S.grouped_kfold(rows.select("group_id"), [5], 4)
    pred = O.oof_predict(rows, folds, ["a", "b"], 4, 2, 0.1)
    assert pred.count() == 240
    used = O.member_weights(folds, 4, 2).join(folds.select("group_id", F.col("fold").alias("own")), "group_id")
    assert used.where("fold = own").count() == 0


def test_grids(spark):
    assert S.gain_grid(spark).count() == 1001
    assert S.noise_grid(spark, [1e-4, 1e-3], [0.1]).count() == 2
    base = {"past_window": [5, 10], "innovation_scale": [0.08], "disagreement_scale": [0.08], "slope_scale": [0.025], "variance_scale": [0.01],
            "temperature": [0.75], "alpha_outlier": [0.04, 0.3], "alpha_stable": [0.2], "alpha_transition": [0.75]}
    assert S.tracker_grid(spark, base).count() == 2
    assert S.tracker_grid(spark, base, sample=1).count() == 1


def test_selection_lock_counts_outer_rows(spark):
    choices = spark.createDataFrame([(1, "a"), (2, "b")], "outer_group int, candidate string")
    dev = spark.createDataFrame([(1, 2), (1, 3), (2, 1), (2, 2)], "outer_group int, group_id int")
    got = {r.outer_group: r for r in O.selection_lock(choices, dev).collect()}
    assert (got[1].outer_rows_used, got[2].outer_rows_used) == (0, 1)
    assert got[1].lock_sha256 != got[2].lock_sha256 and len(got[1].lock_sha256) == 64
    again = O.selection_lock(choices, dev).where("outer_group = 1").first()
    assert again.lock_sha256 == got[1].lock_sha256
