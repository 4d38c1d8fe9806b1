"""What larger tables showed: sizes that grow with the rows, runs of equal values."""

import numpy as np
import pyarrow as pa

from panelseq.llm import simhash as H
from panelseq.llm import suffix_dedup as S
from panelseq.operators import contracts as C
from panelseq.operators import features as X
from panelseq.operators import joins as J
from panelseq.operators import metrics as M
from panelseq.operators import oof as O
from panelseq.operators import updaters as U


def test_slices_are_not_broadcast(spark):
    rng = np.random.default_rng(3)
    rows = [(g, 0, t, float(g * 100 + t)) for g in range(3) for t in range(-25, 45) if rng.random() < 0.9 or g == 0]
    panel = spark.createDataFrame(rows + rows[:2], "group_id long, recording_id int, time_index long, value double")
    roots = panel.select("group_id", "recording_id", panel["time_index"].alias("t0")).where("t0 % 3 = 0")
    got = J.slice_roots(roots, panel, 20, ["group_id", "recording_id"])
    want = sorted((g, t, z, t - z, v) for g, _, z, _ in [r for r in rows + rows[:2] if r[2] % 3 == 0] for h, _, t, v in rows + rows[:2] if h == g and z <= t < z + 20)
    assert got.columns == ["group_id", "recording_id", "time_index", "t0", "offset", "value"]
    assert sorted((r["group_id"], r["time_index"], r["t0"], r["offset"], r["value"]) for r in got.collect()) == want
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_equal_values_correlate_without_an_error(spark):
    v = [0.5] * 40 + [0.1, 0.4, 0.2, 0.9, 0.3, 0.8]
    rows = spark.createDataFrame([(0, t, x, 0.25) for t, x in enumerate(v)], "k long, time_index long, v double, c double")
    got = [r["v_w10_autocorrelation"] for r in X.temporal_pattern(rows, "v", keys=["k"]).orderBy("time_index").collect()]
    assert got[:40] == [0.0] * 40
    assert abs(got[-1] - np.corrcoef(v[-10:-1], v[-9:])[0, 1]) < 1e-9
    pcc = M.error_metrics(rows, "c", ["k"], target="v").first()["pcc"]
    assert np.isnan(pcc)
    traj = rows.selectExpr("k group_id", "0 seed", "0 recording_id", "time_index", "v target", "c", "v")
    assert M.xcorr_lag(traj, "c", 2).first()["signed_lag"] is None
    assert M.xcorr_lag(traj, "v", 2).first()["signed_lag"] == 0


def test_near_copies_come_through_the_grid_join(spark, monkeypatch):
    made = H._sketch

    def blind(shingle):
        inner = made(shingle)

        def run(batches):
            for b in inner(batches):
                none = pa.array([[] for _ in range(b.num_rows)], pa.list_(pa.int64()))
                yield b.set_column(b.schema.get_field_index("keys"), "keys", none)

        return run

    monkeypatch.setattr(H, "_sketch", blind)
    rng = np.random.default_rng(5)
    rows = []
    for k in range(6):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 3000)]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join([*words[:-1], "changed"]))]
    rows += [(100, None), (101, ""), (102, "one word"), (103, "other word")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in H.near_duplicates(df).collect()}
    assert got == {i: i - i % 10 if i < 100 else {101: 100}.get(i, i) for i, _ in rows}


def test_hot_fragments_that_share_no_window_send_none(spark):
    rng = np.random.default_rng(9)
    letters = list("abcdefghijklmnopqrstuvwxyz ")
    line = "~~~~ common words ~~~~~~~~~"
    rows = [(k, "".join(rng.choice(letters, 40)) + line + "".join(rng.choice(letters, 40))) for k in range(30)]
    rows += [(100 + k, rows[k][1][20:80]) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    texts = df.selectExpr("doc_id doc", "0 dup", "text")
    found = S.Repeats(df, 2, 1000)
    every = {}
    for doc, text in rows:
        lo, *_ = S.anchors(*S.text_bytes(pa.array([text])))
        every[doc] = list(range(len(lo)))
    hot = spark.createDataFrame([(d, 0, k) for d, k in every.items()], "doc long, dup int, hot array<int>")
    assert {r.doc for r in found._meeting(texts, hot).collect()} == {0, 1, 2, 100, 101, 102}


def test_gain_grid_of_short_and_long_groups_and_its_selection(spark):
    rng = np.random.default_rng(4)
    rows = [(g, s, c, t, *rng.random(3).tolist()) for g in range(5) for s in (1, 2) for c in range(3) for t in range((6, 6, 6, 9, 30)[g] - c)]
    df = spark.createDataFrame(rows, "group_id long, seed int, recording_id int, time_index long, fast double, slow double, target double")
    gains = [0.1, 0.4, 0.7, 1.0]
    want = {}
    for g in range(5):
        per = []
        for s in (1, 2):
            errors = []
            for c in range(3):
                state = None
                for *_, fast, slow, y in [r for r in rows if r[:3] == (g, s, c)]:
                    state = np.clip(np.array(gains) * fast + (1 - np.array(gains)) * (slow if state is None else state), 0, 1)
                    errors.append((y - state) ** 2)
            per.append(np.sqrt(np.mean(errors, 0)))
        want[g] = np.mean(per, 0)
    for chunk in (8, 64):
        got = {r.group_id: r.rmse for r in M.gain_grid_rows(df, gains, 30, chunk=chunk).collect()}
        assert sorted(got) == list(range(5)) and all(np.allclose(got[g], want[g], atol=1e-12) for g in want)
    made = M.gain_grid_rows(df, gains, 30)
    slow = O.leave_out_selection(M.gain_grid_objective(df, gains, 30), spark.createDataFrame([(g, g) for g in range(5)], "outer_group long, group_id long"), "gain_index", "rmse")
    assert sorted(map(tuple, O.leave_group_out(made, "gain_index", "rmse").collect())) == sorted(map(tuple, slow.collect()))
    assert O.leave_group_out(made.union(made.limit(1)), "gain_index", "rmse").where("outer_rows_used > 0").count() > 0
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_candidates_of_a_recording_equal_their_states(spark):
    rng = np.random.default_rng(6)
    rows = [(g, s, c, t, float(rng.random()) if g else 0.5, float(rng.random())) for g in range(4) for s in (1, 2) for c in range(2) for t in range((12, 1, 25, 40)[g] + c)]
    df = spark.createDataFrame(rows, "group_id long, seed int, recording_id int, time_index long, fast double, target double").repartition(3)
    made = M.candidate_recordings(df, [0.3, 1.0], [(0.01, 0.1)], 3)
    got = {(r.place, r.group_id): r for r in M.recording_metrics(made, ["place"]).collect()}
    for place, gain in enumerate((0.3, 1.0, None)):
        states = U.ema(df, gain, length=60, keep=["target"]) if gain else U.kalman_fixed(df, 0.01, 0.1, length=60, keep=["target"])
        for want in M.subject_metrics(states, "state", 3).collect():
            have = got.pop((place, want.group_id))
            assert abs(have.rmse - want.rmse) < 1e-9 and have.absolute_lag == want.absolute_lag
            assert have.mafd == want.mafd or abs(have.mafd - want.mafd) < 1e-9
    assert not got and made._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 1


def test_roots_are_grouped_once(spark):
    kind = "group_id long, recording_id int, t0 long"
    seen = spark.createDataFrame([(1, 0, 7), (1, 0, 7), (1, 0, 2), (2, 0, 9)], kind)
    due = spark.createDataFrame([(1, 0, 7), (2, 0, 8), (2, 0, 8)], kind)
    made = C.validate_roots(seen, due, 5, 30)
    got = sorted((r.rule_id, r.key, r.detail) for r in made.collect())
    assert got == [("root_range", "1|0|2", "2"), ("root_set", "1|0|2", "extra"), ("root_set", "2|0|8", "missing"), ("root_set", "2|0|9", "extra"), ("unique_key", "1|0|7", "2")]
    assert C.validate_roots(seen, due, 5, 30)._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 1
