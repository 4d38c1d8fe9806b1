"""Rules that must not pass in silence: lengths, domains, partners, seeds, files, gaps and leaks."""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelseq.operators import claims as C
from panelseq.operators import oof as O
from panelseq.operators import perturb as R
from panelseq.operators import updaters as U
from panelseq.sources import manifest as A
from panelseq.streaming import updaters as ST

PANEL = "group_id long, seed int, recording_id int, time_index long, fast double, slow double"


def panel(spark, n, seeds=(1, 2, 3), groups=(1,)):
    rows = [(g, s, 0, t, 0.4 + 0.1 * ((t * 7 + s) % 5) / 5, 0.3) for g in groups for s in seeds for t in range(n)]
    return spark.createDataFrame(rows, PANEL)


@pytest.mark.parametrize(("q", "r", "p0"), [(0.0, 1e-6, 1.0), (0.0, 0.01, 1.0), (1e-12, 1.0, 1.0), (1e-4, 1e-2, 1.0), (1e-3, 0.01, 0.0), (0.0, 0.5, 0.0), (1e-30, 0.1, 2.0)])
def test_gains_equal_the_recursion_on_long_sequences(q, r, p0):
    wanted = [0, 1, 2, 10, 1000, 316_229, 999_999]
    got_k, got_v = U.gains_at(q, r, p0, 1e-12, np.array(wanted))
    p, at = p0, dict.fromkeys(wanted)
    for k in range(1_000_000):
        prior = max(1e-12, p + q)
        gain = prior / (prior + r)
        p = (1.0 - gain) * prior
        if k in at:
            at[k] = (gain, p)
    np.testing.assert_allclose(got_k, [at[k][0] for k in wanted], rtol=1e-6)
    np.testing.assert_allclose(got_v, [at[k][1] for k in wanted], rtol=1e-6, atol=1e-24)


def test_rows_beyond_the_stated_length_raise(spark):
    p = panel(spark, 60)
    for run in (lambda n: U.constant_gain(p, 0.2, length=n, chunk=20), lambda n: U.change_aware(p, length=n, chunk=20), lambda n: U.kalman_fixed(p, 0.1, 0.1, length=n, chunk=20)):
        assert run(60).count() == 180
        with pytest.raises(Exception, match="stated length"):
            run(20).collect()


def test_inputs_outside_the_domain_raise(spark):
    for bad in (1.5, -0.1, float("nan"), None):
        p = spark.createDataFrame([(1, 1, 0, 0, 0.5, 0.5), (1, 1, 0, 1, bad, 0.5)], PANEL)
        for run in (lambda d: U.constant_gain(d, 0.2), lambda d: U.change_aware(d)):
            with pytest.raises(Exception, match="outside"):
                run(p).collect()
    assert U.kalman_adaptive(spark.createDataFrame([(1, 1, 0, 0, -3.0, 0.5)], PANEL)).count() == 1


def test_repaired_chunks_equal_one_chunk(spark):
    p = panel(spark, 90)
    whole = U.change_aware(p, chunk=200).select("seed", "time_index", "state").toPandas().sort_values(["seed", "time_index"])
    parts = U.change_aware(p, chunk=25, warmup=1).select("seed", "time_index", "state").toPandas().sort_values(["seed", "time_index"])
    assert len(parts) == 270
    np.testing.assert_allclose(parts.state.to_numpy(), whole.state.to_numpy(), atol=1e-11)


def test_roots_of_two_seeds_and_missing_seeds(spark):
    two = R.root_table(panel(spark, 30, seeds=(1, 2)), 3, 5, 0)
    assert two.count() == 26 and two.where("eligible").count() == 26
    holed = panel(spark, 30).where("not (seed = 2 and time_index >= 20)")
    got = {r.t0: r for r in R.root_table(holed, 3, 5, 0).collect()}
    assert len(got) == 26 and got[10].eligible
    assert not got[25].eligible and [v.reason for v in got[25].violations] == [R.MISSING_SEED]
    nulls = panel(spark, 30).withColumn("fast", F.when((F.col("time_index") == 12) & (F.col("seed") == 1), None).otherwise(F.col("fast")))
    got = {r.t0: r.eligible for r in R.root_table(nulls, 3, 5, 0).collect()}
    assert sorted(t for t, ok in got.items() if not ok) == [10, 11, 12]


def test_groups_without_a_partner_raise(spark):
    a = spark.createDataFrame([("x", 1, 0.5), ("x", 2, -0.5)], "comparison_id string, group_id long, value double")
    b = a.where("group_id = 1")
    with pytest.raises(Exception, match="no partner"):
        C.transition_rows(a, b).collect()
    assert [(r.group_id, r.present_in) for r in C.unmatched_groups(a, b, ["comparison_id"]).collect()] == [(2, "first")]
    assert C.transition_rows(a, a).count() == 2
    c = a.withColumnRenamed("comparison_id", "component")
    with pytest.raises(Exception, match="no partner"):
        C.updater_difference(c.where("group_id = 2"), c).collect()


def test_ties_of_the_largest_group_go_to_the_first(spark):
    d = spark.createDataFrame([("c", "b", 1.0), ("c", "a", -1.0), ("c", "z", 0.5)], "claim_id string, group_id string, value double")
    assert C.heterogeneity(d).first().largest_group == "a"


def test_scan_reads_large_files_in_blocks_and_any_root(spark, tmp_path):
    (tmp_path / "s").mkdir()
    big, small = b"x" * 5000, b"ok"
    (tmp_path / "s" / "session_05.csv").write_bytes(big)
    (tmp_path / "s" / "session_31.csv").write_bytes(small)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 100)
    try:
        for root in (str(tmp_path), f"file://{tmp_path}", f"{tmp_path}/"):
            got = {r.relative_path: r for r in A.scan_manifest(spark, root).collect()}
            assert sorted(got) == ["s/session_05.csv", "s/session_31.csv"]
            assert got["s/session_05.csv"].sha256 == hashlib.sha256(big).hexdigest() and got["s/session_05.csv"].scan_status == "ok"
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    scan = A.scan_manifest(spark, str(tmp_path), hashed=False)
    assert {r.scan_status for r in scan.collect()} == {"dry_run"}
    ids = lambda **kw: sorted(r.recording_id for r in A.resolve_recording(scan, **kw).where("recording_id is not null").collect())
    assert ids() == [5] and ids(known=lambda c: c > 20) == [31] and ids(known=lambda c: c >= 0) == [5, 31]
    gone = A._hash_files([pa.RecordBatch.from_pydict({"file_path": [f"file:{tmp_path}/none.csv"]})])
    row = next(iter(gone)).to_pylist()[0]
    assert row["sha256"] is None and "none.csv" in row["error_message"]


def test_lost_and_late_rows_of_a_stream_come_out(spark, tmp_path):
    rows = [t for t in range(40) if t != 7] + [3]
    d = spark.createDataFrame([(1, 1, 0, t, 0.5, 0.2) for t in rows], PANEL)
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(PANEL).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    q = ST.stream_update(stream, "constant_gain", 0.2, max_waiting=10).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(out).toPandas()
    gap = got[got.event == "gap"]
    assert gap.time_index.tolist() == [7] and gap.missing_rows.tolist() == [1]
    assert got[got.event == "late"].time_index.tolist() == [3]
    assert sorted(got[got.event == "state"].time_index) == [t for t in range(40) if t != 7]


def test_prefix_check_sees_empty_and_holed_streams(spark):
    batch = spark.createDataFrame([(g, 1, 0, t, 0.1 * t) for g in (1, 2) for t in range(5)], "group_id long, seed int, recording_id int, time_index long, state double")
    tagged = batch.withColumn("event", F.lit("state"))
    assert ST.check_prefix(tagged.where("time_index < 3"), batch).count() == 0
    assert ST.check_prefix(tagged.limit(0), batch).count() == 2
    assert ST.check_prefix(tagged.where("not (group_id = 1 and time_index = 2)"), batch).count() == 1
    counts = {r.group_id: (r.streamed_rows, r.prefix_rows, r.equal_rows) for r in ST.prefix_counts(tagged.where("group_id = 1 and time_index <> 1"), batch).collect()}
    assert counts == {1: (4, 5, 4), 2: (0, 1, 0)}


def test_grams_of_many_columns(spark):
    rng = np.random.default_rng(0)
    names = [f"f{i}" for i in range(271)]
    x, y, g = rng.normal(size=(400, 271)), rng.normal(size=400), rng.integers(0, 3, 400)
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(group_id=g, target=y, time_index=np.arange(400) * 50)).repartition(4)
    got = {r.group_id: r for r in O.group_gram(df, names).collect()}
    upper = np.triu_indices(272)
    for k in range(3):
        z = np.concatenate([np.ones((int((g == k).sum()), 1)), x[g == k]], axis=1)
        np.testing.assert_allclose(got[k].gram, (z.T @ z)[upper], atol=1e-9)
        np.testing.assert_allclose(got[k].moment, z.T @ y[g == k], atol=1e-9)
    total = O.sum_arrays(O.group_gram(df, names).withColumn("w", F.lit(2.0)).withColumn("k", F.lit(0)), ["k"], ["gram", "moment"], "w").first()
    z = np.concatenate([np.ones((400, 1)), x], axis=1)
    np.testing.assert_allclose(total.gram, 2 * (z.T @ z)[upper], atol=1e-9)
    assert total.n == 3


def test_a_leak_turns_the_audit_red(spark):
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(g, c, float(x)) for g in range(5) for c, x in enumerate(rng.normal(size=4))], "group_id long, candidate long, score double")
    own = spark.createDataFrame([(g, g) for g in range(5)], "outer_group long, group_id long")
    good = O.leave_out_selection(v, own, "candidate", "score").toPandas().set_index("outer_group")
    assert (good.outer_rows_used == 0).all() and (good.development_rows == 16).all()
    table = v.toPandas()
    for g in range(5):
        rest = table[table.group_id != g].groupby("candidate").score.mean()
        assert good.candidate[g] == rest.idxmin()
    wrong = spark.createDataFrame([(0, 1), *[(g, g) for g in range(1, 4)]], "outer_group long, group_id long")
    bad = O.leave_out_selection(v, wrong, "candidate", "score").toPandas().set_index("outer_group")
    assert bad.outer_rows_used.to_dict() == {0: 4, 1: 0, 2: 0, 3: 0, 4: 4}
    assert O.lock(O.leave_out_selection(v, own, "candidate", "score")).select("lock_sha256").distinct().count() == 5
