"""Out-of-order streams, sinks and manifests."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelseq.operators import updaters as U
from panelseq.plans import contract_queries as CQ
from panelseq.sources import manifest as A
from panelseq.sources import panel_io as IO
from panelseq.streaming import updaters as ST


def test_late_and_early_rows(spark, tmp_path):
    rows = pd.DataFrame({"group_id": 1, "seed": 1, "recording_id": 0, "time_index": range(12), "fast": [0.1 * (i % 7) for i in range(12)], "slow": 0.2})
    schema = "group_id long, seed int, recording_id int, time_index long, fast double, slow double"
    order = [[0, 1, 5, 4], [3, 2, 2, 8], [7, 6, 9, 0], [11, 10]]
    for i, part in enumerate(order):
        spark.createDataFrame(rows.iloc[part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b{i}"))
    src = str(tmp_path / "in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/b*")
    out = str(tmp_path / "out")
    q = ST.stream_change_aware(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(out)
    assert got.where("event = 'state'").count() == 12 and got.where("event = 'late'").count() == 2
    assert got.agg(F.max("late_rows")).first()[0] == 2
    assert ST.check_prefix(got, U.change_aware(spark.createDataFrame(rows, schema))).count() == 0


def test_a_long_shuffled_key_loses_nothing(spark, tmp_path):
    schema = "group_id long, seed int, recording_id int, time_index long, fast double, slow double"
    rows = pd.DataFrame({"group_id": 1, "seed": 1, "recording_id": 0, "time_index": range(5000), "fast": [0.1 * (i % 7) for i in range(5000)], "slow": 0.2})
    mixed = rows.sample(frac=1, random_state=3)
    for i in range(3):
        spark.createDataFrame(mixed.iloc[i::3], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/b*")
    out = str(tmp_path / "out")
    ST.stream_update(stream, "ema", 0.3).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", out).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out)
    assert got.where("event = 'state'").count() == got.count() == 5000
    assert ST.check_prefix(got, U.ema(spark.createDataFrame(rows, schema), 0.3)).count() == 0


def test_stream_queries_refuse_lost_rows(spark, monkeypatch):
    whole = spark.range(300).selectExpr("1L AS group_id", "1 AS seed", "0 AS recording_id", "id AS time_index", "0.5D AS fast", "0.2D AS slow")
    run = lambda stream: ST.stream_update(stream, "ema", 0.3)
    monkeypatch.setattr(CQ.P, "event_panel", lambda *a: whole)
    assert CQ._streamed(spark, "", run).count() == 300
    for bad in (whole.where("time_index <> 150"), whole.union(whole.where("time_index = 7"))):
        monkeypatch.setattr(CQ.P, "event_panel", lambda *a, d=bad: d)
        with pytest.raises(ValueError, match="rows streamed"):
            CQ._streamed(spark, "", run)


def test_sinks_refuse_to_overwrite(spark, sf_dir, tmp_path):
    m = CQ.document_manifest(spark, sf_dir)
    A.save_manifest(m, str(tmp_path / "m"))
    with pytest.raises(Exception, match="(?i)exists"):
        A.save_manifest(m, str(tmp_path / "m"))
    IO.write_result(m.select("doc_id"), str(tmp_path / "r"), "csv")
    with pytest.raises(Exception, match="(?i)exists"):
        IO.write_result(m.select("doc_id"), str(tmp_path / "r"), "csv")


def test_scan_hashes_and_skips(spark, tmp_path):
    import hashlib

    (tmp_path / "a" / "session_03").mkdir(parents=True)
    (tmp_path / "cache").mkdir()
    (tmp_path / "a" / "session_03" / "x.csv").write_bytes(b"1,2\n")
    (tmp_path / "a" / "notes.txt").write_bytes(b"no")
    (tmp_path / "cache" / "y.csv").write_bytes(b"no")
    (tmp_path / "a" / ".#z.csv").write_bytes(b"no")
    d = A.resolve_recording(A.scan_manifest(spark, str(tmp_path))).collect()
    assert [(r.relative_path, r.recording_id, r.condition) for r in d] == [("a/session_03/x.csv", 3, "a")]
    assert d[0].sha256 == hashlib.sha256(b"1,2\n").hexdigest()


def test_physical_order_needs_the_full_set(spark):
    names = [f"cond/file_{chr(97 + i)}.mat" for i in range(23)]
    df = A.path_parts(spark.createDataFrame([(n,) for n in names], "file_path string"))
    got = A.resolve_recording(df, physical_order=True).orderBy("relative_path").collect()
    assert [r.recording_id for r in got] == list(range(23))
    less = A.resolve_recording(df.where("file_path < 'cond/file_w'"), physical_order=True)
    assert less.where("recording_id is not null").count() == 0


@pytest.mark.parametrize("kind", [*ST.KINDS, "tracker"])
def test_keys_of_a_bucket_are_stepped_together(spark, tmp_path, monkeypatch, kind):
    """Many keys of other lengths, rows in any order: one call a bucket and trigger, and the batch states."""
    monkeypatch.setattr(ST, "BUCKETS", 3)
    monkeypatch.setattr(ST, "GATHERED", 200)
    rng = [((i * 7919) % 1000) / 1000 for i in range(4000)]
    rows = [(g, 1, None if g == 5 else g % 2, t, rng[(31 * g + t) % 4000], rng[(17 * g + t) % 4000]) for g in range(40) for t in range(1 + 3 * g)]
    schema = "group_id long, seed int, recording_id int, time_index long, fast double, slow double"
    whole = spark.createDataFrame(rows, schema)
    whole.orderBy(F.xxhash64("group_id", "time_index")).repartition(3).write.parquet(str(tmp_path / "in" / "b0"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/b*")
    update, batch = {
        "constant_gain": (lambda s: ST.stream_update(s, kind, 0.2), lambda d: U.constant_gain(d, 0.2)),
        "ema": (lambda s: ST.stream_update(s, kind, 0.3), lambda d: U.ema(d, 0.3)),
        "kalman_fixed": (lambda s: ST.stream_update(s, kind, U.KalmanParams(q=0.001, r=0.01)), lambda d: U.kalman_fixed(d, 0.001, 0.01)),
        "kalman_adaptive": (lambda s: ST.stream_update(s, kind, U.KalmanParams()), U.kalman_adaptive),
        "tracker": (ST.stream_change_aware, U.change_aware),
    }[kind]
    q = update(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) == 3
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.where("event = 'state'").count() == got.count() == len(rows)
    assert got.where("recording_id is null").count() == 16
    known = whole.where("recording_id is not null")
    assert ST.check_prefix(got.where("recording_id is not null"), batch(known)).count() == 0


def test_slices_are_cut_by_sequences(spark, monkeypatch):
    whole = spark.range(3000).selectExpr("id % 100 AS group_id", "1 AS seed", "0 AS recording_id", "id div 100 AS time_index", "0.5D AS fast", "0.2D AS slow")
    monkeypatch.setattr(CQ.P, "event_panel", lambda *a: whole)
    monkeypatch.setattr(CQ, "SLICE_ROWS", 250)
    most, order = [], CQ._in_slice_order

    def look(spark, src):
        most.extend(r[0] for r in spark.read.parquet(src).groupBy(F.input_file_name()).count().select("count").collect())
        order(spark, src)

    monkeypatch.setattr(CQ, "_in_slice_order", look)
    assert CQ._streamed(spark, "", lambda stream: ST.stream_update(stream, "ema", 0.3)).count() == 3000
    assert sum(most) == 3000 and max(most) < 1500
