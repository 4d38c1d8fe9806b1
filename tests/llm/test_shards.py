"""Byte shards: balance, order and checksums."""

import zlib

from panelseq.llm.shards import byte_shards, shard_of


def check(rows, got, shards):
    assert len(got) == len(rows)
    total, most = sum(r.size for r in got), max((r.size for r in got), default=0)
    per = {}
    for r in got:
        per.setdefault(r.shard, []).append(r)
    for s, own in per.items():
        assert 0 <= s < shards and sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / shards) <= most
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    ids = [r.doc_id for r in order if r.doc_id is not None]
    assert ids == sorted(ids)
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want


def test_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check(rows, byte_shards(docs, 40).collect(), 40)


def test_nulls_ties_clashes_and_empty(spark):
    rows = [(None, "a"), (None, None), (1, ""), (2, "x" * 5000), (2, "x" * 5000), (2, "é"), *((7, "same") for _ in range(300)), *((k, "t" * (k % 50)) for k in range(10, 200))]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, size int, shard int, part int").repartition(5)
    for shards in (1, 3, 40):
        check(rows, byte_shards(df, shards).collect(), shards)
    assert byte_shards(df.limit(0), 4).count() == 0
    assert len(byte_shards(df.limit(1), 40).collect()) == 1


def test_cuts_of_large_totals_are_exact(spark):
    big = 1 << 62
    rows = [(29_999_999_700, 30_000_000_000), (1_499_999_984, 1_500_000_000), (499_999_984, 500_000_000), (0, 7), (749_999_999, 30_000_000_000),
            (750_000_000, 30_000_000_000), (big - 1, big), (big // 40 * 39, big)]
    got = spark.createDataFrame(rows, "start long, total long").select("start", "total", shard_of("start", "total", 40).alias("shard")).collect()
    assert [r.shard for r in got] == [s * 40 // t for s, t in rows]


def test_rows_just_before_a_cut_stay(spark):
    over = 30_000_000_000
    rows = spark.createDataFrame([(1, ""), (2, "x"), (3, ""), (4, "x")], "doc_id long, text string")
    for n, shards in ((2, 2), (4, 4)):
        got = {r.doc_id: (r.shard, r.slot) for r in byte_shards(rows.where(f"doc_id <= {n}"), shards, over).collect()}
        total = n * over + n // 2
        starts = [0, over, 2 * over + 1, 3 * over + 1][:n]
        assert [got[k + 1][0] for k in range(n)] == [s * shards // total for s in starts]
