"""Registered corpus queries against their SQL twins, and the pipeline stage by stage."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelseq.llm import decontam, quality, simhash, suffix_dedup
from panelseq.llm.queries import ORACLES, QUERIES

TABLES = "documents embeddings pages benchmark labels conversations".split()


def table(df):
    df = df[sorted(df.columns)]
    return sorted((["" if pd.isna(x) else str(float(x)) if isinstance(x, int | float) else str(x) for x in r] for r in df.astype(object).values.tolist()))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, sf_dir, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf_dir).toPandas(), db.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and table(got) == table(want)


def test_all_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_digest_columns(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    got = {k: QUERIES[k](spark, sf_dir) for k in ("op2_suffix_dedup", "op6_simhash", "op8_byte_shards")}
    assert all(d.count() == n for d in got.values())
    assert got["op2_suffix_dedup"].columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert got["op6_simhash"].where("length(fingerprint) <> 16 or component_id > doc_id").count() == 0
    assert got["op8_byte_shards"].columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert got["op8_byte_shards"].schema["slot"].dataType.simpleString() == "bigint"


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("extra", F.lit(1)).cache()
    labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == list(corpus_pipeline.COLUMNS), name
        if name == "quality_filter":
            assert ids(out) == ids(quality.importance_resample(docs, labels).where("kept"))
        elif name == "near_dedup":
            assert ids(out) == ids(simhash.near_duplicates(docs).where("doc_id = component_id"))
        elif name == "decontamination":
            bad = {r.doc_id for r in decontam.contamination(docs, bench).collect()}
            assert bad and ids(out) == sorted(set(ids(docs)) - bad)
        else:
            left = {r.doc_id: r.n_bytes - r.n_removed for r in suffix_dedup.repeated_bytes(docs).collect()}
            for r in out.collect():
                assert 0 <= left[r.doc_id] - len(r.text.encode()) <= 6 * 50 and r.n_chars == len(r.text)


def test_run_equals_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_filter", "near_dedup", "repeat_removal", "decontamination", "piece_encoding"]
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.where("not round_trip").count() == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    texts = {r.doc_id: r.text for r in docs.collect()}
    from panelseq.llm.pieces import decode
    assert {r.doc_id: r.text for r in decode(got).collect()} == texts
