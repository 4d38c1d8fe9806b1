"""Adapters: the given tables read as panels of sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelseq import GROUP, RECORDING, SEED, TIME
from panelseq.operators.blocks import dense_index, trailing

# Fixed values of the events adapter.
SEED_CURVES = ((42, 40.0), (123, 50.0), (2026, 60.0))
SPLIT_DAY = "2024-01-16"
SUSTAINED = 5
HORIZON = 20
T0_MIN = 5
DELTA = 0.05


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as (group_id, recording_id, time_index, value)."""
    ev = table(spark, sf_dir, "events").select(
        F.col("user_id").alias(GROUP),
        F.when(F.col("ts") < F.lit(SPLIT_DAY).cast("timestamp"), 0).otherwise(1).alias(RECORDING),
        "ts", "event_id", "value",
    )
    ranked = dense_index(ev, [GROUP, RECORDING], F.date_trunc("minute", "ts"), ["ts", "event_id"])
    return ranked.select(GROUP, RECORDING, TIME, "value")


def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel with fast, slow and target; one copy of each sequence per seed."""
    seq = event_sequences(spark, sf_dir)

    def build(rows):
        made = {"target": F.avg(F.col("value") / (F.col("value") + 50.0)).over(rows(-4, 0))}
        for seed, c in SEED_CURVES:
            made[f"_slow_{seed}"] = F.avg(F.col("value") / (F.col("value") + c)).over(rows(-9, 0))
        return made

    wide = trailing(seq, [GROUP, RECORDING], build, before=9)
    per_seed = F.inline(F.array(*[
        F.struct(
            F.lit(seed).alias(SEED),
            (F.col("value") / (F.col("value") + c)).alias("fast"),
            F.col(f"_slow_{seed}").alias("slow"),
        )
        for seed, c in SEED_CURVES
    ]))
    return wide.select(GROUP, RECORDING, TIME, "target", per_seed).select(
        GROUP, SEED, RECORDING, TIME, "fast", "slow", "target"
    )


def order_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders per customer by date: (group_id, recording_id, time_index, fast)."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias(GROUP), F.lit(0).alias(RECORDING), "o_orderdate", "o_orderkey", "o_totalprice"
    )
    ranked = dense_index(o, [GROUP, RECORDING], F.date_trunc("month", "o_orderdate"), ["o_orderdate", "o_orderkey"])
    return ranked.select(
        GROUP, RECORDING, TIME, (F.col("o_totalprice") / (F.col("o_totalprice") + 100000.0)).alias("fast")
    )


def spatial_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as one row per time step with the 64 values as an array."""
    e = table(spark, sf_dir, "embeddings").select(
        F.col("label").alias(RECORDING), "vec_id", F.col("embedding").cast("array<double>").alias("values")
    )
    ranked = dense_index(e, [RECORDING], F.expr("vec_id div 1000"), ["vec_id"])
    return ranked.select(RECORDING, TIME, "values")


def spatial_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long layout: 16 channels x 4 bands per time step."""
    return spatial_rows(spark, sf_dir).select(
        RECORDING, TIME, F.posexplode("values").alias("pos", "value")
    ).select(
        RECORDING, TIME, F.expr("pos div 4").cast("int").alias("channel"), (F.col("pos") % 4).alias("band"), "value"
    )


def group_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents per source: mean length of English and of other texts."""
    d = table(spark, sf_dir, "documents").select("source", "lang", F.col("n_chars").cast("double").alias("n"))
    return d.groupBy(F.col("source").alias(GROUP)).agg(
        F.avg(F.when(F.col("lang") == "en", F.log1p("n"))).alias("a"),
        F.avg(F.when(F.col("lang") != "en", F.log1p("n"))).alias("b"),
    ).where("a is not null and b is not null")


def event_length(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the longest event sequence: one aggregate over two columns."""
    ev = table(spark, sf_dir, "events").select(
        "user_id", (F.col("ts") < F.lit(SPLIT_DAY).cast("timestamp")).alias("_early"))
    top = ev.groupBy("user_id", "_early").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return int(top or 0)
