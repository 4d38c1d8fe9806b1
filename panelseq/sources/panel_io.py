"""Readers and writers of panels, ledgers and results, and table assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelseq import GROUP, RECORDING, SEED, SEQUENCE, TIME
from panelseq.sources.manifest import nan_to_null

PANEL_SCHEMA = (
    f"{GROUP} long, {SEED} int, {RECORDING} int, {TIME} long, fast double, slow double, target double")
LEDGER_SCHEMA = (
    f"{GROUP} long, {RECORDING} int, t0 long, {SEED} int, sign int, controller string, shape string, construction string, A double, B_late double")


def read_panel(spark: SparkSession, path: str, cols: Sequence[str] | None = None, fmt: str = "csv", schema: str = PANEL_SCHEMA) -> DataFrame:
    """Declared schema, only the wanted columns, NaN as null."""
    reader = spark.read.schema(schema)
    df = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    return nan_to_null(df.select(*cols) if cols else df)


def read_ledger(spark: SparkSession, path: str, schema: str = LEDGER_SCHEMA) -> DataFrame:
    return nan_to_null(spark.read.schema(schema).json(path))


def read_folds(spark: SparkSession, paths: str | Sequence[str], schema: str, fmt: str = "parquet", pattern: str | None = None, fold: str = "outer_group") -> tuple[DataFrame, DataFrame]:
    """Many per-fold files as one table, and the rows whose file name disagrees.

    ``pattern`` has one group with the fold id, matched on the file path.
    """
    reader = spark.read.schema(schema)
    df = (reader.option("header", True).csv(paths) if fmt == "csv" else reader.format(fmt).load(paths)).withColumn("_file", F.col("_metadata.file_path"))
    if pattern is None:
        return df.drop("_file"), df.drop("_file").limit(0)
    named = F.regexp_extract("_file", pattern, 1)
    wrong = df.where(~named.eqNullSafe(F.col(fold).cast("string"))).select(fold, F.col("_file").alias("file"))
    return df.drop("_file"), wrong.distinct()


def write_result(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), overwrite: bool = False) -> None:
    """Result tables; CSV prints doubles in their shortest exact form."""
    w = df.write.mode("overwrite" if overwrite else "errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path)


def write_bucketed(df: DataFrame, table: str, buckets: int, keys: Sequence[str] = SEQUENCE) -> None:
    """Panel as a bucketed table, so later joins on ``keys`` need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys, TIME).saveAsTable(table)


def build_trajectories(panel: DataFrame, methods: dict, lock: DataFrame | None = None, length: int | None = None) -> DataFrame:
    """One row per time step with target, proxies and every method's state.

    ``methods`` maps a column name to a function (panel, length, keep) -> panel
    with ``state``; they run one after the other and keep earlier columns, so no
    join is needed. ``lock`` adds the lock hash per group.
    """
    from panelseq.operators.blocks import longest

    length = longest(panel) if length is None else length
    base = [c for c in panel.columns if c not in (*SEQUENCE, TIME)]
    out, kept = panel, list(base)
    for name, run in methods.items():
        out = run(out, length, kept).withColumnRenamed("state", name)
        kept.append(name)
        out = out.select(*SEQUENCE, TIME, *kept)
    if lock is not None:
        out = out.join(lock.select(GROUP, "lock_sha256"), GROUP, "left")
    return out


def assemble_recordings(first: DataFrame, second: DataFrame, label: DataFrame, ids: Sequence[int] | None = None, key: str = RECORDING) -> DataFrame:
    """Label and two feature views as aligned rows; absent rows stay visible as nulls."""
    if ids is not None:
        first, second, label = (d.where(F.col(key).isin(*ids)) for d in (first, second, label))
    keys = [key, TIME]
    return first.join(second, keys, "full").join(label, keys, "full")
