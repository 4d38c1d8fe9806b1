"""Fingerprints of parameter rows and of whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprint(df: DataFrame, cols: Sequence[str], name: str = "fingerprint") -> DataFrame:
    """sha256 of the row's canonical JSON: the given columns in name order."""
    return df.withColumn(name, F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256))


def table_fingerprint(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: row count and an order-free sum of row hashes."""
    h = F.xxhash64(*sorted(cols)).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h).alias("hash_sum"))
