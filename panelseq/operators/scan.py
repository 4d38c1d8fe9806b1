"""Ordered scans: ranks and running values of orders of any length, with no task that holds a whole order.

Rows are dealt by ranges of their order and written once. A range is scanned on its own; what earlier
ranges of the same key add is scanned over one row a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelseq.session import cut

#: Name of a running value: the aggregate of a range, and how it joins what stands before.
RUNNING = {
    "max": (F.max, lambda own, before: F.greatest(own, before)),
    "min": (F.min, lambda own, before: F.least(own, before)),
    "sum": (F.sum, lambda own, before: F.coalesce(own + before, own, before)),
}
EARLIER = (Window.unboundedPreceding, -1)


def ranged(df: DataFrame, by: Sequence[str], order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """``df`` with ``_range``, the number of its range in the order of ``by`` and ``order`` (ascending, nulls first).

    A key of any share of the rows is spread over many ranges. Rows of equal ``by`` and ``order`` share a
    range, so ``order`` should tell rows apart. The ranges are sampled, so they are written once and read from there.
    Without ``ranges`` their number follows the bytes, up to the shuffle partitions.
    """
    return cut(df.repartitionByRange(*([ranges] if ranges else []), *by, *order).withColumn("_range", F.spark_partition_id()))


def _inside(by: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(*by, "_range").orderBy(*order)


def _with_ranges(df: DataFrame, parts: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Columns ``names`` of ``parts``, one row for each key and range, beside the rows of ``df``; null keys meet each other."""
    keys = [*by, "_range"]
    side = parts.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], *names)
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    return df.join(side, same).drop(*[f"_key{i}" for i in range(len(keys))])


def ranks(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "rank", total: str = "total") -> DataFrame:
    """Add the 1-based rank within ``by`` and the rows of ``by``; ``df`` comes from ``ranged`` with the same arguments."""
    by = list(by)
    parts = df.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    key = Window.partitionBy(*by)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(key.orderBy("_range").rowsBetween(*EARLIER)), F.lit(0))).withColumn(total, F.sum("_n").over(key))
    placed = _with_ranges(df.withColumn("_pos", F.row_number().over(_inside(by, order))), parts, by, ["_before", total])
    return placed.withColumn(name, F.col("_pos") + F.col("_before")).drop("_pos", "_before")


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, kind: str = "max", name: str = "running") -> DataFrame:
    """Add the running ``kind`` of ``value`` up to and with each row; nulls are passed over, and no value yet gives null.

    ``order`` is that of ``ranged`` or the rank in it, which also tells apart rows that are equal in all of it.
    """
    by = list(by)
    whole, both = RUNNING[kind]
    rows = df.withColumn("_value", value)
    parts = rows.groupBy(*by, "_range").agg(whole("_value").alias("_part"))
    parts = parts.withColumn("_earlier", whole("_part").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(*EARLIER)))
    own = whole("_value").over(_inside(by, order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = _with_ranges(rows.withColumn("_own", own), parts, by, ["_earlier"])
    return placed.withColumn(name, both(F.col("_own"), F.col("_earlier"))).drop("_value", "_own", "_earlier")
